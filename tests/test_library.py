"""Expressions, operators, readers, flows and streams on small rows."""

import datetime as dt
import gzip  # noqa: F401
import io
import struct
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__
from textloom.functions import identity, runs, text
from textloom.operators import checks, diff, govern, graph, history, layout, memory, segmentation, stats, terms
from textloom.plans import flow, tools  # noqa: F401
from textloom.sources import lexers, tables
from textloom.streaming import feeds


def one(spark, column, **values):
    row = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("content", "words"),
    [("Hello world", 2), ("  leading spaces  ", 2), ("", 0), ("multiple   spaces   between", 3), ("one\ue001two three", 3), ("wor\ue000d", 2), ("a\xa0b", 2)],
)
def test_count_words(spark, content, words):
    assert one(spark, text.count_words(F.col("t")), t=content) == words


@pytest.mark.parametrize(("length", "least", "window"), [(13, 0.8, (10, 17)), (13, 0.5, (6, 26)), (10, 1.0, (10, 10)), (0, 0.8, (0, 0)), (13, 0, (0, 2**31 - 1)), (13, 1.5, (0, 2**31 - 1))])
def test_length_window(spark, length, least, window):
    low, high = text.length_window(F.lit(length), least)
    assert (one(spark, low), one(spark, high)) == window


def test_text_functions(spark):
    assert one(spark, text.edit_ratio(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, text.similarity_percent(F.lit("kitten"), F.lit("sitting"))) == 57
    assert one(spark, text.trim_space(F.lit("\u2003 a b\xa0"))) == "a b"
    assert one(spark, text.placeholders(F.lit("{{a}} ${b} %(c)s %1$s %s {d} </1>"))) == ["{{a}}", "${b}", "%(c)s", "%1$s", "%s", "{d}", "</1>"]
    assert one(spark, text.pseudo(F.lit("Save {name}"), expand=0)) == "[Šåžé {name}]" or one(spark, text.pseudo(F.lit("Save {name}"))).count("{name}") == 1
    assert one(spark, text.correct_space(F.lit("a\u200b  b "), source=F.lit(" x\n"))) == " a b\n"
    assert one(spark, text.search_replace(F.lit("a.b A.B"), [("a.b", "$1")], ignore_case=True)) == "$1 $1"
    assert one(spark, text.timecode_ms(F.lit("01:02:03,004"))) == 3723004
    assert one(spark, text.timecode_ms(F.lit("02:03.004"))) == 123004
    assert one(spark, text.format_timecode(F.lit(3723004).cast("long"))) == "01:02:03,004"
    assert one(spark, text.has_doubled_word(F.lit("is is it"))) and not one(spark, text.has_doubled_word(F.lit("is it")))
    for said, doubled in {"The the fox": True, "pass1 pass1": True, "проверка проверка": True, "▒ ▒ x ▒ ▒": False, "a — — b": False, "a … … b": False}.items():
        assert one(spark, text.has_doubled_word(F.lit(said))) is doubled
    assert not one(spark, text.has_doubled_word(F.lit("Vous vous souvenez"), ("sie", "vous"))) and one(spark, text.has_doubled_word(F.lit("nous nous"), ("vous",)))
    assert one(spark, text.variant_key(F.lit("de"), F.lit("formal"), F.lit(""))) == "de;tone=formal"


def test_context_hash_ignores_advisory_keys(spark):
    def hashed(values):
        return one(spark, identity.context_hash(F.lit("n"), F.lit("t"), F.create_map(*[F.lit(x) for p in values.items() for x in p])))

    assert hashed({"b": "2", "a": "1"}) == hashed({"a": "1", "@note": "x", "b": "2"}) != hashed({"a": "1", "b": "3"})


def run_row(kind, **fields):
    names = ["kind", "text", "id", "type", "subtype", "data", "equiv", "disp", "forms"]
    return tuple({"kind": kind, **fields}.get(n) for n in names)


def test_run_keys(spark):
    content = [
        run_row("text", text="Hi "), run_row("ph", id="1", type="entity:person", equiv="name", data="Ann"), run_row("pcOpen", id="2"),
        run_row("text", text="x"), run_row("pcClose", id="2"), run_row("sub", id="3", equiv="s"), run_row("plural", forms={"one": "1 f", "other": "n f"}),
    ]
    df = spark.createDataFrame([(content,)], f"r {runs.RUNS}")
    out = df.select(runs.plain_key("r"), runs.structural_key("r"), runs.generalized_key("r"), runs.plain_text("r"), runs.entity_values("r")).first() if False else df.select(
        runs.plain_key(F.col("r")), runs.structural_key(F.col("r")), runs.generalized_key(F.col("r")), runs.plain_text(F.col("r")), runs.entity_values(F.col("r"))
    ).first()
    assert tuple(out) == ("Hi {name}x[s]n f", "Hi {1/}{2}x{/2}[3]n f", "Hi {PERSON}{2}x{/2}[3]n f", "Hi x", {"1": "Ann"})
    delta = runs.multiset_minus(F.array(*[F.lit(x) for x in "aab"]), F.array(*[F.lit(x) for x in "abc"]))
    assert [tuple(e) for e in one(spark, delta)] == [("a", 1)]


def test_term_pattern(spark):
    cases = [("app", "The App.", 1), ("app", "apps", 0), ("log in", "Log\n in now", 1), ("c++", "c++, C++", 2), ("北京", "去北京市", 1), ("a_b", "xa_b", 0), ("ring", "ring ring", 2)]
    for term, content, n in cases:
        blocks = spark.createDataFrame([(1, content)], "id long, t string")
        found = terms.term_matches(blocks, spark.createDataFrame([("x", term)], "term_id string, term string"), "id", "t").collect()
        assert sum(r["hits"] for r in found) == n, (term, content)


def test_validity(spark):
    at = dt.datetime(2024, 5, 1)
    cases = [(None, None, None, True), (at, None, None, True), (None, at, None, False), (None, None, {"m": "de"}, True), (None, None, {"m": "fr"}, False), (None, None, {"q": "1"}, False)]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, f timestamp, t timestamp, g map<string,string>")
    held = df.select("k", terms.is_valid(F.lit(at), F.col("f"), F.col("t"), F.col("g"), {"m": "de"}).alias("h")).orderBy("k").collect()
    assert [r["h"] for r in held] == [c[3] for c in cases]


def test_exact_and_ambiguous_matches(spark):
    schema = "query_id long, generalized_key string, structural_key string, plain_key string"
    queries = spark.createDataFrame([(1, "Install", "Install", "Install"), (2, "Save", "Save", "Save")], schema)
    entries = spark.createDataFrame(
        [(1, "**Install**", "{1}Install{/1}", "Install", "Installieren"), (2, "Save", "Save", "Save", "Sichern"), (3, "Save", "Save", "Save", "Speichern")],
        "entry_id long, generalized_key string, structural_key string, plain_key string, target string",
    )
    found = memory.settle_ambiguous(memory.exact_matches(queries, entries)).orderBy("query_id", "entry_id").collect()
    assert [(r["query_id"], r["entry_id"], r["score"], r["ambiguous"]) for r in found] == [(1, 1, 0.99, False), (2, 2, 0.99, True), (2, 3, 0.99, True)]
    best = memory.tiered_lookup(queries, entries, 0.7, 1).orderBy("query_id").collect()
    assert [(r["query_id"], r["entry_id"]) for r in best] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_fuzzy_finds_every_pair(spark, least):
    words = ["installation", "installations", "instal", "reinstallation", "The file was saved", "The file was not saved", "saved file", "", "a", "ab", "installed", "stall"]
    queries = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "query_id long, plain_key string")
    entries = spark.createDataFrame([(k, w, w) for k, w in enumerate(words)], "entry_id long, plain_key string, target string")
    found = {(r["query_id"], r["entry_id"]) for r in memory.fuzzy_matches(queries, entries, least).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    expected = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if not (a or b) or 1 - distance(a, b) / max(len(a), len(b)) >= least - 1e-12}
    assert found == expected


def test_point_distance(spark):
    for other, expected in (("p\x1fc\x1fk", 0), ("p\x1fc\x1fz", 1), ("p\x1fz\x1fk", 2), ("z\x1fc\x1fk", 3)):
        assert one(spark, memory.point_distance(F.lit("p\x1fc\x1fk"), F.lit(other))) == expected
    stored, wanted = F.create_map(F.lit("1"), F.lit("Ann")), F.create_map(F.lit("1"), F.lit("Bob"))
    assert one(spark, memory.adapt(F.lit("Hallo Ann, Ann"), stored, wanted)) == "Hallo Bob, Ann"


def test_reconcile_claims_in_order(spark):
    before = [("a", h) for h in "1234"] + [("b", h) for h in "5678"] + [("gone", "9")]
    now = [("m", h) for h in "1235"] + [("n", h) for h in "1234"] + [("b", h) for h in "5670"] + [("z", "y")]
    found = diff.reconcile(spark.createDataFrame(now, "p string, h string"), spark.createDataFrame(before, "p string, h string"), "p", "h").collect()
    assert {tuple(r) for r in found} == {("b", "edited", "b"), ("m", "moved", "a"), ("n", "new", None), ("z", "new", None)}


def test_merge_spans_and_batches(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 2, 5), (1, 7, 9), (1, 8, 8), (2, 0, 1)], "k int, start int, end int")
    assert {tuple(r) for r in diff.merge_spans(spans, ["k"]).collect()} == {(1, 0, 5), (1, 7, 9), (2, 0, 1)}
    blocks = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 5, 20, 1, 1, 1])], "k int, seq int, tokens int")
    out = diff.pack_blocks(blocks, ["k"], "seq", "tokens", 10, 2).orderBy("seq").collect()
    assert [r["batch"] for r in out] == [0, 0, 1, 2, 2, 3]


def test_histories(spark):
    rows = [("u", 1, "a", dt.datetime(2024, 1, 1)), ("u", 2, "b", dt.datetime(2024, 1, 5)), ("v", 3, "c", dt.datetime(2024, 1, 6))]
    log = spark.createDataFrame(rows, "k string, id long, v string, at timestamp")
    assert [r["v"] for r in history.as_of(log, ["k"], "at", "id", F.lit(dt.datetime(2024, 1, 4))).collect()] == ["a"]
    before = {r["k"]: r["v"] for r in history.before_batch(log, ["k"], "id", F.col("id") >= 2).collect()}
    assert before == {"u": "a", "v": None}
    page = history.changes(log.withColumnRenamed("id", "seq"), 0, 2).collect()
    assert len(page) == 2 and all(r["has_more"] and r["next_cursor"] == 2 for r in page)


def test_scores_and_gates(spark):
    found = spark.createDataFrame([(1, "critical"), (1, "minor"), (2, "neutral"), (3, "unknown")], "b int, severity string")
    assert {r["b"]: r["score"] for r in checks.scores(found, ["b"]).collect()} == {1: 74, 2: 100, 3: 100}
    counts = spark.createDataFrame([(200, 101, 0)], "a long, b long, c long")
    assert [(r["percent"], r["lost"]) for r in govern.funnel(counts, ["a", "b", "c"]).orderBy("ordinal").collect()] == [(100, 0), (51, 99), (0, 101)]
    texts = spark.createDataFrame([("paste", "x", "abcdef"), ("url", "a", "ghij"), ("repo", "r", "klm")], "kind string, label string, text string")
    kept = govern.corpus_budget(texts, {"paste": 0, "url": 1, "file": 2, "repo": 3}, 60).orderBy("label").collect()
    assert [(r["label"], r["text"]) for r in kept] == [("a", "gh"), ("x", "abcdef")]
    single = stats.describe(spark.createDataFrame([(3.0,)], "v double"), F.col("v")).first()
    assert single["stddev"] == 0 and single["median"] == 3


def test_segments_and_redaction(spark):
    cases = {"One. Two! Three?": 3, "": 0, "Mr. Smith went. He left.": 2, "No end": 1, "a\nb c": 2, "Sehr gut. ": 1}
    df = spark.createDataFrame([(t, "en") for t in cases], "t string, l string")
    for r in segmentation.segment(df, "t", "l").collect():
        assert len(r["segments"]) == cases[r["t"]], r["t"]
        assert all(r["t"][s["start"] : s["end"]] == s["text"] for s in r["segments"])
    blocks = spark.createDataFrame([(1, "Ask ann@x.org or 12345 12345"), (2, "nothing"), (3, None)], "id long, t string")
    hidden, vault = segmentation.redact(blocks, [("mail", r"\S+@\S+"), ("n", r"\d+")], "id", "t")
    assert {r["id"]: r["t"] for r in hidden.collect()}[1] == "Ask [MAIL-1] or [N-2] [N-3]"
    back = segmentation.unredact(hidden, vault, "id", "t")
    assert sorted((r["id"], r["t"]) for r in back.filter("t is not null").collect()) == [(1, "Ask ann@x.org or 12345 12345"), (2, "nothing")]


def test_shortest_paths(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("a", "c", "x"), ("c", "d", "x"), ("d", "a", "x")], "source_id string, target_id string, label string")
    start = spark.createDataFrame([("a",)], "node string")
    found = {r["node"]: (r["hops"], r["path"]) for r in graph.shortest_paths(edges, start, 5).collect()}
    assert found == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (1, ["a", "c"]), "d": (2, ["a", "c", "d"])}


def rows_of(kind, content):
    return [(b, t) for b, t, _ in lexers.PARSERS[kind](content)]


def test_parsers():
    assert rows_of("json", '{"a": {"b": ["x", 1, {"c": "y"}]}}') == [("a.b[0]", "x"), ("a.b[2].c", "y")]
    assert rows_of("properties", "# c\nkey = va\\\n  lue\nk2:\\u00e9 x\n k3  v=1") == [("key", "value"), ("k2", "é x"), ("k3", "v=1")]
    assert rows_of("apple_strings", '/* c */ "a" = "x \\"y\\"";\n"b"="z";') == [("a", 'x "y"'), ("b", "z")]
    assert list(lexers.po('msgid ""\nmsgstr "h"\n\nmsgctxt "m"\nmsgid "a"\n"b"\nmsgstr "c\\n"\n')) == [("m\x04ab", "ab", "c\n")]
    assert rows_of("yaml", "a:\n  b: 'it''s'\n  c: |\n    x\n    y\nl:\n  - one\n  - k: two # c\n") == [("a.b", "it's"), ("a.c", "x\ny"), ("l", "one"), ("l.k", "two")]
    assert rows_of("markdown", "---\nt: 1\n---\n# Head\n\nPara one\ntwo\n\n- item\n\n```\ncode\n```\n> quote") == [("md0", "Head"), ("md1", "Para one two"), ("md2", "item"), ("md3", "quote")]
    assert [t for _, t in rows_of("html", "<title>T</title><script>no</script><p>a <b>b</b>&amp;<br>c<p><img alt='pic'>d")] == ["T", "a b& c", "pic", "d"]
    assert rows_of("message_format", "{n, plural, one {# file} other {{n} files}}") == [("n.plural.one", "# file"), ("n.plural.other", "{n} files")]
    assert rows_of("message_format", "Hello {name}") == [("message", "Hello {name}")]
    assert rows_of("arb", '{"a": "x", "@a": {"description": "d"}}') == [("a", "x")]
    original, translated = b"id", "übersetzt".encode()
    head = struct.pack("<7I", 0x950412DE, 0, 1, 28, 36, 0, 0) + struct.pack("<4I", len(original), 44, len(translated), 47)
    assert list(lexers.mo(head + original + b"\0" + translated + b"\0")) == [("id", "id", "übersetzt")]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/x.json", '{"k": "v"}')
        z.writestr("word/document.xml", "<d><p><r>Hello </r><r>there</r></p></d>")
    assert list(lexers.archive(held.getvalue()))[0] == ("a/x.json!k", "v", None)
    assert rows_of("office", held.getvalue()) == [("word/document.xml#0", "Hello there")]
    assert lexers.detect("x.tokens.json") == "design_tokens" and lexers.detect("noext", b"<html>") == "html" and lexers.detect("x", b"abc") is None


def test_bad_files_are_reported(spark):
    files = spark.createDataFrame([("a", "{bad"), ("b", '{"k": "v"}'), ("c", None)], "path string, content string")
    found = {(r["path"], r["text"]) for r in lexers.parse_blocks(files, "json").collect()}
    assert found == {("a", None), ("b", "v")}


def test_table_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('key,en,note\nk1,"Hello, you",\nk2,Bye,n\n')
    cells = tables.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert {(r["block_id"], r["text"]) for r in cells} == {("k1/en", "Hello, you"), ("k2/en", "Bye"), ("k2/note", "n")}
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><resources><string name="a">A &amp; b</string><string name="n" translatable="false">x</string></resources>')
    assert [(r["block_id"], r["text"]) for r in tables.read_android(spark, str(tmp_path / "s.xml")).collect()] == [("a", "A & b")]
    (tmp_path / "t.tmx").write_text('<tmx><body><tu><tuv xml:lang="en"><seg>Hi</seg></tuv><tuv xml:lang="de"><seg>Hallo</seg></tuv></tu></body></tmx>')
    assert {(r["locale"], r["text"]) for r in tables.read_tmx(spark, str(tmp_path / "t.tmx")).collect()} == {("en", "Hi"), ("de", "Hallo")}
    (tmp_path / "c.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n")
    cues = tables.read_subtitles(spark, str(tmp_path / "c.srt"))
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in cues.orderBy("seq").collect()] == [(1000, 2500, "Hello\nthere"), (3000, 4000, "Bye")]
    assert tables.subtitle_lines(cues).first()["content"] == (tmp_path / "c.srt").read_text()
    (tmp_path / "p.txt").write_text("one\ntwo\n\n\nthree\n")
    assert [r["text"].strip() for r in tables.read_plain(spark, str(tmp_path / "p.txt")).orderBy("seq").collect()] == ["one\ntwo", "three"]


def test_flow_checks(spark):
    with pytest.raises(ValueError, match="needs"):
        flow.check_columns({"x"}, ["word-count"])
    with pytest.raises(Exception):
        flow.order({"a": {"b"}, "b": {"a"}})
    assert flow.order({"c": {"b"}, "b": {"a"}}) == ["a", "b", "c"]
    assert flow.passes(["word-count"], ["de", "fr"]) == [[]]
    assert flow.passes(["word-count", "create-target"], ["de", "fr"]) == [["de"], ["fr"]]
    df = spark.createDataFrame([("b1", " Hi  all ", "", True), ("b2", "x", "weird", False)], "block_id string, source_text string, source_status string, translatable boolean")
    out = flow.run(df, [("whitespace-correct", {}), ("case-transform", {}), ("create-target", {}), ("source-gate", {"required": "authored"})]).orderBy("block_id").collect()
    assert [(r["source_text"], r["target_text"], r["held"]) for r in out] == [("HI ALL", "HI ALL", False), ("x", "x", False)]


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams_match_batches(spark, tmp_path):
    events = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, k % 24), "ab"[k % 2], 1.0) for k in range(60)], "id long, ts timestamp, event_type string, value double")
    for k in range(3):
        events.filter(F.col("id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    schema = "id long, ts timestamp, event_type string, value double"
    stream = feeds.event_stream(spark, str(tmp_path / "in"), schema)
    counts = feeds.windowed_counts(stream, "ts", "event_type", "6 hours")
    drain(counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).start())
    batch = feeds.windowed_counts(events, "ts", "event_type", "6 hours")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    blocks = stream.select(F.col("event_type").alias("content_hash"), F.col("id").cast("string").alias("block_id"))
    drain(feeds.repetition_stream(blocks).writeStream.outputMode("append").format("memory").queryName("rep").option("checkpointLocation", str(tmp_path / "c2")).start())
    for kind in "ab":
        assert sorted(r["index"] for r in spark.table("rep").filter(F.col("content_hash") == kind).collect()) == list(range(1, 31))


def test_deadlines_notify_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [[(1, at, at + dt.timedelta(hours=30))], [(1, at + dt.timedelta(hours=10), at + dt.timedelta(hours=30))], [(1, at + dt.timedelta(hours=12), at + dt.timedelta(hours=30))]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "task_id long, at timestamp, due timestamp").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = feeds.event_stream(spark, str(tmp_path / "in"), "task_id long, at timestamp, due timestamp", 3)
    drain(feeds.deadline_notices(stream).writeStream.outputMode("append").format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "c")).start())
    assert [(r["task_id"], r["at"]) for r in spark.table("due").collect()] == [(1, at + dt.timedelta(hours=10))]


def test_quiet_hours(spark):
    def held(hour, start, end):
        return one(spark, feeds.quiet(F.lit(dt.datetime(2024, 1, 1, hour)), F.lit("UTC"), F.lit(start), F.lit(end)))

    assert held(23, "22:00", "06:00") and held(5, "22:00", "06:00") and not held(7, "22:00", "06:00") and held(7, "07:00", "08:00") and not held(7, "", "")


def test_registry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_udfs(spark):
    from textloom.functions import udfs

    df = spark.createDataFrame([("é  x\n", "straße ǆ"), (None, None), ("<b>a</b> {n} %s ${x}", "x")], "t string, u string")
    out = df.select(udfs.normalise("t").alias("n"), udfs.title_each("u").alias("c"), udfs.protect_tags("t").alias("p"), udfs.xml_error("t").alias("e"), udfs.tags("t").alias("g")).collect()
    assert [r["n"] for r in out] == ["é x", None, "<b>a</b> {n} %s ${x}"]
    assert [r["c"] for r in out] == ["STRAßE ǅ", None, "X"]
    assert out[2]["p"]["tags"][:3] == ["<b>", "</b>", "{n}"] and out[2]["p"]["text"].startswith("{1}a{2} {3} {4} ")
    assert out[2]["e"] is None and out[2]["g"][0]["start"] == 0
    bad = spark.createDataFrame([("a < b",), ("<a></b>",), (" ",)], "t string").select(udfs.xml_error("t").alias("e")).collect()
    assert [r["e"] is None for r in bad] == [False, False, True]
    back = df.withColumn("p", udfs.protect_tags("t")).select("t", udfs.restore_tags("p.text", "p.tags").alias("b")).filter("t is not null").collect()
    assert all(r["t"] == r["b"] for r in back)


def test_layout(spark):
    from textloom.operators import layout

    frames = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 7), (1, 3, 6), (2, 0, 7), (2, 1, -1)], "video_id long, frame long, hash long")
    kept = {(r["video_id"], r["frame"]) for r in layout.keep_frames(frames, 2).collect()}
    assert kept == {(1, 0), (1, 2), (2, 0), (2, 1)}
    formats = spark.createDataFrame([("html",), ("html@2",), ("po@1",)], "name string")
    assert {r["name"] for r in layout.newest_formats(formats).collect()} == {"html", "po@1"}


def test_whole_tables_are_read(spark):
    queries, folder = __spark_entry__.queries(), "/root/testdata/sf0.01"
    docs = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    moves = {int(r["path"].split("/")[1]) for r in queries["document_moves"](spark, folder).select("path").collect()}
    assert moves <= {int(i) for i in docs} and max(moves) >= 900
    assert queries["memory_tiered"](spark, folder).agg(F.max("query_id")).first()[0] >= 1200


def test_rules_of_status_and_hygiene(spark):
    pairs = spark.createDataFrame([("forbidden", "preferred"), ("admitted", "proposed"), ("preferred", "preferred"), ("gone", "preferred"), (None, "preferred")], "a string, b string")
    assert [r[0] for r in pairs.select(terms.may_change(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]
    texts = {"": ["empty"], " \n\t": ["empty"], " a": ["leading-whitespace"], "a\n": [], "a\r\n": [], "a\n\n": ["trailing-whitespace"], "a ": ["trailing-whitespace"], "a  b": ["double-spaces"], "The the cat": ["doubled-word"], "a\u0007b": ["control-char"], "fine": []}
    rows = spark.createDataFrame([(t, t) for t in texts], "k string, t string")
    found = {}
    for r in checks.lint(rows, ["k"], "t").collect():
        found.setdefault(r["k"], []).append(r["category"])
        assert r["severity"] == ("major" if r["category"] == "empty" else "minor")
    assert {k: sorted(v) for k, v in texts.items() if v} == {k: sorted(v) for k, v in found.items()}
    assert one(spark, text.placeholders(F.lit("{n, number} {} %v %% ${a}"))) == ["{n, number}", "%v", "%%", "${a}"]


def test_governance_figures(spark):
    days = spark.createDataFrame([(g, k, s, 1) for g, k, s in [("a", 1, 90.0), ("a", 2, 70.0), ("b", 1, 50.0), ("c", 1, 90.04), ("c", 2, 80.0)]] + [("d", 1, 1.0, 0)], "g string, day int, score double, n int")
    out = {r["g"]: (r["recent"], r["baseline"], r["drop"], r["drifted"]) for r in govern.drift(days, ["g"], "day", "score", "n", recent=1).collect()}
    assert out == {"a": (70.0, 90.0, 20.0, True), "b": (50.0, 50.0, 0.0, False), "c": (80.0, 90.0, 10.0, True), "d": (0.0, 0.0, 0.0, False)}
    low = {r["g"]: r["drifted"] for r in govern.drift(days, ["g"], "day", "score", "n", recent=1, floor=60).collect()}
    assert low == {"a": False, "b": True, "c": False, "d": False}
    counts = spark.createDataFrame([(100, 40, 60, 30, 90)], "a long, b long, c long, d long, t long")
    steps = govern.funnel(counts, [("a", "blocks"), ("b", "blocks"), ("c", "blocks"), ("d", "targets")], {"blocks": "a", "targets": "t"})
    assert [(r["percent"], r["lost"]) for r in steps.orderBy("ordinal").collect()] == [(100, 0), (40, 60), (60, 0), (33, 0)]
    schema = "k int, category string, severity string, replacement string"
    before = spark.createDataFrame([(1, "x", "major", ""), (2, "x", "minor", "")], schema)
    after = spark.createDataFrame([(1, "x", "major", ""), (1, "y", "critical", "z"), (3, "y", "minor", None)], schema)
    blocks = spark.createDataFrame([(k, "g") for k in range(1, 5)], "k int, by string")
    r = govern.blast_radius(blocks, before, after, "k", "by").first()
    assert (r["blocks"], r["affected"], r["prescribed"], r["improved"], r["degraded"]) == (4, 3, 1, 1, 2)
    assert (r["new_violations"], r["resolved_violations"], r["critical"], r["mean_delta"]) == (2, 1, 1, (-25 + 1 - 1) / 3)
    docs = spark.createDataFrame([(1, "aXb")], "k int, t string")
    assert [tuple(r) for r in govern.pattern_findings(docs, [("bad", "(", "minor"), ("x", "X|$", "")], "k", "t").collect()] == [(1, "x", "major", 1)]
    assert [r["rule"] for r in govern.unmet_patterns(docs, [("bad", "("), ("y", "Y")], "k", "t").collect()] == ["y"]


def test_edits_gates_and_order(spark):
    blocks = spark.createDataFrame([("1", "one", True), ("2", "two", True), ("3", "three", True), ("4", "four", False), ("5", "five", True)], "block_id string, source_text string, translatable boolean")
    h = {r["source_text"]: r["h"] for r in blocks.select("source_text", identity.content_hash(F.col("source_text")).alias("h")).collect()}
    edits = spark.createDataFrame([("1", "stale", "one"), ("2", "stale", "2"), ("x", h["three"], "3"), ("4", "", "4")], "block_id string, expected_hash string, new_text string")
    out = {r["block_id"]: (r["source_text"], r["edit_state"]) for r in flow.run(blocks, [("apply-edits", {"edits": edits})]).collect()}
    assert out == {"1": ("one", "skipped"), "2": ("two", "stale"), "3": ("3", "applied"), "4": ("four", "none"), "5": ("five", "none")}
    gated = spark.createDataFrame([("1", "a", "", True), ("2", " ", "approved", True), ("3", "a", "approved", True), ("4", "", "odd", False)], "block_id string, source_text string, source_status string, translatable boolean")
    out = {r["block_id"]: (r["source_status"], r["held"]) for r in flow.run(gated, [("source-gate", {})]).collect()}
    assert out == {"1": ("checked", False), "2": ("authored", True), "3": ("approved", False), "4": ("odd", False)}
    found = spark.createDataFrame([("1", "minor"), ("1", "critical"), ("3", "minor"), ("4", "critical")], "block_id string, severity string")
    out = {r["block_id"]: (r["source_status"], r["held"]) for r in flow.run(gated, [("source-gate", {"findings": found})]).collect()}
    assert out == {"1": ("authored", True), "2": ("authored", True), "3": ("approved", False), "4": ("odd", False)}
    out = {r["block_id"]: r["source_status"] for r in flow.run(gated, [("source-check", {"findings": found, "block_severity": "minor"})]).collect()}
    assert out == {"1": "authored", "2": "approved", "3": "authored", "4": "odd"}
    with pytest.raises(ValueError):
        flow.run(gated, [("source-check", {"block_severity": "severe"})])
    regions = spark.createDataFrame([(1, "b", 0.0, 50.0), (1, "c", 100.0, 0.0), (1, "a", 10.0, 0.0), (1, "d", 130.0, 5.0), (1, "e", 160.0, 1.0)], "page int, region_id string, x double, y double").withColumn("w", F.lit(80.0)).withColumn("h", F.lit(20.0))
    order = layout.reading_order(regions).orderBy("ordinal").collect()
    assert [(r["region_id"], r["ordinal"]) for r in order] == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]
    unknown = feeds.quiet(F.lit(dt.datetime(2024, 1, 1, 23)), F.lit("Nowhere/Land"), F.lit("22:00"), F.lit("06:00"))
    assert one(spark, unknown) is False


def test_key_columns(spark):
    assert [tables.is_key_header(n) for n in ("ID", "message key", "product_id", "Ref", "name", "token", "paid", "x.uuid")] == [True, True, True, True, False, False, False, True]
    rows = spark.createDataFrame([("1", "a", "x"), ("1", "b", "y")], "id string, `my code` string, name string")
    assert tables.key_column(rows) == "my code" and tables.key_column(rows.select("name")) is None
