"""Uses of terms, vocabulary by scope, layered streams and convergence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import converge, layers, recycle, usage
from textloom.operators import terms as terms_module

USES = [
    ("memory", "The memory holds it.", ["memory"]),
    ("Content Memory", "the CONTENT memory and the content Memory", ["CONTENT memory", "content Memory"]),
    ("content memory", "the content  memory, the content\nmemory, the content\tmemory", ["content  memory", "content\nmemory", "content\tmemory"]),
    ("content memory", "contentmemory is one word", []),
    ("AI", "again and again", []),
    ("term", "terminology is not a term", ["term"]),
    ("memory", "(memory), memory. memory!", ["memory"] * 3),
    ("v1", "v1 and v12", ["v1"]),
    ("id", "id and block_id", ["id"]),
    ("e.g.", "see e.g. the guide", ["e.g."]),
    ("語語", "語語語語", ["語語", "語語"]),
    ("aa", "aaaa", []),
    ("用語", "これは日本語の用語です。", ["用語"]),
    ("café", "café and cafés", ["café"]),
    ("   ", "anything", []),
    ("memory", "", []),
    ("memory", None, []),
    ("widget", "nothing of the sort", []),
    ("(a) b", "x (A)  b (a) c", ["(A)  b"]),
    ("a a", "a a a a a", ["a a", "a a"]),
]


def test_uses_of_terms(spark):
    blocks = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(USES)], "id int, text string")
    terms = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(USES)], "term_id int, term string")
    found = {}
    for r in usage.occurrences(blocks, terms, "id", "text").orderBy("start").collect():
        text = USES[r["id"]][1]
        assert text[r["start"] : r["end"]] == r["found"]
        if r["id"] == r["term_id"]:
            found.setdefault(r["id"], []).append(r["found"])
    assert [found.get(i, []) for i in range(len(USES))] == [wanted for *_, wanted in USES]


def test_longest_of_overlapping_uses(spark):
    blocks = spark.createDataFrame([(1, "the content memory recycles memory")], "id int, text string")
    terms = spark.createDataFrame([(1, "memory"), (2, "content memory"), (3, "memory recycles")], "term_id int, term string")
    uses = usage.occurrences(blocks, terms, "id", "text")
    assert sorted((r["term_id"], r["start"]) for r in uses.collect()) == [(1, 12), (1, 28), (2, 4), (3, 12)]
    assert sorted((r["term_id"], r["found"]) for r in usage.longest_uses(uses, "id").collect()) == [(1, "memory"), (2, "content memory")]


def test_vocabulary_by_scope(spark):
    rules = spark.createDataFrame(
        [
            ("1", "p", "base", "", "forbidden", "Cheap", "good value", None),
            ("2", "p", "base", "", "competitor", "Acme", None, None),
            ("3", "p", "locale", "pt-BR", "preferred", "ola", None, None),
            ("4", "p", "locale", "pt", "preferred", "oi", None, None),
            ("5", "p", "persona", "ceo", "forbidden", "guys", None, "neutral"),
            ("6", "p", "persona", "ceo", "preferred", " cheap ", None, None),
            ("7", "p", "persona", "ceo", "preferred", "guys", None, None),
            ("8", "p", "persona", "ceo", "preferred", "team", None, None),
            ("9", "p", "locale", "pt-BR", "forbidden", "ignored", None, None),
            ("10", "q", "base", "", "forbidden", "other", None, None),
        ],
        "rule_id string, profile string, layer string, layer_key string, kind string, term string, replacement string, severity string",
    )
    scopes = spark.createDataFrame([("a", "p", "pt_br", "web", "ceo"), ("b", "p", None, None, ""), ("c", "none", "pt", None, None)], "scope_id string, profile string, locale string, channel string, persona string")
    resolved = usage.resolved_rules(rules, scopes)
    found = {}
    for r in resolved.collect():
        found.setdefault(r["scope_id"], {})[r["rule_id"]] = r["severity"]
    assert found == {"a": {"1": "major", "2": "critical", "3": None, "5": "neutral", "8": None}, "b": {"1": "major", "2": "critical"}}
    texts = spark.createDataFrame([(1, "Guys, ACME is cheap", "a"), (2, "Guys, ACME is cheap", "b"), (3, "cheap", "c"), (4, None, "a")], "id int, text string, scope_id string")
    hits = usage.vocabulary_findings(texts, resolved, "id", "text").collect()
    assert sorted((r["id"], r["kind"], r["severity"], r["start"], r["found"]) for r in hits) == [
        (1, "competitor", "critical", 6, "ACME"),
        (1, "forbidden", "major", 14, "cheap"),
        (1, "forbidden", "neutral", 0, "Guys"),
        (2, "competitor", "critical", 6, "ACME"),
        (2, "forbidden", "major", 14, "cheap"),
    ]


def test_streams_see_their_ancestors(spark):
    streams = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "a")], "stream string, parent string")
    chain = layers.ancestors(streams)
    assert {(r["stream"], r["ancestor"]): r["distance"] for r in chain.filter("stream in ('e', 'x')").collect()} == {
        ("e", "e"): 0, ("e", "d"): 1, ("e", "c"): 2, ("e", "b"): 3, ("e", "a"): 4, ("x", "x"): 0, ("x", "a"): 1}
    entries = spark.createDataFrame(
        [("a", "k1", False, "A1"), ("a", "k2", False, "A2"), ("a", "k3", False, "A3"), ("c", "k1", False, "C1"), ("d", "k2", True, None), ("e", "k3", None, "E3")],
        "stream string, k string, deleted boolean, text string",
    )
    seen = layers.resolved_entries(entries, chain, ["k"])
    found = {}
    for r in seen.collect():
        found.setdefault(r["stream"], {})[r["k"]] = (r["text"], r["layer"])
    assert found["e"] == {"k1": ("C1", "c"), "k3": ("E3", "e")} and found["x"] == {"k1": ("A1", "a"), "k2": ("A2", "a"), "k3": ("A3", "a")}
    page = layers.searched_page(seen.filter("stream = 'x'"), F.col("text").contains("A"), [F.col("k").desc()], 1, 1).collect()
    assert [(r["k"], r["place"], r["total"]) for r in page] == [("k2", 2, 3)]
    for loop in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a")]):
        with pytest.raises(ValueError):
            layers.ancestors(spark.createDataFrame(loop, "stream string, parent string"), most=8)


EVENT = "run_id string, seq long, type string, pass int, locale string, units long, done long, via_memory long, via_ai long, state string, failing_checks int, files int, pending array<string>"


def run_events(run, end):
    def event(seq, kind, **values):
        row = {"pass": 1, "units": 0, "done": 0, "via_memory": 0, "via_ai": 0, "failing_checks": 0, "files": 0, "state": "", "locale": None, "pending": None, **values}
        return (run, seq, kind, *[row[c.split()[0]] for c in EVENT.split(", ")[3:]])

    return [
        event(1, "pass_start"),
        event(2, "locale_start", locale="de", units=4),
        event(3, "locale_start", locale="fr", units=2),
        event(4, "unit_progress", locale="de", done=1, via_memory=1),
        event(5, "locale_done", locale="fr", done=2, via_ai=2),
        event(6, "locale_done", locale="de", done=3, via_memory=1, via_ai=2),
        event(7, "locale_done", locale="it", done=0, state="shippable"),
        event(8, "pass_done", pending=["de"], failing_checks=3),
        event(9, "materialized", files=5),
        event(10, "done", state=end),
    ]


def test_standing_of_runs(spark, tmp_path):
    rows = run_events("r1", "parked") + run_events("r2", "converged") + [("r3", 1, "log", *[None] * 10)]
    found = {(r["run_id"], r["locale"]): r for r in converge.standing(spark.createDataFrame(rows[::-1], EVENT)).collect()}
    assert {k: r["state"] for k, r in found.items()} == {
        ("r1", "de"): "parked", ("r1", "fr"): "shippable", ("r1", "it"): "shippable",
        ("r2", "de"): "pending", ("r2", "fr"): "shippable", ("r2", "it"): "shippable", ("r3", None): None}
    de = found["r1", "de"]
    assert (de["passes"], de["failing_checks"], de["materialized"], de["run_state"], de["done"]) == (1, 3, 5, "parked", True)
    assert (de["units"], de["produced"], de["via_memory"], de["via_ai"]) == (4, 3, 1, 2)
    # The same as a stream in two batches.
    for k, part in enumerate((rows[:5] + rows[10:13], rows[5:10] + rows[13:])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    query = converge.standing_stream(stream).writeStream.outputMode("update").format("memory").queryName("standing").option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    streamed = {}
    for r in spark.sql("select * from standing").collect():
        key = (r["run_id"], r["locale"])
        if key not in streamed or r["done"] or not streamed[key]["done"]:
            streamed[key] = r
    assert {k: tuple(r) for k, r in streamed.items() if k[0] != "r3"} == {k: tuple(r) for k, r in found.items() if k[0] != "r3"}


def test_passes_stop_without_progress(spark):
    work = spark.createDataFrame([(k, "de" if k < 6 else "fr") for k in range(8)], "id int, locale string")
    asked = []

    def produce(pending, number):
        asked.append(sorted(r["id"] for r in pending.collect()))
        return pending.filter((F.col("id") < 2 * number) & (F.col("id") != 3)).unionByName(work.limit(1)).select("id", F.lit(number).alias("n"))

    made, passes = converge.converge(work, produce, ["id"])
    assert passes == 5 and [len(x) for x in asked] == [8, 6, 5, 3, 1]
    assert {r["id"]: r["n"] for r in made.collect()} == {0: 1, 1: 1, 2: 2, 4: 3, 5: 3, 6: 4, 7: 4}
    states = {r["locale"]: (r["units"], r["produced"], r["state"]) for r in converge.locale_standing(work, made, ["id"], "locale").collect()}
    assert states == {"de": (6, 5, "parked"), "fr": (2, 2, "shippable")}
    assert converge.converge(work.limit(0), produce, ["id"])[1] == 0
    assert converge.converge(work, produce, ["id"], most_passes=2)[1] == 2


def test_three_keys_and_recycling(spark):
    keys = "generalized_key string, structural_key string, plain_key string, entities map<string,string>, project string"
    queries = spark.createDataFrame(
        [(1, "Buy {N} now", "Buy 5 now", "Buy 5 now", {"n": "5"}, "p"), (2, "completely different", "{1}abcdefghij{/1}", "abcdefghij", None, "p"), (3, "zzz", "zzz", "zzz", None, None), (4, "done", "done", "done", None, None)],
        f"query_id int, {keys}",
    )
    entries = spark.createDataFrame(
        [
            (10, "Kaufe 7 jetzt 7", "Buy {N} now", "Buy 7 now", "Buy 7 now", {"n": "7"}, "p"),
            (11, "other", "something else entirely", "nothing like it at all", "abcdefghix", None, "p"),
            (12, "third", "completely differen", "no key of this kind", "nor of this kind", None, "q"),
            (13, "erledigt", "done", "done", "done", None, None),
            (14, "fertig", "done", "done", "done", None, None),
        ],
        f"entry_id int, target string, {keys}",
    )
    found = {(r["query_id"], r["entry_id"]): r for r in recycle.full_lookup(queries, entries, 0.7).collect()}
    assert set(found) == {(1, 10), (2, 11), (2, 12), (4, 13), (4, 14)}
    assert (found[1, 10]["tier"], found[1, 10]["score"], found[1, 10]["adapted"]) == (0, 1.0, "Kaufe 5 jetzt 7")
    assert (found[2, 11]["tier"], round(found[2, 11]["score"], 4)) == (5, 0.93)  # 0.9 and the same project
    assert (found[2, 12]["tier"], round(found[2, 12]["score"], 4)) == (3, 0.95)
    assert found[4, 13]["ambiguous"] and found[4, 13]["score"] == 0.99
    blocks = spark.createDataFrame([(1, "Buy 5 now", None), (2, "x", ""), (3, "zzz", None), (4, "done", "schon da")], "query_id int, source_text string, target_text string")
    filled = {r["query_id"]: (r["memory_state"], r["memory_score"], r["target_text"]) for r in recycle.recycle(blocks, recycle.full_lookup(queries, entries, 0.7, 1)).collect()}
    assert filled == {1: ("filled", 100, "Kaufe 5 jetzt 7"), 2: ("offered", 95, ""), 3: ("none", None, None), 4: ("kept", 99, "schon da")}
    coded = blocks.withColumn("source_text", F.concat("source_text", F.lit('<x id="1/"/>')))
    assert recycle.recycle(coded, recycle.full_lookup(queries, entries, 0.7, 1)).filter("query_id = 1").first()["memory_state"] == "offered"
    assert {r["query_id"] for r in recycle.full_lookup(queries, entries, 1.0).collect()} == {1}


@pytest.mark.parametrize("few", [10_000, 2])
def test_terms_meet_in_the_tasks_or_by_a_shuffle(spark, monkeypatch, few):
    """The same uses either way; few terms move no token and no text but the hits."""
    monkeypatch.setattr(terms_module, "FEW", few)
    monkeypatch.setattr(usage, "FEW", few)
    texts = ["The end of  the world", "of the of the", "", None, "Überall über der Tür the", "off the other"]
    blocks = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    given = spark.createDataFrame([("a", "the"), ("b", "of the"), ("c", "über"), ("d", "...")], "term_id string, term string")
    found = usage.occurrences(blocks, given, "id", "text")
    assert {(r["id"], r["term_id"], r["start"]) for r in found.collect()} == {
        (0, "a", 0), (0, "a", 12), (0, "b", 8), (1, "a", 3), (1, "a", 10), (1, "b", 0), (1, "b", 7), (4, "a", 21), (4, "c", 8), (5, "a", 4),
    }
    hits = terms_module.term_hits(blocks, given, "id", "text")
    assert {tuple(r) for r in hits.collect()} == {(0, "a", 2), (0, "b", 1), (1, "a", 2), (1, "b", 2), (4, "a", 1), (4, "c", 1), (5, "a", 1)}
    for frame in (found, hits):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (few > 2)
