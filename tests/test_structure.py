"""Scans, trees, tables, edits over runs and message placeholders, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import edits, icu, runs
from textloom.operators import checks, scans, srx, tree
from textloom.plans import tools

EVENT = "doc_id string, seq long, kind string, node_id string, type string, role string, level int, col_span int, row_span int, text string, properties map<string,string>"


def test_scans_over_parts(spark):
    chance = random.Random(1)
    rows = [(chance.choice(["a", "b", None]), i, chance.choice([1, -1, -1, 0]), chance.choice([None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq long, step int, v long")
    found = scans.running_sums(df, ["k"], ["seq"], {"total": F.col("step")}, part=4)
    found = scans.running_depth(found, ["k"], ["seq"], F.col("step"), "depth", part=4)
    found = {r["seq"]: r for r in scans.carried(found, ["k"], ["seq"], F.col("v"), "last", part=4).collect()}
    assert len(found) == 60
    total, depth, last = {}, {}, {}
    for k, seq, step, v in rows:
        total[k] = total.get(k, 0) + step
        depth[k] = max(depth.get(k, 0) + step, 0)
        assert (found[seq]["total"], found[seq]["depth"], found[seq]["last"]) == (total[k], depth[k], last.get(k))
        last[k] = last.get(k) if v is None else v


def random_events(chance, doc, size):
    """A stream with some closings too many, bare cells and properly nested layers."""
    events, layers, since = [], 0, 0
    for seq in range(size):
        kind = chance.choice(["group_start"] * 3 + ["group_end"] * 3 + ["block"] * 8 + ["data"])
        type_ = None
        if kind == "group_start":
            type_ = chance.choice(["table", "table-row", "ordered-list", "section"])
            since += 1
        elif kind == "group_end":
            if layers and not since:
                continue
            since -= 1
        elif kind == "block":
            type_ = chance.choice(["paragraph", "table-cell", "table-cell", "table-header"])
        properties = {}
        if chance.random() < 0.3:
            properties["row"] = chance.choice(["r1", "r2"])
        if chance.random() < 0.1:
            properties["vmerge"] = "continue"
        events.append((doc, seq * 2, kind, f"n{seq}", type_, None, None, None, None, f"t{seq}", properties))
        if chance.random() < 0.05 and not layers:
            events.append((doc, seq * 2 + 1, "layer_start", "l", "layer", None, None, None, None, None, {}))
            layers, since = 1, 0
        elif layers and since == 0 and chance.random() < 0.3:
            events.append((doc, seq * 2 + 1, "layer_end", "l", "layer", None, None, None, None, None, {}))
            layers = 0
    return events


def tree_by_stack(events):
    """(seq, part) -> (role, depth, parent) by walking the stream."""
    found, stack, cells = {}, [], []

    def container():
        groups = [f for f in stack if f[0] != "layer"]
        return (groups[-1][1], 2) if groups else None, len(groups) + 1

    def flush():
        if not cells:
            return
        parent, depth = cells[0][2], cells[0][3]
        table = (cells[0][0], 0)
        found[table] = ("table", depth, parent)
        row, last = None, ""
        for seq, role, _, _, hint in cells:
            if row is None or (hint is not None and hint != last):
                row, last = (seq, 1), hint or ""
                found[row] = ("table-row", depth + 1, table)
            found[seq, 2] = (role, depth + 2, row)
        cells.clear()

    for _, seq, kind, _, type_, *_, properties in events:
        if kind == "layer_start":
            stack.append(("layer", seq))
        elif kind == "layer_end":
            flush()
            if stack and stack[-1][0] == "layer":
                stack.pop()
        elif kind == "group_start":
            flush()
            parent, depth = container()
            found[seq, 2] = ("list" if type_ == "ordered-list" else type_, depth, parent)
            stack.append((type_, seq))
        elif kind == "group_end":
            flush()
            if stack and stack[-1][0] != "layer":
                stack.pop()
        elif kind == "block" and properties.get("vmerge") != "continue":
            parent, depth = container()
            if type_.startswith("table-") and not (stack and stack[-1][0] == "table-row"):
                cells.append((seq, type_, parent, depth, properties.get("row")))
            else:
                flush()
                found[seq, 2] = (type_, depth, parent)
    flush()
    return found


@pytest.mark.parametrize("layers", [False, True])
def test_tree_is_that_of_a_stack(spark, layers):
    chance = random.Random(2)
    streams = {f"d{k}": random_events(chance, f"d{k}", chance.randint(0, 60)) for k in range(12)}
    if not layers:
        streams = {d: [e for e in events if not e[2].startswith("layer")] for d, events in streams.items()}
    df = spark.createDataFrame([e for events in streams.values() for e in events], EVENT)
    found = {}
    for r in tree.project_stream(df, part=7).collect():
        parent = None if r["parent_seq"] is None else (r["parent_seq"], r["parent_part"])
        found.setdefault(r["doc_id"], {})[r["seq"], r["part"]] = (r["role"], r["depth"], parent)
    for doc, events in streams.items():
        assert found.get(doc, {}) == tree_by_stack(events)


def test_tables(spark):
    def event(seq, kind, type_=None, text=None, **properties):
        return ("d", seq, kind, f"n{seq}", type_, None, None, None, None, text, properties)

    stream = [
        event(0, "block", "paragraph", "before"),
        event(1, "group_start", "table"),
        event(2, "block", "caption", "title"),
        event(3, "group_start", "table-row", header="true"),
        event(4, "block", "table-cell", "a"),
        event(5, "block", "table-cell", "b", vmerge="continue"),
        event(6, "group_end"),
        event(7, "group_start", "table-row"),
        event(8, "block", "table-header", "c"),
        event(9, "block", "table-cell", "d"),
        event(10, "group_end"),
        event(11, "group_start", "table-row"),
        event(12, "block", "table-cell", "e"),
        event(13, "group_end"),
        event(14, "group_end"),
    ]
    found = tree.assemble_tables(spark.createDataFrame(stream, EVENT), part=3).orderBy("seq").collect()
    cells = [(r["row"], r["cell"], r["row_header"], r["header"], r["text"]) for r in found]
    assert cells == [(None, None, False, False, "title"), (0, 0, True, False, "a"), (1, 0, True, True, "c"), (1, 1, True, False, "d"), (2, 0, False, False, "e")]
    assert {r["table_seq"] for r in found} == {1}


RUN_NAMES = ("kind", "text", "id", "type", "subtype", "data", "equiv", "disp", "forms")


def text(t):
    return {"kind": "text", "text": t}


def code(kind, type_=None, id_="1"):
    return {"kind": kind, "id": id_, "type": type_}


def bold(type_="fmt:bold"):
    return [text("Hello "), code("pcOpen", type_), text("ugly"), code("pcClose", type_), text(" world")]


def shown(found):
    marks = {"pcOpen": "<{}>", "pcClose": "</{}>", "ph": "{{{}}}", "sub": "[{}]"}
    return "".join(r["text"] if r["kind"] == "text" else marks[r["kind"]].format(r["id"]) for r in found)


def run_frame(spark, rows, more):
    """Rows of (runs, ...) as a DataFrame."""
    whole = [tuple([[tuple(r.get(n) for n in RUN_NAMES) for r in row[0]], *row[1:]]) for row in rows]
    return spark.createDataFrame(whole, f"runs {runs.RUNS}, {more}")


EDIT_CASES = [
    (bold(), [(6, 10, "pretty")], "Hello <1>pretty</1> world"),
    (bold(), [(6, 10, "x")], "Hello <1>x</1> world"),
    (bold(), [(3, 8, "X")], "HelX<1>ly</1> world"),
    (bold(), [(0, 16, "Hi")], "Hi"),
    (bold("var:x"), [(0, 16, "Hi")], "Hi<1></1>"),
    ([text("Hello "), code("ph", "struct:break"), text("world")], [(0, 11, "Hi")], "{1}Hi"),
    ([text("see "), code("sub"), text(" here")], [(0, 9, "X")], "[1]X"),
    ([text("a"), code("pcOpen", "fmt:bold"), text("b"), code("pcClose", "fmt:bold"), text("c")], [(0, 3, "Z")], "Z"),
    (bold(), [], "Hello <1>ugly</1> world"),
    (bold(), [(4, 5, "0"), (12, 13, "0")], "Hell0 <1>ugly</1> w0rld"),
    (bold(), [(4, 8, "x"), (6, 9, "y")], "Hello <1>ugly</1> world"),  # they overlap
    (bold(), [(4, 99, "x")], "Hello <1>ugly</1> world"),  # out of range
    ([code("pcClose", "fmt:bold"), text("ab")], [(1, 2, "")], "</1>a"),  # half a pair stands alone
    ([text("é😀x"), code("ph", "fmt:bold")], [(1, 2, "y")], "éyx{1}"),
    ([], [(0, 0, "new")], "new"),
]


def test_edits_over_runs(spark):
    df = run_frame(spark, [(r, e) for r, e, _ in EDIT_CASES], f"edits {edits.EDITS}")
    found = df.select(edits.apply_edits(F.col("runs"), F.col("edits")).alias("r")).collect()
    assert [shown(row["r"]) for row in found] == [wanted for _, _, wanted in EDIT_CASES]


def test_replacement_across_codes(spark):
    cases = [
        (bold(), "o", "0", False, "Hell0 <1>ugly</1> w0rld"),
        (bold(), "o", "0", True, "Hell0 <1>ugly</1> world"),
        (bold(), "o ug", "-", False, "Hell-<1>ly</1> world"),
        (bold(), "[a-z]", "-", False, "Hello <1>ugly</1> world"),
        (bold(), "ugly", "", False, "Hello  world"),
    ]
    for given, old, new, first, wanted in cases:
        row = run_frame(spark, [(given, 1)], "k int").select(edits.replace_in_runs(F.col("runs"), old, new, first).alias("r")).first()
        assert shown(row["r"]) == wanted


def test_placeholder_view_and_back(spark):
    given = [text("a"), code("pcOpen", "fmt:bold"), text("b"), code("pcClose", "fmt:bold"), code("ph", "struct:break", "2"), code("sub", None, "3")]
    df = run_frame(spark, [(given, 'x<x  id="/1" /><x id="9"/>y<x id="2/"/>')], "said string")
    row = df.select(
        edits.placeholder_text(F.col("runs")).alias("view"),
        edits.parse_placeholder_text(edits.placeholder_text(F.col("runs")), F.col("runs")).alias("back"),
        edits.parse_placeholder_text(F.col("said"), F.col("runs")).alias("other"),
        "runs",
    ).first()
    assert row["view"] == 'a<x id="1"/>b<x id="/1"/><x id="2/"/><x id="sub:3"/>'
    assert row["back"] == row["runs"]
    assert shown(row["other"]) == "x</1><9>y{2}" and [r["type"] for r in row["other"]] == [None, "fmt:bold", None, None, "struct:break"]


def test_run_edits_are_guarded(spark):
    source = bold()
    blocks = run_frame(spark, [(source, f"b{k}") for k in range(6)], "block_id string").withColumnRenamed("runs", "source")
    plural = run_frame(spark, [([{"kind": "plural", "forms": {"other": "many"}}], "p")], "block_id string").withColumnRenamed("runs", "source")
    texts = [
        ("b0", None, 'Bye <x id="1"/>nice<x id="/1"/>'),
        ("b1", None, "Bye"),
        ("b2", None, 'Bye <x id="/1"/>nice<x id="1"/>'),
        ("b3", "other", "x"),
        ("b4", None, 'Hello <x id="1"/>ugly<x id="/1"/> world'),
        ("p", None, "few"),
    ]
    changes = spark.createDataFrame(texts, "block_id string, expected_hash string, new_text string")
    found = {r["block_id"]: (r["edit_state"], shown(r["source"]) if r["block_id"] != "p" else r["source"][0]["text"]) for r in tools.apply_run_edits(blocks.unionByName(plural), changes).collect()}
    same = shown(source)
    assert found == {
        "b0": ("applied", "Bye <1>nice</1>"),
        "b1": ("guard_failed", same),
        "b2": ("guard_failed", same),
        "b3": ("stale", same),
        "b4": ("skipped", same),
        "b5": ("none", same),
        "p": ("applied", "few"),
    }


@pytest.mark.parametrize(
    ("message", "picker", "frame", "inner"),
    [
        ("{vessel} is alongside until {until}.", False, {"{vessel}": 1, "{until}": 1}, []),
        ("{vessel} follows {vessel}.", False, {"{vessel}": 2}, []),
        ("Berth {n, number, integer} of { total ,number}.", False, {"{n, number, integer}": 1, "{total, number}": 1}, []),
        ("{count, plural, one {# a} few {# b} other {# c}} here", True, {"{count, plural}": 1}, ["#"]),
        ("The {n, selectordinal, one {#st} other {#th}} berth # 2", True, {"{n, selectordinal}": 1}, ["#"]),
        ("{count, plural, offset:1 =0 {Nobody} one {# other} other {# others}}", True, {"{count, plural, offset:1}": 1}, ["#"]),
        ("{g, select, male {{n, plural, one {#} other {{x}}}} other {none}}", True, {"{g, select}": 1}, ["#", "{n, plural}", "{x}"]),
        ("Write '{'name'}' to {name}, don't ''quote'' it", False, {"{name}": 1}, []),
        ("{d, date, yyyy {x} mm}", False, {"{d, date, yyyy {x} mm}": 1}, []),
    ],
)
def test_message_tokens(message, picker, frame, inner):
    found = icu.tokens_of(message)
    assert (found["picker"], {x["token"]: x["n"] for x in found["frame"]}, found["inner"]) == (picker, frame, inner)


@pytest.mark.parametrize("message", ["{unterminated, plural,", "Hello {{name}}, welcome", "a stray } brace", "{n, plural, {x}}", "{n, choice, 0#a}", "{n, plural}", "{n"])
def test_malformed_messages(message):
    assert icu.tokens_of(message) is None


def test_placeholder_check_of_messages(spark):
    rows = [
        (1, "{n, plural, one {# a} other {# b}}", "{n, plural, one {# a} few {# b} many {# c} other {# d}}"),
        (2, "{n, plural, one {# a} other {b}}", "{n, plural, other {b}}"),
        (3, "{x} {x} {n, plural, other {#}}", "{n, plural, other {# {x}}}"),
        (4, "{n, plural, other {{x}}}", "{x} {n, plural, other {y}}"),
        (5, "%s %s {a}", "%s {b} {b}"),
        (6, None, "{a}"),
        (7, "{n, plural, other {#}}", None),
    ]
    df = spark.createDataFrame(rows, "k int, s string, t string")
    found = sorted((r["k"], r["token"], r["category"], r["in_source"], r["in_target"]) for r in checks.placeholder_check(df, ["k"], "s", "t").collect())
    assert found == [
        (2, "#", "missing", None, None),
        (3, "{x}", "missing", 2, 0),
        (5, "%s", "missing", 2, 1),
        (5, "{a}", "missing", 1, 0),
        (5, "{b}", "extra", 0, 2),
        (6, "{a}", "extra", 0, 1),
        (7, "#", "missing", None, None),
        (7, "{n, plural}", "missing", 1, 0),
    ]


def test_most_codes_of_branches(spark):
    df = spark.createDataFrame([([["a", "a", "b"], ["a", "c"], []],)], "b array<array<string>>")
    assert [(x["token"], x["n"]) for x in df.select(checks.most_codes(F.col("b")).alias("m")).first()["m"]] == [("a", 2), ("b", 1), ("c", 1)]


def test_srx_rules_decide_in_order():
    import regex

    rules = srx.parse_srx(srx.DEFAULT_SRX)
    chance = random.Random(4)
    pieces = ["Mr", "Dr", "J", ".", "...", "…", " ", "\n", "a", "B", "!", "?", '"', ")", "3", "z. B", "。"]
    for _ in range(150):
        text = "".join(chance.choice(pieces) for _ in range(25))
        chosen = rules.of_locale(chance.choice(["en-GB", "de", "fr", "es", None]))
        places = [{m.start() for m in regex.finditer(f"(?<={r.before})(?={r.after})", text)} for r in chosen]
        first = [next((r.breaks for r, at in zip(chosen, places, strict=True) if p in at), False) for p in range(len(text))]
        assert srx.break_places(text, chosen) == [p for p in range(1, len(text)) if first[p]]


def test_srx_reading():
    text = """<srx version="2.0"><header cascade="no"/><body><languagerules>
      <languagerule languagerulename="one"><rule><beforebreak>;</beforebreak></rule></languagerule>
      <languagerule languagerulename="two"><rule break="no"><afterbreak>x</afterbreak></rule></languagerule></languagerules>
      <maprules><languagemap languagepattern="EN.*" languagerulename="one"/><languagemap languagepattern=".*" languagerulename="two"/></maprules></body></srx>"""
    rules = srx.parse_srx(text)
    assert rules.of_locale("en-US") == (srx.Rule(True, ";", ""),) and rules.of_locale("de") == (srx.Rule(False, "", "x"),)
    assert srx.parse_srx(text.replace('"no"/>', '""/>')).of_locale("en") == (srx.Rule(True, ";", ""), srx.Rule(False, "", "x"))
    assert srx.break_places("a;b;", rules.of_locale("en")) == [2]


def test_segments_of_masked_runs(spark):
    rules = srx.parse_srx(srx.DEFAULT_SRX)
    given = [
        ([text("One."), code("ph"), text("Two. "), code("pcOpen"), text("Three."), code("pcClose"), text("  ")], 0),
        ([code("ph"), code("sub")], 1),
        ([], 2),
    ]
    df = run_frame(spark, given, "k int").withColumn("locale", F.lit("en"))
    df = df.unionByName(df.filter("k = 2").withColumns({"runs": F.lit(None).cast(runs.RUNS), "k": F.lit(3)}))

    def cut(spaced):
        return {r["k"]: [(s["id"], s["start"], s["end"], s["text"]) for s in r["segments"]] for r in srx.segment_runs(df, "runs", "locale", rules, spaced).collect()}

    assert cut(False) == {0: [("s1", 0, 8, "One.Two."), ("s2", 9, 15, "Three.")], 1: [], 2: [], 3: []}
    assert cut(True) == {0: [("s1", 0, 4, "One."), ("s2", 4, 8, "Two."), ("s3", 9, 15, "Three.")], 1: [], 2: [], 3: []}


def test_units_are_committed_whole(spark):
    segment = "array<struct<id:string,start:int,end:int,text:string>>"
    rows = [("a", "x y", {"": [("s1", 0, 1, "x"), ("s2", 2, 3, "y")]}), ("b", "whole", {"other": [("s1", 0, 5, "whole")]}), ("c", "", None)]
    blocks = spark.createDataFrame(rows, f"id string, text string, layers map<string,{segment}>")
    found = srx.units(blocks, "id", "text", "layers", "")
    assert sorted((r["id"], r["unit"], r["start"], r["text"]) for r in found.collect()) == [("a", 0, 0, "x"), ("a", 1, 2, "y"), ("b", 0, 0, "whole")]
    written = spark.createDataFrame([("a", 0, "X"), ("b", 0, "W")], "id string, unit int, target_text string")
    assert [tuple(r) for r in srx.committed(found, written, "id").collect()] == [("b", "W")]
    marked = found.withColumn("ignorable", F.col("text") == "y")
    assert sorted(tuple(r) for r in srx.committed(marked, written, "id").collect()) == [("a", "Xy"), ("b", "W")]


@pytest.mark.parametrize("layers", [False, True])
def test_short_documents_are_shuffled_once(spark, layers):
    """Documents within one part, alone and beside a longer one, have the tree of a stack; their plan has one shuffle."""
    chance = random.Random(3)
    streams = {f"d{k}": random_events(chance, f"d{k}", chance.randint(0, 60)) for k in range(12)}
    if not layers:
        streams = {d: [e for e in events if not e[2].startswith("layer")] for d, events in streams.items()}
    df = spark.createDataFrame([e for events in streams.values() for e in events], EVENT)
    alone = tree.project_stream(df)
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert alone._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    mixed = tree.project_stream(df, part=30)
    for nodes in (alone, mixed):
        found = {}
        for r in nodes.collect():
            parent = None if r["parent_seq"] is None else (r["parent_seq"], r["parent_part"])
            found.setdefault(r["doc_id"], {})[r["seq"], r["part"]] = (r["role"], r["depth"], parent)
        assert found == {doc: t for doc, events in streams.items() if (t := tree_by_stack(events))}


def test_tables_of_short_and_long_documents_are_the_same(spark):
    chance = random.Random(6)
    events = [e for k in range(20) for e in random_events(chance, f"d{k}", 60) if not e[2].startswith("layer")]
    df = spark.createDataFrame(events, EVENT)
    short, long = ({tuple(r) for r in tree.assemble_tables(df, part=p).collect()} for p in (65_536, 7))
    assert short == long and len(short) > 50
    assert tree.assemble_tables(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
