"""Term files, sessions, user steps and collectors."""

from __future__ import annotations

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from textloom.plans import script
from textloom.sources import bundles, nested

TBX = """<?xml version="1.0"?>
<tbx xmlns="urn:iso:std:iso:30042:ed-2" type="TBX-Basic"><text><body>
 <conceptEntry id="c1"><descrip type="subjectField">ships</descrip><descrip type="definition">a place &amp; more</descrip>
  <langSec xml:lang="en"><termSec><term> berth </term><termNote type="administrativeStatus">preferredTerm-admn-sts</termNote><termNote type="partOfSpeech">noun</termNote></termSec></langSec>
  <langSec xml:lang="de"><termSec><term>Liegeplatz</term></termSec><termSec><term/></termSec></langSec></conceptEntry>
 <conceptEntry><langSec xml:lang="en"><termSec><term>mooring</term><termNote type="status">prohibited</termNote></termSec></langSec></conceptEntry>
 <conceptEntry id="empty"/>
</body></text></tbx>"""
MARTIF = """<martif><text><body><termEntry id="m"><descripGrp><descrip type="definition">old</descrip></descripGrp>
 <langSet xml:lang="fr"><ntig><termGrp><term>quai</term><termNote type="normativeAuthorization">supersededTerm</termNote></termGrp></ntig><tig><term>poste</term><termNote type="usageNote">rare</termNote></tig></langSet></termEntry></body></text></martif>"""


def test_tbx_of_both_dialects():
    found = [(r["concept_id"], r["domain"], r["definition"], r["locale"], r["term"], r["status"], r["part_of_speech"], r["note"]) for r in bundles.tbx_terms(TBX)]
    assert found == [
        ("c1", "ships", "a place & more", "en", "berth", "preferred", "noun", None),
        ("c1", "ships", "a place & more", "de", "Liegeplatz", "approved", None, None),
        ("tbx-2", None, None, "en", "mooring", "forbidden", None, None),
    ]
    assert [(r["term"], r["status"], r["note"], r["definition"]) for r in bundles.tbx_terms(MARTIF)] == [("quai", "deprecated", None, "old"), ("poste", "approved", "rare", "old")]
    with pytest.raises(ValueError):
        bundles.tbx_terms("<html/>")


def test_term_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tbx").write_text(TBX)
    (tmp_path / "in" / "b.tbx").write_text(MARTIF)
    terms = bundles.read_terms(spark, f"{tmp_path}/in", "tbx")
    plain = terms.drop("path")
    expected = sorted(plain.collect(), key=str)
    assert len(expected) == 5
    for kind, store in (("json", bundles.json_store(terms, "mine")), ("tbx", bundles.tbx_store(terms))):
        for k, row in enumerate(store.orderBy("path").collect()):
            (tmp_path / kind).mkdir(exist_ok=True)
            (tmp_path / kind / f"{k}.{kind}").write_text(row["content"])
        assert sorted(bundles.read_terms(spark, f"{tmp_path}/{kind}", kind).drop("path").collect(), key=str) == expected


def test_sessions_and_ids(spark):
    files = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("d", "three")], "path string, content string")
    hashes = {r["path"]: r["h"] for r in files.select("path", F.sha2("content", 256).alias("h")).collect()}
    sessions = spark.createDataFrame([(1, hashes["c"], 10), (2, hashes["c"], 20)], "session_id int, file_hash string, imported_at int")
    found = {r["path"]: (r["session_id"], r["fresh"]) for r in bundles.new_sessions(files, sessions).collect()}
    assert found == {"a": (None, True), "b": (None, False), "c": (2, False), "d": (None, True)}
    entries = spark.createDataFrame([("x", "s", "t"), ("", "s", "t"), (None, "s", "t"), (None, "s", None)], "entry_id string, source string, target string")
    ids = [r["entry_id"] for r in bundles.stable_entry_ids(entries, ["source", "target"], "kmb").collect()]
    assert ids[0] == "x" and ids[1] == ids[2] != ids[3] and ids[1].startswith("kmb-")


def test_script_steps(spark):
    blocks = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "c")], "id int, text string")

    def split(text, most):
        for k, word in enumerate((text or "").split()[:most]):
            yield word, k

    found = script.script(blocks, split, ["text", F.lit(5)], "word string, place int", ["id"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", 0), (1, "b", 1), (4, "c", 0)]


def test_collectors(spark):
    class Lengths(script.Collector):
        def empty(self):
            return {}

        def add(self, state, row):
            return self.merge(state, {len(row["text"] or ""): 1})

        def merge(self, one, two):
            return {k: one.get(k, 0) + two.get(k, 0) for k in {*one, *two}}

        def result(self, state):
            return [{"length": k, "n": n} for k, n in sorted(state.items())]

    rows = spark.range(1000).select(F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text")).repartition(30)
    found = script.collect(rows, Lengths(), "length int, n long", fan_in=4)
    assert [tuple(r) for r in found.orderBy("length").collect()] == [(k, len(range(k, 1000, 7))) for k in range(7)]
    assert script.collect(rows.filter("false"), Lengths(), "length int, n long").collect() == []


def test_formats_within_formats(spark):
    page = '<p title="x">Hello <b>big</b> world</p>'
    row = json.dumps({"id": 7, "body": page, "tags": ["one", "two"]}, ensure_ascii=False)
    table = io.StringIO()
    csv.writer(table, lineterminator="\n").writerows([["name", "data"], ["a, b", row], ["c", "not json"]])
    docs = spark.createDataFrame([("d", "csv", table.getvalue()), ("e", "csv", None), ("f", None, "plain")], "doc_id string, format string, text string")
    rules = [("csv", r"/[1-9]\d*/1", "json"), ("json", "/body", "html")]
    layers = nested.extract(docs, rules)
    found = {r["layer_id"]: (r["text"], r["layer_format"]) for r in nested.texts(layers).collect()}
    assert sorted(t for t, k in found.values() if k == "html") == [" world", "Hello ", "big"] and ("not json", "csv") in found.values() and ("plain", None) in found.values()
    assert {r["doc_id"]: r["text"] for r in nested.fold(layers, nested.transform(layers, lambda c: c)).collect()} == {"d": table.getvalue(), "e": "", "f": "plain"}
    done = {r["doc_id"]: r["text"] for r in nested.fold(layers, nested.transform(layers, F.upper, ["html", "json"])).collect()}
    rows = list(csv.reader(io.StringIO(done["d"])))
    assert json.loads(rows[1][1]) == {"id": 7, "body": '<p title="x">HELLO <b>BIG</b> WORLD</p>', "tags": ["ONE", "TWO"]} and rows[2] == ["c", "not json"] and done["f"] == "plain"
    with pytest.raises(ValueError):
        nested.extract(spark.createDataFrame([("d", "lines", "a")], "doc_id string, format string, text string"), [("lines", ".*", "lines")], most_depth=3)
