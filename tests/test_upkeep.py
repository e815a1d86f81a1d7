"""Targets over sources, decisions into memory, settled findings, protected terms, summaries and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import memory, upkeep


def test_targets_over_sources(spark):
    sources = spark.createDataFrame(
        [("a", 1, "k1", "x1"), ("a", 2, "k2", "x2"), ("a", 3, "k3", ""), ("b", 1, "k1", None), ("b", 2, "k9", "x9"), ("c", 1, "k", "x")], "doc_id string, seq int, key string, address string"
    )
    targets = spark.createDataFrame(
        [("a", 1, "other", "x2", "by address"), ("a", 2, "k1", "x7", "by key"), ("a", 5, "", "", "third"), ("b", 1, "k1", None, "old"), ("b", 2, "k1", None, "new"), ("b", 3, "z", "", "odd")],
        "doc_id string, seq int, key string, address string, text string",
    )
    found = {(r["doc_id"], r["seq"]): (r["target_text"], r["paired_by"]) for r in upkeep.overlay_targets(sources, targets).collect()}
    assert found == {
        ("a", 1): ("by key", "key"), ("a", 2): ("by address", "address"), ("a", 3): ("third", "place"),
        ("b", 1): ("new", "key"), ("b", 2): (None, None), ("c", 1): (None, None)}


def test_decisions_into_memory(spark):
    rows = [("i", str(k), "de", "en", s, t) for k, (s, t) in enumerate([("one", "eins"), ("two", "zwei"), ("three", ""), ("four", "vier"), ("one", "eins")])]
    blocks = spark.createDataFrame(rows, "item string, unit string, locale string, source_locale string, source_text string, target_text string")
    hashed = blocks.withColumn("target_hash", F.sha2("target_text", 256))
    states = spark.createDataFrame([("0", "approved"), ("1", "signed-off"), ("2", "approved"), ("3", "approved"), ("4", "open")], "unit string, state string")
    decisions = hashed.join(states, "unit").withColumn("target_hash", F.when(F.col("unit") == "3", "stale").otherwise(F.col("target_hash")))
    empty = spark.createDataFrame([], "entry_id string, source_locale string, target_locale string, source_text string, target_text string")
    once = upkeep.promote_decisions(blocks, decisions, empty)
    assert sorted(r["target_text"] for r in once.collect()) == ["eins", "zwei"]
    assert sorted(upkeep.promote_decisions(blocks, decisions, once).collect()) == sorted(once.collect())
    rejected = decisions.withColumn("state", F.when(F.col("unit") == "4", "rejected").otherwise(F.col("state")))
    assert [r["target_text"] for r in upkeep.promote_decisions(blocks, rejected, once).collect()] == ["zwei"]
    ids = once.select(memory.memory_id(F.lit("en"), F.lit("de"), F.lit("two"), F.lit("zwei")).alias("x")).first()["x"]
    assert ids in {r["entry_id"] for r in once.collect()}


def test_settled_findings(spark):
    findings = spark.createDataFrame([("target-same-as-source", "OK", "de"), ("target-same-as-source", "Go", "de"), ("length", "OK", "de"), ("target-same-as-source", "OK", "fr")], "category string, source_text string, locale string")
    answers = spark.createDataFrame([("OK", "de"), ("OK", "de")], "source_text string, locale string")
    assert sorted((r["category"], r["source_text"], r["locale"], r["suppressed"]) for r in upkeep.settled_findings(findings, answers).collect()) == [
        ("length", "OK", "de", False), ("target-same-as-source", "Go", "de", False), ("target-same-as-source", "OK", "de", True), ("target-same-as-source", "OK", "fr", False)]


def test_protected_terms(spark):
    terms = ["Tool", " Tool Box ", "", "Tool", "a$b\\c"]
    assert upkeep.protected_terms(terms) == ["Tool Box", "a$b\\c", "Tool"]
    row = spark.createDataFrame([("Tool Box and Tool, a$b\\c",)], "t string").select(
        upkeep.mask_terms(F.col("t"), terms).alias("m"), upkeep.unmask_terms(F.lower(upkeep.mask_terms(F.col("t"), terms)), terms).alias("u")
    ).first()
    assert row["m"] == "[[DNT_0]] and [[DNT_2]], [[DNT_1]]" and row["u"] == "Tool Box and Tool, a$b\\c"


def test_summary_of_scores(spark):
    df = spark.createDataFrame([(k, s) for k, values in {"a": [100, 0, 25, 26], "b": [50], "c": [None]}.items() for s in values], "k string, s long")
    found = {r["k"]: tuple(r)[1:] for r in upkeep.score_summary(df, "s", ["k"]).collect()}
    assert found == {"a": (4, 37.75, 0, 100, 25.5, 2, 1, 0, 1), "b": (1, 50.0, 50, 50, 50.0, 0, 1, 0, 0)}


def test_suggested_rules(spark):
    rules = spark.createDataFrame([("Cheap", "good", "mine", None), ("same", "x", "mine", "c1")], "term string, replacement string, note string, concept_id string")
    given = spark.createDataFrame([("cheap ", "", 5, "c9"), ("new", "fresh", 3, None), ("new", "old", 2, None), ("few", "x", 1, None), (" ", "x", 9, None)], "term string, replacement string, corrections int, concept_id string")
    found = sorted(tuple(r) for r in upkeep.apply_suggestions(rules, given, 2).collect())
    assert found == [("Cheap", "good", "from 5 corrections", "c9"), ("new", "fresh", "from 3 corrections", None), ("same", "x", "mine", "c1")]
    assert upkeep.apply_suggestions(rules, given, 0).count() == 2
