"""Fuzzy matches by segments, and look-ups of many copies."""

import random

from pyspark.sql import functions as F

from textloom.operators import memory, recycle, segments


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(text, edits, rng):
    for _ in range(edits):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("abcdé 𝄞")) + text[at + (kind < 2) :]
    return text


def test_alike_texts_are_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé 𝄞") for _ in range(n)) for n in (1, 2, 5, 9, 20, 21, 40, 90)]
    texts = sorted({edited(t, k, rng) for t in base for k in (0, 1, 2, 4, 7)} | {""})
    q, e = spark.createDataFrame([(t,) for t in texts], "q string"), spark.createDataFrame([(t,) for t in texts * 2], "e string")
    ratio = {(a, b): 1 - distance(a, b) / max(len(a), len(b), 1) for a in texts for b in texts}
    for least in (0.6, 0.85, 0.95, 1.0):
        found = memory.alike_texts(q, e, least).collect()
        assert sorted((r["q"], r["e"]) for r in found) == sorted(p for p, s in ratio.items() if s >= least)


def test_only_texts_that_meet_are_shuffled(spark):
    """Of entries without a segment of any query no key passes."""
    q = spark.createDataFrame([("the quick brown fox jumps over the lazy dog",)], "q string")
    probes = memory._matching(q, "q", 0.9).select(F.explode("keys.key").alias("key"))
    rng = random.Random(5)
    others = ["".join(rng.choice("klmnop") for _ in range(43)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in [*others, "the quick brown fox jumped over the lazy dog"]], "e string")
    assert memory._matching(rows, "e", 0.9, segments.bit_table(probes, "key")).count() < 10


def test_copies_are_looked_up_once(spark):
    """40 queries and 500 entries of few texts: the rows that go on are those of the texts, and the best matches those of all."""
    columns = [f"{k}_key" for k in memory.EXACT_TIERS]
    texts = ["old ring no 4", "old ring no 44", "new bolt no 7", "nothing"]
    rows = [(k, texts[k % 4], f"t{k % 2}", f"b{k % 3}") for k in range(500)]
    entries = spark.createDataFrame(rows, "entry_id long, t string, target string, project string").select("entry_id", "target", "project", *[F.col("t").alias(c) for c in columns])
    asked = [(k, ["old ring no 4", "old rings no 4", "new bolt 7"][k % 3], f"b{k % 2}") for k in range(40)]
    queries = spark.createDataFrame(asked, "query_id long, t string, project string").select("query_id", "project", *[F.col("t").alias(c) for c in columns])
    assert memory.first_entries(entries, ["target", "project", *columns], 3).count() == 12 * 3
    first, held = memory.first_of_each(queries, ["project", *columns])
    assert (first.count(), held.count()) == (6, 40)

    def best(text, project, tier):
        found = []
        for k, t, _, p in rows:
            exact, score = t == text, 1 - distance(t, text) / max(len(t), len(text))
            gain = 0.03 if p == project and score < 1 else 0
            if score >= 0.8 or exact:
                found.append((-min(score + gain, 1.0), 0 if exact else tier, k))
        return [(k, t, round(-s, 6)) for s, t, k in sorted(found)[:3]]

    for lookup in (memory.tiered_lookup, recycle.full_lookup):
        out = {}
        for r in lookup(queries, entries, 0.8, 3).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append((r["entry_id"], r["tier"], round(r["score"], 6)))
        assert out == {k: b for k, t, p in asked if (b := best(t, p, 3))}
