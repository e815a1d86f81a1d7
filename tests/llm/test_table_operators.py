"""Packing, mixing, top-k search, LM scores, line dedup and the classifier."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import line_dedup, lm_scoring, mixing, packing, quality, topk_search

DOCS = "/root/testdata/sf0.001/documents.parquet"


def bins_of(histogram, capacity):
    """Lengths in each bin of a plan, after checking places."""
    bins = defaultdict(list)
    ranks = defaultdict(set)
    for length, rank, count, first, per_bin, offset in packing.plan(histogram, capacity):
        for k in range(count):
            ranks[length].add(rank + k)
            bins[first + k // per_bin].append((offset + k % per_bin * length, length))
    for length, n in histogram.items():
        assert ranks[length] == set(range(n))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_fills_bins(histogram):
    bins = bins_of(histogram, 40)
    lengths = sorted((length for length, n in histogram.items() for _ in range(n)), reverse=True)
    rooms = []
    for length in lengths:  # plain best-fit decreasing, for comparison
        fitting = [k for k, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(40 - length)
    assert len(bins) <= math.ceil(len(rooms) * 1.1) + 1
    assert len(bins) >= math.ceil(sum(lengths) / 40)


def test_large_pieces_pair_at_most_twice():
    bins = bins_of({30: 3, 20: 5, 14: 9, 26: 2}, 40)
    assert all(len(p) <= 2 for p in bins.values())
    assert len(bins) == 3 + 2 + 3 + 3  # 26 with 14, 20 with 20, the last 20 with 14, 14 with 14


def test_packing_matches_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    odd = ["", None, "  \n\t ", "á ́b\x1cc\x85d e", "<|endoftext|> x<|startoftext|>y", "İstanbul K ß ﬁ", "word " * 9000, "it's we'll I'd", "x" * 5000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, " ".join(rng.choice(["Ab", "c1", "d!", "efg"]) for _ in range(rng.randint(1, 6000)))) for i in range(30)]
    rows += [(None, "no id"), rows[12]]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected.append((i, k // 4096, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(expected, key=str)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert len(sequences) <= math.ceil(sum(r["length"] for r in out) / 4096) + 2


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 50), min_size=1))
def test_schedule_stays_within_a_block(weights):
    rows = mixing.schedule(weights)
    period = sum(weights.values())
    assert Counter(r[0] for r in rows) == weights
    done = Counter()
    for slot, (source, k, release, deadline, at) in enumerate(rows):
        assert at == slot and done[source] == k and release <= slot < deadline
        done[source] += 1
        assert all(abs(done[s] - w * (slot + 1) / period) < 1 for s, w in weights.items())


def test_mixing_places_every_document(spark):
    rows = [(i, "x" if i % 3 else "y", "t", 0) for i in range(500)] + [(None, "x", "t", 0), (7, None, "t", 0), (7, None, "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    out = mixing.mix_sources(docs, block=8).collect()
    assert {(r["id"], r["source"]) for r in out} == {(i, s or "") for i, s, _, _ in rows}
    places = [(r["slot"], r["place"]) for r in out]
    assert len(set(places)) == len(places)
    blocks = {}
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"]
        assert blocks.setdefault(r["slot"], (r["source"], r["block"], r["epoch"])) == (r["source"], r["block"], r["epoch"])
    weights = mixing.temperature_weights(Counter(s or "" for _, s, _, _ in rows))
    done = Counter()
    assert sorted(blocks) == list(range(len(blocks)))
    for slot in sorted(blocks):
        done[blocks[slot][0]] += 1
        assert all(abs(done[s] - w * (slot + 1) / sum(weights.values())) < 1 for s, w in weights.items())
    once = Counter((r["id"], r["source"]) for r in out if r["epoch"] == 0)
    assert once == Counter((i, s or "") for i, s, _, _ in rows)
    mixed = mixing.mixed_documents(docs, weights={"x": 3, "y": 1}, block=8)
    assert mixed.columns == docs.columns and mixed.filter("source is null").isEmpty()
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=6).round(2).tolist() for _ in range(300)]
    vectors[10:60] = [vectors[10]] * 50  # many copies
    vectors[61:64] = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6]
    vectors[64:68] = [[float("inf")] * 6, [1.0, 2.0], [2.0, 1.0], []]
    vectors[70] = [3e30] * 6
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(None, vectors[0], 0), (5, vectors[5], 1)]
    found = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int").repartition(3), F.col("id") % 10 == 0, pivots=5).collect()
    ok = {i: [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v] for i, v in enumerate(vectors) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q in (i for i in ok if i % 10 == 0):
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ok[q], ok[c])))), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))
        expected |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:5])}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 10 == 0).collect() == []


def brute_losses(docs, wanted):
    grams = {}
    for k, (_, t) in enumerate(docs):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (t or "").split()]
        grams[k] = w
    single, pair = [Counter(), Counter()], [Counter(), Counter()]
    size = [0, 0]
    inside = [i in wanted for i, _ in docs]
    for k, w in grams.items():
        for m in (0, 1):
            if m == 0 or inside[k]:
                single[m].update(w)
                pair[m].update(zip(w, w[1:]))
                size[m] += len(w)
    scale = [size[1] / max(size[0], 1), 1.0]
    out = []
    for k, w in grams.items():
        sums = [0.0, 0.0]
        for m in (0, 1):
            own = m == 0 or inside[k]
            c1, c2 = Counter(w), Counter(zip(w, w[1:]))
            for j, x in enumerate(w):
                one = (single[m][x] - own * c1[x]) * scale[m]
                n = (size[m] - own * len(w)) * scale[m]
                both = before = 0.0
                if j:
                    both = (pair[m][w[j - 1], x] - own * c2[w[j - 1], x]) * scale[m]
                    before = (single[m][w[j - 1]] - own * c1[w[j - 1]]) * scale[m]
                p = (min(both, before) + 8 * (one + 1) / (n + max(len(single[0]), 1))) / (before + 8)
                sums[m] -= math.log(p)
        out.append((docs[k][0], len(w), sums[1] / len(w) if w else None, sums[0] / len(w) if w else None))
    return out


@pytest.mark.parametrize("part_bytes", [300, 6 << 20])
def test_lm_scores(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(lm_scoring, "PART_BYTES", part_bytes)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("The of été b cat sat on mat x y z".split()) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    docs += [(90, None), (91, ""), (None, "the cat sat"), (5, docs[5][1]), (6, "another text of six")]
    wanted = set(range(0, 40, 3))
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, part string")
    targets = spark.createDataFrame([(i,) for i in [*wanted, 3, None]], "doc_id long")
    found = lm_scoring.cross_entropy_difference(frame, targets).collect()
    expected = brute_losses(docs, wanted)
    key = lambda r: (str(r[0]), r[1], str(r[2])[:9])
    for r, e in zip(sorted((tuple(r) for r in found), key=key), sorted(expected, key=key), strict=True):
        assert r[:2] == e[:2]
        assert r[2:4] == (None, None) if e[2] is None else np.allclose(r[2:4], e[2:])
        assert r[4] is None if e[2] is None else math.isclose(r[4], e[3] - e[2], abs_tol=1e-9)
    assert lm_scoring.cross_entropy_difference(frame.limit(0), targets).collect() == []
    assert {r["score"] for r in lm_scoring.cross_entropy_difference(frame, targets.limit(0)).collect()} <= {None, 0.0}


def test_line_dedup(spark):
    base = "it was a bright cold day in april and the clocks were striking thirteen while winston smith slipped quickly through the glass doors of victory mansions"
    rows = [
        (1, f"Heading\n{base}\n\n***\nfirst only"),
        (2, f"HEADING!\n{base.upper()}.\nsecond only\n***"),
        (3, "third only\nthird only\n\n"),
        (4, base),
        (5, None),
        (6, ""),
        (None, "heading\nnull only"),
        (7, "repeated row\nHeading"),
        (7, "repeated row\nHeading"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, line string")
    out = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(docs).collect()}
    assert out == {
        (1, rows[0][1], 5, 0),
        (2, "second only\n***", 4, 2),
        (3, "third only\n\n", 4, 1),
        (4, "", 1, 1),
        (5, None, 0, 0),
        (6, "", 1, 0),
        (None, "null only", 2, 1),
        (7, "repeated row", 2, 1),
    }
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


def test_line_dedup_joins_near_lines(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    lines = [[rng.choice(vocabulary) for _ in range(80)] for _ in range(60)]
    changed = [[*line[:40], "other", *line[41:]] for line in lines]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines + changed)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert all(out[i] for i in range(60))
    assert sum(out[i] == "" for i in range(60, 120)) >= 58


def test_fingerprint_is_the_majority_of_bits(spark):
    rng = random.Random(9)
    rows = [([rng.getrandbits(63) for _ in range(rng.randint(1, 31))],) for _ in range(40)]
    frame = spark.createDataFrame(rows, "h array<long>").select("h", F.size("h").alias("n"), line_dedup.counters(F.col("h")).alias("d"))
    for r in frame.select("h", line_dedup.majority("d", F.col("n")).alias("fp")).collect():
        assert r["fp"] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r["h"]) > len(r["h"]))


def test_groups_of_too_many_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LARGE", 50)
    rows = spark.createDataFrame([(7, i // 20 if i < 100 else -1, i) for i in range(400)] + [(i, 0, i) for i in range(1000, 1040)], "key long, next long, node long")
    group, number = line_dedup.group_of(rows)
    sizes = [r["count"] for r in rows.withColumn("g", group).groupBy("g").count().collect()]
    assert number == sum(sizes) == 440 and max(sizes) < 120 and sizes.count(20) >= 5


@pytest.mark.parametrize("size", [8, 20, 60])
def test_line_dedup_finds_lines_at_the_threshold(spark, size):
    """Of lines in which as many words differ as the similarity allows, nine in ten are found."""
    rng = random.Random(size)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    lines = [[rng.choice(vocabulary) for _ in range(size)] for _ in range(200)]
    changed = [[rng.choice(vocabulary) if k in at else w for k, w in enumerate(line)] for line in lines for at in [set(rng.sample(range(size), size // 5))]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines + changed)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert all(out[i] for i in range(200))
    assert sum(out[i] == "" for i in range(200, 400)) >= 180


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.7
    right = [0.95, 0.9, 0.85, 0.8]
    said = np.stack([np.where(rng.random(20000) < p, good, ~good) for p in right], axis=1)
    patterns = Counter("".join("+" if x else "-" for x in row) for row in said)
    posterior, accuracy = quality.estimate(patterns)
    assert np.allclose(accuracy.mean(axis=0), right, atol=0.03)
    guess = np.array([posterior["".join("+" if x else "-" for x in row)] > 0.5 for row in said])
    assert (guess == good).mean() > 0.95
    assert quality.estimate({}) == ({}, pytest.approx(np.full((2, 0), 0.5)))


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(DOCS)
    labels = {r["doc_id"]: r for r in spark.read.parquet(DOCS.replace("documents", "labels")).collect()}
    found = {r["id"]: r for r in quality.classify(docs).collect()}
    assert len(found) == docs.count()
    good = [found[i]["good"] for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    bad = [found[i]["good"] for i, r in labels.items() if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["good"] for r in found.values())


def test_classifier_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "ok"), (3, "ok"), (None, "A fine day, and so to bed."), (4, "$$$ %%% " * 50), (5, "you stupid idiot")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, version string")
    found = {(r["id"], r["version"]): r["good"] for r in quality.classify(docs).collect()}
    assert len(found) == 6 and not next(v for (i, _), v in found.items() if i == 5)
    assert quality.good_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [10, 20, 50])
def test_line_dedup_finds_one_changed_word(spark, size):
    rng = random.Random(size)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 7))) for _ in range(500)]
    lines = [[rng.choice(vocabulary) for _ in range(size)] for _ in range(100)]
    changed = []
    for line in lines:
        k = rng.randrange(size)
        changed.append([*line[:k], "other", *line[k + 1 :]])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines + changed)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert all(out[i] for i in range(100))
    assert sum(out[i] == "" for i in range(100, 200)) >= 99


def test_line_dedup_counts_characters(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 8))) for _ in range(500)]
    lines = [[rng.choice(vocabulary) for _ in range(10)] for _ in range(100)]
    changed = []
    for line in lines:
        typed = rng.sample(range(10), 3)
        changed.append([w[:2] + "x" + w[3:] if k in typed else w for k, w in enumerate(line)])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines + changed)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert all(out[i] for i in range(100))
    found = sum(out[i] == "" for i in range(100, 200))
    assert found >= 90


@pytest.mark.parametrize("others", [0, 100])
def test_line_dedup_compares_lines_unlike_their_head(spark, others):
    # Lines that share five words and are unlike otherwise: under 0.8 in words and in characters.
    rng = random.Random(6)
    heads = ["0 0 0 0 0 9 8 7 6", *["0 0 0 0 0 " + " ".join(f"{rng.getrandbits(32):08x}" for _ in range(4)) for _ in range(others)]]
    lines = [*heads, "0 0 0 0 0 1 2 3 4", "0 0 0 0 0 1 2 3 5"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert [i for i, text in out.items() if text == ""] == [len(lines) - 1]


def test_line_dedup_loses_no_line_alike_in_words(spark):
    """Every word pair is in most lines, so that near lines are far apart in any order of a group."""
    rng = random.Random(8)
    vocabulary = ["above", "child", "fritz", "jumpy", "known", "sqlgg"]
    docs = []
    for size in (5, 6, 9, 20, 33):
        lines = [[rng.choice(vocabulary) for _ in range(size)] for _ in range(60)]
        changed = [[f"new{i}x{k}" if k in at else w for k, w in enumerate(line)] for i, line in enumerate(lines) for at in [set(rng.sample(range(size), size // 5))]]
        docs += [(len(docs) + i, i >= 60, " ".join(w)) for i, w in enumerate(lines + changed)]
    out = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, changed boolean, text string"))
    assert [r["doc_id"] for r in out.filter("changed and text <> ''").collect()] == []


def test_line_dedup_repeats_no_group_of_few_members(spark):
    """A group is only repeated for parts of its pairs where it has many members."""
    sizes = [2, 65, 1000, 1024, 5000, 100_000]
    out = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", line_dedup.parts(F.col("n")).alias("parts")).collect()
    assert [r["parts"] for r in out] == [1, 1, 1, 2, 5, 98]


def test_line_dedup_verifies_all_pairs_in_parts(spark, monkeypatch):
    """The texts of all pairs aren't shuffled at once, and no pair is left out."""
    monkeypatch.setattr(line_dedup, "PAIRS_A_TEXT", 2)
    lines = [f"one two three four five six seven eight nine word{i % 2} {'x' * (i % 3)}" for i in range(12)] + ["quite another line of several words here"]
    texts = spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "node long, words array<string>")
    pairs = spark.createDataFrame([(i, j) for j in range(13) for i in range(j)], "x long, y long")
    links, staged = line_dedup.verified(pairs, texts, 0.8)
    assert len(staged) == 4 and sorted(map(tuple, links.collect())) == [(i, j) for i in range(12) for j in range(i + 1, 12)]


def test_mixing_refuses_too_many_epochs_and_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a" if i else "b") for i in range(2000)], "doc_id long, source string")
    with pytest.raises(ValueError, match="more than 3 times.*'b'"):
        mixing.mix_sources(docs, weights={"a": 1, "b": 1}, block=10, most_epochs=3)
    assert mixing.mix_sources(docs, weights={"a": 1, "b": 1}, block=10, most_epochs=200).filter("source = 'b'").count() > 100
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    with pytest.raises(ValueError, match="over 1 values"):
        mixing.mix_sources(docs)
