"""Substring dedup, exact dedup, license scan and SimHash groups against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, license_scan, simhash_dedup, substring_dedup
from textloom.llm.components import connected_components

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UP, LOW))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    """Documents with copies, shared passages, odd characters, nulls, ties and repeated rows."""
    rng = random.Random(7)
    vocabulary = ["the", "of", "Été", "naïve", "ß", "x" * 40, "a", "b", "日本語", "\x1c", "\xa0y", "K", "it's", "--"]
    vocabulary += ["".join(rng.choice(LOW) for _ in range(rng.randint(2, 7))) for _ in range(200)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))

    texts = [prose(rng.randint(0, 120)) for _ in range(60)]
    texts += [t.upper() if k % 2 else t for k, t in enumerate(texts[:12])]
    texts += [prose(20) + passage.replace(" ", "\n") + " " + prose(k) for k in range(12)]
    texts += [passage + " " + " ".join(passage.split()[:k]) for k in range(5)]
    texts += ["", None, " ", "one", "one two", "ONE two", "go " * 300, "go " * 300 + "on", prose(9000)]
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (rows[3][0], "another text of an id that repeats " * 4), (None, texts[2]), (None, None), (None, texts[2])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, "x") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, row int, DOC_ID string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substring_dedup(docs):
    rows = corpus()
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    expected = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    for piece in (3, 13):
        found = [tuple(r) for r in substring_dedup.substring_dedup(docs, piece=piece).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_substring_dedup_empty(nothing):
    assert substring_dedup.substring_dedup(nothing).collect() == []


@pytest.mark.parametrize("stays", ["min", "max"])
@pytest.mark.parametrize("digest", [exact_dedup.content_hash, F.length], ids=["md5", "colliding"])
def test_exact_dedup(docs, stays, digest):
    rows = corpus()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    keep = {t: {"min": min, "max": max}[stays]((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected, kept_before = [], set()
    for i, t in rows:
        norm = lower(t)
        kept = i == keep[norm] and norm not in kept_before
        kept_before |= {norm} if kept else set()
        expected.append((i, keep[norm], len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    found = [tuple(r) for r in exact_dedup.exact_dedup(docs, stays=stays, digest=digest).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_exact_dedup_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_groups(docs):
    rows = [(i, fingerprint(t)) for i, t in corpus()]
    group = components(sorted({fp for _, fp in rows}), lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[group[fp]] = min(i, least.get(group[fp], i))
    expected = [(i, fp, least.get(group[fp])) for i, fp in rows]
    found = [(r["id"], r["fp"] % 2**64, r["component_id"]) for r in simhash_dedup.simhash_groups(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_near_dedup_keeps_one_of_each_group(docs, nothing):
    groups = {(r["component_id"], r["fp"] if r["component_id"] is None else 0) for r in simhash_dedup.simhash_groups(docs).collect()}
    kept = simhash_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)
    assert simhash_dedup.near_dedup(nothing).collect() == []


@pytest.mark.parametrize("bucket", [40, 2048])
def test_hamming_links_find_every_component(spark, bucket):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(40)}
    center = rng.getrandbits(64)
    for fp in [*list(prints)[:20], *[center] * 120]:  # clusters, and one large cluster
        for _ in range(rng.randint(1, 3)):
            fp ^= 1 << rng.randrange(64)
            prints.add(fp)
    values = sorted(fp - 2**64 if fp >> 63 else fp for fp in prints)
    expected = components(values, lambda a, b: bin((a ^ b) % 2**64).count("1") <= 2)
    links = simhash_dedup.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long"), bucket=bucket)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {v: found.get(v, v) for v in values} == expected


def test_allocation_is_a_cover():
    total, thresholds = simhash_dedup.allocate([[1, 5, 9], [2, 3, 4], [7, 7, 7]], 2)
    assert sum(t + 1 for t in thresholds) == 3
    assert total == 4 and thresholds == [-1, 2, -1]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (None, 3), (200, 90), (90, 200)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 200: 90, 90: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_license_scan_base_places(spark):
    mit = license_scan.TEMPLATES["mit"].upper().replace(" ", ", ")
    texts = [
        "Under the MIT license. under the-mit (License)! under the mit",
        "Apache License, Version 2.0; cc-by-nc cc by nc by nc",
        mit,
        mit.replace("COPY", "duplicate", 1).replace("SUBLICENSE", "sub lease or lend"),
        "cc by nc under the mit license " * 50,
        "underé the mit license; under the mit licenseé",
        "",
        None,
        "word",
    ]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, texts[1], "")]
    found = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, place string")).collect()
    assert len(found) == len(rows)
    for r in found:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else texts[1]
        w = license_words(text)
        places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["labels"] == "mit" and by_id[2]["base_labels"] == "" and by_id[2]["score"] == 1
    assert by_id[3]["labels"] == "mit" and 0.6 <= by_id[3]["score"] < 1
    assert by_id[8]["labels"] == "" and by_id[8]["score"] == 0


def test_license_scan_empty(nothing):
    assert license_scan.license_scan(nothing).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("all rights reserved " * 6, ""),
        ("copy of the license " * 9, ""),
        ("all rights reserved " * 6 + "no part of this publication may be reproduced", "all-rights-reserved"),
        ("creative commons attribution " * 8, ""),
        ("x " + license_scan.TEMPLATES["cc-by"], "cc-by"),
        ("x " + license_scan.TEMPLATES["cc-by-nc"] + " y", "cc-by-nc"),
        (license_scan.TEMPLATES["cc-by"] + " and so on " * 9 + license_scan.TEMPLATES["cc-by-nc"], "cc-by,cc-by-nc"),
        (license_scan.TEMPLATES["mit"].replace("free of charge", "without any charge at all"), "mit"),
    ],
)
def test_license_spans_are_verified(spark, text, labels):
    docs = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    found = license_scan.license_scan(docs).orderBy("doc_id").collect()
    assert [r["labels"] for r in found] == [labels, labels, ""]
