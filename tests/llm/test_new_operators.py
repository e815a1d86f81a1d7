"""URL filters, fill-in-the-middle and periodic runs against plain Python, and their odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import fill_middle, periodic_runs, queries, similar, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_trial(words, length=6, repeats=4):
    """All runs, by comparing words for each period."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if size >= max(length, repeats * q):
                found.setdefault((start, size), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def without_repeats(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_are_those_of_trial():
    import numpy as np

    chance = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(chance.randint(1, 6)):
            size, kinds = chance.randint(0, 60), chance.randint(1, 3)
            words = [chance.randrange(kinds) for _ in range(size)]
            if size and chance.random() < 0.6:
                period = chance.randint(1, 7)
                words = [words[i % min(period, size)] if chance.random() < 0.95 else chance.randrange(kinds) for i in range(size)]
            texts.append(words)
        repeats, length = chance.choice([2, 3, 4]), chance.choice([1, 6])
        found = periodic_runs.runs_of([np.array(t, dtype=np.int64) for t in texts], length, repeats)
        for words, runs in zip(texts, found, strict=True):
            expected = sorted(runs_by_trial(words, length, repeats), key=lambda r: (r[0], r[2]))
            assert [tuple(r) for r in runs.tolist()] == expected


def test_runs_over_arrays_and_block_borders(monkeypatch):
    """The way of long texts: loops over arrays, words split in blocks, ranges over several blocks of the index."""
    import numpy as np

    monkeypatch.setattr(periodic_runs, "LISTED", 10)
    monkeypatch.setattr(periodic_runs, "SPLIT", 7)
    monkeypatch.setattr(periodic_runs, "RANGE", 4)
    text = " ".join(["alpha", "b", "gamma"] * 40 + ["x", "y"] * 9 + list("abcdef"))
    known = {}
    ids = periodic_runs.word_ids(text.encode(), known)
    assert [list(known)[k].decode() for k in ids] == text.split()
    (runs,) = periodic_runs.runs_of([np.asarray(ids)])
    assert [tuple(r) for r in runs.tolist()] == runs_by_trial(text.split())


def test_runs_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n\t ", 1), (None, "a a a a a a a", 1), (4, "a " * 9 + "b", 2), (4, "a " * 9 + "b", 2), (5, "x\u00a0y " * 6, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").withColumn("more", F.lit("clash"))
    docs = docs.toDF("doc_id", "text", "ID", "Text")
    found = {(r["id"], r["n_words"]): r for r in periodic_runs.periodic_runs(docs).collect()}
    assert found[1, 0]["runs"] == found[2, 0]["runs"] == found[3, 0]["runs"] == [] and found[1, 0]["text"] == "" and found[1, 0]["strongest"] is None
    assert found[None, 7]["text"] == "a" and tuple(found[None, 7]["strongest"]) == (0, 7, 1)
    assert found[4, 10]["text"] == "a b" and found[5, 6]["text"] == "x\u00a0y"
    assert periodic_runs.periodic_runs(docs).count() == len(rows)
    assert periodic_runs.periodic_runs(docs.filter("false")).collect() == []


def test_runs_of_a_very_long_text(spark):
    chance = random.Random(3)
    noise = [f"w{chance.randrange(10**6)}" for _ in range(150_000)]
    words = noise[:70_000] + ["p", "q", "r"] * 5_000 + noise[70_000:] + [f"t{i % 2_000}" for i in range(9_001)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periodic_runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(70_000, 15_000, 3), (165_000, 9_001, 2_000)]
    assert row["text"].split() == words[:70_003] + words[85_000:167_000]


def test_query_of_runs(spark, tmp_path):
    chance = random.Random(5)
    rows = [(i, " ".join(chance.choice("abcde") * chance.randint(1, 2) for _ in range(chance.randint(0, 50)))) for i in range(150)]
    spark.createDataFrame([*rows, (None, "a b"), (500, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == 152
    changed = 0
    for doc_id, text in [*rows, (500, "")]:
        words = WORD.findall(text)
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = runs_by_trial(words)
        row = found[doc_id]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert row["n_runs"] == len(runs) and (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (None if not runs else 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(without_repeats(words, runs).encode()).hexdigest()
    assert changed > 5


def arranged(doc_id, text):
    """Form, parts and output by plain Python."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 5, 64, fill_middle.BLOCK])
def test_fill_in_middle(spark, block):
    chance = random.Random(block)
    texts = ["", None, "word", "a<S>b", "<<P", "S><M", "\n\n", "é😀 abc\r\nxyz", "x" * 300, "日本語 text " * 40, "<S<P<M" * 5]
    texts += ["".join(chance.choice("ab1 <>PSMé\n😀") for _ in range(chance.randint(0, 200))) for _ in range(120)]
    rows = [(None if i == 9 else i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, extra string")
    docs = docs.toDF("doc_id", "text", "TEXT")
    made = fill_middle.fill_in_middle(docs, block=block).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form")))
    found = made.collect()
    assert len(found) == len(rows) + 1
    by_id = {r["id"]: r for r in found}
    forms = set()
    for doc_id, text, _ in rows:
        r = by_id[doc_id]
        lengths = [None if r[c] is None else len(r[c]) for c in ("prefix", "middle")]
        assert (r["n"], r["form"], *lengths, r["output"]) == arranged(doc_id, text or "")
        assert r["restored"] == (text or "")
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.filter("false")).collect() == []


def test_sentinels_must_be_told_apart(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, sentinels=("aba", "x", "y"))
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, sentinels=("<a", "a>", "y"))
    other = fill_middle.fill_in_middle(docs.withColumn("doc_id", F.explode(F.sequence(F.lit(0), F.lit(50)))), sentinels=("[p]", "[s]", "[m]"))
    assert all(r["t"] == "abc" for r in other.select(fill_middle.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]")).alias("t")).collect())


def test_hosts_paths_and_rules(spark):
    urls = [
        ("https://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
        ("http://m.example.com/en/a", "m.example.com", "/en/a", "example.com/en/", "block"),
        ("http://notexample.com/en/a", "notexample.com", "/en/a", "com/", "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com?x=/b", "a.com", "", None, "allow"),
        ("ftp://x.net/es/9", "x.net", "/es/9", "net/es/", "block"),
        ("http://x.net/es", "x.net", "/es", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c", "b:", "//c", None, "allow"),
        ("http://É.COM/\u00c9", "É.com", "/É", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id long, url string, bad boolean")
    found = {r["id"]: r for r in url_filters.url_filter(pages).collect()}
    for i, (_, *expected) in enumerate(urls):
        assert [found[i][c] for c in ("host", "path", "rule", "verdict")] == expected
    assert url_filters.url_filter(pages.filter("false")).collect() == []


def test_templates_by_purity(spark):
    """A bad branch among good ones stays a branch and is rejected; like branches merge; small ones share their node's."""
    rows = []
    for lang in ("en", "de", "fr", "es"):
        rows += [(f"http://a.org/{lang}/{i}", i % 10 == 0) for i in range(100)]
    rows += [(f"http://a.org/offers/{i}", i % 10 != 0) for i in range(100)]
    rows += [(f"http://a.org/offers/{i}", None) for i in range(100, 140)]
    rows += [(f"http://a.org/slug-{chr(97 + i % 26)}x{i // 26}", None) for i in range(200)]
    rows += [("http://b.org/x/0f3a9c1b77", False), (None, None), ("http://b.org/" + "/".join("abcdefgh") + "/9", None)]
    rows = [(None if i % 50 == 0 else i, *r, "clash") for i, r in enumerate(rows)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean, extra string").toDF("page_id", "url", "bad", "URL")
    found = url_filters.url_filter(pages)
    assert found.count() == len(rows)
    templates = {(r["host"], r["template"]): r for r in found.select("host", "template", "verdict", "purity", "labelled").distinct().collect()}
    assert templates["a.org", "/offers/{n}"]["verdict"] == "block"
    assert templates["a.org", "/*/{n}"]["verdict"] == "allow" and templates["a.org", "/*/{n}"]["labelled"] == 400
    assert ("b.org", "/*/{c}") in templates and ("b.org", "/*/*/*/*/*/**") in templates and ("", "") in templates
    assert found.filter("path like '/offers/%' and verdict = 'block'").count() == 140
    assert found.filter("path not like '/offers/%' and verdict = 'block'").count() == 0


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/en/7.html"), (2, "http://a/99999999999999999999"), (3, None), (4, "http://a/en/8?n=7")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r["bad"] for r in url_filters.labelled_pages(pages, labels).collect()}
    assert found == {1: True, 2: None, 3: None, 4: False}


def test_salted_joins_are_no_broadcasts(spark, tmp_path):
    """Files of a few bytes a row would be broadcast with all their copies, which the driver can't hold."""
    spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels")
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.format_string("http://a/en/%d", F.col("id")).alias("url"))
    found = url_filters.labelled_pages(pages, spark.read.parquet(f"{tmp_path}/labels"))
    assert found.filter("bad = false").count() == 200
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def similar_by_trial(docs, similarity=0.8, shingle=5):
    """Smallest id of each document's group, by comparing all pairs of shingle sets."""
    sets = {}
    for doc_id, text in docs:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or sets[a] | sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("bucket", [2, 128])
def test_similar_texts_are_found(spark, bucket):
    """With buckets of two, heads and splits decide."""
    chance = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    shared = [chance.choice(words) for _ in range(30)]
    docs = []
    for k in range(12):
        base = [chance.choice(words) for _ in range(chance.randint(8, 90))] + (shared if k % 2 else [])
        for _ in range(6):
            text = list(base)
            for _ in range(chance.choice([0, 0, 1, 1, 2, 6])):
                text[chance.randrange(len(text))] = chance.choice(words)
            docs.append(" ".join(text))
    docs += ["", " \n", "Only Three Words", "only three words", "other three words"]
    rows = [(k, t) for k, t in enumerate(docs)]
    expected = similar_by_trial(rows)
    found = {r["doc_id"] for r in similar.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    assert found == {d for d, least in expected.items() if d == least}


def test_similar_dedup_of_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (3, "A b c d e f", 2), (3, "A b c d e f", 3), (None, None, 4), (7, "", 5), (8, "x", 6), (8, "y", 7), (None, "z", 8), (None, "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").toDF("doc_id", "text", "TEXT")
    found = sorted(((r[0], r[1]) for r in similar.similar_dedup(docs).collect()), key=str)
    assert found == sorted([(3, "A b c d e f"), (7, ""), (8, "x"), (8, "y"), (None, "z")], key=str)
    assert similar.similar_dedup(docs.filter("false")).collect() == []


def test_overlap_of_sketches():
    import numpy as np

    chance = np.random.default_rng(1)
    values = np.unique(chance.integers(0, 1 << 32, 6_000, dtype=np.uint32))
    one, two = np.sort(chance.permutation(values)[:5_000]), np.sort(chance.permutation(values)[:5_200])
    true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    found, rests_on = similar.overlap(one[:512], two[:512], 512)
    assert abs(found - true) < 0.08 and rests_on > 400
    assert similar.overlap(one[:100], one[:80], 512) == (0.8, 0)


def test_line_dedup_of_rows_without_ids(spark):
    """Two texts whose hashes share the 24 bits that an order of places holds."""
    from textloom.llm.line_dedup import line_dedup

    line = "one same line of several words"
    for ids in ((None, None), (1, 2), (1, 1)):
        docs = spark.createDataFrame([(ids[0], f"{line}\nunique number 7470"), (ids[1], f"{line}\nunique number 22056")], "doc_id long, text string")
        assert sorted(r["n_removed"] for r in line_dedup(docs).collect()) == [0, 1]
