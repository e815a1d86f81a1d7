"""Language-model scores of documents: cross-entropy differences of matched n-gram models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, free_shuffles, pick, stage, text_bytes, windows_hash

#: Bytes of text of a part of the corpus, and weight of the word model in the pair model, in words.
PART_BYTES, PRIOR = 6 << 20, 8.0
#: Leading bytes of an n-gram's hash that travel; byte by byte, for those of sorted hashes compress.
KEY_BYTES = 7

SENT = "bucket int, part int, keys binary, counts binary"
RETURNED = "part int, bucket int, counts binary, words long, tokens long, target_tokens long"


class Grams:
    """Words and word pairs of the texts of a part: hashes of the distinct ones and where they stand."""

    def __init__(self, texts: list[bytes]) -> None:
        words = Words(texts, lower=True)
        self.doc, self.first = words.doc, words.first
        one = words.hashes()
        two = windows_hash(one, 2)
        self.pair_at = np.flatnonzero(words.doc[1:] == words.doc[:-1]) + 1 if len(one) > 1 else np.zeros(0, dtype=np.int64)
        # Of the leading bytes the lowest bit tells words from pairs.
        last, rest = np.uint64(8 * (8 - KEY_BYTES)), ~np.uint64((1 << 8 * (8 - KEY_BYTES) + 1) - 1)
        hashes = np.concatenate([one & rest, two[self.pair_at - 1] & rest | np.uint64(1) << last])
        self.distinct, self.place = np.unique(hashes, return_inverse=True)
        self.gram_doc = np.concatenate([self.doc, self.doc[self.pair_at]])

    def buckets(self, number: int) -> np.ndarray:
        """Bucket of each distinct hash, ascending as the hashes are."""
        return ((self.distinct >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int64)


def texts_of(docs: pa.Table) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in docs.column("text").to_pylist()]


def members(docs: pa.Table, targets: pa.Table) -> np.ndarray:
    """Which documents belong to the target corpus."""
    wanted = set(targets.column("id").to_pylist())
    return np.fromiter((i in wanted and i is not None for i in docs.column("id").to_pylist()), dtype=bool, count=docs.num_rows)


def count_part(docs: pa.Table, targets: pa.Table, buckets: int) -> pa.Table:
    """Distinct n-grams of a part with their counts in all and in target documents, by bucket."""
    names = [c.split()[0] for c in SENT.split(", ")]
    if not docs.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})
    grams = Grams(texts_of(docs))
    pack = zstandard.ZstdCompressor(level=1)
    chosen = members(docs, targets)[grams.gram_doc]
    size = len(grams.distinct)
    counts = np.stack([np.bincount(grams.place, minlength=size), np.bincount(grams.place[chosen], minlength=size)]).astype("<u4")
    keys = grams.distinct.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].T
    bucket = grams.buckets(buckets)
    start = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    out: list[list] = [[], [], [], []]
    part = docs.column("part")[0].as_py()
    for a, b in zip(start, [*start[1:], size], strict=True):
        row = (int(bucket[a]), part, pack.compress(np.ascontiguousarray(keys[:, a:b]).tobytes()), pack.compress(np.ascontiguousarray(counts[:, a:b]).tobytes()))
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def sum_bucket(sent: pa.Table) -> pa.Table:
    """Counts in all other parts of a bucket's n-grams, for each part in the order in which it sent them.

    Most n-grams stand in one part only, so most of these are zero and compress to nothing.
    """
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    keys, counts, sizes = [], [], []
    for row in sent.select(["keys", "counts"]).to_pylist():
        raw = np.frombuffer(unpack.decompress(row["keys"]), dtype=np.uint8).reshape(KEY_BYTES, -1)
        size = raw.shape[1]
        wide = np.zeros((size, 8), dtype=np.uint8)
        wide[:, :KEY_BYTES] = raw.T
        keys.append(wide.view(">u8").ravel().astype(np.uint64))
        counts.append(np.frombuffer(unpack.decompress(row["counts"]), dtype="<u4").reshape(2, -1))
        sizes.append(size)
    key, count = np.concatenate(keys), np.concatenate(counts, axis=1)
    distinct, place = np.unique(key, return_inverse=True)
    total = np.stack([np.bincount(place, weights=c, minlength=len(distinct)) for c in count])
    word = distinct >> np.uint64(8 * (8 - KEY_BYTES)) & np.uint64(1) == 0
    back = total[:, place].astype("<u4") - count
    ends = np.cumsum(sizes)
    blobs = [pack.compress(np.ascontiguousarray(back[:, b - n : b]).tobytes()) for n, b in zip(sizes, ends.tolist(), strict=True)]
    # The bucket's totals go along with its first row.
    first = np.arange(len(sizes)) == 0
    return pa.table({
        "part": sent.column("part"),
        "bucket": sent.column("bucket"),
        "counts": pa.array(blobs, pa.binary()),
        "words": pa.array(first * int(word.sum()), pa.int64()),
        "tokens": pa.array(first * int(total[0, word].sum()), pa.int64()),
        "target_tokens": pa.array(first * int(total[1, word].sum()), pa.int64()),
    })


def losses(count: np.ndarray, history: np.ndarray, word: np.ndarray, tokens: np.ndarray, words: int, prior: float) -> np.ndarray:
    """-log of the probability of each word: pair counts smoothed by the word model, that by one of all words."""
    single = (word + 1.0) / (tokens + max(words, 1))
    return -np.log((count + prior * single) / (history + prior))


def score_part(docs: pa.Table, returned: pa.Table, totals: dict[str, int], prior: float) -> pa.Table:
    """Losses of a part's documents under both models, each document left out of what scores it."""
    if not docs.num_rows:
        return pa.table({"id": docs.column("id"), "n_tokens": pa.array([], pa.int64()), "target_loss": pa.array([], pa.float64()), "background_loss": pa.array([], pa.float64())})
    grams = Grams(texts_of(docs))
    counted = returned.filter(pa.compute.is_valid(returned.column("counts"))).sort_by("bucket")
    unpack = zstandard.ZstdDecompressor()
    blobs = [np.frombuffer(unpack.decompress(b), dtype="<u4").reshape(2, -1) for b in counted.column("counts").to_pylist()]
    count = np.concatenate(blobs, axis=1).astype(np.float64) if blobs else np.zeros((2, 0))
    chosen = members(docs, returned.filter(pa.compute.is_valid(returned.column("id"))))
    n_docs, n_words, size = docs.num_rows, len(grams.doc), max(len(grams.distinct), 1)
    if blobs:  # what the part itself adds
        count += np.stack([np.bincount(grams.place, minlength=size), np.bincount(grams.place[chosen[grams.gram_doc]], minlength=size)])
    # How often each document has the n-gram itself.
    _, where, times = np.unique(grams.gram_doc * size + grams.place, return_inverse=True, return_counts=True)
    own = times[where].astype(np.float64)
    own_tokens = np.diff(grams.first)[grams.doc].astype(np.float64)
    inside = chosen[grams.doc].astype(np.float64)
    one, two = grams.place[:n_words], grams.place[n_words:]
    total, target_total = totals["tokens"], totals["target_tokens"]
    scale = target_total / max(total, 1)
    sums = []
    for k, (own_share, size_scale, everything) in enumerate(((np.ones(n_words), scale, total), (inside, 1.0, target_total))):
        word = np.maximum(count[k][one] - own[:n_words] * own_share, 0) * size_scale
        tokens = np.maximum(everything - own_tokens * own_share, 0) * size_scale
        pair, history = np.zeros(n_words), np.zeros(n_words)
        at = grams.pair_at
        pair[at] = np.maximum(count[k][two] - own[n_words:] * own_share[at], 0) * size_scale
        history[at] = word[at - 1]
        loss = losses(np.minimum(pair, history), history, word, tokens, totals["words"], prior)
        sums.append(np.bincount(grams.doc, weights=loss, minlength=n_docs))
    n = np.diff(grams.first)
    mean = [np.where(n > 0, s / np.maximum(n, 1), np.nan) for s in sums]
    return pa.table({
        "id": docs.column("id"),
        "n_tokens": pa.array(n, pa.int64()),
        "target_loss": pa.array(mean[1], pa.float64(), from_pandas=True),
        "background_loss": pa.array(mean[0], pa.float64(), from_pandas=True),
    })


def cross_entropy_difference(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_id_col: str = "doc_id",
    prior: float = PRIOR,
) -> DataFrame:
    """A row per row of `docs`: id, n_tokens, target_loss, background_loss and score.

    Two pair models share one vocabulary, all words of `docs`: the target model counts the documents whose ids
    `targets` lists, the background model all documents, its counts scaled to the target's number of words, so
    both smooth alike. Losses are nats a word, of the document's words under models without it;
    score = background_loss - target_loss is high for texts like the target's.

    The corpus is dealt into parts of about PART_BYTES of text. Each part sends its distinct words and
    pairs with their counts to buckets by hash and gets the corpus counts of just those back; what is
    exchanged grows with the corpus, and nothing of its size is broadcast or held by one task. N-grams are
    told apart by 56 bits. What a part sends and gets is cut into as many parcels as there are parts.

    Null and empty texts have n_tokens 0 and null losses and score. Null ids are in no target. Rows that
    repeat an id are documents of their own, in the target if the id is. Without target documents both models
    are uniform and scores are 0. An empty table gives an empty result. Further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col)
    number = max(1, -(-text_bytes(rows) // PART_BYTES))
    part = F.pmod(F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("text")), F.lit(number)).cast("int").alias("part")
    rows = rows.select("id", "text", part)
    ids = pick(targets, id=target_id_col).filter("id is not null").distinct()
    ids = ids.select(F.pmod(F.xxhash64(F.col("id").cast(rows.schema["id"].dataType)), F.lit(number)).cast("int").alias("part"), F.col("id").cast(rows.schema["id"].dataType))
    sent = rows.groupBy("part").cogroup(ids.groupBy("part")).applyInArrow(lambda d, t: count_part(d, t, number), SENT)
    returned = stage(sent.groupBy("bucket").applyInArrow(sum_bucket, RETURNED))
    totals = returned.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "target_tokens")]).first().asDict()
    free_shuffles(docs.sparkSession)  # texts and n-grams of the counts, before texts are dealt again
    answers = returned.select("part", "bucket", "counts").unionByName(ids, allowMissingColumns=True)
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        lambda d, r: score_part(d, r, totals, prior), f"id {id_type}, n_tokens long, target_loss double, background_loss double"
    )
    return out.withColumn("score", F.col("background_loss") - F.col("target_loss")).withColumnRenamed("id", id_col)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS good,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents
), t AS (
  SELECT doc_id, good, len(w) AS n, w[p] AS x, CASE WHEN p > 1 THEN w[p - 1] END AS v
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d)
), one AS (SELECT x, count(*) AS c, count(*) FILTER (good) AS g FROM t GROUP BY x),
own AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY ALL),
two AS (SELECT v, x, count(*) AS c, count(*) FILTER (good) AS g FROM t WHERE v IS NOT NULL GROUP BY ALL),
pairs AS (SELECT doc_id, v, x, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY ALL),
z AS (SELECT CAST(count(*) AS DOUBLE) AS total, CAST(count(*) FILTER (good) AS DOUBLE) AS target, count(DISTINCT x) AS words FROM t),
s AS (
  SELECT t.doc_id, t.n, target / total AS scale, words, total, target, CAST(t.good AS INT) AS inside,
         one.c - own.c AS c1, one.g - own.c * CAST(t.good AS INT) AS g1,
         coalesce(two.c - pairs.c, 0) AS c2, coalesce(two.g - pairs.c * CAST(t.good AS INT), 0) AS g2,
         coalesce(h.c - ho.c, 0) AS ch, coalesce(h.g - ho.c * CAST(t.good AS INT), 0) AS gh
  FROM t JOIN one ON one.x = t.x JOIN own ON own.doc_id = t.doc_id AND own.x = t.x
  LEFT JOIN two ON two.v = t.v AND two.x = t.x LEFT JOIN pairs ON pairs.doc_id = t.doc_id AND pairs.v = t.v AND pairs.x = t.x
  LEFT JOIN one h ON h.x = t.v LEFT JOIN own ho ON ho.doc_id = t.doc_id AND ho.x = t.v, z
), l AS (
  SELECT doc_id,
    -ln((least(c2, ch) * scale + {PRIOR} * ((c1 * scale + 1) / ((total - n) * scale + words))) / (ch * scale + {PRIOR})) AS b,
    -ln((least(g2, gh) + {PRIOR} * ((g1 + 1) / (target - n * inside + words))) / (gh + {PRIOR})) AS a
  FROM s
), m AS (SELECT doc_id, avg(a) AS a, avg(b) AS b FROM l GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(a, 6) AS target_loss, round(b, 6) AS background_loss, round(b - a, 6) AS score
FROM d LEFT JOIN m USING (doc_id)
"""
