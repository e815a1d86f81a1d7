"""Removal of repeated word windows: super-k-mer partitioning and exact counting in buckets."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, pick, text_bytes, windows_hash

#: Words of a window, and of the pieces whose smallest hash is a window's minimiser.
WINDOW, PIECE = 13, 3
#: Most windows of one super-k-mer, text that a map task gathers before it sends, and text of a bucket.
RUN, GATHER_BYTES, BUCKET_BYTES = 64, 12 << 20, 2 << 20

PARCELS = "bucket int, strings binary, docs binary, versions binary, starts binary, counts binary"
SPANS = "id long, version long, first int, last int"


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive values."""
    done, out = 1, x
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def super_kmers(words: Words, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first word and number of windows of each run of windows that share a minimiser."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    least = sliding_min(windows_hash(words.hashes(), piece), window - piece + 1)
    inside = words.doc[:n] == words.doc[window - 1 :]
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (words.doc[1:n] != words.doc[: n - 1])
    at = np.arange(n)
    run_start = np.maximum.accumulate(np.where(new, at, 0))
    new |= (at - run_start) % RUN == 0
    new &= inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(~inside | new)  # a run ends where the next begins or the document's windows end
    after = np.searchsorted(stop, first, side="right")
    ends = np.append(stop, n)[after]
    return least[first], first, ends - first


def parcels(batches: Iterator[pa.RecordBatch], buckets: int, window: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Cuts texts into super-k-mers and sends them to the buckets of their minimisers.

    Within what a task gathers, a string is sent for its smallest id only; the other holders of it are
    known to repeat it, and go along as finished spans, to buckets by their ids. A string that a third
    of all documents share thus arrives once for each gathered part.
    """
    pack = zstandard.ZstdCompressor(level=3)
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("strings", "docs", "versions", "starts", "counts"))])

    def send(strings: list, minimisers: list, holders: list) -> Iterator[pa.RecordBatch]:
        minimiser, held = np.concatenate(minimisers), np.concatenate(holders)
        least: dict[bytes, int] = {}
        for s, doc in zip(strings, held["id"].tolist(), strict=True):
            if doc < least.get(s, doc + 1):
                least[s] = doc
        own = np.fromiter((least[s] for s in strings), dtype=np.int64, count=len(strings)) == held["id"]
        to = np.where(own, minimiser % np.uint64(buckets), held["id"].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((~own, to))
        bounds = np.append(np.flatnonzero(np.diff(to[order], prepend=-1)), len(order))
        out = defaultdict(list)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = order[a:b]
            sent = rows[own[rows]]
            part = held[rows]
            out["bucket"].append(int(to[rows[0]]))
            out["strings"].append(pack.compress(b"\n".join([strings[i] for i in sent])) if len(sent) else None)
            for column, field in (("docs", "id"), ("versions", "version"), ("starts", "start"), ("counts", "count")):
                out[column].append(pack.compress(np.ascontiguousarray(part[field]).tobytes()))
        yield pa.RecordBatch.from_pydict(dict(out), schema=schema)

    kind = np.dtype([("id", np.int64), ("version", np.int64), ("start", np.int32), ("count", np.int32)])
    strings, minimisers, holders, gathered = [], [], [], 0
    for batch, texts in chunks(batches):
        words = Words(texts)
        minimiser, first, count = super_kmers(words, window, piece)
        if not len(first):
            continue
        doc = words.doc[first]
        part = np.empty(len(first), dtype=kind)
        part["id"] = batch.column("id").to_numpy(zero_copy_only=False)[doc]
        part["version"] = batch.column("version").to_numpy(zero_copy_only=False)[doc]
        part["start"], part["count"] = first - words.first[doc], count
        text = words.text
        strings += [text[a:b] for a, b in zip(words.start[first].tolist(), words.end[first + count + window - 2].tolist(), strict=True)]
        minimisers.append(minimiser)
        holders.append(part)
        gathered += sum(map(len, texts))
        if gathered >= GATHER_BYTES:
            yield from send(strings, minimisers, holders)
            strings, minimisers, holders, gathered = [], [], [], 0
    if strings:
        yield from send(strings, minimisers, holders)


def repeated_spans(table: pa.Table, window: int) -> pa.Table:
    """Spans of words that windows cover which start in a document of a smaller id, of one bucket.

    Windows are sorted by a 64-bit hash; where hashes are equal, the words themselves are compared.
    """
    unpack = zstandard.ZstdDecompressor()
    whole = []
    texts, ids, versions, starts = [], [], [], []
    for row in table.to_pylist():
        held = [np.frombuffer(unpack.decompress(row[c]), dtype=t) for c, t in (("docs", np.int64), ("versions", np.int64), ("starts", np.int32), ("counts", np.int32))]
        sent = 0
        if row["strings"] is not None:
            texts += unpack.decompress(row["strings"]).split(b"\n")
            sent = len(texts) - sum(map(len, ids))
            for store, values in zip((ids, versions, starts), held, strict=False):
                store.append(values[:sent])
        whole.append([x[sent:] for x in held])
    doc, version, start, count = (np.concatenate(x) for x in zip(*whole, strict=True))
    found = [(doc, version, start, start + count - 1)]
    if texts:
        words = Words(texts)
        doc, version, start = np.concatenate(ids), np.concatenate(versions), np.concatenate(starts)
        code = windows_hash(words.hashes(), window)
        at = np.flatnonzero(words.doc[: len(code)] == words.doc[window - 1 :])
        code = code[at]
        order = np.argsort(code, kind="stable")
        ordered = code[order]
        same = ordered[1:] == ordered[:-1]
        several = np.zeros(len(order), dtype=bool)
        several[1:] |= same
        several[:-1] |= same
        rows = at[order[several]]  # first words of windows that may occur again
        entry = words.doc[rows]
        holder = doc[entry]
        text = words.text
        spelled = [text[a:b] for a, b in zip(words.start[rows].tolist(), words.end[rows + window - 1].tolist(), strict=True)]
        least: dict[bytes, int] = {}
        for s, d in zip(spelled, holder.tolist(), strict=True):
            if d < least.get(s, d + 1):
                least[s] = d
        again = np.fromiter((least[s] for s in spelled), dtype=np.int64, count=len(spelled)) < holder
        rows, entry = rows[again], entry[again]
        place = start[entry] + (rows - words.first[entry])
        found.append((doc[entry], version[entry], place, place))
    doc, version, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, version, doc))
    doc, version, first, last = doc[order], version[order], first[order], last[order]
    if len(doc):  # neighbouring windows make one span
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (first[1:] > last[:-1] + 1)
        head = np.flatnonzero(new)
        doc, version, first, last = doc[head], version[head], first[head], np.maximum.reduceat(last, head)
    return pa.table({"id": doc, "version": version, "first": first.astype(np.int32), "last": (last + window - 1).astype(np.int32)})


def without_spans(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans."""
    for batch, texts in chunks(batches):
        words = Words(texts)
        spans = batch.column("spans")
        removed = np.zeros(len(words) + 1, dtype=np.int64)
        for i, own in enumerate(spans.to_pylist()):
            for span in own or ():
                removed[words.first[i] + span["first"]] += 1
                removed[words.first[i] + span["last"] + 1] -= 1
        stays = np.cumsum(removed[:-1]) == 0
        kept = words.data[np.repeat(stays, words.end - words.start + 1)].tobytes()
        size = np.concatenate(([0], np.cumsum((words.end - words.start + 1) * stays)))
        cut = [kept[a : max(a, b - 1)] for a, b in zip(size[words.first[:-1]].tolist(), size[words.first[1:]].tolist(), strict=True)]
        total = np.diff(words.first)
        out = {
            "id": batch.column("id"),
            "n_words": pa.array(total, pa.int64()),
            "n_removed": pa.array(total - np.diff(np.concatenate(([0], np.cumsum(stays)))[words.first]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in cut], pa.string()),
        }
        if keep_text:
            out["kept_text"] = pa.array(cut, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict(out)


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    piece: int = PIECE,
    keep_text: bool = True,
) -> DataFrame:
    """Removes each word that a window of `window` words covers which also starts in a smaller id.

    Returns a row per row of `docs`: the id, n_words, n_removed, kept_sha256 and (keep_text) kept_text,
    the kept words joined by one space. Words are `[^\\x20\\x09-\\x0D]+`; windows are those of the input.

    Consecutive windows with one minimiser (the smallest hash of their runs of `piece` words) travel to
    the bucket of the minimiser as one string; equal windows have equal minimisers and so meet. Buckets
    sort their windows and compare equal hashes word by word. The number of buckets follows the bytes of
    text. A span only goes back to documents that lose words.

    Null texts have no words. A null id is smaller than no other and has no smaller one: its text stays
    whole and removes nothing. Rows that repeat an id don't remove each other's words; each keeps its
    own text, spans being joined by id and text hash. An empty table gives an empty result. Ids are
    integers. Further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col)
    # A hash of the text tells rows of one id apart; where no id repeats, it would only be carried along.
    repeated = not rows.groupBy("id").count().filter("count > 1 and id is not null").isEmpty()
    rows = rows.select("id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("version"), "text")
    id_type = rows.schema["id"].dataType
    rows = rows.withColumn("id", F.col("id").cast("long"))
    buckets = max(1, -(-text_bytes(rows) // BUCKET_BYTES))
    sent = rows.filter("id is not null and text is not null").mapInArrow(
        lambda batches: parcels(batches, buckets, window, piece), PARCELS
    )
    spans = (
        sent.groupBy("bucket")
        .applyInArrow(lambda table: repeated_spans(table, window), SPANS)
        .groupBy("id", "version")
        .agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    out = rows.join(spans, ["id", "version"], "left").mapInArrow(lambda batches: without_spans(batches, keep_text), schema)
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13
), k AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM g
), r AS (
  SELECT doc_id, p, doc_id > min(doc_id) OVER (PARTITION BY s) AS again FROM k
), c AS (
  SELECT DISTINCT doc_id, p + i AS p FROM r, range(0, 13) AS t(i) WHERE again
), l AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""
