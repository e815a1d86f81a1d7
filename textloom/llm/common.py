"""Helpers that several of the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that a Python task handles at once.
CHUNK_BYTES = 2 << 20
#: Words whose bytes are spread to 64 bits at once.
BLOCK_WORDS = 1 << 16


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The columns that `columns` names (new name = name in `df`) and no others.

    Columns are found by position, so further columns whose names clash (in another case, or
    twice the same) do no harm; of several equal names the first counts.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()])


def with_row(df: DataFrame, **columns: str) -> DataFrame:
    """Like `pick`, with the whole row beside them as the struct `row` (fields c0, c1, ...)."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(
        F.struct(*plain.columns).alias("row"),
        *[F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()],
    )


def only_row(df: DataFrame, names: list[str]) -> DataFrame:
    """Undoes `with_row`: the original columns in the original order."""
    return df.select("row.*").toDF(*names)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    A text of one byte per character is ASCII, where `lower` does the same and is faster.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`).

    Only a local session without that setting (as in a test) takes a folder of this machine; on a cluster,
    where executors would each write to a disk of their own, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are done: it does so once the driver has collected its garbage.

    Those of the plan that ended last may still be held by its closing events; a later call frees them.
    """
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it again.

    This cuts the lineage at data that outlives any executor, and lets the optimizer see real sizes. The shuffle
    files behind it are of no more use.
    """
    path = shared_dir(df.sparkSession)
    free_shuffles(df.sparkSession)
    df.write.options(**options).parquet(path)
    free_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes the files of tables that `stage` returned, once nothing reads them any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(texts: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes the number of buckets to the data."""
    return texts.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Cuts Arrow batches into (record batch, list of UTF-8 texts) of about `most` bytes of text.

    A longer text makes a chunk of its own; null becomes the empty text.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("" if pa.types.is_string(texts.type) else b"")
        texts = texts.cast(pa.binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first), texts.slice(first, last - first).to_pylist()
            first = last


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a list of UTF-8 texts, as numpy arrays.

    text   all words, each followed by one space, as bytes (`data` is the same as an array)
    start  where each word starts in `text`
    end    where it ends (the place of its space)
    doc    index of its text, ascending
    first  index of the first word of each text, with the number of words at the end
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        keep = ~space | ~before
        starts = np.flatnonzero(~space & before)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        text_start = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.doc = np.searchsorted(text_start, starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.data = np.where(space, np.uint8(32), raw)[keep]
        self.text = self.data.tobytes()
        ends = np.flatnonzero(self.data == 32)
        self.end = ends
        self.start = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self), dtype=np.uint64)
        for a in range(0, len(self), BLOCK_WORDS):  # the arrays below are wider than the text
            start, end = self.start[a : a + BLOCK_WORDS], self.end[a : a + BLOCK_WORDS]
            length = end - start + 1
            data = self.data[start[0] : end[-1] + 1].astype(np.uint64) + np.uint64(1)
            power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
            place = np.arange(len(data)) - np.repeat(start - start[0], length)
            out[a : a + BLOCK_WORDS] = np.add.reduceat(data * power[place], start - start[0])
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive word hashes, for each place where so many words are left."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)
