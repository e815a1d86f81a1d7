"""Packing of documents into token sequences: large-item matching, then best fit."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks, pick, stage

CAPACITY, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers, and parts that the pieces of one length are numbered in.
REMEMBERED, PARTS = 500_000, 64
#: Letter words that the tokenizer gets as one text.
TOGETHER = 1000
#: Marks after a Latin letter and before white space, a piece of their own for the tokenizer. (Its normal form
#: of some other letters ends in a mark, which belongs to what follows.)
MARKS = re.compile(r"(?<=[a-zÀ-ÖØ-öø-ÿ])[.,;:!?$%&*#|]+(?=[ \n]|$)")

PIECES = "id {}, piece int, start long, length int, ids_crc32 long"


class Ids:
    """Ids of texts, remembered by word.

    The tokenizer lower-cases, drops white space and never joins what it separates, nor letters and the marks
    after them; so a text's ids are those of its runs between spaces, with such marks cut off, and A-Z may
    be lower-cased before. Texts with "<|" (special tokens are found before that) go through it whole.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, runs: set[str]) -> None:
        words = [run for run in runs if run.isalpha()]
        self.known.update((run, self.encode(run)) for run in runs if not run.isalpha())
        for a in range(0, len(words), TOGETHER):
            part = words[a : a + TOGETHER]
            code = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            owner = np.array(code.word_ids, dtype=np.int64)
            if len(owner) and owner[-1] == len(part) - 1:
                raw = np.array(code.ids, dtype="<u4").tobytes()
                cut = (4 * np.searchsorted(owner, np.arange(len(part) + 1))).tolist()
                self.known.update(zip(part, (raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)), strict=True))
            else:
                self.known.update((word, self.encode(word)) for word in part)

    def of_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts as little-endian unsigned 32-bit integers."""
        special = {k: self.encode(text.decode()) for k, text in enumerate(texts) if b"<|" in text}
        split = [MARKS.sub(r" \g<0>", text.lower().decode()).replace("\n", " ").split(" ") if k not in special else [] for k, text in enumerate(texts)]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*split)
        self.learn(new)
        get = self.known.__getitem__
        return [special[k] if k in special else b"".join(map(get, runs)) for k, runs in enumerate(split)]


_ids: dict[str, Ids] = {}


def ids_of(vocabulary: str) -> Ids:
    """One for each Python worker."""
    if vocabulary not in _ids:
        _ids[vocabulary] = Ids(vocabulary)
    return _ids[vocabulary]


def pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterator[pa.RecordBatch]:
    end = np.array([END], dtype="<u4").tobytes()
    for batch, texts in chunks(batches):
        doc, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(ids_of(vocabulary).of_all(texts)):
            ids += end
            for k in range(0, len(ids), 4 * capacity):
                part = ids[k : k + 4 * capacity]
                doc.append(i)
                piece.append(k // (4 * capacity))
                start.append(k // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        columns = [batch.column("id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])


class Bins:
    """Bins by the room left in them, as runs of consecutive bin numbers."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []  # ascending, those with bins

    def put(self, room: int, first: int, count: int) -> None:
        if room not in self.runs:
            self.runs[room] = []
            bisect.insort(self.rooms, room)
        self.runs[room].append((first, count))

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to `most` bins that lie together."""
        first, count = self.runs[room].pop()
        if count > most:
            self.runs[room].append((first + most, count - most))
            count = most
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.remove(room)
        return first, count

    def new(self, count: int) -> int:
        self.made += count
        return self.made - count

    def tightest(self, length: int) -> int | None:
        """The least room that holds `length`."""
        k = bisect.bisect_left(self.rooms, length)
        return self.rooms[k] if k < len(self.rooms) else None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places of all pieces: rows (length, rank, count, bin, per_bin, offset).

    Pieces rank .. rank+count-1 of that length fill the bins from `bin` on, `per_bin` in each, the first of
    them at `offset`. It works on the number of pieces of each length, so its work depends on the
    capacity, not on the data.

    Large pieces (over a third of a bin, so at most two share one) are matched greedily: the largest left
    takes the largest one that still fits beside it. Smaller ones go, in descending order, to the bin
    with the least room that holds them, else to a new bin.
    """
    left = {length: n for length, n in histogram.items() if n}
    placed: Counter[int] = Counter()
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = Bins(capacity)

    def place(length: int, count: int, first: int, per_bin: int, offset: int) -> None:
        out.append((length, placed[length], count, first, per_bin, offset))
        placed[length] += count
        left[length] -= count

    third = capacity // 3
    large = sorted((length for length in left if length > third), reverse=True)
    ascending = large[::-1]
    for length in large:
        while left[length]:
            k = bisect.bisect_right(ascending, capacity - length) - 1
            while k >= 0 and left[ascending[k]] == 0:
                del ascending[k]
                k -= 1
            partner = ascending[k] if k >= 0 else None
            if partner == length:
                pairs = left[length] // 2
                if not pairs:
                    ascending.remove(length)  # a single one left: look for a smaller partner
                    continue
                first = bins.new(pairs)
                place(length, 2 * pairs, first, 2, 0)
                bins.put(capacity - 2 * length, first, pairs)
                continue
            count = left[length] if partner is None else min(left[length], left[partner])
            first = bins.new(count)
            place(length, count, first, 1, 0)
            room = capacity - length
            if partner is not None:
                place(partner, count, first, 1, length)
                room -= partner
            bins.put(room, first, count)
        if length in ascending:
            ascending.remove(length)
    for length in sorted((length for length in left if length <= third), reverse=True):
        while left[length]:
            room = bins.tightest(length)
            if room is None:
                per_bin = capacity // length
                count = max(1, left[length] // per_bin)
                first, room = bins.new(count), capacity
            else:
                per_bin = room // length
                first, count = bins.take(room, max(1, left[length] // per_bin))
            per_bin = min(per_bin, left[length])
            place(length, count * per_bin, first, per_bin, capacity - room)
            bins.put(room - per_bin * length, first, count)
    return out


def places(batches: Iterator[pa.RecordBatch], by_length: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id and offset to pieces numbered within their length."""
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            table = by_length[size]
            k = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
            nth, step = np.divmod(rank[rows] - table[k, 0], table[k, 2])
            sequence[rows] = table[k, 1] + nth
            offset[rows] = table[k, 3] + step * size
        batch = batch.drop_columns(["rank"])
        yield batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is the ids of its text and an end id (1); only longer ones than `capacity` are cut, into
    pieces of that size. The lengths of all pieces are counted (at most `capacity` numbers), the counts are
    packed on the driver (`plan`), and the pieces, numbered within their length, look their place up in that
    plan, whose size is bounded by the capacity. Numbers within a length are made in PARTS parts each,
    so that a length that most pieces share is not sorted in one task.

    vocabulary: file of the tokenizer, at the same path on every machine.

    Null and empty texts are one end id. Rows that repeat an id are packed each; a null id stays null. An
    empty table gives an empty result. Further columns are ignored.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    cut = stage(rows.mapInArrow(lambda batches: pieces(batches, vocabulary, capacity), PIECES.format(id_type)))
    part = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(PARTS)).alias("part")
    counts = cut.groupBy("length", part).count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table: dict[int, list] = {}
    for length, rank, _, first, per_bin, offset in plan(histogram, capacity):
        table.setdefault(length, []).append((rank, first, per_bin, offset))
    by_length = {length: np.array(sorted(found), dtype=np.int64) for length, found in table.items()}

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("part", part)
        .withColumn("rank", F.row_number().over(within) - 1)
        .join(bases, ["length", "part"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    )
    schema = PIECES.format(id_type) + ", sequence_id long, offset long"
    out = ranked.mapInArrow(lambda batches: places(batches, by_length), schema)
    return out.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")
