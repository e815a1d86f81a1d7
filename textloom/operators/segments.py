"""Keys by which texts meet that few edits set apart: segments of one, substrings of the other.

d edits leave at least one of d + 1 segments of a text as it is, at most d places off. A query has a key for each of its segments,
for each class of lengths and of places in which it may stand in a match; an entry has one for each substring of such a length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

KEYS = ArrayType(StructType([StructField("key", LongType()), StructField("at", IntegerType())]))
#: Characters that a Python task takes at once.
CHUNK = 1 << 18
#: Bits that a key has in the table, bits of it that are set, and the least and greatest table (logarithms; the greatest has 32 MB).
ROOM, TESTS, SMALL, GREAT = 32, 3, 16, 28

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_ODD, _CLASS, _EMPTY = (np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * _ODD
    return x ^ (x >> np.uint64(32))


def lost(n: int, least: float) -> int:
    """Edits at most between a text of n characters and one that is alike."""
    return math.floor((1 - least) * math.floor(n / least + 1e-9) + 1e-9)


def reach(n: int, least: float) -> tuple[int, int]:
    """Lengths of the texts that one of n characters may be like."""
    return math.floor(n * least + 1e-9), math.ceil(n / least - 1e-9)


@lru_cache(1 << 17)
def length_class(n: int, least: float) -> int:
    """Class of a length: those of a text's matches are in a few neighbouring ones."""
    return int(math.log(max(n, 1)) / math.log(max(1 / least, 1.01)))


@lru_cache(1 << 12)
def drift(of_class: int, least: float) -> int:
    """Places at most that a segment is off in an entry of a class of lengths."""
    return math.floor((1 - least) * max(1 / least, 1.01) ** (of_class + 2)) + 1


@lru_cache(1 << 17)
def spans(n: int, least: float) -> tuple[int, int]:
    """Lengths of the segments of all queries that an entry of n characters may be like: least, greatest."""
    low, high = reach(n, least)
    cut = [(k // (lost(k, least) + 1), -(-k // (lost(k, least) + 1))) for k in range(max(low - 1, 1), high + 2) if k > lost(k, least)]
    return (min(a for a, _ in cut), max(b for _, b in cut)) if cut else (1, 0)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the characters, and what takes a difference of two back to its first place."""
    n = len(codes)
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(max(n + 1, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    return sums, _powers[1]


def _keys(hashes: np.ndarray, of_class: np.ndarray | int, place: np.ndarray | int) -> np.ndarray:
    label = (np.asarray(of_class).astype(np.uint64) << np.uint64(40)) + np.asarray(place).astype(np.int64).astype(np.uint64)
    return _mixed(hashes + label * _CLASS)


def _length_key(n: int) -> np.ndarray:
    return _mixed(np.asarray([n], np.uint64) * _CLASS + _EMPTY)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def query_keys(text: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a query's segments and their places. One with fewer characters than segments has its matches' lengths, at -1."""
    n = len(text)
    low, high = reach(n, least)
    parts = lost(n, least) + 1
    if n < parts:
        found = np.concatenate([_length_key(m) for m in range(low, high + 1)])
        return found, np.full(len(found), -1)
    sums, back = _sums(_codes(text))
    starts = np.arange(parts + 1) * n // parts
    starts, ends = starts[:-1], starts[1:]
    hashes = (sums[ends] - sums[starts]) * back[starts]
    keys, at = [], []
    for c in range(length_class(low, least), length_class(high, least) + 1):
        off = drift(c, least)
        width = 2 * off + 1
        first, last = (starts - off) // width, (starts + off) // width
        for step in range(int((last - first).max()) + 1):
            on = (first + step <= last) & (first + step >= 0)
            keys.append(_keys(hashes[on], c, (first + step)[on]))
            at.append(starts[on])
    return np.concatenate(keys), np.concatenate(at)


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the table has, as places in `keys`."""
    mask, left = np.uint64(len(bits) * 64 - 1), np.arange(len(keys))
    for k in range(TESTS):
        at = (keys[left] >> np.uint64(18 * k)) & mask
        left = left[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return left


def entry_keys(texts: list[str], least: float, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the entries' substrings that the table has: number of the text, key, place."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    sums, back = _sums(_codes("".join(texts)))
    sizes = np.asarray([spans(int(n), least) for n in lengths])
    classes = np.asarray([length_class(int(n), least) for n in lengths])
    widths = np.asarray([2 * drift(int(c), least) + 1 for c in classes])
    whole = np.concatenate([_length_key(int(n)) for n in lengths])
    left = _held(bits, whole)
    found = [(left, whole[left], np.full(len(left), -1))]
    for size in range(int(sizes[:, 0].min()), int(sizes[:, 1].max()) + 1):
        chosen = np.flatnonzero((sizes[:, 0] <= size) & (size <= sizes[:, 1]) & (size <= lengths))
        if not len(chosen):
            continue
        counts = lengths[chosen] - size + 1
        of = np.repeat(chosen, counts)
        place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begins[of] + place
        keys = _keys((sums[at + size] - sums[at]) * back[at], classes[of], place // widths[of])
        left = _held(bits, keys)
        found.append((of[left], keys[left], place[left]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rows(keys: np.ndarray, at: np.ndarray) -> list[dict]:
    return [{"key": k, "at": p} for k, p in zip(keys.astype(np.int64).tolist(), at.tolist(), strict=True)]


def keys(text: Column, least: float, bits: np.ndarray | None = None) -> Column:
    """Array of (key, at): of a query all, of an entry those that the table `bits` has. Each pair of alike texts has one in common."""

    def of_queries(texts: pd.Series) -> pd.Series:
        return pd.Series([_rows(*query_keys(t, least)) for t in texts], dtype=object)

    def chunks(texts: list[str]) -> Iterator[list[str]]:
        part, size = [], 0
        for t in texts:
            if part and size + len(t) > CHUNK:
                yield part
                part, size = [], 0
            part.append(t)
            size += len(t)
        if part:
            yield part

    def of_entries(texts: pd.Series) -> pd.Series:
        out: list[list[dict]] = []
        for part in chunks(texts.tolist()):
            of, found, at = entry_keys(part, least, bits)
            order = np.argsort(of, kind="stable")
            rows, ends = _rows(found[order], at[order]), np.searchsorted(of[order], np.arange(len(part) + 1))
            out += [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return pd.Series(out, dtype=object)

    of_queries.__annotations__ = of_entries.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of_queries if bits is None else of_entries, KEYS)(text)


def bit_table(rows: DataFrame, key: str) -> np.ndarray:
    """A table of bits in which every key has its own set. Its size is bounded: a full one lets more through, and loses nothing."""
    size = min(max(int(rows.count() * ROOM).bit_length(), SMALL), GREAT)
    places = F.explode(F.array(*[F.shiftrightunsigned(F.col(key), 18 * k).bitwiseAND(F.lit((1 << size) - 1)) for k in range(TESTS)]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    words = rows.select(places.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (size - 6), np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)
