"""Periodic runs of words: maximal repetitions found through Lyndon roots, and texts with the repeats dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, pick

#: Fewest words of a run, and fewest repeats of its period.
LENGTH, REPEATS = 6, 4
#: Bytes of a text that are split into words at once.
SPLIT = 1 << 20
#: Entries of a block of the range-minimum index.
RANGE = 32
#: Up to so many words, loops run over lists (faster); beyond, over the arrays themselves (smaller).
LISTED = 1 << 20
SPACES = b" \t\n\v\f\r"

RESULT = "id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, text string"


def word_ids(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """A number for each word `[^\\x20\\x09-\\x0D]+`, the same for the same word."""
    found, at = [], 0
    while at < len(text):
        end = at + SPLIT
        while end < len(text) and text[end] not in SPACES:
            end += 1
        found.append(np.fromiter((known.setdefault(w, len(known)) for w in text[at:end].split()), dtype=np.int64))
        at = end
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def suffix_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of all suffixes, by doubling the length that is sorted.

    Each text must end with a number that occurs nowhere else; then no comparison passes its end.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank, slots, h = np.empty(n, dtype=np.int64), np.arange(n), 0
    sorted_key, moved = key[order], order
    while True:
        head = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        size = np.diff(np.append(head, len(sorted_key)))
        rank[moved] = np.repeat(slots[head], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order, rank
        h = 2 * h or 1
        moved = order[slots]
        both = rank[moved] * np.int64(n) + rank[moved + h]
        perm = np.argsort(both, kind="stable")
        moved, sorted_key = moved[perm], both[perm]
        order[slots] = moved


def loopable(x: np.ndarray) -> list[int] | memoryview:
    return x.tolist() if len(x) <= LISTED else memoryview(np.ascontiguousarray(x))


def common_prefixes(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP: at r the length of what the suffixes of ranks r - 1 and r have in common."""
    n = len(key)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    shared = np.zeros(n, dtype=np.int32)
    word, prior, out, h = loopable(key), loopable(before), memoryview(shared), 0
    for i in range(n):
        j = prior[i]
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and word[i + h] == word[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return shared[order]


def next_beyond(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one of a smaller rank, and the next one of a larger rank (else the end).

    Up to there reaches the longest Lyndon word of the place, under the order of words and under its reverse.
    """
    n = len(rank)
    smaller, larger = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
    value = loopable(rank)
    # Lists are kept short of the arrays' size by looping over the arrays where these are long.
    down = [0] * n if n <= LISTED else memoryview(smaller)
    up = [0] * n if n <= LISTED else memoryview(larger)
    for i in range(n - 1, -1, -1):
        x, j = value[i], i + 1
        while j < n and value[j] > x:
            j = down[j]
        down[i] = j
        j = i + 1
        while j < n and value[j] < x:
            j = up[j]
        up[i] = j
    if n <= LISTED:
        smaller[:], larger[:] = down, up
    return smaller, larger


class RangeMinimum:
    """Minimum of any range: within blocks by running minima, over whole blocks by a sparse table."""

    def __init__(self, values: np.ndarray) -> None:
        n = -(-len(values) // RANGE) * RANGE
        padded = np.full(n, np.iinfo(values.dtype).max, dtype=values.dtype)
        padded[: len(values)] = values
        rows = padded.reshape(-1, RANGE)
        self.values = padded
        self.to_end = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.from_start = np.minimum.accumulate(rows, axis=1).ravel()
        self.levels = [rows.min(axis=1)]
        while 2 ** len(self.levels) <= len(rows):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[: len(last) - half], last[half:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum from `first` to `last`, both included."""
        out = np.minimum(self.to_end[first], self.from_start[last])
        a, b = first // RANGE, last // RANGE
        near = np.flatnonzero(a == b)
        if len(near):
            at = a[near, None] * RANGE + np.arange(RANGE)
            inside = (at >= first[near, None]) & (at <= last[near, None])
            out[near] = np.where(inside, self.values[at], np.iinfo(self.values.dtype).max).min(axis=1)
        far = np.flatnonzero(b - a > 1)
        count = b[far] - a[far] - 1
        level = np.frexp(count)[1] - 1
        for k in np.unique(level):
            some = far[level == k]
            best = np.minimum(self.levels[k][a[some] + 1], self.levels[k][b[some] - 2**k])
            out[some] = np.minimum(out[some], best)
        return out


def runs_of(words: list[np.ndarray], length: int = LENGTH, repeats: int = REPEATS) -> list[np.ndarray]:
    """The runs of each text, as rows (start, length, period) in order.

    A run is a longest stretch of a smallest period that repeats at least `repeats` times (2 or more) and has at least
    `length` words. Each contains, from one of its first `period` words on, a Lyndon word of the length of its
    period, which is the longest from there under the order of words or under its reverse. So all
    such words are tried and extended to both sides through what the suffixes have in common.
    """
    count = np.array([len(w) + 1 for w in words], dtype=np.int64)
    end = np.cumsum(count) - 1  # of each text's closing number
    first = end - count + 1
    n = int(count.sum())
    doc = np.repeat(np.arange(len(words)), count)
    key = np.zeros(n, dtype=np.int64)
    key[np.arange(n) != end[doc]] = np.concatenate(words) + 1
    width = int(key.max()) + 1
    key += doc * width  # texts are apart, and a closing number is the smallest of its text
    order, rank = suffix_order(key)
    minimum = RangeMinimum(common_prefixes(key, order))

    def shared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = rank[i], rank[j]
        return minimum.between(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)

    found = []
    places = np.arange(n)
    for beyond in next_beyond(rank):
        period = beyond - places
        # The leftmost such word of a run is followed by more than repeats - 2 further periods.
        i = np.flatnonzero(places + (repeats - 1) * period < end[doc])
        p = period[i].astype(np.int64)
        same = (key[i] == key[i + p]) & (key[i] == key[i + (repeats - 1) * p])
        i, p = i[same], p[same]
        if not len(i):
            continue
        right = shared(i, i + p)
        enough = right > (repeats - 2) * p
        i, p, right = i[enough], p[enough], right[enough]
        start = first[doc[i]]
        inner = np.flatnonzero(i - p >= start)
        follows = inner[shared(i[inner] - p[inner], i[inner]) >= p[inner]]
        leftmost = np.ones(len(i), dtype=bool)
        leftmost[follows] = False
        i, p, right, start = i[leftmost], p[leftmost], right[leftmost], start[leftmost]
        low, high = np.zeros(len(i), dtype=np.int64), np.minimum(p - 1, i - start)
        while (open_ := np.flatnonzero(low < high)).size:  # the most words before that fit the period
            t = (low[open_] + high[open_] + 1) // 2
            fits = shared(i[open_] - t, i[open_] - t + p[open_]) >= t
            low[open_[fits]] = t[fits]
            high[open_[~fits]] = t[~fits] - 1
        found.append(np.stack([doc[i], i - low - start, low + p + right, p], axis=1))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), dtype=np.int64)
    rows = rows[rows[:, 2] >= np.maximum(length, repeats * rows[:, 3])]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    edges = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
    return [rows[a:b, 1:] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def strongest(runs: np.ndarray) -> dict | None:
    """The run of greatest length by period, exactly; of equals the first."""
    best: list[int] | None = None
    for run in runs.tolist():  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return None if best is None else dict(zip(("start", "length", "period"), best, strict=True))


def collapsed(ids: np.ndarray, runs: np.ndarray, words: list[bytes]) -> str:
    """The words that no run holds after its first period."""
    if len(runs):
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        ids = ids[np.cumsum(edge[:-1]) == 0]
    return b" ".join([words[k] for k in ids]).decode()


def batches_of_runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema, length: int, repeats: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        known: dict[bytes, int] = {}
        ids = [word_ids(t, known) for t in texts]
        spelled = list(known)
        found = runs_of(ids, length, repeats)
        columns = [
            batch.column(0),
            pa.array([len(x) for x in ids], type=pa.int64()),
            pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()] for runs in found], type=schema.field("runs").type),
            pa.array([strongest(runs) for runs in found], type=schema.field("strongest").type),
            pa.array([collapsed(x, runs, spelled) for x, runs in zip(ids, found, strict=True)], type=pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "strongest", "text"])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, repeats: int = REPEATS
) -> DataFrame:
    """One row per row of `docs`: id, n_words, runs (start, length, period, in this order), strongest run, and the text
    without what runs repeat: its words, less those that a run contains after its first period, joined by a space.

    A run is a stretch of words of smallest period q (words q apart are the same) that neither neighbour extends, with
    at least `repeats` (2 or more) times q and at least `length` words. The strongest has the greatest ratio of
    length and period; ties go to the smallest start, then period.

    Texts are handled where they lie, 2 MB at a time or one longer text, and nothing is shuffled. Time is n log n words
    at most; memory about 150 bytes a word of a chunk.

    Null text counts as empty, and an empty text has no words, no runs and an empty text. Ids may be null or repeat:
    each row has its own result. An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    if repeats < 2 or length < 1:
        raise ValueError("a run has two repeats and one word at least")
    rows = pick(docs, id=id_col, text=text_col)
    result = RESULT.format(id=rows.schema["id"].dataType.simpleString())
    run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    schema = pa.schema([("runs", pa.list_(run)), ("strongest", run)])
    return rows.mapInArrow(lambda batches: batches_of_runs(batches, schema, length, repeats), result)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text with its words from some place on replaced by repeats of a stretch there, in one of ten documents.

    Which documents, where and with what period follows from the id's CRC-32. A null id leaves the text as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        times = F.floor((n - a) / p).cast("int")
        rest = F.slice(period, F.lit(1), ((n - a) % p).cast("int"))
        parts = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.array_repeat(F.array_join(period, " "), times), rest)
        return F.when(n > 0, F.array_join(parts, " ")).otherwise(F.lit(""))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(text)


ORACLE = r"""
with docs as (
  select doc_id, row_number() over () as k, coalesce(text, '') as text,
    case when doc_id is null then 1 else xor(list_reduce(
      list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''),
        lambda c: list_prepend(ascii(c)::bigint, [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))),
      lambda crc, x: case when x >= 0 then xor(crc, x) when crc % 2 = 1 then xor(crc // 2, 3988292384::bigint) else crc // 2 end
    ), 4294967295::bigint) end as h
  from documents
), spelled as (
  select k, doc_id, h, h // 10 as g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from docs
), sized as (
  select k, doc_id, h, g, ws, len(ws)::bigint as n, case when len(ws) > 0 then g % len(ws) end as a from spelled
), dealt as (
  select k, n, unnest(ws) as w, unnest(range(n)) as i, a, h, 1 + (n - a) // (3 + g % 8) as p from sized
), words as materialized (
  select d.k, d.n, d.i, coalesce(o.w, d.w) as w
  from dealt d left join dealt o on o.k = d.k and d.h % 10 = 0 and d.i >= d.a and o.i = d.a + (d.i - d.a) % d.p
), periods as (
  select k, q from (select k, n, unnest(range(1, n // 4 + 1)) as q from sized)
), anchors as materialized (
  select k, q, unnest(range(0, n // q - 2)) * q as i from periods join sized using (k)
), twice as materialized (
  select x.k, x.q, x.i, a.w from anchors x join words a on a.k = x.k and a.i = x.i join words b on b.k = x.k and b.i = x.i + x.q and b.w = a.w
), thrice as materialized (
  select x.k, x.q, x.i, x.w from twice x join words c on c.k = x.k and c.i = x.i + 2 * x.q and c.w = x.w
), tried as materialized (
  select distinct x.k, x.q from thrice x join words d on d.k = x.k and d.i = x.i + 3 * x.q and d.w = x.w
), equal as (
  select k, q, i, i - row_number() over (partition by k, q order by i) as island from (
    select a.k, t.q, a.i from tried t join words a on a.k = t.k join words b on b.k = a.k and b.i = a.i + t.q and b.w = a.w
  )
), stretches as (
  select k, q, min(i) as start, count(*) + q as length from equal group by k, q, island having count(*) + q >= greatest(6, 4 * q)
), runs as (
  select k, start, length, min(q) as period from stretches group by k, start, length
), ranked as (
  select *, row_number() over (partition by k order by length / period desc, start, period) as place from runs
), digests as (
  select k, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed from runs group by k
), dropped as (
  select distinct k, unnest(range(start + period, start + length)) as i from runs
), kept as (
  select k, string_agg(w, ' ' order by i) as text from words anti join dropped using (k, i) group by k
)
select s.doc_id, coalesce(d.n_runs, 0) as n_runs, r.start, r.length, r.period, (1000 * r.length) // r.period as exponent_milli,
  sha256(coalesce(d.listed, '')) as runs_sha256, sha256(coalesce(t.text, '')) as collapsed_sha256
from sized s left join digests d using (k) left join ranked r on r.k = s.k and r.place = 1 left join kept t on t.k = s.k
"""
