"""Mixing of sources to target weights: Pfair windows, earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only_row, with_row

#: Documents of a block, sum of the weights that are made from counts, and the exponent of the counts.
BLOCK, PARTS, TEMPERATURE = 64, 1000, 0.7
#: Sources of a mixture at most: what the driver and the broadcast tables hold a row for.
MOST_SOURCES = 1 << 14
#: Hex digits of the id's hash that number a source's documents in parts.
DIGITS = 3


def temperature_weights(counts: Mapping[str, int], temperature: float = TEMPERATURE, parts: int = PARTS) -> dict[str, int]:
    """Integer weights in proportion to count ** temperature; at least 1 each."""
    powers = {s: n**temperature for s, n in counts.items()}
    total = sum(powers.values())
    return {s: max(1, int(parts * p / total + 0.5)) for s, p in powers.items()}


def schedule(weights: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period: rows (source, block, release, deadline, slot) of sum(weights) slots.

    Block k of a source of weight w in W slots is released at floor(k W / w) and due by
    ceil((k + 1) W / w). Each slot goes to the released block of the earliest deadline, ties to the smaller
    source. One slot at a time and weights that add up to the period: every block meets its deadline,
    so after any number t of slots a source is less than one block from t w / W. The period repeats.
    """
    period = sum(weights.values())
    released: list[list[tuple[int, str, int]]] = [[] for _ in range(period)]
    for source, w in weights.items():
        for k in range(w):
            released[k * period // w].append((-(-(k + 1) * period // w), source, k))
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        for block in released[slot]:
            heapq.heappush(ready, block)
        deadline, source, k = heapq.heappop(ready)
        out.append((source, k, k * period // weights[source], deadline, slot))
    return out


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Mapping[str, int] | None = None,
    block: int = BLOCK,
    temperature: float = TEMPERATURE,
    most_epochs: int | None = None,
) -> DataFrame:
    """Places in a mixture that follows the target weights: a row per document and epoch.

    Columns: row (the document, as in `common.with_row`), id, source, block, epoch, release, deadline,
    slot and place. A source's documents are ordered by the MD5 of their ids and cut into blocks of `block`; blocks
    are numbered on through further epochs and put in slots by `schedule`, whose period repeats. The
    mixture is as long as it takes to use every document: no document is left out, and sources that run
    out before begin again (epoch 1, 2, ...). place is the place in the block.

    weights: whole parts by source; without them count ** temperature in PARTS parts, from the counts of all
    rows. There is a weight for each source, so the counts that come to the driver and the schedule are as
    small as the mixture's definition; over MOST_SOURCES sources are an error. With explicit weights a source that has none isn't part of the
    mixture. The numbers of documents within a source are made in 16 ** DIGITS parts: a source that holds a
    third of all rows isn't sorted in one task.

    Small sources with large weights are used many times over. With `most_epochs`, needing more is an error that lists
    them, before any document is dealt; no document is ever left out.

    A null source is a source like any other, named ''; explicit weights name it ''. Null ids are
    ordered before others. Rows that repeat an id are documents of their own, ordered by a hash of
    the row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = with_row(docs, id=id_col, source=source_col).withColumn("source", F.coalesce("source", F.lit("")))
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumn("part", F.substring("order", 1, DIGITS))
    sizes = rows.groupBy("source", "part").count()
    totals = sizes.groupBy("source").agg(F.sum("count").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"{source_col} has over {MOST_SOURCES} values; a mixture needs a weight for each")
    counts = {r["source"]: r["n"] for r in totals}
    if weights is None:
        weights = temperature_weights(counts, temperature)
    weights = {s: w for s, w in sorted(weights.items()) if w > 0 and s in counts}
    blocks = {s: -(-counts[s] // block) for s in weights}
    period, rows_of_period = sum(weights.values()), schedule(weights)
    slot_of = {(source, k): slot for source, k, _, _, slot in rows_of_period}
    # As long as it takes to reach every source's last block, and so many blocks of each source.
    length = max(((blocks[s] - 1) // w * period + slot_of[s, (blocks[s] - 1) % w] + 1 for s, w in weights.items()), default=0)
    used = {s: length // period * w + sum(slot_of[s, k] < length % period for k in range(w)) for s, w in weights.items()}
    often = {s: -(-used[s] // blocks[s]) for s in weights}
    if most_epochs is not None and max(often.values(), default=0) > most_epochs:
        raise ValueError(f"sources would be used more than {most_epochs} times: { {s: n for s, n in often.items() if n > most_epochs} }")
    slots = spark.createDataFrame(rows_of_period, "source string, k long, release long, deadline long, slot long")
    shares = spark.createDataFrame([(s, w, blocks[s], used[s]) for s, w in weights.items()], "source string, weight long, blocks long, used long")

    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("source", "part").orderBy("order", "id", F.xxhash64("row"))
    # Sources are few (see above), and so the tables that hold a row or a weight for each.
    ranked = (
        rows.join(F.broadcast(shares), "source")
        .withColumn("rank", F.row_number().over(within) - 1)
        .join(bases, ["source", "part"])
        .withColumn("rank", F.col("base") + F.col("rank"))
        .withColumn("block", F.expr(f"rank div {block}"))
        .withColumn("place", F.col("rank") % block)
        .withColumn("epoch", F.explode(F.expr("sequence(0L, (used - 1 - block) div blocks)")))
        .withColumn("number", F.col("block") + F.col("epoch") * F.col("blocks"))
        .withColumn("turn", F.expr("number div weight"))
        .withColumn("k", F.expr("number % weight"))
    )
    shift = F.col("turn") * period
    return ranked.join(F.broadcast(slots), ["source", "k"]).select(
        "row",
        "id",
        "source",
        "block",
        "epoch",
        (shift + F.col("release")).alias("release"),
        (shift + F.col("deadline")).alias("deadline"),
        (shift + F.col("slot")).alias("slot"),
        "place",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture of `mix_sources`, once for each of their epochs, in its columns' order."""
    return only_row(mix_sources(docs, **options), docs.columns)


def oracle() -> str:
    """The places of `mix_sources` in DuckDB's SQL, the schedule by recursion."""
    return f"""
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
p AS (
  SELECT source, n, greatest(1, CAST(floor({PARTS} * pow(n, {TEMPERATURE}) / sum(pow(n, {TEMPERATURE})) OVER () + 0.5) AS BIGINT)) AS w,
         (n + {BLOCK - 1}) // {BLOCK} AS blocks
  FROM c
), q AS (
  SELECT CAST(sum(w) AS BIGINT) AS period, list(w ORDER BY source) AS ws, list(source ORDER BY source) AS names
  FROM p
), s AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS pick, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, ws, period, names FROM q
  UNION ALL
  SELECT slot, pick, list_transform(range(1, len(ws) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), ws, period, names
  FROM (
    SELECT slot + 1 AS slot, done, ws, period, names,
      list_sort(list_transform(
        list_filter(range(1, len(ws) + 1), lambda i: done[i] < ws[i] AND done[i] * period // ws[i] <= slot + 1),
        lambda i: [((done[i] + 1) * period + ws[i] - 1) // ws[i], i]))[1][2] AS pick
    FROM s WHERE slot + 1 < period
  )
), e AS (SELECT names[pick] AS source, done[pick] - 1 AS k, slot FROM s WHERE slot >= 0),
z AS (
  SELECT max((blocks - 1) // w * period + slot + 1) AS length FROM p JOIN e ON e.source = p.source AND e.k = (blocks - 1) % w, q
), u AS (
  SELECT p.source, w, blocks, max(period) AS period,
         max(length // period * w) + count(*) FILTER (slot < length % period) AS used
  FROM p JOIN e ON e.source = p.source, q, z GROUP BY p.source, w, blocks
), r AS (
  SELECT doc_id, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank
  FROM documents
), x AS (
  SELECT doc_id, source, rank // {BLOCK} AS block, rank % {BLOCK} AS place, w, blocks, period,
         unnest(range(0, CAST((used - 1 - rank // {BLOCK}) // blocks + 1 AS BIGINT))) AS epoch
  FROM r JOIN u USING (source)
), y AS (SELECT *, block + epoch * blocks AS number FROM x)
SELECT doc_id, y.source, block, epoch,
       (number // w) * period + (number % w) * period // w AS release,
       (number // w) * period + ((number % w + 1) * period + w - 1) // w AS deadline,
       (number // w) * period + slot AS slot, place
FROM y JOIN e ON e.source = y.source AND e.k = number % w
"""
