"""Entries of layered streams: a stream has what its ancestors have, but for what it changes or takes away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(streams: DataFrame, most: int = 64) -> DataFrame:
    """(stream, ancestor, distance) of each stream, itself at distance 0; streams: stream, parent (null: none).

    One join doubles the distance reached. A chain that leads back to itself raises, as does one longer than `most`.
    """
    found = streams.select("stream", F.col("stream").alias("ancestor"), F.lit(0).alias("distance"))
    step = streams.filter("parent is not null").select(F.col("stream").alias("low"), F.col("parent").alias("high"), F.lit(1).alias("steps"))
    reach = 1
    while reach <= most and not step.isEmpty():
        if not step.filter("low = high").isEmpty():
            raise ValueError("a stream is its own ancestor")
        further = found.join(step, F.col("ancestor") == F.col("low")).select("stream", F.col("high").alias("ancestor"), (F.col("distance") + F.col("steps")).alias("distance"))
        found = found.unionByName(further).distinct()
        two = step.alias("a").join(step.alias("b"), F.col("a.high") == F.col("b.low"))
        step = two.select(F.col("a.low").alias("low"), F.col("b.high").alias("high"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        reach *= 2
    if not step.isEmpty():
        raise ValueError(f"a stream has over {most} ancestors")
    return found


def resolved_entries(entries: DataFrame, chain: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that each stream of `chain` (stream, ancestor, distance) sees: those of the nearest layer that has the key.

    entries: stream, keys, deleted, any more. A deleted entry hides those behind it. One aggregation decides for all streams.
    """
    rest = [c for c in entries.columns if c not in (*keys, "stream", "deleted")]
    seen = entries.withColumnRenamed("stream", "ancestor").join(chain, "ancestor")
    best = seen.groupBy("stream", *keys).agg(F.min_by(F.struct("deleted", F.col("ancestor").alias("layer"), *rest), "distance").alias("e"))
    return best.filter(~F.coalesce(F.col("e.deleted"), F.lit(False))).select("stream", *keys, "e.*").drop("deleted")


def searched_page(entries: DataFrame, match: Column, order: list[Column], offset: int, limit: int, by: str | None = None) -> DataFrame:
    """The page of matching entries after `offset`, with the `total` of all matches; of each `by`, if given.

    Totals are an aggregation; of the rows only the first offset + limit of each are numbered.
    """
    hits = entries.filter(match)
    if by is None:
        page = hits.orderBy(*order).limit(offset + limit)
        numbered = page.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of at most offset + limit rows
        return numbered.filter(F.col("place") > offset).crossJoin(hits.agg(F.count(F.lit(1)).alias("total")))
    places = hits.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    page = places.filter((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return page.join(hits.groupBy(by).agg(F.count(F.lit(1)).alias("total")), by)
