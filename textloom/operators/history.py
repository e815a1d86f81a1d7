"""Reads over histories: as of a time, before a batch, latest rows, hash chains, change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest `order` for each key, by aggregation: no sort, and partial before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def as_of(df: DataFrame, keys: list[str], at: str, order: str, cutoff: Column) -> DataFrame:
    """The latest row of each key at or before the cutoff."""
    return latest(df.filter(F.col(at) <= cutoff), keys, order)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before its time.

    Both sides are stacked and a window carries the last right row forward: one shuffle on the keys,
    no pairs of rows.
    """
    marked = left.select(*keys, F.col(at).alias("_at"), F.struct(*left.columns).alias("_row"), F.lit(None).alias("_v"), F.lit(1).alias("_side"))
    given = right.select(
        *keys, F.col(right_at).alias("_at"), F.lit(None).alias("_row"), F.struct(F.col(right_at).alias("_time"), *values).alias("_v"), F.lit(0).alias("_side")
    )
    both = marked.withColumn("_v", F.lit(None).cast(given.schema["_v"].dataType)).unionByName(
        given.withColumn("_row", F.lit(None).cast(marked.schema["_row"].dataType))
    )
    along = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(along)).filter("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def before_batch(history: DataFrame, keys: list[str], order: str, batch: Column) -> DataFrame:
    """What each key held before the first row of a batch, null where that row was its first.

    The batch's first rows are one per key; they are joined to the history by key.
    """
    first = history.filter(batch).groupBy(*keys).agg(F.min(order).alias("_first"))
    earlier = history.join(first, keys).filter(F.col(order) < F.col("_first")).drop("_first")
    return first.join(latest(earlier, keys, order), keys, "left").drop("_first")


def compact(log: DataFrame, keys: list[str], order: str, at: str, cutoff: Column) -> DataFrame:
    """The log with `kept`: rows younger than the cutoff and the latest row of each key stay, others are archived."""
    newest = log.groupBy(*keys).agg(F.max(order).alias("_newest"))
    return log.join(newest, keys).withColumn("kept", (F.col(order) == F.col("_newest")) | (F.col(at) >= cutoff)).drop("_newest")


def changes(log: DataFrame, cursor: int, limit: int, order: str = "seq", only: Column | None = None) -> DataFrame:
    """The next page after a cursor: at most `limit` rows with next_cursor and has_more."""
    page = log.filter(F.col(order) > cursor)
    if only is not None:
        page = page.filter(only)
    probe = page.orderBy(order).limit(limit + 1)
    number = Window.orderBy(order)  # of at most limit + 1 rows
    everything = Window.partitionBy()
    numbered = probe.withColumn("_n", F.row_number().over(number)).withColumn("has_more", F.count(F.lit(1)).over(everything) > limit)
    kept = numbered.filter(F.col("_n") <= limit).drop("_n")
    return kept.withColumn("next_cursor", F.max(order).over(everything))


def chain_breaks(log: DataFrame, chain: str, order: str, own: Column, previous: str, stored: str) -> DataFrame:
    """Rows whose stored hash isn't their own or whose link isn't the stored hash before; the first row is an anchor."""
    along = Window.partitionBy(chain).orderBy(order)
    linked = log.withColumn("_before", F.lag(stored).over(along)).withColumn("_own", own)
    broken = (F.col("_own") != F.col(stored)) | (F.col("_before").isNotNull() & (F.col("_before") != F.col(previous)))
    return linked.filter(broken).drop("_before", "_own")


def sessions(events: DataFrame, keys: list[str], at: str, gap_seconds: int) -> DataFrame:
    """Numbers each key's sessions: a pause of more than the gap starts a new one."""
    along = Window.partitionBy(*keys).orderBy(at)
    time = F.col(at).cast("timestamp")
    pause = F.unix_micros(time) - F.unix_micros(F.lag(time).over(along))
    new = F.when(pause <= gap_seconds * 1_000_000, 0).otherwise(1)
    return events.withColumn("session", F.sum(new).over(along.rowsBetween(Window.unboundedPreceding, 0)))
