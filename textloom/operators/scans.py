"""Running values along an order, in two levels: within parts of each key's rows, and over the parts' totals.

A key's rows lie in parts of `PART` places, so a key of any size is many tasks; only its parts' totals, one row for
each, come together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the order that make a part.
PART = 65_536


def _parts(df: DataFrame, order: str, part: int) -> DataFrame:
    return df.withColumn("_part", F.floor(F.col(order) / part))


def _same(keys: list[str]) -> Column:
    """Equality of keys that takes nulls as equal."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    return condition


def joined(rows: DataFrame, totals: DataFrame, keys: list[str], new: list[str], how: str = "left") -> DataFrame:
    """Rows with new columns from `totals`, a row for each key; null keys match."""
    return rows.alias("r").join(totals.alias("t"), _same(keys), how).select("r.*", *[f"t.{c}" for c in new])


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: Mapping[str, Column], part: int = PART) -> DataFrame:
    """Adds for each name the sum of its column up to and with the row; `order` begins with a whole number."""
    rows = _parts(df, order[0], part).withColumns({f"_{name}": F.coalesce(value.cast("long"), F.lit(0)) for name, value in sums.items()})
    along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_part").agg(*[F.sum(f"_{name}").alias(f"_sum_{name}") for name in sums])
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_sum_{name}").over(along), F.lit(0)).alias(f"_before_{name}") for name in sums])
    inner = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = joined(rows, offsets, [*keys, "_part"], [f"_before_{name}" for name in sums])
    return found.select(*df.columns, *[(F.col(f"_before_{name}") + F.sum(f"_{name}").over(inner)).alias(name) for name in sums])


def running_depth(df: DataFrame, keys: list[str], order: list[str], step: Column, name: str = "depth", part: int = PART) -> DataFrame:
    """Adds the depth after each row: the sum of steps (+1 opens, -1 closes), where a close at depth 0 has no effect.

    That is the plain sum less the lowest that any sum before has been, if below zero: both combine over parts.
    """
    rows = _parts(df, order[0], part).withColumn("_step", F.coalesce(step.cast("long"), F.lit(0)))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_step").over(inner))
    totals = rows.groupBy(*keys, "_part").agg(F.sum("_step").alias("_total"), F.min("_sum").alias("_low"))
    along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(along), F.lit(0)))
    offsets = offsets.withColumn("_lowest", F.coalesce(F.min(F.col("_before") + F.col("_low")).over(along), F.lit(0)))
    found = joined(rows, offsets, [*keys, "_part"], ["_before", "_lowest"])
    total = F.col("_before") + F.col("_sum")
    lowest = F.least(F.col("_lowest"), F.col("_before") + F.min("_sum").over(inner), F.lit(0))
    return found.select(*df.columns, (total - lowest).alias(name))


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, part: int = PART) -> DataFrame:
    """Adds the last value that isn't null of the rows before (not with) each row."""
    rows = _parts(df, order[0], part).withColumn("_value", value)
    place = F.struct(*order)
    totals = rows.groupBy(*keys, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), place)).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", F.last("_last", ignorenulls=True).over(along).alias("_before"))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = joined(rows, offsets, [*keys, "_part"], ["_before"])
    return found.select(*df.columns, F.coalesce(F.last("_value", ignorenulls=True).over(inner), F.col("_before")).alias(name))
