"""Counts and statistics of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text


def content_stats(blocks: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """Blocks, words, characters (with and without space) and distinct characters of each group."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    sums = blocks.groupBy(by).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum(text.count_words(body)).alias("words"),
        F.sum(text.count_chars(body)).alias("chars"),
        F.sum(text.count_chars(body, spaces=False)).alias("chars_no_space"),
    )
    # Sets are united, not added; characters are few, so each task sends few rows.
    chars = blocks.select(by, F.explode(F.array_distinct(F.split(body, ""))).alias("c")).filter("c <> ''")
    return sums.join(chars.groupBy(by).agg(F.countDistinct("c").alias("unique_chars")), by, "left").fillna(0, ["unique_chars"])


def repetitions(blocks: DataFrame, order: list[str], text_col: str = "source_text") -> DataFrame:
    """Class (unique, first, repetition), count and 1-based index of each block among equal texts."""
    hashed = blocks.withColumn("content_hash", identity.content_hash(F.col(text_col)))
    group = Window.partitionBy("content_hash")
    numbered = hashed.withColumn("repetitions", F.count(F.lit(1)).over(group)).withColumn(
        "index", F.row_number().over(group.orderBy(*order))
    )
    return numbered.withColumn(
        "class",
        F.when(F.col("repetitions") == 1, "unique").when(F.col("index") == 1, "first").otherwise("repetition"),
    )


def describe(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """Mean, median, 5th and 95th percentile (linear), sample deviation (0 for one value), least, largest; 2 decimals."""
    grouped = df.groupBy(*(by or []))
    return grouped.agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 2).alias("mean"),
        F.round(F.percentile(value, 0.5), 2).alias("median"),
        F.round(F.percentile(value, 0.05), 2).alias("p5"),
        F.round(F.percentile(value, 0.95), 2).alias("p95"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 2).alias("stddev"),
        F.min(value).alias("least"),
        F.max(value).alias("largest"),
    )


def facets(entries: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct members of each key, most first."""
    return entries.groupBy(key).agg(F.countDistinct(member).alias("n")).orderBy(F.desc("n"), key)


def unit_rollup(hits: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures at the root and each level of a hierarchy; depth is the number of levels given."""
    depth = sum((1 - F.grouping(c) for c in levels), F.lit(0))
    return hits.rollup(*levels).agg(depth.cast("int").alias("depth"), *[c.alias(n) for n, c in measures.items()])


def filtered_facets(df: DataFrame, condition: Column, columns: list[str], count: str | None = None) -> DataFrame:
    """(facet, value, n) of several columns over the rows that the condition holds for, in one pass.

    n counts rows, or distinct values of `count`. Null values are left out.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.filter(condition).select(*([count] if count else []), F.explode(pairs).alias("f")).filter("f.value is not null")
    n = F.countDistinct(count) if count else F.count(F.lit(1))
    return rows.groupBy("f.facet", "f.value").agg(n.alias("n"))
