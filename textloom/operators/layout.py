"""Geometry, frames, rule resolution and metadata of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_regions(lines: DataFrame, regions: DataFrame, page: str = "page") -> DataFrame:
    """Each line with the first region, in reading order, that holds its centre; null where none does.

    lines: page, line_id, x, y, w, h; regions: page, region_id, ordinal, x, y, w, h. They meet on the page only.
    """
    a = lines.select(page, "line_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    b = regions.select(page, "region_id", "ordinal", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    inside = (F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") < F.col("y1"))
    held = a.join(b, page).filter(inside).groupBy(page, "line_id").agg(F.min_by("region_id", "ordinal").alias("region_id"))
    return a.select(page, "line_id").join(held, [page, "line_id"], "left")


def reading_order(regions: DataFrame, page: str = "page") -> DataFrame:
    """Numbers the regions of each page from 0: by columns from left to right, within a column from top to bottom.

    From left to right a region starts a column where its left edge is over half the (upper) median width, at least 1, from
    that of the column's first region. A page has few regions: their edges are walked through in one array.
    """
    widths, edges = F.sort_array(F.collect_list(F.col("w").cast("double"))), F.sort_array(F.collect_set(F.col("x").cast("double")))
    pages = regions.groupBy(page).agg(widths.alias("_w"), edges.alias("_x"))
    pages = pages.select(page, "_x", F.greatest(F.get("_w", F.floor(F.size("_w") / 2).cast("int")) * 0.5, F.lit(1.0)).alias("_tol"))
    # The left edges that start columns, the last one first.
    walk = F.aggregate(
        "_x", F.array().cast("array<double>"),
        lambda held, x: F.when((F.size(held) == 0) | (x - F.get(held, F.lit(0)) > F.col("_tol")), F.concat(F.array(x), held)).otherwise(held),
    )
    placed = regions.join(pages.select(page, walk.alias("_starts")), page)
    column = F.size(F.filter("_starts", lambda s: s <= F.col("x")))
    order = Window.partitionBy(page).orderBy("_column", "y", "x", "region_id")
    return placed.withColumn("_column", column).withColumn("ordinal", F.row_number().over(order) - 1).drop("_starts", "_column")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def keep_frames(frames: DataFrame, distance: int, key: str = "video_id", order: str = "frame", hash_col: str = "hash") -> DataFrame:
    """Frames whose 64-bit hash is over `distance` bits from the last frame kept of their video.

    What is kept depends on what was kept before, so sorted rows of each video are walked through once.
    """

    def walk(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, last = None, None
        for frame in rows:
            chosen = []
            for own, value in zip(frame[key], frame[hash_col], strict=True):
                new = own != video or ((int(value) ^ last) & (1 << 64) - 1).bit_count() > distance
                if new:
                    video, last = own, int(value)
                chosen.append(new)
            yield frame[chosen]

    return frames.repartition(key).sortWithinPartitions(key, order).mapInPandas(walk, frames.schema)


def resolve_rules(matches: DataFrame, local: DataFrame) -> DataFrame:
    """Value of each element and category: a local one, else that of the last matching rule.

    matches: element_id, category, ordinal, value; local: element_id, category, value.
    """
    rules = matches.groupBy("element_id", "category").agg(F.max_by("value", "ordinal").alias("rule_value"))
    own = local.select("element_id", "category", F.col("value").alias("local_value"))
    return rules.join(own, ["element_id", "category"], "full_outer").select("element_id", "category", F.coalesce("local_value", "rule_value").alias("value"))


def metadata_blocks(docs: DataFrame, key: str, metadata: str) -> DataFrame:
    """A block per metadata entry with text, named by a slug of its key."""
    entries = docs.select(key, F.explode(F.map_entries(metadata)).alias("e")).filter(F.coalesce(F.trim("e.value"), F.lit("")) != "")
    slug = F.regexp_replace(F.regexp_replace(F.lower("e.key"), "[^a-z0-9]+", "-"), "^-|-$", "")
    return entries.select(key, F.concat(F.lit("meta-"), slug).alias("block_id"), F.col("e.value").alias("text"))


def numbered(blocks: DataFrame, path: str, order: str) -> DataFrame:
    """Continuous numbers over the blocks of all files: counts per file are added up, files number their own."""
    counts = blocks.groupBy(path).count()
    before = Window.orderBy(path).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = counts.select(path, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(path).orderBy(order))
    return blocks.withColumn("_n", own).join(bases, path).withColumn("number", F.col("_base") + F.col("_n")).drop("_base", "_n")


def newest_formats(formats: DataFrame, name: str = "name") -> DataFrame:
    """Formats without the versioned ones (name@v) whose bare name is there, too."""
    bare = formats.filter(~F.contains(F.col(name), F.lit("@"))).select(F.col(name).alias("_bare"))
    versioned = F.contains(F.col(name), F.lit("@")) & (F.substring_index(name, "@", 1) == F.col("_bare"))
    return formats.join(bare, versioned, "left_anti")
