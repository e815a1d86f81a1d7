"""Exact deduplication of texts: 128-bit content hashes, then bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pick, stage


def content_hash(text: Column) -> Column:
    """128 bits of MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stays: str = "min",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are the same bytes after lower-casing A-Z. Rows are grouped by a
    128-bit hash of that form together with the form itself, so texts that only share the hash form
    groups of their own. Copies collapse in the map tasks, before anything is shuffled: a text that a
    third of all rows hold leaves each task once. What goes back to the rows is keyed by the hash
    alone; only hashes of more than one text (none, as a rule) are resolved by the bytes again.

    stays: "min" or "max", the end of the id order whose row stays.

    Null text counts as empty. Null ids are larger or smaller than no other: they never stay while
    their group has another id; of a group of null ids one row stays, and its keep_id is null. Of rows
    that repeat the id that stays, text included, one stays. An empty table gives an empty result.
    Further columns of `docs` are ignored, whatever their names.
    """
    pick_id = {"min": F.min, "max": F.max}[stays]
    rows = pick(docs, id=id_col, text=text_col).select("id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = rows.withColumn("hash", digest(F.col("norm")))

    texts = rows.groupBy("hash", "norm").agg(pick_id("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(
        texts.groupBy("hash").agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        )
    )
    light = rows.select("id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    found = light.join(groups.filter("texts = 1"), "hash").drop("texts")
    collided = groups.filter("texts > 1").select("hash")
    if not collided.isEmpty():
        by_bytes = rows.join(collided, "hash", "left_semi").join(texts, ["hash", "norm"])
        found = found.unionByName(by_bytes.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm"))

    # Rows that repeat both id and text are next to each other here; the first of them counts.
    same_id = Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("text_sha256"))).orderBy("text_sha256")
    return found.withColumn("before", F.lag("text_sha256").over(same_id)).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("text_sha256").eqNullSafe(F.col("before"))).alias("kept"),
        "text_sha256",
    )


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
