"""Differences between two states of content, and which documents are the same under new paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def hash_diff(mine: DataFrame, theirs: DataFrame, key: str, hash_col: str) -> DataFrame:
    """State of each key: new (only theirs), deleted (only mine), changed or unchanged."""
    a, b = mine.select(key, F.col(hash_col).alias("_a")), theirs.select(key, F.col(hash_col).alias("_b"))
    state = (
        F.when(F.col("_a").isNull(), "new")
        .when(F.col("_b").isNull(), "deleted")
        .when(F.col("_a") == F.col("_b"), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def leverage(now: DataFrame, before: DataFrame, key: str, text_col: str, target_col: str, least: int = 70) -> DataFrame:
    """Targets of the previous version: kind equal, case, fuzzy (over `least` percent) or none."""
    from ..functions.text import similarity_percent

    old = before.select(key, F.col(text_col).alias("_old"), F.col(target_col).alias("_target"))
    joined = now.join(old, key, "left")
    percent = F.when(F.col("_old").isNotNull(), similarity_percent(F.col(text_col), F.col("_old")))
    kind = (
        F.when(F.col("_old") == F.col(text_col), "equal")
        .when(F.lower("_old") == F.lower(text_col), "case")
        .when(percent > least, "fuzzy")
        .otherwise("none")
    )
    out = joined.withColumn("kind", kind).withColumn("percent", percent)
    return out.withColumn("target", F.when(F.col("kind") != "none", F.col("_target"))).drop("_old", "_target")


def _first_blocks(blocks: DataFrame, path: str, least: float) -> DataFrame:
    """Of a path's blocks (`_h`, numbered by `_j`, seen `_f` times) the rarest, of which any path that has `least` of them has one."""
    rarest = Window.partitionBy(path).orderBy("_f", "_h", "_j")
    cut = F.col("_size") - F.ceil(F.col("_size") * F.lit(least) - F.lit(1e-9)) + 1
    return blocks.withColumn("_r", F.row_number().over(rarest)).filter(F.col("_r") <= cut).select(path, "_h", "_j", "_size")


def block_overlap(now: DataFrame, before: DataFrame, path: str, hash_col: str, least: float = 0.0) -> DataFrame:
    """Multiset similarity of document pairs that share a block: common / larger number of blocks. With `least` those of at least that.

    Pairs meet on a block's hash; counts are summed before they meet, so a pair comes from each hash once. With `least`, documents
    meet by their rarest blocks only, as many as must have one in common with each document that is so similar; a block
    that many documents have makes no pairs but where they have little else.
    """
    a = now.groupBy(F.col(path).alias("path"), F.col(hash_col).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    b = before.groupBy(F.col(path).alias("old_path"), F.col(hash_col).alias("_h")).agg(F.count(F.lit(1)).alias("_m"))
    sizes_a = a.groupBy("path").agg(F.sum("_n").alias("_size"))
    sizes_b = b.groupBy("old_path").agg(F.sum("_m").alias("_old_size"))
    if least > 0:
        def numbered(blocks: DataFrame, key: str, count: str, sizes: DataFrame, size: str) -> DataFrame:
            return blocks.join(sizes.withColumnRenamed(size, "_size"), key).select(key, "_h", "_size", F.explode(F.sequence(F.lit(1), F.col(count))).alias("_j"))

        each_a, each_b = numbered(a, "path", "_n", sizes_a, "_size"), numbered(b, "old_path", "_m", sizes_b, "_old_size")
        seen = each_a.select("_h", "_j").unionByName(each_b.select("_h", "_j")).groupBy("_h", "_j").agg(F.count(F.lit(1)).alias("_f"))
        first_a = _first_blocks(each_a.join(seen, ["_h", "_j"]), "path", least)
        first_b = _first_blocks(each_b.join(seen, ["_h", "_j"]), "old_path", least).withColumnRenamed("_size", "_old_size")
        met = first_a.join(first_b, ["_h", "_j"]).filter(F.least("_size", "_old_size") >= F.greatest("_size", "_old_size") * F.lit(least) - F.lit(1e-9))
        common = met.select("path", "old_path").distinct().join(a, "path").join(b, ["old_path", "_h"])
    else:
        common = a.join(b, "_h")
    common = common.groupBy("path", "old_path").agg(F.sum(F.least("_n", "_m")).alias("common"))
    out = common.join(sizes_a, "path").join(sizes_b, "old_path")
    out = out.select("path", "old_path", (F.col("common") / F.greatest("_size", "_old_size")).alias("similarity"))
    return out.filter(F.col("similarity") >= least) if least > 0 else out


def _content(hash_col: str) -> Column:
    """One value for each multiset of blocks."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(hash_col).cast("string"))), "\0"), 256)


def _groups(pairs: DataFrame) -> DataFrame:
    """(path, group) of the paths of pairs (path, old_path) that are connected: the smallest path of them, spread in both directions and doubled."""
    held = pairs.select("path").distinct().withColumn("group", F.col("path"))
    while True:
        of_old = pairs.join(held, "path").groupBy("old_path").agg(F.min("group").alias("group"))
        near = pairs.join(of_old, "old_path").groupBy("path").agg(F.min("group").alias("group"))
        far = near.select(F.col("path").alias("group"), F.col("group").alias("_far"))
        next_ = near.join(far, "group").join(held.withColumnRenamed("group", "_was"), "path")
        next_ = checkpoint(next_.select("path", F.col("_far").alias("group"), (F.col("_far") != F.col("_was")).alias("_moved")))
        held = next_.select("path", "group")
        if next_.filter("_moved").isEmpty():
            return held


def _claimed(pairs: DataFrame) -> DataFrame:
    """(path, old_path): in the order of paths each takes its first choice (`_r`) that is left.

    Documents that aren't connected don't meet, so each connected group is one pass over its sorted pairs, of which a task keeps only
    the old documents that are taken. Rounds of requests and refusals would be as many as a group has near copies.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, path, taken, served = None, None, set(), False
        for frame in frames:
            out = []
            for g, p, old in zip(frame["group"], frame["path"], frame["old_path"], strict=True):
                if g != group:
                    group, taken = g, set()
                if p != path:
                    path, served = p, False
                if not served and old not in taken:
                    taken.add(old)
                    served = True
                    out.append((p, old))
            yield pd.DataFrame(out, columns=["path", "old_path"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("path", "old_path"))
    grouped = pairs.join(_groups(pairs), "path").repartition("group").sortWithinPartitions("group", "path", "_r")
    return grouped.select("group", "path", "old_path").mapInPandas(walk, kinds)


def reconcile(now: DataFrame, before: DataFrame, path: str, hash_col: str, least: float = 0.5) -> DataFrame:
    """State of each path: unchanged or edited (same path), moved (from old_path) or new.

    Paths that stay are settled first. The others claim, in the order of their paths, the most similar old document
    that is left, if it has at least `least` of its blocks in common.

    Documents of equal blocks are compared as one. Paths of equal blocks have the same preferences, so the n-th of them never gets a
    choice before its n-th.
    """
    a = now.groupBy(F.col(path).alias("path")).agg(_content(hash_col).alias("_a"))
    b = before.groupBy(F.col(path).alias("path")).agg(_content(hash_col).alias("_b"))
    both = a.join(b, "path", "left").withColumn(
        "state", F.when(F.col("_a") == F.col("_b"), "unchanged").when(F.col("_b").isNotNull(), "edited")
    )
    settled = both.filter("state is not null").select("path", "state", F.col("path").alias("old_path"))
    open_now = checkpoint(both.filter("state is null").select("path", "_a"))
    open_old = checkpoint(b.join(a.select("path"), "path", "left_anti").select("path", "_b"))
    first_now, first_old = open_now.groupBy("_a").agg(F.min("path").alias("path")), open_old.groupBy("_b").agg(F.min("path").alias("path"))
    one_now = now.join(first_now, now[path] == first_now["path"], "left_semi")
    one_old = before.join(first_old, before[path] == first_old["path"], "left_semi")
    alike = block_overlap(one_now, one_old, path, hash_col, least)
    alike = alike.join(first_now, "path").drop("path").join(first_old.withColumnRenamed("path", "old_path"), "old_path").drop("old_path")
    choices = alike.join(open_old.withColumnRenamed("path", "old_path"), "_b")
    choices = choices.withColumn("_r", F.row_number().over(Window.partitionBy("_a").orderBy(F.desc("similarity"), "old_path")))
    members = open_now.withColumn("_i", F.row_number().over(Window.partitionBy("_a").orderBy("path")))
    pairs = checkpoint(choices.select("_a", "old_path", "_r").join(members, "_a").filter("_r >= _i"))
    wishes = checkpoint(_claimed(pairs.select("path", "old_path", "_r")))
    moved = wishes.select("path", F.lit("moved").alias("state"), "old_path")
    new = open_now.join(moved, "path", "left_anti").select("path", F.lit("new").alias("state"), F.lit(None).cast("string").alias("old_path"))
    return settled.unionByName(moved).unionByName(new)


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unites spans of a key that overlap or touch."""
    along = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= reach, 0).otherwise(1)
    marked = spans.withColumn("_new", new).withColumn("_group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def pack_blocks(blocks: DataFrame, keys: list[str], order: str, tokens: str, budget: int, most: int) -> DataFrame:
    """Numbers greedy batches in order: a batch closes when its budget or its number of blocks would be passed.

    The state of a key's open batch travels from row to row, so this is a loop over sorted rows of each key.
    """

    def walk(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, used, held = None, 0, 0, 0
        for frame in rows:
            numbers = []
            for own, size in zip(frame[keys].itertuples(index=False, name=None), frame[tokens], strict=True):
                if own != key:
                    key, batch, used, held = own, 0, 0, 0
                elif held and (used + size > budget or held >= most):
                    batch, used, held = batch + 1, 0, 0
                used, held = used + size, held + 1
                numbers.append(batch)
            yield frame.assign(batch=numbers)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return blocks.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(walk, fields + ", batch long")
