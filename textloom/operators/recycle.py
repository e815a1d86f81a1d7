"""Reuse of content memory: fuzzy matches over three keys at once, entity values carried over, targets filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits
from . import memory
from .memory import EXACT_TIERS, NEAR_EXACT

#: Tiers of exact matches on a key, and of fuzzy ones on it, in order of the keys.
FUZZY_TIER = len(EXACT_TIERS)
#: Tiers whose keys have a type where an entity's value stands.
GENERAL_TIERS = (0, FUZZY_TIER)


def _stacked(rows: DataFrame, id_col: str, more: list[str]) -> DataFrame:
    """A row per different text of a row's three keys: id (struct of the id and which keys have the text), text."""
    keys = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.col(f"{tier}_key").alias("text")) for k, tier in enumerate(EXACT_TIERS)])
    flat = rows.select(id_col, *more, F.explode(keys).alias("k")).select(id_col, *more, "k.*").filter("text is not null")
    each = flat.groupBy(id_col, "text").agg(F.bit_or("bit").alias("bits"), *[F.first(c).alias(c) for c in more])
    return each.select(F.struct(F.col(id_col).alias("id"), "bits").alias(id_col), F.col("text").alias("any_key"), *more)


def three_key_fuzzy(queries: DataFrame, entries: DataFrame, least: float = 0.7) -> DataFrame:
    """(query_id, entry_id, target, score, tier) of pairs of which some key's edit ratio is at least `least`.

    The best ratio of the generalized, structural and plain keys counts, of equal ones the first; tiers 3 to 5 name the key. All keys
    go through one index, in which texts that several keys of a row have in common stand once.
    """
    found = memory.fuzzy_matches(_stacked(queries, "query_id", []), _stacked(entries, "entry_id", ["target"]), least, key="any_key")
    common = F.col("query_id.bits").bitwiseAND(F.col("entry_id.bits"))
    first = F.when(common.bitwiseAND(F.lit(1)) > 0, 0).when(common.bitwiseAND(F.lit(2)) > 0, 1).otherwise(2)
    rated = found.filter(common > 0).select(
        F.col("query_id.id").alias("query_id"), F.col("entry_id.id").alias("entry_id"), "target", "score", (first + FUZZY_TIER).alias("tier")
    )
    best = rated.groupBy("query_id", "entry_id").agg(F.max_by(F.struct("target", "score", "tier"), F.struct("score", -F.col("tier"))).alias("m"))
    return best.select("query_id", "entry_id", "m.*")


def full_lookup(
    queries: DataFrame, entries: DataFrame, least: float = 0.7, most: int = 5, same_project: float = 0.03, distance: Column | None = None
) -> DataFrame:
    """Exact tiers, then fuzzy ones over all three keys: query_id, entry_id, target, score, tier, ambiguous, adapted, rank.

    queries: query_id, generalized_key, structural_key, plain_key; entries: entry_id, target and the same keys. If both have
    `project`, a fuzzy match in the same project gains `same_project`, up to 1. If both have `entities` (map of id to value),
    `adapted` is the target with the query's values, where values were generalised in the match; else the target.
    With least >= 1, queries that have an exact match aren't looked up again. distance: as of `settle_ambiguous`.

    Ids are unique. Without a distance, queries that are alike are looked up once, and of alike entries only those with the
    `most` smallest ids, as no other can be among the best.
    """
    used = [f"{tier}_key" for tier in EXACT_TIERS] + [c for c in ("project", "entities") if c in queries.columns and c in entries.columns]
    held = None
    if distance is None:
        queries, held = memory.first_of_each(queries, used)
        entries = memory.first_entries(entries, ["target", *used], most)
    exact = memory.settle_ambiguous(memory.exact_matches(queries, entries), distance)
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti") if least >= 1 else queries
    fuzzy = three_key_fuzzy(rest, entries, least).join(exact, ["query_id", "entry_id"], "left_anti")
    both = exact.select("query_id", "entry_id", "target", "score", "tier", "ambiguous").unionByName(fuzzy.withColumn("ambiguous", F.lit(False)))

    def shared(column: str, a: str, b: str) -> DataFrame:
        return both.join(queries.select("query_id", F.col(column).alias(a)), "query_id").join(entries.select("entry_id", F.col(column).alias(b)), "entry_id")

    if "project" in queries.columns and "project" in entries.columns:
        both = shared("project", "_p", "_o")
        gain = F.when((F.col("tier") >= FUZZY_TIER) & (F.col("_p") == F.col("_o")), same_project).otherwise(0.0)
        both = both.withColumn("score", F.when(F.col("score") < 1, F.least(F.col("score") + gain, F.lit(1.0))).otherwise(F.col("score"))).drop("_p", "_o")
    both = both.filter(F.col("score") >= least)
    adapted = F.col("target")
    if "entities" in queries.columns and "entities" in entries.columns:
        both = shared("entities", "_wanted", "_stored")
        known = F.col("tier").isin(*GENERAL_TIERS) & F.col("_wanted").isNotNull() & F.col("_stored").isNotNull()
        adapted = F.when(known, memory.adapt(F.col("target"), F.col("_stored"), F.col("_wanted"))).otherwise(F.col("target"))
    both = both.withColumn("adapted", adapted).drop("_wanted", "_stored")
    best = memory.best_matches(both, most)
    return best if held is None else memory.of_each(best, held)


def recycle(blocks: DataFrame, matches: DataFrame, fill_at: float = NEAR_EXACT) -> DataFrame:
    """Blocks (query_id, target_text, any more) with the best match's adapted target filled in, and `memory_state`, `memory_score`.

    kept: the block has a target. filled: the match scores `fill_at` or more and isn't ambiguous, and the target keeps the codes of the
    source, written as <x id="..."/> tags, if the blocks have a `source_text` with any. offered: there is a lesser match, whose
    text is left out. none: there is no match. The score is in whole per cent.
    """
    best = matches.filter("rank = 1").select("query_id", F.col("adapted").alias("_a"), F.col("score").alias("_s"), F.col("ambiguous").alias("_no"))
    both = blocks.join(best, "query_id", "left")
    tags = [F.array_sort(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(edits.TAG), F.lit(1))) for c in ("source_text", "_a") if c == "_a" or c in blocks.columns]
    same = tags[0] == tags[1] if len(tags) == 2 else F.lit(True)
    kept = F.coalesce("target_text", F.lit("")) != ""
    good = (F.col("_s") >= fill_at) & ~F.col("_no") & same & (F.col("_a") != "")
    state = F.when(kept, "kept").when(F.coalesce(good, F.lit(False)), "filled").when(F.col("_s").isNotNull(), "offered").otherwise("none")
    out = both.withColumn("memory_state", state).withColumn("memory_score", F.round(F.col("_s") * 100).cast("int"))
    return out.withColumn("target_text", F.when(F.col("memory_state") == "filled", F.col("_a")).otherwise(F.col("target_text"))).drop("_a", "_s", "_no")
