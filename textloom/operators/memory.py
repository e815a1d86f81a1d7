"""Content memory: exact and fuzzy matches of many texts at once.

Queries and entries are tables; a lookup is a set of joins: equality on keys for the exact tiers, and for the fuzzy
tier a join on segments of the texts, which provably finds every entry that reaches the score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..session import checkpoint
from . import segments

#: Match types by priority.
EXACT_TIERS = ("generalized", "structural", "plain")
NEAR_EXACT = 0.99


def exact_matches(queries: DataFrame, entries: DataFrame, tiers: tuple[str, ...] = EXACT_TIERS) -> DataFrame:
    """(query_id, entry_id, target, score, tier) by equality of the columns <tier>_key; the first tier of a pair counts.

    A plain match whose structural key differs scores NEAR_EXACT.
    """
    out = None
    for priority, tier in enumerate(tiers):
        key = f"{tier}_key"
        score = F.lit(1.0)
        if tier == "plain" and "structural" in tiers:
            score = F.when(F.col("q.structural_key") == F.col("e.structural_key"), 1.0).otherwise(NEAR_EXACT)
        found = (
            queries.alias("q")
            .join(entries.alias("e"), F.col(f"q.{key}") == F.col(f"e.{key}"))
            .select("q.query_id", "e.entry_id", "e.target", score.alias("score"), F.lit(priority).alias("tier"))
        )
        out = found if out is None else out.unionByName(found)
    first = out.groupBy("query_id", "entry_id").agg(F.min_by(F.struct("target", "score", "tier"), "tier").alias("m"))
    return first.select("query_id", "entry_id", "m.*")


def settle_ambiguous(matches: DataFrame, distance: Column | None = None) -> DataFrame:
    """Full-score matches of a query with differing targets are demoted to NEAR_EXACT and flagged.

    With a `distance` (of the entry's place from the query's) the nearest one, then the smallest text, keeps its score.
    """
    full = F.col("score") >= 1
    own = Window.partitionBy("query_id")
    targets = F.size(F.collect_set(F.when(full, F.col("target"))).over(own))
    out = matches.withColumn("ambiguous", full & (targets > 1))
    if distance is not None:
        nearest = Window.partitionBy("query_id").orderBy((~full).cast("int"), distance, "target", "entry_id")
        out = out.withColumn("ambiguous", F.col("ambiguous") & (F.row_number().over(nearest) > 1))
    return out.withColumn("score", F.when(F.col("ambiguous"), NEAR_EXACT).otherwise(F.col("score")))


def point_distance(a: Column, b: Column) -> Column:
    """0 for equal places profile/channel/collection (U+001F between them), else 3 less the rungs of the common prefix."""
    x, y = F.split(a, "\x1f"), F.split(b, "\x1f")
    same = [F.coalesce(F.get(x, F.lit(k)) == F.get(y, F.lit(k)), F.lit(False)) for k in range(3)]
    return (
        F.when(a == b, 0)
        .when(same[0] & same[1], 1)
        .when(same[0], 2)
        .otherwise(3)
    )


def _matching(texts: DataFrame, name: str, least: float, wanted: np.ndarray | None = None) -> DataFrame:
    """Texts with `id` (hash), `n` and their keys: of queries, or of entries those that the table `wanted` has."""
    keyed = texts.select(F.xxhash64(name).alias("id"), F.char_length(name).alias("n"), name).withColumn("keys", segments.keys(F.col(name), least, wanted))
    return keyed if wanted is None else keyed.filter(F.size("keys") > 0)


def alike_texts(queries: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """(q, e, score) of all pairs of the different texts `q` and `e` whose edit ratio is at least `least`.

    Of a query that at most d edits set apart from its matches, cut into d + 1 segments, one stands unchanged in every match,
    at most d places off (`segments`). So all substrings of entries are looked up among the queries' segments, in a bit table
    of bounded size first: only what it has is shuffled, and only texts that meet are compared, by a bounded edit distance.
    """
    q = queries.select("q").filter("q is not null").distinct()
    probes = checkpoint(_matching(q, "q", least).select(F.col("id").alias("x"), F.col("n").alias("xn"), F.explode("keys").alias("k")).select("x", "xn", F.col("k.key").alias("key"), F.col("k.at").alias("s")))
    # Texts of entries stay where their hash puts them: read twice, shuffled once. The size keeps the keys in both readings.
    e = _matching(entries.select("e").filter("e is not null"), "e", least, segments.bit_table(probes, "key"))
    e = e.repartition("id").dropDuplicates(["id", "n", "e"]).filter(F.size("keys") > 0)
    index = e.select(F.col("id").alias("y"), F.col("n").alias("yn"), F.explode("keys").alias("k")).select("y", "yn", F.col("k.key").alias("key"), F.col("k.at").alias("p"))
    longer = F.greatest("xn", "yn")
    most = F.floor(longer * F.lit(1 - least) + F.lit(1e-9)).cast("int")
    off = F.abs(F.col("p") - F.col("s")) + F.abs((F.col("yn") - F.col("p")) - (F.col("xn") - F.col("s")))
    near = F.when(F.col("s") >= 0, off).otherwise(F.abs(F.col("yn") - F.col("xn"))) <= most
    pairs = probes.join(index, "key").filter(near).select("x", "y").distinct()
    both = pairs.join(q.select(F.xxhash64("q").alias("x"), "q"), "x").join(e.select(F.col("id").alias("y"), "e", "keys"), "y").filter(F.size("keys") > 0)
    both = both.withColumn("longer", F.greatest(F.char_length("q"), F.char_length("e")))
    most = F.floor(F.col("longer") * F.lit(1 - least) + F.lit(1e-9)).cast("int")
    both = both.withColumn("edits", F.call_function("levenshtein", F.col("q"), F.col("e"), most)).filter("edits >= 0")
    score = F.when(F.col("longer") == 0, F.lit(1.0)).otherwise(1 - F.col("edits") / F.col("longer"))
    return both.withColumn("score", score).filter(F.col("score") >= least).select("q", "e", "score")


def fuzzy_matches(queries: DataFrame, entries: DataFrame, least: float = 0.7, key: str = "plain_key") -> DataFrame:
    """(query_id, entry_id, target, score) of all pairs whose edit ratio is at least `least`.

    Each different text is compared once, however many queries and entries have it; then ids take the places of texts.
    """
    q = queries.select("query_id", F.col(key).alias("q")).filter("q is not null")
    e = entries.select("entry_id", "target", F.col(key).alias("e")).filter("e is not null")
    found = alike_texts(q, e, least)
    by_query = found.join(q, "q").select("query_id", "e", "score").distinct()
    # Pairs of ids are many: only those of an entry that has several texts can come twice, and only they are made distinct.
    texts = e.groupBy("entry_id", "target").agg(F.collect_set("e").alias("texts"))
    one = texts.filter(F.size("texts") == 1).select("entry_id", "target", F.element_at("texts", 1).alias("e"))
    more = texts.filter(F.size("texts") > 1).select("entry_id", "target", F.explode("texts").alias("e"))
    columns = ["query_id", "entry_id", "target", "score"]
    return by_query.join(one, "e").select(*columns).unionByName(by_query.join(more, "e").select(*columns).distinct())


def _comparable(rows: DataFrame, names: list[str]) -> list[Column]:
    """Columns that can be grouped by: maps as their sorted entries."""
    return [(F.array_sort(F.map_entries(n)) if isinstance(rows.schema[n].dataType, MapType) else F.col(n)).alias(f"_{k}") for k, n in enumerate(names)]


def first_of_each(queries: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first query of each group that is equal in the columns, and for each query (query_id) that one (first_id)."""
    keyed = queries.select("query_id", *names, *_comparable(queries, names))
    keys = [f"_{k}" for k in range(len(names))]
    firsts = keyed.groupBy(*keys).agg(F.min("query_id").alias("query_id"), F.min_by(F.struct(*names), "query_id").alias("_row"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    held = keyed.alias("a").join(firsts.alias("b"), same).select(F.col("a.query_id").alias("query_id"), F.col("b.query_id").alias("first_id"))
    return firsts.select("query_id", "_row.*"), held


def first_entries(entries: DataFrame, names: list[str], most: int) -> DataFrame:
    """Of entries that are equal in the columns those with the `most` smallest ids; no other is among the `most` best of a query."""
    order = Window.partitionBy(*_comparable(entries, names)).orderBy("entry_id")
    return entries.select("entry_id", *names, F.dense_rank().over(order).alias("_r")).filter(F.col("_r") <= most).drop("_r")


def of_each(matches: DataFrame, held: DataFrame) -> DataFrame:
    """The matches of the first queries for all queries that are like them."""
    return held.join(matches.withColumnRenamed("query_id", "first_id"), "first_id").select(*matches.columns)


def best_matches(matches: DataFrame, most: int = 1) -> DataFrame:
    """The best matches of each query: score, then tier, then entry id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "tier", "entry_id")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def tiered_lookup(queries: DataFrame, entries: DataFrame, least: float = 0.7, most: int = 5, same_project: float = 0.03) -> DataFrame:
    """Exact tiers, then fuzzy for the rest of the pairs: query_id, entry_id, target, score, tier, ambiguous, rank.

    queries: query_id and the keys generalized_key, structural_key, plain_key. entries: entry_id, target and the same keys; ids are unique.
    Queries that are alike are looked up once, and of alike entries only those with the `most` smallest ids, as no other can be among the best.
    If both have `project`, a match in the same project gains `same_project`, up to 1. With least >= 1, queries that
    have an exact match aren't looked up again.
    """
    keys = [f"{tier}_key" for tier in EXACT_TIERS]
    shared = ["project"] if "project" in queries.columns and "project" in entries.columns else []
    queries, held = first_of_each(queries, [*keys, *shared])
    entries = first_entries(entries, ["target", *keys, *shared], most)
    exact = settle_ambiguous(exact_matches(queries, entries))
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti") if least >= 1 else queries
    fuzzy = fuzzy_matches(rest, entries, least).join(exact, ["query_id", "entry_id"], "left_anti")
    both = exact.unionByName(fuzzy.withColumn("tier", F.lit(len(EXACT_TIERS))).withColumn("ambiguous", F.lit(False)))
    if shared:
        both = both.join(queries.select("query_id", F.col("project").alias("_p")), "query_id").join(
            entries.select("entry_id", F.col("project").alias("_o")), "entry_id"
        )
        gain = F.when((F.col("_p") == F.col("_o")) & ~F.col("ambiguous"), same_project).otherwise(0.0)
        both = both.withColumn("score", F.least(F.col("score") + gain, F.lit(1.0))).drop("_p", "_o")
    return of_each(best_matches(both.filter(F.col("score") >= least), most), held)


def adapt(target: Column, stored: Column, wanted: Column) -> Column:
    """The target with the first occurrence of each stored entity value replaced by the query's (two maps by id)."""
    ids = F.array_intersect(F.map_keys(stored), F.map_keys(wanted))

    def put(text: Column, i: Column) -> Column:
        old, at = F.try_element_at(stored, i), F.instr(text, F.try_element_at(stored, i))
        return F.when(
            at > 0,
            F.concat(F.substring(text, F.lit(1), at - 1), F.try_element_at(wanted, i), F.substring(text, at + F.char_length(old), F.char_length(text))),
        ).otherwise(text)

    return F.aggregate(ids, target, put)


def memory_id(source_locale: Column, target_locale: Column, source: Column, target: Column) -> Column:
    parts = F.concat_ws("\0", source_locale, target_locale, source, target)
    return F.concat(F.lit("tmseed-"), F.substring(F.sha2(parts, 256), 1, 32))


def merge_variants(variants: DataFrame) -> DataFrame:
    """Latest variant of each entry and locale; an empty one retires the locale. Columns entry_id, locale, text, at."""
    newest = variants.groupBy("entry_id", "locale").agg(F.max_by("text", "at").alias("text"), F.max("at").alias("at"))
    return newest.filter(F.coalesce("text", F.lit("")) != "")
