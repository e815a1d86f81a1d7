"""Terms: matching in texts, coverage, status rules and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The known statuses.
STATUSES = ("proposed", "admitted", "preferred", "deprecated", "forbidden")

#: Terms that every task may hold at most.
FEW = 10_000

#: Scripts that put no spaces between words: there a term needs no word boundary.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"


def term_pattern(term: Column) -> Column:
    """Regular expression of a term: case folded, any white space between words, boundaries where an edge is a word character."""
    quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(term, r"(?U)\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))
    edge = rf"[\p{{L}}\p{{N}}_&&[^{UNSPACED}]]"
    left = F.when(term.rlike(f"^{edge}"), rf"(?<!{edge})").otherwise("")
    right = F.when(term.rlike(f"{edge}$"), rf"(?!{edge})").otherwise("")
    return F.concat(F.lit("(?iu)"), left, quoted, right)


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def term_hits(blocks: DataFrame, terms: DataFrame, block_id: str, text: str) -> DataFrame:
    """(block_id, term_id, hits): how often each term's words stand consecutively in a text.

    Word n-grams of the blocks, of the lengths that terms have, are joined to the terms by equality, so the
    work grows with the text and not with text times terms. Up to FEW terms are sent to every task, where n-grams that are none
    of them go at once; more are joined by a shuffle. Terms of unspaced scripts go through `term_matches`. terms: term_id, term.
    """
    folded = terms.select("term_id", tokens(F.col("term")).alias("t")).filter(F.size("t") > 0)
    keyed = folded.select("term_id", F.size("t").alias("length"), F.array_join("t", " ").alias("gram"))
    counts = {r["length"]: r["count"] for r in keyed.groupBy("length").count().orderBy("length").collect()}
    if not counts:
        return blocks.select(block_id).join(keyed.select("term_id"), F.lit(False)).withColumn("hits", F.lit(0).cast("long"))
    known = keyed.select("term_id", "gram")
    words = blocks.select(block_id, tokens(F.col(text)).alias("w"))

    def grams(n: int) -> Column:
        if n == 1:
            return F.col("w")
        found = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, found).otherwise(F.array().cast("array<string>"))

    rolled = words.filter("w is not null").select(block_id, F.explode(F.concat(*[grams(n) for n in counts])).alias("gram"))
    met = rolled.join(F.broadcast(known) if sum(counts.values()) <= FEW else known, "gram")
    return met.groupBy(block_id, "term_id").agg(F.count(F.lit(1)).alias("hits"))


def term_matches(blocks: DataFrame, terms: DataFrame, block_id: str, text: str) -> DataFrame:
    """(block_id, term_id, hits) by regular expression, for a small list of terms in any script."""
    hits = F.regexp_count(F.col(text), F.col("pattern"))
    small = terms.select("term_id", term_pattern(F.col("term")).alias("pattern"))
    return blocks.join(small, F.rlike(F.col(text), F.col("pattern"))).select(block_id, "term_id", hits.cast("long").alias("hits"))


def locale_coverage(terms: DataFrame, concept: str = "concept_id", locale: str = "locale") -> DataFrame:
    """Distinct concepts of each locale and their percentage of all concepts."""
    total = terms.agg(F.countDistinct(concept).alias("total"))
    counts = terms.groupBy(locale).agg(F.countDistinct(concept).alias("concepts"))
    return counts.crossJoin(total).select(locale, "concepts", (F.col("concepts") * 100.0 / F.col("total")).alias("percent"))


def may_change(before: Column, after: Column) -> Column:
    """Any change between known statuses is valid, also to the same one; unknown or null ones make it invalid."""
    return F.coalesce(before.isin(*STATUSES) & after.isin(*STATUSES), F.lit(False))


def is_governed(before: Column, after: Column) -> Column:
    """Changes to forbidden or preferred, or away from forbidden, need approval."""
    return (before != after) & (after.isin("forbidden", "preferred") | (before == "forbidden"))


def is_valid(at: Column, valid_from: Column, valid_to: Column, tags: Column, scope: dict[str, str]) -> Column:
    """Half-open interval [from, to) and every tag of the row present in the scope with the same value."""
    known = F.create_map(*[F.lit(x) for pair in scope.items() for x in pair]) if scope else F.create_map().cast("map<string,string>")
    held = F.forall(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(F.try_element_at(known, e["key"]) == e["value"], F.lit(False)))
    return (valid_from.isNull() | (valid_from <= at)) & (valid_to.isNull() | (at < valid_to)) & held
