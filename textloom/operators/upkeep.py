"""Keeping content in order: targets laid over sources, decisions taken into memory, findings settled, terms kept from change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import memory_id

APPROVED, REJECTED = ("approved", "signed-off"), ("rejected",)
#: Ranges of scores in a summary, by their upper ends.
BUCKETS = (25, 50, 75, 100)


def overlay_targets(sources: DataFrame, targets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Source blocks (doc, seq, key, address, any more) with `target_text` and `paired_by` from target blocks (doc, seq, key, address, text).

    A block takes the target of its key; else that of its address (null or empty: none); else, where both documents have as
    many blocks, the one in its place by seq. Of targets with one key or address the last counts. paired_by: key, address,
    place or null.
    """

    def last(column: str, name: str) -> DataFrame:
        held = targets.filter(F.coalesce(column, F.lit("")) != "").groupBy(doc, column)
        return held.agg(F.max_by("text", "seq").alias(name), F.lit(True).alias(f"_by_{column}"))

    def placed(blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("_place", F.row_number().over(Window.partitionBy(doc).orderBy("seq")))

    counts = sources.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).join(targets.groupBy(doc).agg(F.count(F.lit(1)).alias("_m")), doc)
    even = counts.filter("_n = _m").select(doc)
    by_place = placed(targets).join(even, doc).select(doc, "_place", F.col("text").alias("_t3"), F.lit(True).alias("_by_place"))
    out = placed(sources).join(last("key", "_t1"), [doc, "key"], "left").join(last("address", "_t2"), [doc, "address"], "left").join(by_place, [doc, "_place"], "left")
    found = F.when(F.col("_by_key"), F.struct(F.lit("key").alias("by"), F.col("_t1").alias("t")))
    found = found.when(F.col("_by_address"), F.struct(F.lit("address").alias("by"), F.col("_t2").alias("t")))
    found = found.when(F.col("_by_place"), F.struct(F.lit("place").alias("by"), F.col("_t3").alias("t")))
    return out.withColumn("_f", found).select(*sources.columns, F.col("_f.t").alias("target_text"), F.col("_f.by").alias("paired_by"))


def promote_decisions(blocks: DataFrame, decisions: DataFrame, memory: DataFrame) -> DataFrame:
    """The memory (entry_id, source_locale, target_locale, source_text, target_text) after decisions on units.

    blocks: item, unit, locale, source_locale, source_text, target_text. decisions: item, unit, locale, state, target_hash. What is
    approved comes in, what is rejected goes, but only where the decision's hash is that of the unit's present target: a
    stale decision moves nothing. Ids follow from the wording, so doing it again changes nothing; of a wording both
    approved and rejected the rejection counts.
    """
    held = blocks.join(decisions.select("item", "unit", "locale", "state", "target_hash"), ["item", "unit", "locale"])
    fresh = held.filter((F.coalesce("target_text", F.lit("")) != "") & (F.col("target_hash") == F.sha2("target_text", 256)))
    judged = fresh.withColumn("entry_id", memory_id(F.col("source_locale"), F.col("locale"), F.col("source_text"), F.col("target_text")))
    gone = judged.filter(F.col("state").isin(*REJECTED)).select("entry_id").distinct()
    come = judged.filter(F.col("state").isin(*APPROVED)).select("entry_id", "source_locale", F.col("locale").alias("target_locale"), "source_text", "target_text").dropDuplicates(["entry_id"])
    kept = memory.join(come.select("entry_id"), "entry_id", "left_anti")
    return kept.unionByName(come).join(gone, "entry_id", "left_anti")


def settled_findings(findings: DataFrame, answers: DataFrame, category: str = "target-same-as-source") -> DataFrame:
    """Findings with `suppressed`: those of the category whose text and locale the record answers.

    findings: category, source_text, locale, any more. answers: source_text, locale of what needs no other target (terms that
    stay as they are, approved identical targets).
    """
    known = answers.select("source_text", "locale", F.lit(True).alias("_known")).distinct()
    out = findings.join(known, ["source_text", "locale"], "left")
    return out.withColumn("suppressed", F.coalesce((F.col("category") == category) & F.col("_known"), F.lit(False))).select(*findings.columns, "suppressed")


def protected_terms(terms: list[str]) -> list[str]:
    """Terms without blanks and repeats, longer ones first, so that one within another is masked after it."""
    return sorted({t.strip() for t in terms} - {""}, key=lambda t: (-len(t), t))


def mask_terms(text: Column, terms: list[str]) -> Column:
    """The text with each of a short list of terms as [[DNT_n]]."""
    for number, term in enumerate(protected_terms(terms)):
        text = F.replace(text, F.lit(term), F.lit(f"[[DNT_{number}]]"))
    return text


def unmask_terms(text: Column, terms: list[str]) -> Column:
    """Puts the terms back, whatever the case of their marks; marks that got lost stay lost."""
    for number, term in enumerate(protected_terms(terms)):
        text = F.regexp_replace(text, rf"(?i)\[\[DNT_{number}\]\]", term.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def score_summary(scores: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, lowest, highest and median of whole scores of 0 to 100, and how many are in each range; the median is exact.

    Scores are counted by value first, so a group is at most 101 rows.
    """
    keys = by or []
    counts = scores.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    low = [-1, *BUCKETS]
    ranges = [F.sum(F.when((F.col("s") > low[k]) & (F.col("s") <= top), F.col("n")).otherwise(0)).alias(f"to_{top}") for k, top in enumerate(BUCKETS)]
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("s").alias("lowest"),
        F.max("s").alias("highest"),
        F.percentile("s", 0.5, F.col("n")).alias("median"),
        *ranges,
    )


def apply_suggestions(rules: DataFrame, suggestions: DataFrame, least: int) -> DataFrame:
    """Forbidden-term rules (term, replacement, note, concept_id) after suggestions (those and corrections) of `least` corrections and more; 0: none.

    Terms are one whatever their case; a rule keeps its spelling, and what a suggestion leaves empty. Of several suggestions
    for a term the one of most corrections counts.
    """
    if least <= 0:
        return rules
    folded = F.lower(F.trim("term"))
    ready = suggestions.filter((F.col("corrections") >= least) & (folded != "")).groupBy(folded.alias("_k"))
    best = ready.agg(F.max_by(F.struct("term", "replacement", "concept_id", "corrections"), F.struct("corrections", "term")).alias("s"))
    both = rules.withColumn("_k", folded).join(best, "_k", "full")

    def given(column: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"s.{column}"), F.lit("")), F.col(column)).alias(column)

    note = F.when(F.col("s").isNotNull(), F.concat(F.lit("from "), F.col("s.corrections"), F.lit(" corrections"))).otherwise(F.col("note"))
    return both.select(F.coalesce("term", "s.term").alias("term"), given("replacement"), note.alias("note"), given("concept_id"))
