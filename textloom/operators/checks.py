"""Checks of source and target texts, findings and scores.

A finding is a row (block key, category, severity, message); a check is a function from blocks to findings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import icu, text

#: Penalty of a severity, and the ladder order.
WEIGHTS = {"neutral": 0, "minor": 1, "major": 5, "critical": 25}


def weight(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, severity), F.lit(0))


def findings(blocks: DataFrame, keys: list[str], checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """A row per block and check that holds: keys, category, severity. checks: category -> (severity, condition)."""
    hits = F.array(
        *[F.when(cond, F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"))) for c, (s, cond) in checks.items()]
    )
    return blocks.select(*keys, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("f")).select(*keys, "f.*")


def lint(blocks: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Hygiene of single texts. An empty text (null, too) is the one major finding and the only one it gets."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    some = text.trim_space(body) != ""
    return findings(
        blocks,
        keys,
        {
            "empty": ("major", ~some),
            "leading-whitespace": ("minor", some & text.has_leading_space(body)),
            "trailing-whitespace": ("minor", some & text.has_trailing_space(body)),
            "double-spaces": ("minor", some & F.contains(body, F.lit("  "))),
            "doubled-word": ("minor", some & text.has_doubled_word(body)),
            "control-char": ("minor", some & text.has_control_char(body)),
        },
    )


def length_limits(blocks: DataFrame, keys: list[str], text_col: str, chars: int, words: int) -> DataFrame:
    body = F.col(text_col)
    return findings(
        blocks,
        keys,
        {
            "too_many_chars": ("major", F.char_length(body) > chars),
            "too_many_words": ("minor", text.count_words(body) > words),
        },
    )


def doubled_words(blocks: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Blocks in which a word follows itself, with the number of places."""
    words = blocks.select(*keys, F.split(F.lower(text_col), r"[ \n\t]+").alias("w"))
    pairs = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b"))
    same = F.filter(pairs, lambda p: (p["a"] == p["b"]) & text.is_word(p["a"]))
    return words.filter(F.size("w") > 1).select(*keys, F.size(same).cast("long").alias("places")).filter("places > 0")


def placeholder_findings(pairs: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Placeholders that the target lacks (critical) or adds (major), as multisets."""

    def side(column: str, sign: int) -> DataFrame:
        return pairs.select(*keys, F.explode(text.placeholders(F.col(column))).alias("token"), F.lit(sign).alias("n"))

    delta = side(source, 1).unionByName(side(target, -1)).groupBy(*keys, "token").agg(F.sum("n").alias("delta"))
    return delta.filter("delta <> 0").select(
        *keys,
        "token",
        F.abs("delta").alias("n"),
        F.when(F.col("delta") > 0, "missing").otherwise("extra").alias("category"),
        F.when(F.col("delta") > 0, "critical").otherwise("major").alias("severity"),
    )


def keep_terms(pairs: DataFrame, terms: list[str], keys: list[str], source: str, target: str) -> DataFrame:
    """Terms of the source that must stand verbatim in the target and don't. `terms` is a short list of the caller's."""
    hits = pairs.withColumn("term", F.explode(F.array(*[F.lit(t) for t in terms])))
    return hits.filter(F.col(source).contains(F.col("term")) & ~F.col(target).contains(F.col("term"))).select(
        *keys, "term", F.lit("critical").alias("severity")
    )


def required_terms(pairs: DataFrame, rules: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Rules (term, target_term, severity) whose term the source has and whose target term the target lacks."""
    low_s, low_t = F.lower(source), F.lower(target)
    joined = pairs.join(rules, low_s.contains(F.lower("term")) & ~low_t.contains(F.lower("target_term")))
    return joined.select(*keys, "term", "target_term", "severity")


def scores(found: DataFrame, keys: list[str], words: DataFrame | None = None) -> DataFrame:
    """100 minus the penalties of each block's findings, at least 0.

    With `words` (keys, words) the penalty is per 100 words, rounded half up; blocks without findings score 100.
    """
    penalty = found.groupBy(*keys).agg(F.sum(weight(F.col("severity"))).alias("penalty"))
    if words is None:
        return penalty.withColumn("score", F.greatest(100 - F.col("penalty"), F.lit(0)))
    whole = words.join(penalty, keys, "left").fillna(0, ["penalty"])
    scaled = F.floor(F.col("penalty") * 100 / F.greatest(F.col("words"), F.lit(1)) + 0.5)
    return whole.withColumn("score", F.greatest(100 - scaled, F.lit(0)))


def first_failing_gate(gates: DataFrame, by: list[str]) -> DataFrame:
    """Gates (by, ordinal, score, threshold, blocking) up to and with the first blocking one that fails."""
    from pyspark.sql import Window

    failed = F.col("blocking") & (F.col("score") < F.col("threshold"))
    before = Window.partitionBy(*by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(failed.cast("int")).over(before), F.lit(0))
    return gates.withColumn("passed", F.col("score") >= F.col("threshold")).withColumn("stopped", stopped).filter("stopped = 0").drop("stopped")


def inconsistent_targets(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Sources that have more than one target."""
    return pairs.groupBy(source).agg(F.countDistinct(target).alias("targets")).filter("targets > 1")


#: Placeholder forms without braces, which an ICU message takes for text.
UNBRACED = r"%\([^)]+\)[a-zA-Z]|%\d+\$[a-zA-Z]|%[sdifeEgGxXobpqv@%]|</?[0-9]+>"


def placeholder_check(pairs: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Placeholders that a target drops (missing, critical) or invents (extra, major): keys, token, category, severity,
    and how often both sides have it, where counts were compared (else null).

    Where both sides are well-formed ICU messages and one chooses between sub-messages (plural, select, selectordinal),
    they are compared as such: tokens outside sub-messages by count, those inside by presence, since languages
    have different numbers of branches; branch names and texts don't count. All others are compared literally. Extra is only
    what the source hasn't at all. Null texts count as empty.
    """
    texts = pairs.select(*keys, F.coalesce(F.col(source), F.lit("")).alias("_s"), F.coalesce(F.col(target), F.lit("")).alias("_t"))
    picking = icu.may_pick(F.col("_s")) | icu.may_pick(F.col("_t"))
    parsed = texts.withColumns({"_icu_s": icu.tokens(F.col("_s"), picking), "_icu_t": icu.tokens(F.col("_t"), picking)})

    def count(tokens: Column, token: Column) -> Column:
        return F.size(F.filter(tokens, lambda x: x == token))

    def named(frame: Column, token: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(frame, lambda x: x["token"] == token), F.lit(1))["n"], F.lit(0))

    def row(token: Column, category: str, a: Column | None = None, b: Column | None = None) -> Column:
        counts = [(F.lit(None) if x is None else x).cast("int").alias(name) for x, name in ((a, "in_source"), (b, "in_target"))]
        severity = "critical" if category == "missing" else "major"
        return F.struct(token.alias("token"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), *counts)

    s, t = text.placeholders(F.col("_s")), text.placeholders(F.col("_t"))
    literal = F.concat(
        F.transform(F.filter(F.array_distinct(s), lambda x: count(t, x) < count(s, x)), lambda x: row(x, "missing", count(s, x), count(t, x))),
        F.transform(F.array_except(t, s), lambda x: row(x, "extra", F.lit(0), count(t, x))),
    )
    frames, inners = (F.col("_icu_s.frame"), F.col("_icu_t.frame")), (F.col("_icu_s.inner"), F.col("_icu_t.inner"))
    others = [F.regexp_extract_all(c, F.lit(UNBRACED), F.lit(0)) for c in ("_s", "_t")]

    def anywhere(side: int) -> Column:
        return F.concat(F.transform(frames[side], lambda x: x["token"]), inners[side])

    nested = F.concat(
        F.transform(
            F.filter(frames[0], lambda x: named(frames[1], x["token"]) < x["n"]),
            lambda x: row(x["token"], "missing", x["n"], named(frames[1], x["token"])),
        ),
        F.transform(F.array_except(inners[0], anywhere(1)), lambda x: row(x, "missing")),
        F.transform(F.array_except(others[0], others[1]), lambda x: row(x, "missing")),
        F.transform(F.array_except(F.transform(frames[1], lambda x: x["token"]), anywhere(0)), lambda x: row(x, "extra")),
        F.transform(F.array_except(inners[1], anywhere(0)), lambda x: row(x, "extra")),
        F.transform(F.array_except(others[1], others[0]), lambda x: row(x, "extra")),
    )
    as_icu = F.col("_icu_s.picker").isNotNull() & F.col("_icu_t.picker").isNotNull() & (F.col("_icu_s.picker") | F.col("_icu_t.picker"))
    return parsed.select(*keys, F.explode(F.when(as_icu, nested).otherwise(literal)).alias("f")).select(*keys, "f.*")


def most_codes(branches: Column) -> Column:
    """Tokens of several branches (array of arrays) with the most that one branch has of each: array of struct(token, n)."""
    all_ = F.array_sort(F.array_distinct(F.flatten(branches)))
    return F.transform(
        all_, lambda x: F.struct(x.alias("token"), F.array_max(F.transform(branches, lambda b: F.size(F.filter(b, lambda y: y == x)))).alias("n"))
    )
