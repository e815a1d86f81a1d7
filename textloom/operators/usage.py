"""Uses of terms in texts, with their places; vocabulary rules of profiles, layered by locale, channel and persona."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .terms import FEW, UNSPACED, term_pattern

# Scripts by the names that `regex` takes, without Java's "Is".
_UNSPACED = UNSPACED.replace("{Is", "{")
#: A token: a character of a script without spaces, or a run of letters, digits and underscores of others.
TOKEN = regex.compile(rf"[{_UNSPACED}]|[\p{{L}}\p{{N}}\p{{M}}_--[{_UNSPACED}]]+", regex.V1)
PLACED = ArrayType(StructType([StructField("word", StringType()), StructField("start", IntegerType())]))
#: Space between two words of a use, in characters, that is looked through at most.
SPACE = 1024


@F.pandas_udf(PLACED)
def placed_tokens(texts: pd.Series) -> pd.Series:
    """Tokens in lower case with their places."""
    return pd.Series([[(m[0].lower(), m.start()) for m in TOKEN.finditer(t or "")] for t in texts])


def occurrences(blocks: DataFrame, terms: DataFrame, key: str, text: str, also: list[str] | None = None) -> DataFrame:
    """Uses of each term: key, term_id, start, end (code points), found (as the text has it), and the columns `also` of terms.

    Case doesn't count, any white space may stand between words, and where a term begins or ends in a letter,
    digit or underscore the use must, too (scripts without spaces excepted). Uses of one term don't overlap, those of
    different ones may. A term without any letter or digit has no uses.

    Terms and texts meet by their first two tokens (or the one), hashed; only where they meet is the text looked
    at, so the work grows with the texts and the uses, not with texts times terms. Up to FEW terms are sent to every task and meet
    the texts there; more meet the tokens by a shuffle.
    """
    also = also or []
    known = terms.select("term_id", F.regexp_replace("term", r"(?U)^\s+|\s+$", "").alias("term"), *also).withColumn("_t", placed_tokens("term"))
    first = F.try_element_at("_t", F.lit(1))
    second = F.try_element_at("_t", F.lit(2))
    known = known.filter(first.isNotNull()).select(
        "term_id", "term", *also, F.xxhash64(first["word"], F.coalesce(second["word"], F.lit(""))).alias("_h"), first["start"].alias("_lead")
    )
    pairs = F.transform("_t", lambda t, i: F.struct(t.alias("a"), F.coalesce(F.get("_t", i + 1)["word"], F.lit("")).alias("b")))
    codes = [r["_h"] for r in known.select("_h").distinct().limit(FEW + 1).collect()]
    count, lead, longest = known.agg(F.count(F.lit(1)), F.coalesce(F.max("_lead"), F.lit(0)), F.coalesce(F.max(F.length("term")), F.lit(0))).first()
    if count <= FEW:  # only what begins like a term leaves its text, with as much of it as a use can have
        tokens = blocks.select(key, F.col(text).alias("_text"), placed_tokens(text).alias("_t")).withColumn("_p", pairs).drop("_t")
        begins = F.transform("_p", lambda p: F.struct(p["a"]["start"].alias("at"), F.array_distinct(F.array(F.xxhash64(p["a"]["word"], F.lit("")), F.xxhash64(p["a"]["word"], p["b"]))).alias("h")))
        begins = F.filter(begins, lambda p: F.exists(p["h"], lambda h: h.isin(codes) if codes else F.lit(False)))
        origin = lambda p: F.greatest(p["at"] - (lead + 1), F.lit(0))
        shown = F.transform(begins, lambda p: F.struct(p["at"], p["h"], origin(p).alias("from"), F.substring(F.col("_text"), origin(p) + 1, F.lit(1 + lead + longest + SPACE)).alias("part")))
        tokens = tokens.select(key, F.explode(shown).alias("p")).select(key, F.col("p.at").alias("_at"), F.col("p.from").alias("_from"), F.col("p.part").alias("_text"), F.explode("p.h").alias("_h"))
        near = tokens.join(F.broadcast(known), "_h").withColumn("start", F.col("_at") - F.col("_lead")).filter("start >= 0").drop("_h", "_at", "_lead")
    else:
        tokens = blocks.select(key, placed_tokens(text).alias("_t")).select(key, F.explode(pairs).alias("p"))
        hashes = F.array_distinct(F.array(F.xxhash64("p.a.word", F.lit("")), F.xxhash64("p.a.word", "p.b")))
        tokens = tokens.select(key, F.col("p.a.start").alias("_at"), F.explode(hashes).alias("_h"))
        met = tokens.join(known, "_h").withColumn("start", F.col("_at") - F.col("_lead")).filter("start >= 0").drop("_h", "_at", "_lead")
        near = met.join(blocks.select(key, F.lit(0).alias("_from"), F.col(text).alias("_text")), key)
    before = F.when(F.col("start") > 0, 1).otherwise(0)
    room = F.length("term") + SPACE
    rest = F.substring(F.col("_text"), F.col("start") + 1 - before - F.col("_from"), before + room)
    pattern = F.concat(F.lit(r"(?s)\A"), F.when(F.col("start") > 0, ".").otherwise(""), F.lit("("), term_pattern(F.col("term")), F.lit(")"))
    hits = near.withColumn("found", F.call_function("regexp_extract", rest, pattern, F.lit(1))).filter("found <> ''").drop("_text", "_from")
    hits = hits.withColumn("end", F.col("start") + F.length("found"))
    uses = hits.groupBy(key, "term_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "found"))).alias("_u"), *[F.first(c).alias(c) for c in also]
    )
    return uses.withColumn("_u", apart(F.col("_u"))).select(key, "term_id", F.explode("_u").alias("u"), *also).select(key, "term_id", "u.*", *also)


def apart(spans: Column) -> Column:
    """Of sorted spans (start, end, ...) those that start where or after the one kept before ends."""
    start = F.struct(F.filter(spans, lambda _: F.lit(False)).alias("kept"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fits = x["start"] >= s["at"]
        return F.struct(F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"), F.when(fits, x["end"]).otherwise(s["at"]).alias("at"))

    return F.aggregate(spans, start, step, lambda s: s["kept"])


def longest_uses(uses: DataFrame, key: str) -> DataFrame:
    """Of uses that overlap the one that starts first, of those the longest, then of the smallest term_id: key, term_id, start, end, found."""
    order = F.struct("start", (-F.col("end")).alias("rank"), "term_id", "end", "found")
    kept = uses.groupBy(key).agg(apart(F.array_sort(F.collect_list(order))).alias("_u"))
    return kept.select(key, F.explode("_u").alias("u")).select(key, "u.term_id", "u.start", "u.end", "u.found")


def _same(column: str) -> Column:
    """Locales and terms in one spelling."""
    return F.lower(F.translate(F.trim(column), "_", "-"))


def resolved_rules(rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rules that hold in each scope: scope_id, rule_id, kind, term, replacement, severity.

    rules: rule_id, profile, layer (base, locale, channel or persona), layer_key, kind (forbidden, competitor or preferred), term,
    replacement, severity. scopes: scope_id, profile, locale, channel, persona (null or empty: none).

    A scope has its profile's base rules, the preferred terms of its locale, and of its persona the forbidden terms and those
    preferred ones that nothing in the scope forbids: a persona tightens the vocabulary, it never allows again. A
    channel has no vocabulary. Forbidden terms are major and competitors' critical where a rule says nothing else.
    """
    of_scope = {"locale": _same("locale"), "persona": F.col("persona")}
    asked = scopes.select("scope_id", "profile", F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.coalesce(v, F.lit("")).alias("layer_key")) for k, v in {"base": F.lit(""), **of_scope}.items()])).alias("l"))
    asked = asked.select("scope_id", "profile", "l.*").filter("layer = 'base' or layer_key <> ''")
    spelled = F.when(F.col("layer") == "base", "").when(F.col("layer") == "locale", _same("layer_key")).otherwise(F.col("layer_key"))
    held = rules.withColumn("layer_key", spelled).join(asked, ["profile", "layer", "layer_key"])
    held = held.filter("layer = 'base' or (layer = 'locale' and kind = 'preferred') or (layer = 'persona' and kind in ('forbidden', 'preferred'))")
    folded = F.lower(F.trim("term"))
    no = held.filter("kind in ('forbidden', 'competitor')").select("scope_id", folded.alias("_no")).distinct()
    held = held.withColumn("_no", F.when((F.col("layer") == "persona") & (F.col("kind") == "preferred"), folded))
    held = held.join(no, ["scope_id", "_no"], "left_anti")
    given = F.lower(F.trim("severity"))
    severity = F.when(given.isin("neutral", "minor", "major", "critical"), given).when(F.col("kind") == "competitor", "critical").when(F.col("kind") == "forbidden", "major")
    return held.select("scope_id", "rule_id", "kind", "term", "replacement", severity.alias("severity"))


def vocabulary_findings(blocks: DataFrame, resolved: DataFrame, key: str, text: str, scope: str = "scope_id") -> DataFrame:
    """Forbidden and competitors' terms that texts use: key, category, severity, kind, term, replacement, start, end, found.

    blocks: key, text and the scope that judges them; resolved: as of `resolved_rules`. Each distinct term is looked
    for once, whatever number of scopes has it.
    """
    bad = resolved.filter("kind in ('forbidden', 'competitor')").withColumn("term_id", F.lower(F.trim("term")))
    wanted = bad.groupBy("term_id").agg(F.min("term").alias("term"))
    uses = occurrences(blocks.select(key, text), wanted, key, text).join(blocks.select(key, scope), key)
    judged = bad.select(F.col("scope_id").alias(scope), "term_id", "kind", "term", "replacement", "severity")
    return uses.join(judged, [scope, "term_id"]).select(key, F.lit("vocabulary").alias("category"), "severity", "kind", "term", "replacement", "start", "end", "found")
