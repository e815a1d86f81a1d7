"""Segmentation by SRX rulesets, over runs with inline codes masked, and units of segmented blocks by layer."""

from __future__ import annotations

import functools
import xml.etree.ElementTree as ElementTree
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

YES, NO = ("yes", "true", "1"), ("no", "false", "0")


@dataclass(frozen=True)
class Rule:
    """Between what `before` ends with and what `after` starts with there is a break, or there is none."""

    breaks: bool
    before: str
    after: str


@dataclass(frozen=True)
class Ruleset:
    rules: dict[str, tuple[Rule, ...]] = field(hash=False)
    #: (pattern of locales, name of rules), in order.
    maps: tuple[tuple[str, str], ...]
    cascade: bool = True
    trim_leading: bool = False
    trim_trailing: bool = False

    def of_locale(self, locale: str | None) -> tuple[Rule, ...]:
        """Rules of all maps that match the locale in map order, or without cascade those of the first."""
        fitting = [self.rules.get(name, ()) for pattern, name in self.maps if regex.fullmatch(pattern, locale or "", regex.I)]
        return tuple(rule for rules in (fitting if self.cascade else fitting[:1]) for rule in rules)


def parse_srx(text: str) -> Ruleset:
    """Reads SRX 2.0 XML. What isn't stated is a break, matches anything, and cascades; other elements are ignored."""
    root = ElementTree.fromstring(text)

    def name(element: ElementTree.Element) -> str:
        return element.tag.rpartition("}")[2]

    def every(wanted: str, of: ElementTree.Element = root) -> list[ElementTree.Element]:
        return [e for e in of.iter() if name(e) == wanted]

    def flag(value: str | None, otherwise: bool) -> bool:
        known = (value or "").lower()
        return True if known in YES else False if known in NO else otherwise

    def part(rule: ElementTree.Element, wanted: str) -> str:
        return next((e.text or "" for e in rule if name(e) == wanted), "")

    header = next(iter(every("header")), ElementTree.Element("header"))
    options = next(iter(every("options")), ElementTree.Element("options"))
    rules = {
        group.get("languagerulename", ""): tuple(
            Rule(flag(rule.get("break"), True), part(rule, "beforebreak"), part(rule, "afterbreak")) for rule in every("rule", group)
        )
        for group in every("languagerule")
    }
    maps = tuple((m.get("languagepattern", ""), m.get("languagerulename", "")) for m in every("languagemap"))
    return Ruleset(
        rules,
        maps,
        flag(header.get("cascade"), True),
        flag(options.get("trimLeadingWhitespaces"), False),
        flag(options.get("trimTrailingWhitespaces"), False),
    )


@functools.lru_cache(maxsize=4096)
def compiled(rule: Rule) -> regex.Pattern:
    return regex.compile(f"(?:{rule.before})(?={rule.after})", regex.M if "(?m)" in rule.before else 0)


def break_places(text: str, rules: tuple[Rule, ...]) -> list[int]:
    """Places within the text where the first rule that fits is a break; a place that no rule fits is none."""
    decided: dict[int, bool] = {}
    for rule in rules:
        for match in compiled(rule).finditer(text, overlapped=True):
            if 0 < match.end() < len(text):
                decided.setdefault(match.end(), rule.breaks)
    return sorted(place for place, breaks in decided.items() if breaks)


def breaks(text: Column, locale: Column, ruleset: Ruleset) -> Column:
    """Places of breaks of each text, by its locale's rules."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(texts: pd.Series, locales: pd.Series) -> pd.Series:
        by_locale = {locale: ruleset.of_locale(locale) for locale in locales.unique()}
        return pd.Series([break_places(t or "", by_locale[k]) for t, k in zip(texts, locales, strict=True)])

    return places(text, locale)


def masked(runs: Column, isolated_as_space: bool = False) -> Column:
    """Text for rules to see: texts as they are, paired codes as nothing, other codes as nothing or a space."""
    alone = F.lit(" " if isolated_as_space else "")
    said = F.transform(
        runs, lambda r: F.when(r["kind"] == "text", F.coalesce(r["text"], F.lit(""))).when(r["kind"].isin("pcOpen", "pcClose"), F.lit("")).otherwise(alone)
    )
    return F.array_join(said, "")


def segments(runs: Column, places: Column, ruleset: Ruleset, isolated_as_space: bool = False) -> Column:
    """Segments between breaks of the masked text: array of id, start, end (in the text of the text runs), text.

    Segments that have no text of their own (codes, trimmed space) are left out; ids count those that stay.
    """
    length = F.transform(
        runs,
        lambda r: F.when(r["kind"] == "text", F.length(F.coalesce(r["text"], F.lit(""))))
        .when(r["kind"].isin("pcOpen", "pcClose"), F.lit(0))
        .otherwise(1 if isolated_as_space else 0),
    )

    def sum_(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda n, x: n + x)

    # Places of the stand-ins in the masked text; a place in it less those before it is one in the real text.
    stand_ins = F.filter(
        F.transform(runs, lambda r, i: F.when(~r["kind"].isin("text", "pcOpen", "pcClose") & F.lit(isolated_as_space), sum_(F.slice(length, F.lit(1), i)))),
        lambda p: p.isNotNull(),
    )
    text = masked(runs, isolated_as_space)

    def real(place: Column) -> Column:
        return place - F.size(F.filter(stand_ins, lambda p: p < place))

    def cut(edges: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            b = F.try_element_at(edges, i + 2)
            part = F.substring(text, a + 1, b - a)
            left = F.length(part) - F.length(F.regexp_replace(part, r"(?U)\A\s+", "")) if ruleset.trim_leading else F.lit(0)
            right = F.length(part) - F.length(F.regexp_replace(part, r"(?U)\s+\z", "")) if ruleset.trim_trailing else F.lit(0)
            first = F.least(a + left, b)
            return F.struct(real(first).alias("start"), real(F.greatest(b - right, first)).alias("end"))

        return F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), one)

    edges = F.concat(F.array(F.lit(0)), places, F.array(F.length(text)))
    kept = F.filter(F.transform(F.array(edges), cut)[0], lambda s: s["start"] < s["end"])
    plain = masked(runs)
    return F.transform(
        kept,
        lambda s, i: F.struct(
            F.concat(F.lit("s"), i + 1).alias("id"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.substring(plain, s["start"] + 1, s["end"] - s["start"]).alias("text"),
        ),
    )


def segment_runs(blocks: DataFrame, runs_col: str, locale_col: str, ruleset: Ruleset, isolated_as_space: bool = False) -> DataFrame:
    """Adds `segments` to blocks of runs. Null runs have none."""
    known = F.coalesce(F.col(runs_col), F.array().cast(blocks.schema[runs_col].dataType))
    marked = blocks.withColumn("_places", breaks(masked(known, isolated_as_space), F.col(locale_col), ruleset))
    return marked.withColumn("segments", segments(known, F.col("_places"), ruleset, isolated_as_space)).drop("_places")


def units(blocks: DataFrame, key: str, text_col: str, layers_col: str, layer: str) -> DataFrame:
    """A row per unit of each block: key, unit (from 0), start, end, text. layers: map of layer to segments (id, start, end, text).

    A block without segments in that layer is one unit, an empty one none.
    """
    found = F.try_element_at(layers_col, F.lit(layer))
    whole = F.when(F.length(text_col) > 0, F.array(F.struct(F.lit(0).alias("start"), F.length(text_col).alias("end"), F.col(text_col).alias("text"))))
    parts = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))).otherwise(whole)
    return blocks.select(key, F.posexplode(parts).alias("unit", "u")).select(key, "unit", "u.*")


def committed(units_: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Targets of blocks (key, target_text) from written units (key, unit, target_text), joined in order.

    Units marked `ignorable`, if there is such a column, stand for themselves where they aren't written. A block of which
    another unit isn't written has no row: all or nothing.
    """
    skip = F.coalesce(F.col("ignorable"), F.lit(False)) if "ignorable" in units_.columns else F.lit(False)
    both = units_.join(written.select(key, "unit", F.col("target_text").alias("_new")), [key, "unit"], "left")
    said = F.coalesce("_new", F.when(skip, F.col("text")))
    whole = both.groupBy(key).agg(
        F.bool_and(said.isNotNull()).alias("_all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", said.alias("t")))), lambda u: u["t"]), "").alias("target_text")
    )
    return whole.filter("_all").drop("_all")


#: A ruleset of this library: no break after abbreviations, initials and numbers, else after a sentence's end, at line ends.
DEFAULT_SRX = r"""<?xml version="1.0" encoding="UTF-8"?>
<srx xmlns="http://www.lisa.org/srx20" xmlns:x="http://okapi.sf.net/srx-extensions" version="2.0">
 <header cascade="yes"><x:options trimLeadingWhitespaces="yes" trimTrailingWhitespaces="yes"/></header>
 <body>
  <languagerules>
   <languagerule languagerulename="german">
    <rule break="no"><beforebreak>\b(?:z\.\s?B|bzw|usw|ca|Nr|Str|\d{1,2})\.</beforebreak><afterbreak>\s</afterbreak></rule>
   </languagerule>
   <languagerule languagerulename="french">
    <rule break="no"><beforebreak>\b(?:M|Mme|Mlle|p\.ex)\.</beforebreak><afterbreak>\s</afterbreak></rule>
   </languagerule>
   <languagerule languagerulename="spanish">
    <rule break="no"><beforebreak>\b(?:Sr|Sra|Ud|p\.ej)\.</beforebreak><afterbreak>\s</afterbreak></rule>
   </languagerule>
   <languagerule languagerulename="english">
    <rule break="no"><beforebreak>\b(?:Mr|Mrs|Ms|vs|e\.g|i\.e)\.</beforebreak><afterbreak>\s</afterbreak></rule>
   </languagerule>
   <languagerule languagerulename="all">
    <rule break="no"><beforebreak>\b(?:Dr|Prof|St|etc|\p{Lu})\.</beforebreak><afterbreak>[ \t]</afterbreak></rule>
    <rule break="no"><beforebreak>\.\.\.|…</beforebreak><afterbreak>\s+\p{Ll}</afterbreak></rule>
    <rule break="yes"><beforebreak>\n</beforebreak><afterbreak></afterbreak></rule>
    <rule break="yes"><beforebreak>[.!?…][\p{Pe}\p{Pf}"']?</beforebreak><afterbreak>\s</afterbreak></rule>
    <rule break="yes"><beforebreak>[。！？]</beforebreak><afterbreak></afterbreak></rule>
   </languagerule>
  </languagerules>
  <maprules>
   <languagemap languagepattern="de.*" languagerulename="german"/>
   <languagemap languagepattern="fr.*" languagerulename="french"/>
   <languagemap languagepattern="es.*" languagerulename="spanish"/>
   <languagemap languagepattern="en.*" languagerulename="english"/>
   <languagemap languagepattern=".*" languagerulename="all"/>
  </maprules>
 </body>
</srx>"""
