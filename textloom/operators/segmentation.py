"""Sentence segmentation by break rules, as spans over code points."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a full stop is no sentence end, by language.
ABBREVIATIONS = {
    "en": ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e", "no"),
    "de": ("dr", "nr", "z.b", "usw", "bzw", "ca", "str"),
    "fr": ("m", "mme", "mlle", "dr", "etc", "p.ex"),
    "es": ("sr", "sra", "dr", "ud", "etc", "p.ej"),
}

#: (before, after) of a break, tried in order at each place; the second value says whether it breaks.
BREAKS = [(r"[.!?。！？]+[\"'»”’)\]]*\s+$", r"\S", True), (r"\n\s*$", r"\S", True)]

SEGMENT = "struct<id:string,start:int,end:int,text:string>"


def breaks(text: str, locale: str, rules: list[tuple[str, str, bool]]) -> list[int]:
    short = ABBREVIATIONS.get((locale or "")[:2], ())
    found = []
    for match in re.finditer(r"\s+(?=\S)", text):
        at = match.end()
        before = text[max(0, at - 80) : at]
        for left, right, stops in rules:
            if re.search(left, before) and re.match(right, text[at:]):
                word = before.rstrip().rstrip(".").rsplit(None, 1)[-1:] or [""]
                abbreviation = before.rstrip().endswith(".") and word[0].lower().lstrip("(\"'") in short and "\n" not in match.group()
                if stops and not abbreviation:
                    found.append(at)
                break
    return found


def spans(text: str, stops: list[int]) -> list[dict]:
    """Trimmed spans between breaks, without empty ones; ids s1, s2, ..."""
    out = []
    for a, b in zip([0, *stops], [*stops, len(text)], strict=True):
        part = text[a:b]
        start = a + len(part) - len(part.lstrip())
        end = a + len(part.rstrip())
        if start < end:
            out.append({"id": f"s{len(out) + 1}", "start": start, "end": end, "text": text[start:end]})
    return out


def segment(blocks: DataFrame, text_col: str, locale_col: str, rules: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """Adds `segments`: array of (id, start, end, text) of each block's sentences."""
    chosen = rules or BREAKS

    @F.pandas_udf(f"array<{SEGMENT}>")
    def cut(texts: pd.Series, locales: pd.Series) -> pd.Series:
        return pd.Series([spans(t or "", breaks(t or "", loc, chosen)) for t, loc in zip(texts, locales, strict=True)])

    return blocks.withColumn("segments", cut(F.col(text_col), F.col(locale_col)))


def segment_counts(blocks: DataFrame, text_col: str, locale_col: str, by: str) -> DataFrame:
    return segment(blocks, text_col, locale_col).groupBy(by).agg(F.sum(F.size("segments")).cast("long").alias("segments"))


def redact(blocks: DataFrame, rules: list[tuple[str, str]], key: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(blocks with placeholders, vault): matches of rules (name, regex) become [NAME-n]; the vault keeps their texts.

    Of overlapping matches the one that starts first counts, of those the longest; empty ones don't.
    """
    compiled = [(name, regex) for name, regex in rules]

    @F.pandas_udf("struct<text:string,secrets:array<struct<token:string,secret:string>>>")
    def hide(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = sorted((m.start(), -m.end(), name) for name, regex in compiled for m in re.finditer(regex, text or "") if m.end() > m.start())
            pieces, secrets, at = [], [], 0
            for start, end, name in found:
                if start >= at:
                    token = f"[{name.upper()}-{len(secrets) + 1}]"
                    pieces += [text[at:start], token]
                    secrets.append({"token": token, "secret": text[start:-end]})
                    at = -end
            out.append({"text": None if text is None else "".join([*pieces, text[at:]]), "secrets": secrets})
        return pd.DataFrame(out, columns=["text", "secrets"])

    hidden = blocks.withColumn("_r", hide(F.col(text_col)))
    vault = hidden.select(key, F.explode("_r.secrets").alias("s")).select(key, "s.token", "s.secret")
    return hidden.withColumn(text_col, F.col("_r.text")).drop("_r"), vault


def unredact(blocks: DataFrame, vault: DataFrame, key: str, text_col: str) -> DataFrame:
    """Puts the vault's texts back; blocks without secrets, and tokens that aren't there, stay as they are."""
    secrets = vault.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("token", "secret")), asc=False).alias("_s"))
    put = F.aggregate(F.coalesce("_s", F.array().cast("array<struct<token:string,secret:string>>")), F.col(text_col), lambda t, s: F.replace(t, s["token"], s["secret"]))
    return blocks.join(secrets, key, "left").withColumn(text_col, put).drop("_s")
