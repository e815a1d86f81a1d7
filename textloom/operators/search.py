"""Search in the texts of blocks, stream edits by substitution commands, and names of blocks by their place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_space


def block_texts(blocks: DataFrame, source: str = "source_text", targets: str = "targets", keep: list[str] | None = None) -> DataFrame:
    """A row per text of a block that isn't empty: `keep`, locale (empty for the source) and text."""
    said = F.map_entries(F.map_filter(F.coalesce(F.col(targets), F.create_map().cast("map<string,string>")), lambda k, _: k != ""))
    own = F.array(F.struct(F.lit("").alias("key"), F.col(source).alias("value")))
    rows = blocks.select(*(keep or ["block_id"]), F.explode(F.concat(own, said)).alias("t"))
    return rows.select(*(keep or ["block_id"]), F.col("t.key").alias("locale"), F.col("t.value").alias("text")).filter("text <> ''")


def pattern_of(patterns: list[str], ignore_case: bool = False, word: bool = False, fixed: bool = False) -> str:
    """One expression for texts that any of the patterns fits; `fixed`: they are no expressions; `word`: whole words only."""
    if not patterns:
        raise ValueError("no pattern given")
    parts = ["".join(f"\\x{{{ord(c):x}}}" for c in p) if fixed else p for p in patterns]
    parts = [rf"\b(?:{p})\b" if word else f"(?:{p})" for p in parts]
    return ("(?i)" if ignore_case else "") + "|".join(parts)


def grep(texts: DataFrame, text: str, patterns: list[str], invert: bool = False, **options: bool) -> DataFrame:
    """Rows whose text fits any pattern, or (invert) none. Options as of `pattern_of`."""
    hit = F.col(text).rlike(pattern_of(patterns, **options))
    return texts.filter(~hit if invert else hit)


def grep_matches(texts: DataFrame, text: str, patterns: list[str], **options: bool) -> DataFrame:
    """A row per match: the row's columns, `pattern` (its number from 0), `match` (number among the pattern's in the text) and `found`."""
    def of(number: int, pattern: str) -> Column:
        all_ = F.regexp_extract_all(F.col(text), F.lit(f"({pattern_of([pattern], **options)})"), F.lit(1))
        return F.transform(all_, lambda m, i: F.struct(F.lit(number).alias("pattern"), i.alias("match"), m.alias("found")))

    found = [of(number, pattern) for number, pattern in enumerate(patterns)]
    return texts.withColumn("_m", F.explode(F.concat(*found))).select(*texts.columns, "_m.*")


def grep_counts(texts: DataFrame, file: str, text: str, patterns: list[str], invert: bool = False, **options: bool) -> DataFrame:
    """(file, matching) of every file, also of those without a match: what -c counts, -l and -L choose by."""
    hit = F.col(text).rlike(pattern_of(patterns, **options))
    return texts.groupBy(file).agg(F.count_if(~hit if invert else hit).alias("matching"))


class SedError(ValueError):
    """A substitution command that isn't one."""


def sed_commands(script: list[str]) -> list[tuple[str, str, bool]]:
    """(expression, replacement, whether all matches) of commands s/expression/replacement/flags with any delimiter.

    Flags: g (all matches) and i (case doesn't count). In replacements \\1 to \\9 are groups, & and \\0 the match, \\n a line
    feed; a delimiter, & or backslash stands for itself after a backslash.
    """
    found = []
    for command in script:
        if len(command) < 2 or command[0] != "s" or command[1] in "\\\n" or ord(command[1]) > 127:
            raise SedError(f"not a substitution: {command}")
        delimiter = command[1]
        parts = _split(command[2:], delimiter)
        if len(parts) != 3:
            raise SedError(f"not a substitution: {command}")
        expression, replacement, flags = parts
        if set(flags) - set("gi") or len(flags) != len(set(flags)):
            raise SedError(f"unknown flags: {flags}")
        if not expression:
            raise SedError("nothing to look for")
        out = ""
        for escaped, plain in re.findall(r"\\(.)|([^\\]|\\$)", replacement, re.S):
            if escaped and escaped.isdigit():
                out += f"${escaped}"
            elif escaped:
                literal = "\n" if escaped == "n" else escaped
                out += "\\" + literal if literal in "$\\" else literal
            elif plain == "&":
                out += "$0"
            else:
                out += "\\" + plain if plain in "$\\" else plain
        found.append((("(?i)" if "i" in flags else "") + expression, out, "g" in flags))
    return found


def _split(text: str, delimiter: str) -> list[str]:
    """Parts between delimiters; one after a backslash belongs to the part, without the backslash."""
    parts, at = [""], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text):
            parts[-1] += text[at + 1] if text[at + 1] == delimiter else text[at : at + 2]
            at += 2
        elif text[at] == delimiter:
            parts.append("")
            at += 1
        else:
            parts[-1] += text[at]
            at += 1
    return parts


def sed(text: Column, script: list[str]) -> Column:
    """The text after the commands, one after the other."""
    for expression, replacement, every in sed_commands(script):
        if every:
            text = F.regexp_replace(text, expression, replacement)
        else:
            # Up to the first match is group 1, the match group 2, and the expression's own groups follow.
            moved = re.sub(r"(\\.)|\$(\d)", lambda m: m[1] or f"${{g{m[2]}}}", replacement)
            groups = re.compile(expression).groups
            for k in range(groups, -1, -1):
                moved = moved.replace(f"${{g{k}}}", f"${k + 2}")
            text = F.regexp_replace(text, rf"(?s)\A(.*?)((?-s:{expression}))", "$1" + moved)
    return text


def structural_path(*segments: Column) -> Column:
    """Segments joined by `/`, without blank ones; white space in one is single, and a `/` becomes a dash."""
    clean = [F.regexp_replace(F.replace(trim_space(F.coalesce(s, F.lit(""))), F.lit("/"), F.lit("-")), r"(?U)\s+", " ") for s in segments]
    return F.array_join(F.filter(F.array(*clean), lambda s: s != ""), "/")


def block_names(blocks: DataFrame, doc: str, order: str, path: Column) -> DataFrame:
    """Adds `name`: the path (`block` if empty), from its second block in a document on with #2, #3 and so on."""
    named = blocks.withColumn("_p", F.when(F.coalesce(path, F.lit("")) == "", "block").otherwise(path))
    nth = F.row_number().over(Window.partitionBy(doc, "_p").orderBy(order))
    return named.withColumn("name", F.when(nth > 1, F.concat("_p", F.lit("#"), nth)).otherwise(F.col("_p"))).drop("_p")
