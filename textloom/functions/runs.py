"""Inline content runs: ARRAY<STRUCT<kind, text, id, type, subtype, data, equiv, disp, forms>>.

kind is text, ph (placeholder), pcOpen, pcClose, sub, plural or select; forms holds the branches of plural and
select one level deep, as texts by form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = (
    "struct<kind:string,text:string,id:string,type:string,subtype:string,data:string,equiv:string,disp:string,"
    "forms:map<string,string>>"
)
RUNS = f"array<{RUN}>"

#: HTML element -> meaning of an inline code.
SPAN_TYPES = {
    "b": "fmt:bold",
    "strong": "fmt:bold",
    "i": "fmt:italic",
    "em": "fmt:italic",
    "u": "fmt:underline",
    "s": "fmt:strikethrough",
    "del": "fmt:strikethrough",
    "strike": "fmt:strikethrough",
    "a": "link:hyperlink",
    "code": "fmt:code",
    "kbd": "fmt:code",
    "samp": "fmt:code",
    "tt": "fmt:code",
    "sub": "fmt:subscript",
    "sup": "fmt:superscript",
    "mark": "fmt:highlight",
    "br": "struct:break",
    "hr": "struct:break",
    "img": "media:image",
}

#: Subtype -> meaning of an inline code.
SUBTYPES = {
    "okapi:bold": "fmt:bold",
    "okapi:italic": "fmt:italic",
    "okapi:underline": "fmt:underline",
    "okapi:strikethrough": "fmt:strikethrough",
    "okapi:link": "link:hyperlink",
    "okapi:code": "fmt:code",
    "okapi:subscript": "fmt:subscript",
    "okapi:superscript": "fmt:superscript",
    "okapi:break": "struct:break",
    "okapi:image": "media:image",
}


def _join(runs: Column, say: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(say(r), F.lit(""))), "")


def _other(r: Column) -> Column:
    return F.try_element_at(r["forms"], F.lit("other"))


def plain_key(runs: Column) -> Column:
    """Text as it is, placeholders as {equiv}, sub-flows as [equiv], the 'other' branch of a plural or select."""
    return _join(
        runs,
        lambda r: F.when(r["kind"] == "text", r["text"])
        .when(r["kind"] == "ph", F.concat(F.lit("{"), r["equiv"], F.lit("}")))
        .when(r["kind"] == "sub", F.concat(F.lit("["), r["equiv"], F.lit("]")))
        .when(r["kind"].isin("plural", "select"), _other(r)),
    )


def structural_key(runs: Column) -> Column:
    """Like the text with the ids of codes: {id/}, {id}, {/id}, [id]."""
    return _join(
        runs,
        lambda r: F.when(r["kind"] == "text", r["text"])
        .when(r["kind"] == "ph", F.concat(F.lit("{"), r["id"], F.lit("/}")))
        .when(r["kind"] == "pcOpen", F.concat(F.lit("{"), r["id"], F.lit("}")))
        .when(r["kind"] == "pcClose", F.concat(F.lit("{/"), r["id"], F.lit("}")))
        .when(r["kind"] == "sub", F.concat(F.lit("["), r["id"], F.lit("]")))
        .when(r["kind"].isin("plural", "select"), _other(r)),
    )


def generalized_key(runs: Column) -> Column:
    """The structural key with entity placeholders as {TYPE}, so that texts differing in a name are equal."""
    entity = runs_with_entities(runs)
    return structural_key(entity)


def runs_with_entities(runs: Column) -> Column:
    return F.transform(
        runs,
        lambda r: F.when(
            (r["kind"] == "ph") & r["type"].startswith("entity:"),
            r.withField("kind", F.lit("text")).withField(
                "text", F.concat(F.lit("{"), F.upper(F.substring_index(r["type"], ":", -1)), F.lit("}"))
            ),
        ).otherwise(r),
    )


def plain_text(runs: Column) -> Column:
    return _join(runs, lambda r: F.when(r["kind"] == "text", r["text"]))


def entity_values(runs: Column) -> Column:
    """Map of placeholder id to data, of entity placeholders."""
    entities = F.filter(runs, lambda r: (r["kind"] == "ph") & r["type"].startswith("entity:"))
    return F.map_from_entries(F.array_distinct(F.transform(entities, lambda r: F.struct(r["id"], r["data"]))))


def strip_codes(runs: Column, breaks_to_space: bool = True) -> Column:
    """Text runs only; a line break becomes a space."""
    kept = F.filter(runs, lambda r: (r["kind"] == "text") | (F.lit(breaks_to_space) & (r["type"] == "struct:break")))
    return F.transform(
        kept,
        lambda r: F.when(r["kind"] == "text", r).otherwise(r.withField("kind", F.lit("text")).withField("text", F.lit(" "))),
    )


def classify_spans(runs: Column) -> Column:
    """Codes of type 'code' or none get the meaning of their subtype or HTML tag, if there is one."""
    known = F.create_map(*[F.lit(x) for pair in (SPAN_TYPES | SUBTYPES).items() for x in pair])

    def named(r: Column) -> Column:
        tag = F.lower(F.regexp_extract(F.coalesce(r["data"], F.lit("")), r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        meaning = F.coalesce(F.try_element_at(known, F.lower(r["subtype"])), F.try_element_at(known, tag))
        unknown = F.coalesce(r["type"], F.lit("")).isin("", "code")
        return F.when((r["kind"] != "text") & unknown & meaning.isNotNull(), r.withField("type", meaning)).otherwise(r)

    return F.transform(runs, named)


def codes(runs: Column) -> Column:
    """Codes of a block as strings kind:type:data, to be counted as a multiset."""
    kept = F.filter(runs, lambda r: r["kind"].isin("ph", "pcOpen", "pcClose", "sub"))
    return F.transform(kept, lambda r: F.concat_ws(":", r["kind"], F.coalesce(r["type"], F.lit("")), F.coalesce(r["data"], r["id"])))


def multiset_minus(a: Column, b: Column) -> Column:
    """Sorted entries of `a` beyond those of `b`, repeats counted: array of struct(token, n)."""
    tokens = F.array_sort(F.array_distinct(a))
    counted = F.transform(
        tokens,
        lambda t: F.struct(
            t.alias("token"),
            (F.size(F.filter(a, lambda x: x == t)) - F.size(F.filter(b, lambda x: x == t))).alias("n"),
        ),
    )
    return F.filter(counted, lambda e: e["n"] > 0)
