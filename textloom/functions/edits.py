"""Edits of inline runs: splices of their plain text with codes put back in place, and a text view of codes.

Offsets count code points of the plain text of flat runs (no plural or select).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .runs import RUN, _join, _other, plain_text

EDITS = "array<struct<start:int,end:int,replacement:string>>"
#: Meanings of paired codes that may go with the text they format; breaks, variables and sub-flows stay.
DELETABLE = ("fmt:", "link:")
#: How codes are written in a text.
TAG = r'<x\s+id="([^"]+)"\s*/>'


def by_meaning(run: Column) -> Column:
    """Whether a code may be dropped, by its meaning."""
    kind = F.coalesce(run["type"], F.lit(""))
    may = F.lit(False)
    for prefix in DELETABLE:
        may = may | kind.startswith(prefix)
    return may & run["kind"].isin("ph", "pcOpen")


def structured(runs: Column) -> Column:
    """Whether plural or select runs are among them: their text has no single place in the flat one."""
    return F.exists(runs, lambda r: r["kind"].isin("plural", "select"))


def _text_run(text: Column) -> Column:
    return F.from_json(F.to_json(F.struct(F.lit("text").alias("kind"), text.alias("text"))), RUN)


def _moved(edits: Column, place: Column, right: bool) -> Column:
    """The place after the edits; inside a replaced range, its start or (right) its end."""

    def step(state: Column, e: Column) -> Column:
        into = F.length(e["replacement"])
        grown = state["shift"] + into - (e["end"] - e["start"])
        inside = e["start"] + state["shift"] + (into if right else 0)
        fixed = F.when(state["at"].isNotNull() | (place >= e["end"]), state["at"]).when(place <= e["start"], place + state["shift"]).otherwise(inside)
        shift = F.when(state["at"].isNull() & (place >= e["end"]), grown).otherwise(state["shift"])
        return F.struct(shift.alias("shift"), fixed.alias("at"))

    start = F.struct(F.lit(0).alias("shift"), F.lit(None).cast("int").alias("at"))
    return F.aggregate(edits, start, step, lambda s: F.coalesce(s["at"], place + s["shift"]))


def well_formed(text: Column, edits: Column) -> Column:
    """Whether edits are in order, don't overlap and lie within the text."""
    last = F.aggregate(
        edits,
        F.lit(0),
        lambda at, e: F.when((at < 0) | (e["start"] < at) | (e["end"] < e["start"]) | (e["end"] > F.length(text)), F.lit(-1)).otherwise(e["end"]),
    )
    return last >= 0


def spliced(text: Column, edits: Column) -> Column:
    """The text with each range replaced."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    return F.aggregate(
        edits,
        start,
        lambda s, e: F.struct(F.concat(s["done"], F.substring(text, s["at"] + 1, e["start"] - s["at"]), e["replacement"]).alias("done"), e["end"].alias("at")),
        lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))),
    )


def _with(values: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(values), use)[0]


def apply_edits(runs: Column, edits: Column, deletable: Callable[[Column], Column] = by_meaning) -> Column:
    """Flat runs with their text edited and the codes put back.

    A pair of codes goes on around what is left of its text; where nothing is left it goes if it is deletable, else it
    stays empty. A single code strictly inside a replaced range goes if it is deletable, else it stands at the
    range's start. Edits out of order, overlapping or out of range, and structured runs, change nothing.
    """
    return _with(plain_text(runs), lambda text: _edited(runs, text, edits, deletable))


def _edited(runs: Column, text: Column, edits: Column, deletable: Callable[[Column], Column]) -> Column:
    def length(r: Column) -> Column:
        return F.when(r["kind"] == "text", F.length(F.coalesce(r["text"], F.lit("")))).otherwise(0)

    placed = F.transform(
        runs,
        lambda r, i: F.struct(
            r.alias("run"), i.alias("seq"), F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda n, x: n + length(x)).alias("at")
        ),
    )

    def decided(codes: Column) -> Column:
        def near(c: Column, kind: str) -> Column:
            """The closest code of the same pair on the other side, if it is the other half."""
            same = F.filter(codes, lambda x: (x["run"]["id"] == c["run"]["id"]) & x["run"]["kind"].isin("pcOpen", "pcClose"))
            after = F.try_element_at(F.filter(same, lambda x: x["seq"] > c["seq"]), F.lit(1))
            before = F.try_element_at(F.filter(same, lambda x: x["seq"] < c["seq"]), F.lit(-1))
            found = after if kind == "pcClose" else before
            return F.when(found["run"]["kind"] == kind, found)

        def place(c: Column) -> Column:
            kind = c["run"]["kind"]
            other = F.when(kind == "pcOpen", near(c, "pcClose")).when(kind == "pcClose", near(c, "pcOpen"))

            def settled(o: Column) -> Column:
                first, last = F.when(kind == "pcOpen", c).otherwise(o), F.when(kind == "pcOpen", o).otherwise(c)
                opens, closes = _moved(edits, first["at"], True), _moved(edits, last["at"], False)
                pair = F.when(closes > opens, F.when(kind == "pcOpen", opens).otherwise(closes)).when(~deletable(first["run"]), opens)
                inside = F.exists(edits, lambda e: (c["at"] > e["start"]) & (c["at"] < e["end"]))
                alone = F.when(~(inside & deletable(c["run"])), _moved(edits, c["at"], False))
                return F.struct(F.when(o.isNotNull(), pair).otherwise(alone).alias("to"), c["seq"].alias("seq"), c["run"].alias("run"))

            return _with(other, settled)

        return F.array_sort(
            F.filter(F.transform(codes, place), lambda p: p["to"].isNotNull()),
            lambda a, b: F.when(a["to"] != b["to"], a["to"] - b["to"]).otherwise(a["seq"] - b["seq"]),
        )

    def woven(kept: Column, body: Column) -> Column:
        def piece(first: Column, last: Column) -> Column:
            return F.when(last > first, F.array(_text_run(F.substring(body, first + 1, last - first)))).otherwise(F.array().cast(f"array<{RUN}>"))

        def step(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.try_element_at(kept, i)["to"]).otherwise(0)
            return F.concat(piece(before, p["to"]), F.array(p["run"]))

        end = F.coalesce(F.try_element_at(kept, F.lit(-1))["to"], F.lit(0))
        return F.concat(F.flatten(F.transform(kept, step)), piece(end, F.length(body)))

    usable = (F.size(edits) > 0) & well_formed(text, edits) & ~structured(runs)
    codes = F.filter(placed, lambda p: p["run"]["kind"] != "text")
    return F.when(F.coalesce(usable, F.lit(False)), _with(F.struct(_with(codes, decided).alias("kept"), spliced(text, edits).alias("body")), lambda w: woven(w["kept"], w["body"]))).otherwise(runs)


def matches(text: Column, pattern: str, replacement: str, first_only: bool = False) -> Column:
    """Edits that replace each match (or the first) of a regular expression; the replacement is literal."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    places = F.transform(
        F.slice(found, 1, 1) if first_only else found,
        lambda m, i: _with(
            F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x))
            + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)),
            lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), F.lit(replacement).alias("replacement")),
        ),
    )
    return places.cast(EDITS)


def replace_in_runs(runs: Column, literal: str, replacement: str, first_only: bool = False, deletable: Callable[[Column], Column] = by_meaning) -> Column:
    """Runs with a literal text replaced, also where codes lie within it."""
    if not literal:
        return runs
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in literal)
    return _with(matches(plain_text(runs), quoted, replacement, first_only), lambda edits: apply_edits(runs, edits, deletable))


def placeholder_text(runs: Column) -> Column:
    """Text with each code as an <x id="..."/> tag: id for an opening code, /id closing, id/ single, sub:id a sub-flow."""

    def tag(*parts: Column) -> Column:
        return F.concat(F.lit('<x id="'), *parts, F.lit('"/>'))

    return _join(
        runs,
        lambda r: F.when(r["kind"] == "text", r["text"])
        .when(r["kind"] == "ph", tag(r["id"], F.lit("/")))
        .when(r["kind"] == "pcOpen", tag(r["id"]))
        .when(r["kind"] == "pcClose", tag(F.lit("/"), r["id"]))
        .when(r["kind"] == "sub", tag(F.lit("sub:"), r["id"]))
        .when(r["kind"].isin("plural", "select"), _other(r)),
    )


def parse_placeholder_text(text: Column, source: Column) -> Column:
    """Runs of such a text; each tag becomes the source's code of its kind and id, or a bare one if there is none."""
    ids = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    texts = F.split(text, TAG, -1)

    def code(raw: Column) -> Column:
        kind = F.when(raw.startswith("/"), "pcClose").when(raw.endswith("/"), "ph").when(raw.startswith("sub:"), "sub").otherwise("pcOpen")
        name = (
            F.when(kind == "pcClose", F.substring(raw, 2, F.length(raw)))
            .when(kind == "ph", F.substring(raw, F.lit(1), F.length(raw) - 1))
            .when(kind == "sub", F.substring(raw, 5, F.length(raw)))
            .otherwise(raw)
        )
        known = F.filter(source, lambda r: (r["kind"] == kind) & (r["id"] == name))
        bare = F.from_json(F.to_json(F.struct(kind.alias("kind"), name.alias("id"))), RUN)
        return F.coalesce(F.try_element_at(known, F.lit(-1)), bare)

    def pieces(t: Column, i: Column) -> Column:
        said = F.when(t != "", F.array(_text_run(t))).otherwise(F.array().cast(f"array<{RUN}>"))
        return F.concat(said, F.when(i < F.size(ids), F.array(code(F.try_element_at(ids, i + 1)))).otherwise(F.array().cast(f"array<{RUN}>")))

    return F.flatten(F.transform(texts, pieces))


def codes_kept(old: Column, new: Column) -> Column:
    """Whether `new` has exactly the codes of `old`, each as often, and its pairs are balanced."""

    def keys(runs: Column) -> Column:
        some = F.filter(runs, lambda r: r["kind"].isin("ph", "pcOpen", "pcClose", "sub"))
        return F.array_sort(F.transform(some, lambda r: F.concat_ws(":", r["kind"], F.coalesce(r["id"], F.lit("")))))

    opens = F.filter(new, lambda r: r["kind"] == "pcOpen")
    balanced = F.forall(
        F.transform(new, lambda r, i: F.struct(r.alias("r"), i.alias("i"))),
        lambda c: F.when(
            c["r"]["kind"] == "pcClose",
            F.size(F.filter(F.slice(new, F.lit(1), c["i"] + 1), lambda x: (x["kind"] == "pcClose") & (x["id"] == c["r"]["id"])))
            <= F.size(F.filter(F.slice(new, F.lit(1), c["i"]), lambda x: (x["kind"] == "pcOpen") & (x["id"] == c["r"]["id"]))),
        ).otherwise(True),
    )
    closes = F.filter(new, lambda r: r["kind"] == "pcClose")
    return (keys(old) == keys(new)) & balanced & (F.size(opens) == F.size(closes))
