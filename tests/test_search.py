"""Search in block texts, substitution commands and names of blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import search


def test_block_texts_and_grep(spark):
    rows = [(1, "A cat. Cats!", {"de": "Katze", "": "shadow", "fr": ""}), (2, "", {"de": "a.b"}), (3, None, None), (4, "axb", None)]
    texts = search.block_texts(spark.createDataFrame(rows, "block_id int, source_text string, targets map<string,string>"))
    assert sorted(tuple(r) for r in texts.collect()) == [(1, "", "A cat. Cats!"), (1, "de", "Katze"), (2, "de", "a.b"), (4, "", "axb")]

    def hits(*patterns, **options):
        return sorted((r["block_id"], r["locale"]) for r in search.grep(texts, "text", list(patterns), **options).collect())

    assert hits("cat") == [(1, "")] and hits("CAT", "KAT", ignore_case=True) == [(1, ""), (1, "de")]
    assert hits("cat", invert=True) == [(1, "de"), (2, "de"), (4, "")]
    assert hits("a.b") == [(2, "de"), (4, "")] and hits("a.b", fixed=True) == [(2, "de")]
    assert hits("cats", word=True) == [] and hits("cats", word=True, ignore_case=True) == [(1, "")]
    assert hits("x|z", "K", word=True) == []
    found = [(r["pattern"], r["match"], r["found"]) for r in search.grep_matches(texts.filter("block_id = 1 and locale = ''"), "text", ["cat", "[.!]"], ignore_case=True).collect()]
    assert sorted(found) == [(0, 0, "cat"), (0, 1, "Cat"), (1, 0, "."), (1, 1, "!")]
    counts = {r["locale"]: r["matching"] for r in search.grep_counts(texts, "locale", "text", ["cat"]).collect()}
    assert counts == {"": 1, "de": 0}
    with pytest.raises(ValueError):
        search.grep(texts, "text", [])


@pytest.mark.parametrize(
    ("script", "before", "after"),
    [
        (["s/colour/color/g"], "colour colour", "color color"),
        (["s/colour/color/"], "colour colour", "color colour"),
        (["s/COLOUR/color/i"], "a\nColour", "a\ncolor"),
        ([r"s/(\w+) (\w+)/\2 \1/"], "one two three", "two one three"),
        (["s/[0-9]+/<&>/g"], "a1b22", "a<1>b<22>"),
        ([r"s/a/\&/"], "banana", "b&nana"),
        (["s|/|-|g"], "a/b/c", "a-b-c"),
        ([r"s/\//-/g"], "a/b", "a-b"),
        (["s/x/$1/"], "x", "$1"),
        ([r"s/x/\\/"], "x", "\\"),
        ([r"s/ /\n/g"], "a b", "a\nb"),
        (["s/v1/v2/g", "s/beta//"], "v1 beta v1 beta", "v2  v2 beta"),
        (["s/b*/X/"], "abc", "Xabc"),
        (["s/none/x/"], "abc", "abc"),
        (["s/(a)(b)?/[\\2]/"], "ac", "[]c"),
        (["s/^b/x/g"], "a\nb", "a\nb"),
    ],
)
def test_sed(spark, script, before, after):
    assert spark.range(1).select(search.sed(F.lit(before), script)).first()[0] == after


@pytest.mark.parametrize("command", ["d", "s/a", "s/a/b", "s/a/b/x", "s/a/b/gg", "s//b/", "s\\a\\b\\", "y/a/b/"])
def test_wrong_commands(command):
    with pytest.raises(search.SedError):
        search.sed_commands([command])


def test_names_of_blocks(spark):
    rows = [("d", 1, "A / B", " x  y "), ("d", 2, "A / B", "x y"), ("d", 3, None, " "), ("d", 4, "", None), ("e", 1, "A / B", "x y")]
    df = spark.createDataFrame(rows, "doc string, seq int, a string, b string")
    named = search.block_names(df, "doc", "seq", search.structural_path(F.col("a"), F.col("b")))
    assert {(r["doc"], r["seq"]): r["name"] for r in named.collect()} == {("d", 1): "A - B/x y", ("d", 2): "A - B/x y#2", ("d", 3): "block", ("d", 4): "block#2", ("e", 1): "A - B/x y"}
