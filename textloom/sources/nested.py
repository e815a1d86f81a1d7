"""Formats within formats: layers taken out until none is left, transformed by format, and put back from the inside.

A layer is a text in a format; its extractor gives the places and texts in it. A rule may say that the text of a place is a
layer of another format, and so on. Layers: layer_id, parent_id (null: the document), place, format, text, depth.
"""

from __future__ import annotations

import csv
import functools
import io
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

LAYER = "doc_id string, layer_id string, parent_id string, place string, format string, text string, depth int"
NAMES = [c.split()[0] for c in LAYER.split(", ")]
TAG = re.compile(r"(<[^>]*>)")


def _json_strings(value: object, at: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, str):
        yield at, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _json_strings(v, f"{at}/{k}")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _json_strings(v, f"{at}/{k}")


def _json_with(value: object, new: dict[str, str], at: str = "") -> object:
    if isinstance(value, str):
        return new.get(at, value)
    if isinstance(value, dict):
        return {k: _json_with(v, new, f"{at}/{k}") for k, v in value.items()}
    if isinstance(value, list):
        return [_json_with(v, new, f"{at}/{k}") for k, v in enumerate(value)]
    return value


def _csv_rows(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text)))


def _csv_with(text: str, new: dict[str, str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([new.get(f"/{r}/{c}", cell) for c, cell in enumerate(row)] for r, row in enumerate(_csv_rows(text)))
    return out.getvalue()


#: format -> (texts of a layer by place, the layer with new texts). Places look like paths.
FORMATS: dict[str, tuple[Callable[[str], list[tuple[str, str]]], Callable[[str, dict[str, str]], str]]] = {
    "csv": (lambda t: [(f"/{r}/{c}", cell) for r, row in enumerate(_csv_rows(t)) for c, cell in enumerate(row)], _csv_with),
    "json": (lambda t: list(_json_strings(json.loads(t))), lambda t, new: json.dumps(_json_with(json.loads(t), new), ensure_ascii=False)),
    "html": (
        lambda t: [(f"/{k}", p) for k, p in enumerate(TAG.split(t)) if k % 2 == 0 and p.strip()],
        lambda t, new: "".join(new.get(f"/{k}", p) for k, p in enumerate(TAG.split(t))),
    ),
    "lines": (lambda t: [(f"/{k}", p) for k, p in enumerate(t.split("\n")) if p.strip()], lambda t, new: "\n".join(new.get(f"/{k}", p) for k, p in enumerate(t.split("\n")))),
}


def _children(batches: Iterator[pd.DataFrame], rules: list[tuple[str, str, str]]) -> Iterator[pd.DataFrame]:
    """Texts in each layer, with the format that the first fitting rule (format of the layer, pattern of places, format) names."""
    for batch in batches:
        rows = []
        for layer in batch.to_dict("records"):
            try:
                found = FORMATS[layer["format"]][0](layer["text"])
            except ValueError:  # not in this format: it stays one text
                found = []
            for place, text in found:
                inner = next((to for of, pattern, to in rules if of == layer["format"] and re.fullmatch(pattern, place)), None)
                rows.append((layer["doc_id"], f"{layer['layer_id']}!{place}", layer["layer_id"], place, inner, text, layer["depth"] + 1))
        yield pd.DataFrame(rows, columns=NAMES)


def extract(docs: DataFrame, rules: list[tuple[str, str, str]], most_depth: int = 16) -> DataFrame:
    """All layers and texts of documents (doc_id, format, text): LAYER. What has no format is a text of its own.

    Each round takes apart only what the one before has found, until there is nothing to take apart; a
    layer that isn't well-formed is a text. Deeper than `most_depth` is an error: rules then feed themselves.
    """
    top = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("layer_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("place"), "format", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("depth"))
    found, delta = [top], top
    for _ in range(most_depth):
        delta = checkpoint(delta.filter("format is not null").mapInPandas(lambda b: _children(b, rules), LAYER))
        if delta.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        found.append(delta)
    raise ValueError(f"layers are nested more than {most_depth} deep")


def texts(layers: DataFrame) -> DataFrame:
    """Layers without anything in them: what there is to transform, with the format of the layer that they stand in."""
    holders = layers.select(F.col("parent_id").alias("layer_id")).filter("layer_id is not null").distinct()
    owners = layers.select(F.col("layer_id").alias("parent_id"), F.col("format").alias("layer_format"))
    return layers.join(holders, "layer_id", "left_anti").join(owners, "parent_id", "left")


def transform(layers: DataFrame, change: Callable[[Column], Column], formats: list[str] | None = None) -> DataFrame:
    """(layer_id, text) of texts as `change` makes them, those of layers of `formats` only, if given."""
    chosen = texts(layers) if formats is None else texts(layers).filter(F.col("layer_format").isin(formats))
    return chosen.select("layer_id", change(F.col("text")).alias("text"))


def fold(layers: DataFrame, changed: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with changed texts (layer_id, text) put back, from the deepest layers up."""

    @F.pandas_udf("string")
    def rebuilt(kinds: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([FORMATS[k][1](old, {n["place"]: n["text"] for n in new}) for k, old, new in zip(kinds, olds, news, strict=True)])

    deepest = layers.agg(F.max("depth").alias("d")).first()["d"] or 0
    current = changed.select("layer_id", F.col("text").alias("new"))
    for depth in range(deepest, 0, -1):
        level = layers.filter(F.col("depth") == depth).select("layer_id", "parent_id", "place")
        parts = level.join(current, "layer_id").groupBy("parent_id").agg(F.collect_list(F.struct("place", F.col("new").alias("text"))).alias("news"))
        owners = layers.filter(F.col("depth") == depth - 1).join(parts.withColumnRenamed("parent_id", "layer_id"), "layer_id")
        above = owners.select("layer_id", rebuilt("format", "text", "news").alias("new"))
        current = checkpoint(current.join(level.select("layer_id"), "layer_id", "left_anti").unionByName(above))
    whole = layers.filter("depth = 0").join(current, "layer_id", "left")
    return whole.select("doc_id", F.coalesce("new", "text").alias("text"))
