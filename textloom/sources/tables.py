"""Formats that Spark reads itself: CSV and TSV, JSON lines, XML, plain text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the header of a key column is, or ends in after a separator.
KEY_HEADERS = ("id", "key", "identifier", "slug", "uid", "uuid", "msgid", "code", "ref")


def is_key_header(name: str) -> bool:
    return re.search(rf"(?:^|[_\-. ])(?:{'|'.join(KEY_HEADERS)})$", name.strip().lower()) is not None


def key_column(df: DataFrame) -> str | None:
    """The leftmost column whose header says that it is a key and whose values are all there and distinct; else none."""
    named = [n for n in df.columns if is_key_header(n)]
    if not named:
        return None
    held = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in named]
    total, *counts = df.agg(F.count(F.lit(1)), *[F.countDistinct(c) for c in held]).first()
    return next((n for n, c in zip(named, counts, strict=True) if total and c == total), None)


def read_csv(spark: SparkSession, path: str, separator: str = ",", columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """A block per translatable cell: path, block_id (key/column), column, text."""
    df = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', multiLine=True)
    key = key or key_column(df)
    texts = columns or [c for c in df.columns if c != key]
    named = df.withColumn("_path", F.col("_metadata.file_name"))
    row = F.col(key) if key else F.monotonically_increasing_id().cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in texts])
    out = named.select(F.col("_path").alias("path"), row.alias("_row"), F.explode(cells).alias("c"))
    return out.filter("c.text is not null").select("path", F.concat_ws("/", "_row", "c.column").alias("block_id"), "c.column", "c.text")


def write_csv(blocks: DataFrame, path: str, separator: str = ",") -> None:
    """Cells back to rows and columns."""
    split = blocks.withColumn("_row", F.substring_index("block_id", "/", 1))
    split.groupBy("_row").pivot("column").agg(F.first("text")).write.csv(path, header=True, sep=separator, quoteAll=True, mode="overwrite")


def read_plain(spark: SparkSession, path: str, by: str = "paragraph") -> DataFrame:
    """A block per line or paragraph of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.regexp_replace("value", "^﻿|\r", "").alias("value"))
    parts = F.split("value", "\n" if by == "line" else r"\n\s*\n")
    out = whole.select("path", F.posexplode(parts).alias("seq", "text")).filter(F.col("text").rlike(r"(?U)\S"))
    return out.withColumn("block_id", F.concat(F.lit("p"), F.col("seq")))


def read_xml_rows(spark: SparkSession, path: str, tag: str, fields: dict[str, str]) -> DataFrame:
    """Elements of a flat XML format; fields: output column -> XPath inside the element."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.regexp_replace("value", r"(?s)<\?xml.*?\?>|<!DOCTYPE[^>]*>", "").alias("xml"))
    found = rows.select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?(?:/>|>.*?</{tag}>)"), F.lit(0))).alias("seq", "x"))
    return found.select("path", "seq", *[F.xpath_string("x", F.lit(p)).alias(n) for n, p in fields.items()])


def read_android(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_rows(spark, path, "string", {"block_id": "/string/@name", "text": "/string", "translatable": "/string/@translatable"}).filter("translatable <> 'false'")


def read_resx(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_rows(spark, path, "data", {"block_id": "/data/@name", "text": "/data/value", "note": "/data/comment"})


def read_qt_ts(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_rows(spark, path, "message", {"text": "/message/source", "target": "/message/translation", "state": "/message/translation/@type"}).withColumn("block_id", F.sha2("text", 256))


def read_xliff(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_rows(spark, path, "trans-unit", {"block_id": "/trans-unit/@id", "text": "/trans-unit/source", "target": "/trans-unit/target", "state": "/trans-unit/target/@state"})


def read_xliff2(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_rows(spark, path, "unit", {"block_id": "/unit/@id", "text": "/unit/segment/source", "target": "/unit/segment/target", "state": "/unit/segment/@state"})


def read_tmx(spark: SparkSession, path: str) -> DataFrame:
    """A row per translation unit and language."""
    units = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("xml"))
    found = units.select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<tu(?:\s[^>]*)?>.*?</tu>"), F.lit(0))).alias("seq", "tu"))
    variants = found.select("path", "seq", F.explode(F.regexp_extract_all("tu", F.lit(r"(?s)<tuv(?:\s[^>]*)?>.*?</tuv>"), F.lit(0))).alias("tuv"))
    plain = F.regexp_replace("tuv", r"xml:lang", "lang")
    return variants.select("path", "seq", F.xpath_string(plain, F.lit("/tuv/@lang")).alias("locale"), F.xpath_string(plain, F.lit("/tuv/seg")).alias("text"))


def tmx_lines(entries: DataFrame, key: str = "entry_id", locale: str = "locale", text: str = "text") -> DataFrame:
    """One <tu> element per entry, as lines to be written with `df.write.text`."""

    def escape(c: str):
        return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    variant = F.concat(F.lit('<tuv xml:lang="'), F.col(locale), F.lit('"><seg>'), escape(text), F.lit("</seg></tuv>"))
    grouped = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(locale).alias("l"), variant.alias("v")))).alias("v"))
    body = F.array_join(F.transform("v", lambda x: x["v"]), "")
    return grouped.select(F.concat(F.lit('<tu tuid="'), F.col(key).cast("string"), F.lit('">'), body, F.lit("</tu>")).alias("value"))


def read_json_paths(spark: SparkSession, path: str) -> DataFrame:
    """A block per string value of JSON files: path, block_id (JSON path), text."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))
    from .lexers import parse_blocks

    return parse_blocks(docs, "json")


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    from .lexers import parse_blocks

    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))
    return parse_blocks(docs, "properties")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT and VTT files: path, seq, start_ms, end_ms, text."""
    from ..functions.text import timecode_ms

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.regexp_replace("value", "\r|^﻿", "").alias("value"))
    cue = r"(?m)^((?:\d+:)?\d{2}:\d{2}[,.]\d{3})\s+-->\s+((?:\d+:)?\d{2}:\d{2}[,.]\d{3})[^\n]*\n((?:[^\n]+\n?)*)"
    found = whole.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(cue), F.lit(0))).alias("seq", "cue"))
    part = [F.regexp_extract("cue", cue, k) for k in (1, 2, 3)]
    return found.select("path", "seq", timecode_ms(part[0]).alias("start_ms"), timecode_ms(part[1]).alias("end_ms"), F.rtrim(F.regexp_replace(part[2], r"\n+$", "")).alias("text"))


def subtitle_lines(cues: DataFrame) -> DataFrame:
    """SRT text of each path: (path, content)."""
    from ..functions.text import format_timecode

    block = F.concat_ws("\n", (F.col("seq") + 1).cast("string"), F.concat(format_timecode(F.col("start_ms")), F.lit(" --> "), format_timecode(F.col("end_ms"))), "text")
    ordered = cues.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))).alias("c"))
    return ordered.select("path", F.concat(F.array_join(F.transform("c", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("content"))


def read_terms_csv(spark: SparkSession, path: str, prefix: str = "term") -> DataFrame:
    """Terms: source, target, domain, definition, status, origin, competitor; rows lacking a half are skipped."""
    names = ["source", "target", "domain", "definition", "status", "origin", "competitor"]
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE")
    whole = df.filter((F.trim(F.coalesce("source", F.lit(""))) != "") & (F.trim(F.coalesce("target", F.lit(""))) != ""))
    numbered = whole.select(F.monotonically_increasing_id().alias("_n"), "*")
    return numbered.withColumn("concept_id", F.concat(F.lit(prefix + "-"), F.col("_n").cast("string"))).drop("_n")


def write_records(blocks: DataFrame, path: str, *columns: str) -> None:
    """Structured records as JSON lines."""
    blocks.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)
