"""Queries of format readers and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import blocks_of_documents, table
from ..sources.lexers import parse_blocks
from . import flow, tools  # noqa: F401  registers the tools


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of web pages by role."""
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return parse_blocks(pages, "html").groupBy("target").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("path").alias("pages")).withColumnRenamed("target", "role")


def json_blocks(spark: SparkSession, d: str) -> DataFrame:
    """String values of JSON files, one file per customer."""
    value = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment"), F.array(F.col("c_name"), F.lit("x")).alias("tags")).alias("more"), F.col("c_nationkey").alias("n"))
    files = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.to_json(value).alias("content"))
    return parse_blocks(files, "json").select("path", "block_id", "text")


def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


def flow_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A flow of tools over blocks: replace, upper-case, count."""
    blocks = blocks_of_documents(table(spark, d, "documents"))
    steps = [("search-replace", {"pairs": [("the ", "THE ")]}), ("whitespace-correct", {}), ("case-transform", {"mode": "lower"}), ("word-count", {}), ("identity", {})]
    out = flow.run(blocks, steps)
    return out.groupBy("source_locale").agg(F.count(F.lit(1)).alias("blocks"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.countDistinct("content_hash").alias("distinct"))


LINES = "(SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)"

QUERIES = {
    "html_blocks": (html_blocks, None),
    "json_blocks": (
        json_blocks,
        """
SELECT CAST(c_custkey AS VARCHAR) AS path, unnest(['name', 'more.segment', 'more.tags[0]', 'more.tags[1]']) AS block_id,
       unnest([c_name, c_mktsegment, c_name, 'x']) AS text FROM customer""",
    ),
    "page_hosts": (page_hosts, r"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1"),
    "flow_blocks": (
        flow_blocks,
        rf"""
WITH b AS (SELECT lang, lower(regexp_replace(regexp_replace(regexp_replace(line, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS t FROM {LINES} WHERE regexp_matches(line, '\S'))
SELECT lang AS source_locale, count(*) AS blocks, CAST(sum(len(regexp_extract_all(t, '[^\s]+'))) AS BIGINT) AS words, CAST(sum(length(t)) AS BIGINT) AS chars, count(DISTINCT t) AS "distinct" FROM b GROUP BY 1""",
    ),
}
