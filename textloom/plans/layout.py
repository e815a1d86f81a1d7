"""Queries of layout, metadata, tags and rule resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import layout
from ..schema import blocks_of_documents, table


def region_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as boxes on a page per supplier, in a grid of regions."""
    items = table(spark, d, "lineitem")
    lines = items.select(F.col("l_suppkey").alias("page"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("line_id"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_linenumber") * 30.0).alias("y"), F.lit(4.0).alias("w"), F.lit(2.0).alias("h"))
    pages = items.select(F.col("l_suppkey").alias("page")).distinct()
    regions = pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("region_id"))
    regions = regions.select("page", "region_id", (F.col("region_id") % 3 * 150.0).alias("x"), (F.floor(F.col("region_id") / 3) * 100.0).alias("y"), F.lit(150.0).alias("w"), F.lit(100.0).alias("h"))
    found = layout.assign_regions(lines, layout.reading_order(regions))
    return found.groupBy("region_id").agg(F.count(F.lit(1)).alias("lines"))


def numbered_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = blocks_of_documents(table(spark, d, "documents")).select(F.col("collection").alias("path"), F.col("doc_id").cast("long").alias("doc_id"), "seq")
    out = layout.numbered(blocks.withColumn("place", F.struct("doc_id", "seq")), "path", "place")
    return out.select("path", "doc_id", "seq", "number")


def resolved_rules(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    matches = events.select(F.col("user_id").alias("element_id"), F.col("event_type").alias("category"), F.col("event_id").alias("ordinal"), F.col("props").alias("value"))
    local = events.filter("event_id < 40").groupBy(F.col("user_id").alias("element_id"), F.col("event_type").alias("category")).agg(F.min("props").alias("value"))
    return layout.resolve_rules(matches, local)


def metadata_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").select("c_custkey", F.create_map(F.lit("Full Name"), F.col("c_name"), F.lit("market (segment)"), F.col("c_mktsegment"), F.lit("none"), F.lit(" ")).alias("m"))
    return layout.metadata_blocks(docs, "c_custkey", "m")


def page_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of pages found, protected and put back."""
    pages = table(spark, d, "pages").select("page_id", "html").withColumn("p", udfs.protect_tags("html"))
    return pages.select("page_id", F.size("p.tags").alias("tags"), (udfs.restore_tags("p.text", "p.tags") == F.col("html")).alias("same"))


def xml_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", udfs.xml_error("text").alias("error")).filter("error is not null")


QUERIES = {
    "region_lines": (
        region_lines,
        """
WITH l AS (SELECT l_quantity * 10 + 2 AS cx, l_linenumber * 30.0 + 1 AS cy FROM lineitem)
SELECT CASE WHEN cx < 450 AND cy < 200 THEN CAST(floor(cx / 150) + 3 * floor(cy / 100) AS INT) END AS region_id, count(*) AS lines FROM l GROUP BY 1""",
    ),
    "numbered_blocks": (
        numbered_blocks,
        r"""
WITH b AS (SELECT source AS path, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS seq FROM documents)
SELECT path, doc_id, seq, row_number() OVER (ORDER BY path, doc_id, seq) AS number FROM b WHERE regexp_matches(line, '\S')""",
    ),
    "resolved_rules": (
        resolved_rules,
        """
WITH r AS (SELECT user_id, event_type, arg_max(props, event_id) AS rule FROM events GROUP BY 1, 2),
o AS (SELECT user_id, event_type, min(props) AS own FROM events WHERE event_id < 40 GROUP BY 1, 2)
SELECT user_id AS element_id, event_type AS category, coalesce(own, rule) AS value FROM r LEFT JOIN o USING (user_id, event_type)""",
    ),
    "metadata_blocks": (
        metadata_blocks,
        "SELECT c_custkey, unnest(['meta-full-name', 'meta-market-segment']) AS block_id, unnest([c_name, c_mktsegment]) AS text FROM customer",
    ),
    "page_tags": (page_tags, None),
    "xml_errors": (xml_errors, None),
}
