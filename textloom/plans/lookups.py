"""Queries of scores by dimension, facets under a filter, graph look-ups and basis tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, govern, graph, stats
from ..schema import table


def compliance_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hygiene and length findings of documents as style and clarity."""
    docs = table(spark, d, "documents")
    style = checks.lint(docs, ["doc_id"], "text").withColumn("category", F.lit("style"))
    clarity = checks.length_limits(docs, ["doc_id"], "text", 5000, 1000).withColumn("category", F.when(F.col("category") == "too_many_words", "clarity").otherwise("other"))
    return govern.compliance_scores(style.unionByName(clarity), ["doc_id"], docs)


def filtered_facets(spark: SparkSession, d: str) -> DataFrame:
    return stats.filtered_facets(table(spark, d, "orders"), F.col("o_totalprice") > 200000, ["o_orderstatus", "o_orderpriority"], "o_custkey")


def found_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as nodes, valid from a balance on, found by segment, nation and scope."""
    at = F.lit("2020-01-01").cast("timestamp")
    nodes = table(spark, d, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.col("c_mktsegment").alias("label"),
        F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("properties"),
        F.when(F.col("c_acctbal") > 0, at).alias("valid_from"),
        F.when(F.col("c_custkey") % 3 == 0, at).alias("valid_to"),
        F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("market"), F.lit("eu"))).alias("tags"),
    )
    one = graph.find_nodes(nodes, "BUILDING", {"nation": "7"})
    all_of_scope = graph.find_nodes(nodes, None, {"nation": "3"}, F.lit("2021-01-01").cast("timestamp"), {"market": "us"})
    return one.select("id", F.lit("any").alias("scope")).unionByName(all_of_scope.select("id", F.lit("us").alias("scope")))


def found_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("label"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("properties"))
    return graph.find_edges(edges, "F", {"flag": "R"}).select("l_orderkey", "l_linenumber")


def basis_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The newest change of each user as microseconds."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("basis"))


QUERIES = {
    "compliance_scores": (
        compliance_scores,
        r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(lower(coalesce(text, '')), '[ \n\t]+') AS w FROM documents),
l AS (SELECT doc_id, t, CAST(regexp_matches(t, '\A\s') AS INT) + CAST(regexp_matches(regexp_replace(t, '\r?\n\z', ''), '\s\z') AS INT) + CAST(contains(t, '  ') AS INT)
  + CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND regexp_matches(w[i], '[\pL\pN]'))) > 0 AS INT) + CAST(regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]') AS INT) AS nits FROM t),
s AS (SELECT doc_id, CASE WHEN regexp_matches(t, '\S') THEN nits ELSE 5 END AS style, CASE WHEN regexp_matches(t, '\S') THEN nits ELSE 1 END AS issues,
  CAST(len(regexp_extract_all(t, '[^\s]+')) > 1000 AS INT) AS clarity, length(t) > 5000 AS long FROM l),
k AS (SELECT * FROM s),
d(dimension) AS (VALUES ('tone'), ('style'), ('vocabulary'), ('clarity'), ('compliance'))
SELECT doc_id, dimension, CAST(greatest(100 - penalty, 0) AS BIGINT) AS score, CAST(penalty AS BIGINT) AS penalty, CAST(CASE dimension WHEN 'style' THEN issues WHEN 'clarity' THEN clarity ELSE 0 END AS BIGINT) AS issues,
  CAST(greatest(100 - style - clarity, 0) AS BIGINT) AS overall
FROM (SELECT *, CASE dimension WHEN 'style' THEN style WHEN 'clarity' THEN clarity ELSE 0 END AS penalty FROM k, d)""",
    ),
    "filtered_facets": (
        filtered_facets,
        """
SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(DISTINCT o_custkey) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 200000 GROUP BY 2""",
    ),
    "found_nodes": (
        found_nodes,
        """
SELECT 'c' || c_custkey AS id, 'any' AS scope FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7
UNION ALL SELECT 'c' || c_custkey, 'us' FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 <> 0 AND c_custkey % 2 <> 0""",
    ),
    "found_edges": (found_edges, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'"),
    "basis_tokens": (basis_tokens, "SELECT user_id, max(epoch_us(ts)) AS basis FROM events GROUP BY 1"),
}
