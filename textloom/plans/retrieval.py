"""Queries of content memory, terms, graphs, segmentation and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, graph, memory, recycle, segmentation, terms
from ..schema import blocks_of_documents, table

TERMS = [("c1", "the of"), ("c1", "thand"), ("c2", "for the"), ("c3", "les"), ("c4", "und"), ("c5", "in of the")]


def memory_keys(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("plain_key", F.col(text)).withColumn("structural_key", F.col(text)).withColumn("generalized_key", F.regexp_replace(text, "[0-9]+", "{NUMBER}"))


def parts(spark: SparkSession, d: str, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Queries and entries: names with types and numbers, of each 100th (or other) part and of all others."""
    part = table(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("no "), F.col("p_size"))))
    queries = memory_keys(part.filter(F.col("p_partkey") % every == 0).select(F.col("p_partkey").alias("query_id"), "t"), "t").drop("t")
    entries = memory_keys(part.filter(F.col("p_partkey") % every != 0).select(F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("target"), "t"), "t").drop("t")
    return queries, entries


def memory_exact(spark: SparkSession, d: str) -> DataFrame:
    queries, entries = parts(spark, d, 2)
    out = memory.settle_ambiguous(memory.exact_matches(queries, entries, ("structural",)))
    return out.select("query_id", "entry_id", "target", F.col("score").cast("double").alias("score"), "ambiguous")


def memory_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    queries, entries = parts(spark, d)
    return memory.fuzzy_matches(queries, entries, 0.85).select("query_id", "entry_id", F.round("score", 6).alias("score"))


def memory_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each 100th document with a word changed, looked up among the lines of all documents.

    Whole lines in any script: DuckDB counts edits in bytes, so there is no SQL; tests compare with all pairs.
    """
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).filter("t <> ''")
    changed = F.replace("t", F.lit(" the "), F.lit(" thee "))
    found = memory.alike_texts(lines.filter("doc_id % 100 = 0").select(changed.alias("q")), lines.select(F.col("t").alias("e")), 0.95)
    return found.select(F.col("q").alias("query_id"), F.col("e").alias("entry_id"), F.round("score", 6).alias("score"))


def memory_tiered(spark: SparkSession, d: str) -> DataFrame:
    queries, entries = parts(spark, d)
    out = memory.tiered_lookup(queries, entries, 0.85, 3)
    return out.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"), F.round(F.max("score"), 6).alias("best"), F.min("tier").alias("tier"))


def _codes_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as texts with keys that differ: every third has a code in it, and numbers are entities."""
    part = table(spark, d, "part").withColumn("plain_key", F.concat_ws(" ", "p_name", F.lit("no"), "p_size"))
    coded = F.concat(F.lit("{1}"), "p_name", F.lit("{/1} no "), "p_size")
    part = part.withColumn("structural_key", F.when(F.col("p_partkey") % 3 == 0, coded).otherwise(F.col("plain_key")))
    part = part.withColumn("generalized_key", F.regexp_replace("structural_key", "no [0-9]+", "no {NUMBER}"))
    return part.withColumn("entities", F.create_map(F.lit("n"), F.col("p_size").cast("string"))).withColumn("project", F.col("p_brand"))


def memory_recycled(spark: SparkSession, d: str) -> DataFrame:
    """Every 100th part filled from the memory of all others."""
    part = _codes_and_numbers(spark, d)
    keys = ["generalized_key", "structural_key", "plain_key", "entities", "project"]
    queries = part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), *keys)
    target = F.concat(F.lit("Teil "), "p_name", F.when(F.col("p_name").contains("ring"), F.concat(F.lit(": "), "p_size")).otherwise(""))
    entries = part.filter("p_partkey % 100 <> 0").select(F.col("p_partkey").alias("entry_id"), target.alias("target"), *keys)
    found = recycle.full_lookup(queries, entries, 0.75, 1)
    blocks = queries.select("query_id", F.lit(None).cast("string").alias("target_text"))
    filled = recycle.recycle(blocks, found)
    return filled.join(found.select("query_id", "entry_id", "tier"), "query_id", "left")


def memory_variants(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("entry_id"), F.col("event_type").alias("locale"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("props")).alias("text"), F.col("event_id").alias("at"))
    return memory.merge_variants(events).drop("at")


def locale_facets(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import facets

    return facets(table(spark, d, "events"), "event_type", "user_id")


def term_hits(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([(f"{c}/{t}", t) for c, t in TERMS], "term_id string, term string")
    return terms.term_hits(table(spark, d, "documents"), given, "doc_id", "text")


def term_matches(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([(t, t) for t in ("red ring", "BOLT", "blue  widget")], "term_id string, term string")
    return terms.term_matches(table(spark, d, "part"), given, "p_partkey", "p_name")


def term_transitions(spark: SparkSession, d: str) -> DataFrame:
    states = spark.createDataFrame([(s,) for s in (*terms.STATUSES, "retired")], "before string")
    pairs = states.join(states.withColumnRenamed("before", "after"))
    return pairs.select("before", "after", terms.may_change(F.col("before"), F.col("after")).alias("allowed"), terms.is_governed(F.col("before"), F.col("after")).alias("governed"))


def valid_terms(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    tags = F.when(F.col("o_orderstatus") == "O", F.create_map(F.lit("market"), F.col("o_orderpriority")))
    at = F.lit("1998-06-01").cast("timestamp_ntz")
    held = terms.is_valid(at, F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")), F.col("o_orderdate") + F.expr("interval 400 days"), tags, {"market": "5-LOW"})
    return orders.filter(held).select("o_orderkey")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts as a graph of who supplies what."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target_id"), F.when(F.col("l_linestatus") == "O", "broader").otherwise("part_of").alias("label")
    )


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([("s1",), ("s7",), ("p100",)], "node string")
    found = graph.neighbours(edges(spark, d), start, "both", ["broader", "part_of"])
    return found.withColumn("inverse", graph.inverse_label(F.col("label")))


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([("s1",), ("s7",)], "node string")
    return graph.shortest_paths(edges(spark, d), start, 3, directed=False).groupBy("start", "hops").agg(F.count(F.lit(1)).alias("nodes"))


def occurrence_graph(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame(TERMS, "concept_id string, term string")
    return graph.occurrence_graph(blocks_of_documents(table(spark, d, "documents")), given).groupBy("target_id", "label").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("uses"))


def document_moves(spark: SparkSession, d: str) -> DataFrame:
    """Documents under new paths with changed lines."""
    blocks = blocks_of_documents(table(spark, d, "documents")).select("doc_id", "seq", F.md5("source_text").alias("h"))
    key = F.col("doc_id").cast("int")
    before = blocks.filter(key % 13 != 0).select(F.concat(F.lit("docs/"), "doc_id").alias("path"), "h")
    now = blocks.filter(~((key % 5 == 0) & (F.col("seq") == 1))).select(F.when(key % 3 == 0, F.concat(F.lit("moved/"), "doc_id")).otherwise(F.concat(F.lit("docs/"), "doc_id")).alias("path"), "h")
    return diff.reconcile(now, before, "path", "h")


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.segment_counts(table(spark, d, "documents"), "text", "lang", "lang")


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    rules = [("mail", r"[\w.]+@[\w.]+"), ("number", r"\d{3,}")]
    hidden, vault = segmentation.redact(docs, rules, "doc_id", "text")
    back = segmentation.unredact(hidden, vault, "doc_id", "text").select("doc_id", F.col("text").alias("restored"))
    counts = vault.groupBy("doc_id").agg(F.count(F.lit(1)).alias("secrets"))
    out = docs.join(back, "doc_id").join(counts, "doc_id", "left").fillna(0, ["secrets"])
    return out.select("doc_id", "secrets", (F.col("text") == F.col("restored")).alias("restored"))


PART = "(SELECT p_partkey, p_brand, p_name || ' ' || p_type || ' no ' || p_size AS t FROM part)"
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
VALUES = ", ".join(f"('{c}', '{t}')" for c, t in TERMS)
HITS = f"""
WITH w AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, '  ') || ' ' AS t FROM documents), c(concept, term) AS (VALUES {VALUES})
SELECT doc_id, concept || '/' || term AS term_id, CAST((length(t) - length(replace(t, ' ' || replace(term, ' ', '  ') || ' ', ''))) // (length(replace(term, ' ', '  ')) + 2) AS BIGINT) AS hits
FROM w, c WHERE hits > 0"""
EDGES = "(SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, CASE WHEN l_linestatus = 'O' THEN 'broader' ELSE 'part_of' END AS label FROM lineitem)"

RECYCLED = """
WITH p AS (SELECT *, p_name || ' no ' || p_size AS pk, CASE WHEN p_partkey % 3 = 0 THEN '{1}' || p_name || '{/1} no ' || p_size ELSE p_name || ' no ' || p_size END AS sk FROM part),
k AS (SELECT *, regexp_replace(sk, 'no [0-9]+', 'no {NUMBER}') AS gk FROM p),
q AS (SELECT * FROM k WHERE p_partkey % 100 = 0), e AS (SELECT * FROM k WHERE p_partkey % 100 <> 0),
r AS (SELECT q.p_partkey AS query_id, e.p_partkey AS entry_id, 'Teil ' || e.p_name || CASE WHEN contains(e.p_name, 'ring') THEN ': ' || e.p_size ELSE '' END AS target, q.p_size AS want, e.p_size AS have, q.p_brand = e.p_brand AS same, e.p_brand AS brand,
  CASE WHEN q.gk = e.gk THEN 0 WHEN q.sk = e.sk THEN 1 WHEN q.pk = e.pk THEN 2 END AS exact, q.sk = e.sk AS coded,
  1 - levenshtein(q.gk, e.gk)::DOUBLE / greatest(length(q.gk), length(e.gk)) AS g, 1 - levenshtein(q.sk, e.sk)::DOUBLE / greatest(length(q.sk), length(e.sk)) AS s,
  1 - levenshtein(q.pk, e.pk)::DOUBLE / greatest(length(q.pk), length(e.pk)) AS p FROM q, e),
x AS (SELECT *, CASE WHEN exact = 2 AND NOT coded THEN 0.99 WHEN exact IS NOT NULL THEN 1.0 END AS whole FROM r),
y AS (SELECT *, count(DISTINCT CASE WHEN whole = 1 THEN target END) OVER (PARTITION BY query_id) AS targets FROM x),
z AS (SELECT *, coalesce(whole = 1 AND targets > 1, false) AS ambiguous,
  CASE WHEN whole IS NOT NULL THEN CASE WHEN whole = 1 AND targets > 1 THEN 0.99::DOUBLE ELSE whole::DOUBLE END WHEN greatest(g, s, p) < 1 AND same THEN least(greatest(g, s, p) + 0.03, 1.0) ELSE greatest(g, s, p) END AS score,
  CASE WHEN exact IS NOT NULL THEN exact WHEN g >= s AND g >= p THEN 3 WHEN s >= p THEN 4 ELSE 5 END AS tier FROM y WHERE whole IS NOT NULL OR greatest(g, s, p) >= 0.75),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier, entry_id) AS rank FROM z WHERE score >= 0.75),
f AS (SELECT * FROM b WHERE rank = 1)
SELECT q.p_partkey AS query_id, CASE WHEN f.query_id IS NULL THEN 'none' WHEN score >= 0.99 AND NOT ambiguous THEN 'filled' ELSE 'offered' END AS memory_state, CAST(round(score * 100) AS INT) AS memory_score,
  CASE WHEN score >= 0.99 AND NOT ambiguous THEN CASE WHEN tier IN (0, 3) AND contains(target, have::VARCHAR) THEN substr(target, 1, strpos(target, have::VARCHAR) - 1) || want || substr(target, strpos(target, have::VARCHAR) + length(have::VARCHAR)) ELSE target END END AS target_text,
  entry_id, tier
FROM q LEFT JOIN f ON f.query_id = q.p_partkey"""


QUERIES = {
    "memory_exact": (
        memory_exact,
        f"""
WITH m AS (SELECT q.p_partkey AS query_id, e.p_partkey AS entry_id, e.p_brand AS target FROM {PART} q JOIN {PART} e ON q.t = e.t AND q.p_partkey % 2 = 0 AND e.p_partkey % 2 = 1),
n AS (SELECT query_id, count(DISTINCT target) > 1 AS ambiguous FROM m GROUP BY 1)
SELECT query_id, entry_id, target, CASE WHEN ambiguous THEN 0.99::DOUBLE ELSE 1.0::DOUBLE END AS score, ambiguous FROM m JOIN n USING (query_id)""",
    ),
    "memory_fuzzy": (
        memory_fuzzy,
        f"""
SELECT q.p_partkey AS query_id, e.p_partkey AS entry_id, round(1 - levenshtein(q.t, e.t) / greatest(length(q.t), length(e.t)), 6) AS score
FROM {PART} q JOIN {PART} e ON q.p_partkey % 100 = 0 AND e.p_partkey % 100 <> 0 WHERE 1 - levenshtein(q.t, e.t) / greatest(length(q.t), length(e.t)) >= 0.85""",
    ),
    "memory_lines": (memory_lines, None),
    "memory_tiered": (memory_tiered, None),
    "memory_recycled": (memory_recycled, RECYCLED),
    "memory_variants": (
        memory_variants,
        "SELECT user_id AS entry_id, event_type AS locale, props AS text FROM events WHERE true QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1 AND event_id % 5 <> 0",
    ),
    "locale_facets": (locale_facets, "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1"),
    "term_hits": (term_hits, HITS),
    "term_matches": (
        term_matches,
        r"""
SELECT p_partkey, term AS term_id, CAST(len(regexp_extract_all(p_name, '(?i)\b' || regexp_replace(term, '\s+', '\\s+', 'g') || '\b')) AS BIGINT) AS hits
FROM part, (VALUES ('red ring'), ('BOLT'), ('blue  widget')) AS t(term) WHERE hits > 0""",
    ),
    "term_transitions": (
        term_transitions,
        """
WITH s(s) AS (VALUES ('proposed'), ('admitted'), ('preferred'), ('deprecated'), ('forbidden'), ('retired'))
SELECT a.s AS before, b.s AS after, a.s <> 'retired' AND b.s <> 'retired' AS allowed,
       a.s <> b.s AND (b.s IN ('forbidden', 'preferred') OR a.s = 'forbidden') AS governed FROM s a, s b""",
    ),
    "valid_terms": (
        valid_terms,
        """
SELECT o_orderkey FROM orders WHERE (o_orderkey % 4 = 0 OR o_orderdate <= TIMESTAMP '1998-06-01') AND TIMESTAMP '1998-06-01' < o_orderdate + INTERVAL 400 DAY
AND (o_orderstatus <> 'O' OR o_orderpriority = '5-LOW')""",
    ),
    "graph_neighbours": (
        graph_neighbours,
        f"""
WITH e AS (SELECT a AS node, b AS neighbour, label FROM {EDGES} UNION SELECT b, a, label FROM {EDGES})
SELECT node, neighbour, label, CASE label WHEN 'broader' THEN 'narrower' ELSE 'has_part' END AS inverse FROM e WHERE node IN ('s1', 's7', 'p100')""",
    ),
    "shortest_paths": (
        shortest_paths,
        f"""
WITH RECURSIVE e AS (SELECT a, b FROM {EDGES} UNION SELECT b, a FROM {EDGES}),
r AS (SELECT unnest(['s1', 's7']) AS start, unnest(['s1', 's7']) AS node, 0 AS hops UNION SELECT start, b, hops + 1 FROM r JOIN e ON node = a WHERE hops < 3),
m AS (SELECT start, node, min(hops) AS hops FROM r GROUP BY 1, 2)
SELECT start, hops, count(*) AS nodes FROM m GROUP BY 1, 2""",
    ),
    "occurrence_graph": (occurrence_graph, None),
    "document_moves": (document_moves, None),
    "sentence_counts": (sentence_counts, None),
    "redacted_documents": (redacted_documents, None),
}
