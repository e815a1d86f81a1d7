"""Queries over relational tables and event logs: joins, roll-ups, histories, governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import diff, govern, history, stats
from ..schema import table


def quality_gate_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 3).alias("basis"))
    verdicts = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 2).alias("basis"), F.col("quality").alias("score"))
    return govern.gate_rollup(docs, verdicts, ["doc_id"], ["source", "lang"], 1)


def stale_verdicts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("doc_id") % 3).alias("basis"))
    verdicts = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 2).alias("basis"))
    return govern.stale_pairs(docs, verdicts, ["doc_id"])


def usage_having(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    percent = F.when(F.col("o_totalprice") > 250000, 100.0).otherwise(0.0)
    return orders.groupBy("o_custkey").agg(F.round(F.avg(percent), 4).alias("percent"), F.count(F.lit(1)).alias("orders")).filter("percent > 80 or percent < 10")


def feature_gate_hits(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "events").filter((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-24").cast("timestamp")))
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits")).filter("hits >= 3")


def as_of_event(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", "value")
    out = history.as_of(events, ["user_id"], "ts", "event_id", F.lit("2024-01-15").cast("timestamp"))
    return out.select("user_id", "event_id", "event_type", "value")


def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", "value")
    bought = events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))
    return history.as_of_join(bought, seen, ["user_id"], "ts", "seen", ["view_id"]).select("event_id", "user_id", "view_id")


def before_batch(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return history.before_batch(events, ["user_id"], "event_id", F.col("event_id") >= 9000).select("user_id", "event_id", "event_type", "value")


def compact_change_log(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    out = history.compact(events, ["user_id", "event_type"], "event_id", "ts", F.lit("2024-01-20").cast("timestamp"))
    return out.groupBy("event_type", "kept").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


def change_page(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type", "user_id")
    return history.changes(log, 500, 50, only=F.col("event_type").isin("view", "click"))


def composite_page(spark: SparkSession, d: str) -> DataFrame:
    """The page after (time, id), newest first."""
    events = table(spark, d, "events").select("event_id", "ts", "event_type")
    cursor = F.struct(F.lit("2024-01-20").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("event_id"))
    page = events.filter(F.struct("ts", "event_id") < cursor).orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return page.select("event_id", "event_type")


def audit_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    """A hash chain per user with every 97th row altered after the fact."""
    events = table(spark, d, "events")
    own = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    along = Window.partitionBy("user_id").orderBy("event_id")
    log = events.select("user_id", "event_id", "event_type", own.alias("stored"))
    log = log.withColumn("previous", F.lag("stored").over(along))
    log = log.withColumn("event_type", F.when(F.col("event_id") % 97 == 5, "altered").otherwise(F.col("event_type")))
    return history.chain_breaks(log, "user_id", "event_id", own, "previous", "stored").select("user_id", "event_id")


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    numbered = history.sessions(table(spark, d, "events").select("user_id", "ts", "value"), ["user_id"], "ts", 6 * 3600)
    return numbered.groupBy("user_id").agg(F.max("session").alias("sessions"), F.count(F.lit(1)).alias("events"))


def activity_by_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


def json_field_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(k >= 50).alias("large"), F.max(k).alias("top"))


def locale_coverage(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.terms import locale_coverage as coverage

    held = table(spark, d, "orders").select(F.col("o_custkey").alias("concept_id"), F.col("o_orderpriority").alias("locale"))
    return coverage(held).select("locale", "concepts", F.round("percent", 6).alias("percent"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.facets(table(spark, d, "orders"), "o_orderstatus", "o_custkey")


def shipping_join(spark: SparkSession, d: str) -> DataFrame:
    """Line items with orders, customers and nations: revenue by nation and priority."""
    items = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    joined = (
        items.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,4)"))
    return joined.groupBy("n_name", "o_orderpriority").agg(revenue.cast("double").alias("revenue"), F.count(F.lit(1)).alias("items"))


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order of high value."""
    orders = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def union_keys(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"))
    return a.union(b).distinct()


def except_keys(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return a.subtract(table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("key")))


def common_keys(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("key"))
    return a.intersect(table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("key")))


def array_relation(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays of parameters as a relation joined to a table."""
    given = spark.range(1).select(F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in (1, 5, 9)]).alias("nation"), F.array(*[F.lit(x) for x in (0.0, 500.0, 9000.0)]).alias("least"))).alias("g")).select("g.*")
    return table(spark, d, "customer").join(F.broadcast(given), F.col("c_nationkey") == F.col("nation")).filter("c_acctbal >= least").select("c_custkey", "nation")


def unit_rollup(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    out = stats.unit_rollup(joined, ["lang", "source"], {"n": F.count(F.lit(1)), "judged": F.count("quality"), "toxic": F.coalesce(F.sum("toxic"), F.lit(0)).cast("long")})
    return out


def funnel(spark: SparkSession, d: str) -> DataFrame:
    """User days that reach each step, of those with a view; purchases of all user days."""
    user_day = F.concat_ws("/", "user_id", F.to_date("ts"))
    steps = ["view", "click", "signup", "purchase"]
    counts = table(spark, d, "events").agg(
        *[F.countDistinct(F.when(F.col("event_type") == s, user_day)).alias(s) for s in steps], F.countDistinct(user_day).alias("everything")
    )
    return govern.funnel(counts, [("view", "views"), ("click", "views"), ("signup", "views"), ("purchase", "all")], {"views": "view", "all": "everything"})


def drift(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg(F.col("value").cast("decimal(20,6)")).cast("double").alias("score"), F.count(F.lit(1)).alias("n"))
    return govern.drift(days, ["event_type"], "day", "score", "n", recent=7, least_drop=0.5)


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")

    def found(rules: dict[str, tuple[str, str, str]]) -> DataFrame:
        hits = [
            F.when(F.contains(F.lower("text"), F.lit(w)), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(r).alias("replacement")))
            for c, (w, s, r) in rules.items()
        ]
        return docs.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("f")).select("doc_id", "f.*")

    before = found({"a": ("the of", "minor", ""), "b": ("##", "minor", "")})
    after = found({"b": ("!!", "major", "!"), "c": ("worthless", "critical", ""), "a": ("the of", "minor", "")})
    return govern.blast_radius(docs, before, after, "doc_id", "lang")


def percentile_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.describe(table(spark, d, "events"), F.col("value"), ["event_type"])


def job_status(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_totalprice") > 400000, "failed").when(F.col("o_totalprice") < 50000, "queued").otherwise("completed").alias("state"))
    return govern.job_status(jobs, ["o_custkey"])


def ship_manifest(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "supplier").select("s_nationkey", (F.col("s_acctbal") > 0).alias("shippable"), (F.col("s_suppkey") % 17 != 3).alias("verified"))
    return govern.ship_manifest(held, "s_nationkey")


def gate_order(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.checks import first_failing_gate

    gates = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), "l_partkey", F.col("l_quantity").alias("score"), F.lit(20.0).alias("threshold"), (F.col("l_linenumber") % 2 == 0).alias("blocking"))
    gates = gates.groupBy("l_orderkey", "ordinal").agg(F.min("score").alias("score"), F.first("threshold").alias("threshold"), F.first("blocking").alias("blocking"))
    return first_failing_gate(gates, ["l_orderkey"])


def block_diff(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    mine = part.filter("p_partkey % 11 <> 0").select("p_partkey", F.md5("p_name").alias("h"))
    theirs = part.filter("p_partkey % 7 <> 0").select("p_partkey", F.md5(F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("h"))
    return diff.hash_diff(mine, theirs, "p_partkey", "h")


def version_leverage(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    before = part.filter("p_partkey % 6 <> 0").select("p_partkey", F.col("p_name").alias("text"), F.col("p_brand").alias("t"))
    changed = F.when(F.col("p_partkey") % 4 == 1, F.upper("p_name")).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit("s"))).when(F.col("p_partkey") % 4 == 3, F.reverse("p_name")).otherwise(F.col("p_name"))
    out = diff.leverage(part.select("p_partkey", changed.alias("text")), before, "p_partkey", "text", "t")
    return out.select("p_partkey", "kind", F.col("percent").cast("long").alias("percent"), "target")


def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").select("l_suppkey", F.datediff("l_shipdate", F.lit("1990-01-01")).alias("start"))
    return diff.merge_spans(spans.withColumn("end", F.col("start") + 2), ["l_suppkey"])


def block_batches(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").cast("long").alias("tokens"))
    out = diff.pack_blocks(lines, ["l_suppkey"], "l_orderkey", "tokens", 500, 20)
    return out.groupBy("l_suppkey", "batch").agg(F.count(F.lit(1)).alias("blocks"), F.sum("tokens").alias("tokens"))


def estimate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return govern.estimate(docs, table(spark, d, "labels").filter("quality = 1"), "doc_id", "lang", "text")


def term_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "part").select("p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("target"), "p_partkey")
    return govern.term_rule_map(rules, "p_name", "target", "p_partkey")


def pattern_findings(spark: SparkSession, d: str) -> DataFrame:
    rules = [("shouting", "!!", "major"), ("symbols", "[#$%&*]{3}", "minor"), ("pipe", "[|]", "minor")]
    return govern.pattern_findings(table(spark, d, "documents"), rules, "doc_id", "text")


def unmet_patterns(spark: SparkSession, d: str) -> DataFrame:
    return govern.unmet_patterns(table(spark, d, "documents"), [("ends", "[.]"), ("article", "(?i)the "), ("digits", "[0-9]")], "doc_id", "text")


def similarity_findings(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    references = [[1.0 if k == j else 0.0 for k in range(64)] for j in range(0, 64, 8)]
    return govern.similarity_findings(vectors, references, "vec_id", "embedding", 0.1).select("vec_id", F.round("similarity", 6).alias("similarity"))


def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return history.latest(events, ["user_id", "event_type"], "event_id")


def tpch_pricing(spark: SparkSession, d: str) -> DataFrame:
    """Sums and means by flag and status."""
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    return (
        table(spark, d, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum(price).cast("double").alias("sum_price"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.count(F.lit(1)).alias("n"),
        )
    )


DAYS = "(SELECT event_type, CAST(ts AS DATE) AS day, CAST(avg(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS score, count(*) AS n FROM events GROUP BY 1, 2)"

QUERIES = {
    "quality_gate_rollup": (
        quality_gate_rollup,
        """
SELECT source, lang, count(*) AS total, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id % 3 = d.doc_id % 2) AS judged,
       count(*) FILTER (d.doc_id % 3 = d.doc_id % 2 AND quality >= 1) AS passed, count(*) FILTER (d.doc_id % 3 = d.doc_id % 2 AND quality < 1) AS held
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source, lang""",
    ),
    "stale_verdicts": (
        stale_verdicts,
        "SELECT d.doc_id, lang, d.doc_id % 3 AS basis FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR d.doc_id % 2 <> d.doc_id % 3",
    ),
    "usage_having": (
        usage_having,
        "SELECT o_custkey, round(avg(CASE WHEN o_totalprice > 250000 THEN 100.0 ELSE 0.0 END), 4) AS percent, count(*) AS orders FROM orders GROUP BY 1 HAVING percent > 80 OR percent < 10",
    ),
    "feature_gate_hits": (
        feature_gate_hits,
        "SELECT user_id, count(*) AS hits FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-24' GROUP BY 1 HAVING count(*) >= 3",
    ),
    "as_of_event": (
        as_of_event,
        "SELECT user_id, event_id, event_type, value FROM events WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    ),
    "as_of_join": (
        as_of_join,
        """
SELECT b.event_id, b.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts""",
    ),
    "before_batch": (
        before_batch,
        """
WITH f AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_id >= 9000 GROUP BY 1),
b AS (SELECT e.* FROM events e JOIN f USING (user_id) WHERE event_id < first QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, event_id, event_type, value FROM f LEFT JOIN b USING (user_id)""",
    ),
    "compact_change_log": (
        compact_change_log,
        """
WITH l AS (SELECT *, event_id = max(event_id) OVER (PARTITION BY user_id, event_type) OR ts >= TIMESTAMP '2024-01-20' AS kept FROM events)
SELECT event_type, kept, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM l GROUP BY 1, 2""",
    ),
    "change_page": (
        change_page,
        """
WITH p AS (SELECT event_id AS seq, event_type, user_id FROM events WHERE event_id > 500 AND event_type IN ('view', 'click') ORDER BY 1 LIMIT 51),
k AS (SELECT * FROM p ORDER BY seq LIMIT 50)
SELECT *, (SELECT count(*) > 50 FROM p) AS has_more, (SELECT max(seq) FROM k) AS next_cursor FROM k""",
    ),
    "composite_page": (
        composite_page,
        "SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 0) ORDER BY ts DESC, event_id DESC LIMIT 50",
    ),
    "audit_chain_breaks": (audit_chain_breaks, "SELECT user_id, event_id FROM events WHERE event_id % 97 = 5"),
    "session_counts": (
        session_counts,
        """
WITH s AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM s GROUP BY 1""",
    ),
    "activity_by_day": (activity_by_day, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "json_field_counts": (
        json_field_counts,
        "SELECT event_type, count(*) AS n, count(*) FILTER (CAST(props->>'$.k' AS INT) >= 50) AS large, max(CAST(props->>'$.k' AS INT)) AS top FROM events GROUP BY 1",
    ),
    "locale_coverage": (
        locale_coverage,
        "SELECT o_orderpriority AS locale, count(DISTINCT o_custkey) AS concepts, round(count(DISTINCT o_custkey) * 100.0 / (SELECT count(DISTINCT o_custkey) FROM orders), 6) AS percent FROM orders GROUP BY 1",
    ),
    "status_counts": (status_counts, "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
    "shipping_join": (
        shipping_join,
        """
SELECT n_name, o_orderpriority, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DOUBLE) AS revenue, count(*) AS items
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2""",
    ),
    "customers_without_orders": (customers_without_orders, "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "union_keys": (union_keys, "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier"),
    "except_keys": (except_keys, "SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40"),
    "common_keys": (common_keys, "SELECT l_suppkey AS key FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0"),
    "array_relation": (
        array_relation,
        "SELECT c_custkey, nation FROM customer JOIN (SELECT unnest([1, 5, 9]) AS nation, unnest([0.0, 500.0, 9000.0]) AS least) ON c_nationkey = nation WHERE c_acctbal >= least",
    ),
    "unit_rollup": (
        unit_rollup,
        """
SELECT lang, source, CAST(2 - grouping(lang) - grouping(source) AS INT) AS depth, count(*) AS n, count(quality) AS judged, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)""",
    ),
    "funnel": (
        funnel,
        """
WITH c AS (SELECT event_type, count(DISTINCT user_id || '/' || CAST(ts AS DATE)) AS n FROM events GROUP BY 1),
a AS (SELECT count(DISTINCT user_id || '/' || CAST(ts AS DATE)) AS n FROM events),
s AS (SELECT o.ordinal, o.step, c.n, CASE WHEN step = 'purchase' THEN a.n ELSE v.n END AS total
      FROM (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase')) o(ordinal, step) JOIN c ON c.event_type = o.step, a, (SELECT n FROM c WHERE event_type = 'view') v)
SELECT ordinal, step, n, (n * 200 // total + 1) // 2 AS percent,
       CASE WHEN step IN ('click', 'signup') THEN greatest(lag(n) OVER (ORDER BY ordinal) - n, 0) ELSE 0 END AS lost FROM s""",
    ),
    "drift": (
        drift,
        f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 7 AS recent FROM {DAYS}),
m AS (SELECT event_type, sum(score * n) FILTER (recent) / sum(n) FILTER (recent) AS r, sum(n) FILTER (recent) AS recent_count,
      sum(score * n) FILTER (NOT recent) / sum(n) FILTER (NOT recent) AS b0 FROM r GROUP BY 1),
z AS (SELECT *, coalesce(b0, r) AS b FROM m)
SELECT event_type, round(r, 1) AS recent, round(b, 1) AS baseline, round(b - r, 1) AS drop, CAST(recent_count AS BIGINT) AS recent_count, round(b - r, 1) >= 0.5 AS drifted FROM z""",
    ),
    "blast_radius": (
        blast_radius,
        """
WITH x AS (SELECT lang, contains(text, '##') AS b0, contains(text, '!!') AS b1, contains(lower(text), 'worthless') AS c1 FROM documents),
y AS (SELECT lang, CAST(b1 AND NOT b0 AS INT) + CAST(c1 AS INT) AS new, CAST(b0 AND NOT b1 AS INT) AS gone, CAST(c1 AS INT) AS critical, b1 AND NOT b0 AS fix,
             CAST(b0 AS INT) - 5 * CAST(b1 AS INT) - 25 * CAST(c1 AS INT) AS delta FROM x)
SELECT lang, count(*) AS blocks, count(*) FILTER (new > 0 OR gone > 0) AS affected, count(*) FILTER (fix) AS prescribed, count(*) FILTER (delta > 0) AS improved,
       count(*) FILTER (delta < 0) AS degraded, CAST(sum(new) AS BIGINT) AS new_violations, CAST(sum(gone) AS BIGINT) AS resolved_violations,
       CAST(sum(critical) AS BIGINT) AS critical, coalesce(avg(delta) FILTER (new > 0 OR gone > 0), 0.0) AS mean_delta
FROM y GROUP BY lang""",
    ),
    "percentile_summary": (
        percentile_summary,
        """
SELECT event_type, count(value) AS n, round(avg(value), 2) AS mean, round(quantile_cont(value, 0.5), 2) AS median, round(quantile_cont(value, 0.05), 2) AS p5,
       round(quantile_cont(value, 0.95), 2) AS p95, round(coalesce(stddev_samp(value), 0), 2) AS stddev, min(value) AS least, max(value) AS largest
FROM events GROUP BY 1""",
    ),
    "job_status": (
        job_status,
        """
WITH j AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'completed' WHEN o_totalprice > 400000 THEN 'failed' WHEN o_totalprice < 50000 THEN 'queued' ELSE 'completed' END AS state FROM orders)
SELECT o_custkey, CASE WHEN bool_or(state IN ('queued', 'processing')) THEN 'in_progress' WHEN bool_or(state = 'failed') THEN 'some_failed' ELSE 'all_completed' END AS status FROM j GROUP BY 1""",
    ),
    "ship_manifest": (ship_manifest, "SELECT s_nationkey, bool_and(s_acctbal > 0 AND s_suppkey % 17 <> 3) AS ships FROM supplier GROUP BY 1"),
    "gate_order": (
        gate_order,
        """
WITH g AS (SELECT l_orderkey, l_linenumber AS ordinal, min(l_quantity) AS score, 20.0::DOUBLE AS threshold, l_linenumber % 2 = 0 AS blocking FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, score >= threshold AS passed, coalesce(max(CAST(blocking AND score < threshold AS INT)) OVER (PARTITION BY l_orderkey ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM g)
SELECT l_orderkey, ordinal, score, threshold, blocking, passed FROM s WHERE stopped = 0""",
    ),
    "block_diff": (
        block_diff,
        """
WITH a AS (SELECT p_partkey, p_name AS h FROM part WHERE p_partkey % 11 <> 0),
b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS h FROM part WHERE p_partkey % 7 <> 0)
SELECT p_partkey, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b USING (p_partkey)""",
    ),
    "version_leverage": (
        version_leverage,
        """
WITH n AS (SELECT p_partkey, p_name, p_brand, CASE p_partkey % 4 WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || 's' WHEN 3 THEN reverse(p_name) ELSE p_name END AS t, p_partkey % 6 <> 0 AS old FROM part),
p AS (SELECT *, CASE WHEN old THEN CAST(floor((greatest(length(t), length(p_name)) - levenshtein(t, p_name)) * 100 / greatest(length(t), length(p_name))) AS BIGINT) END AS percent FROM n),
k AS (SELECT *, CASE WHEN NOT old THEN 'none' WHEN t = p_name THEN 'equal' WHEN lower(t) = lower(p_name) THEN 'case' WHEN percent > 70 THEN 'fuzzy' ELSE 'none' END AS kind FROM p)
SELECT p_partkey, kind, percent, CASE WHEN kind <> 'none' THEN p_brand END AS target FROM k""",
    ),
    "merged_spans": (
        merged_spans,
        """
WITH s AS (SELECT l_suppkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS start FROM lineitem),
r AS (SELECT l_suppkey, start, start + 2 AS "end", CASE WHEN start <= max(start + 2) OVER (PARTITION BY l_suppkey ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY start ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT l_suppkey, CAST(min(start) AS INT) AS start, CAST(max("end") AS INT) AS "end" FROM g GROUP BY l_suppkey, grp""",
    ),
    "block_batches": (block_batches, None),
    "estimate": (
        estimate,
        """
SELECT lang, count(*) AS pending, count(l.doc_id) AS via_memory, count(*) - count(l.doc_id) AS via_model,
       CAST(coalesce(sum(ceil(length(text) / 4.0)) FILTER (l.doc_id IS NULL), 0) AS BIGINT) AS tokens
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id GROUP BY lang""",
    ),
    "term_rules": (term_rules, "SELECT p_name, arg_min(p_brand, p_partkey) AS target FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1"),
    "pattern_findings": (
        pattern_findings,
        """
WITH r(rule, regex, severity) AS (VALUES ('shouting', '!!', 'major'), ('symbols', '[#$%&*]{3}', 'minor'), ('pipe', '[|]', 'minor'))
SELECT doc_id, rule, severity, CAST(len(regexp_extract_all(text, regex)) AS BIGINT) AS matches FROM documents, r WHERE matches > 0""",
    ),
    "unmet_patterns": (
        unmet_patterns,
        "SELECT doc_id, rule FROM documents, (VALUES ('ends', '[.]'), ('article', '(?i)the '), ('digits', '[0-9]')) r(rule, regex) WHERE NOT regexp_matches(text, regex)",
    ),
    "similarity_findings": (
        similarity_findings,
        "SELECT vec_id, round(list_max(list_transform(range(1, 65, 8), lambda i: CAST(embedding[i] AS DOUBLE))), 6) AS similarity FROM embeddings WHERE list_max(list_transform(range(1, 65, 8), lambda i: CAST(embedding[i] AS DOUBLE))) < 0.1",
    ),
    "latest_rows": (latest_rows, "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"),
    "tpch_pricing": (
        tpch_pricing,
        """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS sum_price,
       round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""",
    ),
}
