"""Queries of event-time windows, digests and stream filters, run here over the table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import table
from ..streaming import feeds


def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    out = feeds.windowed_counts(table(spark, d, "events"), "ts", "event_type", "6 hours")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = feeds.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day", "12 hours")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"), F.max("n").alias("most"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    out = feeds.session_windows(table(spark, d, "events"), "ts", "user_id", "6 hours")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def digests(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sent = events.filter("user_id % 3 = 0").select("user_id", F.lit("2024-01-18").cast("timestamp").alias("last_sent")).distinct()
    return feeds.digests(events, sent, F.lit("2024-01-20").cast("timestamp")).select("user_id", "event_type", "n")


def automation_hits(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    data = F.from_json("props", "map<string,string>")
    held = feeds.conditions_hold(data, [("k", "contains", "7"), ("k", "exists", "")])
    return feeds.subscribe(events, ["error", "click"]).filter(held).select("event_id", "event_type")


def quiet_events(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    held = feeds.quiet(at, F.lit("UTC"), F.lit("22:00"), F.lit("06:30"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(held).alias("quiet"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "tumbling_windows": (
        hourly_windows,
        "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    ),
    "sliding_windows": (
        sliding_windows,
        """
WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events),
c AS (SELECT event_type, start, count(*) AS n FROM w GROUP BY 1, 2)
SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM c GROUP BY 1""",
    ),
    "session_windows": (
        session_windows,
        """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s),
c AS (SELECT user_id, k, count(*) AS n FROM g GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    ),
    "digests": (
        digests,
        """
SELECT user_id, event_type, count(*) AS n FROM events
WHERE ts > CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-18' ELSE TIMESTAMP '2024-01-19' END AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2""",
    ),
    "automation_hits": (automation_hits, "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click') AND contains(props->>'$.k', '7')"),
    "quiet_events": (
        quiet_events,
        "SELECT event_type, count(*) FILTER (strftime(ts, '%H:%M') >= '22:00' OR strftime(ts, '%H:%M') < '06:30') AS quiet, count(*) AS n FROM events GROUP BY 1",
    ),
}
