"""Batch twins of the streaming operators over events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmusq.operators.market import keep_first
from litmusq.sources.tables import table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")


def event_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event sent twice and then ingested once."""
    e = _events(spark, folder)
    twice = e.unionByName(e.where("event_id % 3 = 0"))
    return keep_first(twice, ["event_id"], ["ts"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def event_routing(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "payments").when(F.col("event_type") == "error", "alerts").otherwise("dead_letter")
    return e.groupBy(kind.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def early_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of users who have ordered, and those of users not known by an order."""
    c = table(spark, folder, "orders", "o_custkey").select(F.col("o_custkey").alias("user_id")).distinct().withColumn("known", F.lit(True))
    return _events(spark, folder).join(c, "user_id", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    w = F.window("ts", "1 day")
    return _events(spark, folder).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")


def sliding_counts(spark: SparkSession, folder: str) -> DataFrame:
    w = F.window("ts", "2 hours", "1 hour")
    return _events(spark, folder).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "n")


def session_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = _events(spark, folder).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("starts"), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "event_dedup": event_dedup,
    "event_routing": event_routing,
    "early_events": early_events,
    "tumbling_counts": tumbling_counts,
    "sliding_counts": sliding_counts,
    "session_counts": session_counts,
}
SQL: dict[str, str] = {
    "event_dedup": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type",
    "event_routing": "SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'payments' WHEN event_type = 'error' THEN 'alerts' ELSE 'dead_letter' END AS route, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "early_events": "SELECT user_id IN (SELECT o_custkey FROM orders) AS known, count(*) AS n FROM events GROUP BY ALL",
    "tumbling_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS starts, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding_counts": "WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS h FROM events), w AS (SELECT h AS starts FROM h UNION ALL SELECT h - INTERVAL 1 HOUR FROM h) SELECT starts, count(*) AS n FROM w GROUP BY starts",
    "session_counts": """WITH g AS (SELECT user_id, ts, event_id, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS starts, count(*) AS n FROM s GROUP BY user_id, k""",
}
