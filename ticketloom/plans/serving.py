"""Serving queries: admission limits and budgets over the event log, and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators import serving
from ticketloom.plans.registry import Registry
from ticketloom.session import load

R = Registry()
query = R.query
#: Requests of one client are hours apart in these tables, so the limit is set to hours.
SPAN_SECONDS = 6 * 3600.0


@query()
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful by definition; tests hold it against a plain loop."""
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return serving.limiter(events, span=SPAN_SECONDS).select("client", "id", "admitted")


@query("""WITH s AS (SELECT event_id, CAST(ts AS DATE) AS day, coalesce(sum(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events)
SELECT event_id, round(spent, 4) AS spent, round(spent, 4) < 5000 AS admitted FROM s""")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("day"), "ts", F.col("value").alias("cost"))
    spent = serving.daily_budget(events, 5000.0)
    return spent.select(F.col("id").alias("event_id"), F.round("spent", 4).alias("spent"), (F.round("spent", 4) < 5000).alias("admitted"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts by the hour."""
    return load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: runs of a user's events with gaps below half an hour."""
    return load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


QUERIES, ORACLE_SQL = R.queries, R.sql
