"""Streams over the events table, run to their end, and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.lineage import new_folder
from textmill.plans.registry import query
from textmill.sources.tables import table
from textmill.streaming import append, ledger


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of files; the path is a pattern, as a stream's path itself must be a folder."""
    files = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    folder = new_folder(spark, name)
    append.append_to(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals of each kind of event whose hour is closed: two hours before the last event."""
    made = append.windows(event_stream(spark, sf_dir), "ts", "1 hour", "2 hours", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    return finished(spark, made, "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, events less than six hours apart, that are closed two hours before the last event."""
    made = append.sessions(event_stream(spark, sf_dir), "ts", "6 hours", "2 hours", ["user_id"], [F.count("*").alias("n")])
    return finished(spark, made, "sessions").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of events, once."""
    return finished(spark, append.first_of_each(event_stream(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]), "first")


@query("""
WITH e AS (SELECT user_id, ts, event_type, event_id, min(ts) OVER (PARTITION BY user_id) + INTERVAL 2 DAY AS deadline FROM events),
j AS (SELECT user_id, min(ts) AS begun, any_value(deadline) AS deadline, max(ts) AS latest, min(ts) FILTER (WHERE event_type = 'purchase' AND ts <= deadline) AS done FROM e GROUP BY 1),
o AS (SELECT j.*, (SELECT min(event_id) FROM e WHERE e.user_id = j.user_id AND e.ts = j.done AND e.event_type = 'purchase') AS output, (SELECT max(ts) FROM events) AS now FROM j)
SELECT user_id::VARCHAR AS job, 'active' AS state, begun AS at, NULL AS output FROM o
UNION ALL SELECT user_id::VARCHAR, 'finished', done, output::VARCHAR FROM o WHERE done IS NOT NULL
UNION ALL SELECT user_id::VARCHAR, 'timed out', deadline, NULL FROM o WHERE done IS NULL AND (latest > deadline OR now - INTERVAL 1 HOUR >= deadline)""")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs that a purchase within two days of the first event finishes."""
    done = F.col("event_type") == "purchase"
    stream = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("job"), F.col("ts").alias("at"), done.alias("done"), F.when(done, F.col("event_id").cast("string")).alias("output"))
    return finished(spark, ledger.changes(stream, timedelta(days=2)), "ledger").withColumn("at", F.col("at").cast("timestamp_ntz"))
