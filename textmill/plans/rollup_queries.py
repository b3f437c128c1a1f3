"""Queries on roll-ups of results and on distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import rollup
from textmill.plans.registry import query
from textmill.sources.tables import by_file, table, union_all

SETS = "SELECT event_type, user_id, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id), (event_type), ())"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def group_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.mean_std(events(spark, sf_dir), ["event_type"], "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY mean DESC, user_id LIMIT 5")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five users of the highest mean (a top-k report)."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("mean"), "user_id").limit(5)


@query("WITH m AS (SELECT event_type, user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2) SELECT event_type, user_id AS best, mean FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, user_id) = 1")
def best_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    best = means.groupBy("event_type").agg(F.max_by(F.struct("user_id", "mean"), F.struct("mean", -F.col("user_id"))).alias("b"))
    return best.select("event_type", F.col("b.user_id").alias("best"), F.col("b.mean").alias("mean"))


STATUSES = ("F", "O", "P")


@query("SELECT o_orderpriority, " + ", ".join(f"round(100 * avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS {s}" for s in STATUSES) + " FROM orders GROUP BY 1")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", list(STATUSES)).agg(F.round(100 * F.avg("o_totalprice"), 2))


@query("SELECT p_partkey, unnest(['size', 'price']) AS metric, unnest([p_size::DOUBLE, p_retailprice]) AS value FROM part")
def metric_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return parts.unpivot("p_partkey", ["size", "price"], "metric", "value")


@query(SETS)
def results_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rollup.grouping_sets(events(spark, sf_dir), [["event_type", "user_id"], ["event_type"], []], "value")
    return made.withColumn("mean", F.round("mean", 6))


@query("WITH m AS (SELECT user_id, event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2) SELECT *, round(mean - max(mean) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id), 6) AS delta FROM m")
def delta_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return rollup.delta_to_base(means, ["user_id"], F.col("event_type") == "click", "mean").withColumn("delta", F.round("delta", 6))


@query("""WITH b AS (SELECT event_id, user_id, value, max(value) OVER w AS best, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, value, best, r - max(CASE WHEN before IS NULL OR value > before THEN r END) OVER (PARTITION BY user_id ORDER BY event_id) AS stale FROM b""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.running_best(events(spark, sf_dir).select("event_id", "user_id", "value"), ["user_id"], ["event_id"], "value")


@query("SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_mean_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(rollup.centred_mean("value", ["user_id"], ["event_id"], 5), 6).alias("mean"))


@query("WITH t AS (SELECT log10(max(n_chars) + 1) AS top FROM documents) SELECT (CASE WHEN n_chars < 1 THEN 0 ELSE least(floor(log10(n_chars) / top * 20) + 1, 20) END)::BIGINT AS bin, count(*) AS n FROM documents, t WHERE n_chars IS NOT NULL GROUP BY 1")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.log_histogram(table(spark, sf_dir, "documents"), "n_chars", 20)


@query("WITH p AS (SELECT n_nationkey AS k, n_nationkey * 37 % 160 - 80.0 AS lat, n_nationkey * 101 % 360 - 180.0 AS lon FROM nation) SELECT k, round(2 * 6371 * asin(sqrt(power(sin(radians(51.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * power(sin(radians(-0.1 - lon) / 2), 2))), 4) AS km FROM p")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    km = rollup.haversine(key * 37 % 160 - 80.0, key * 101 % 360 - 180.0, F.lit(51.5), F.lit(-0.1))
    return table(spark, sf_dir, "nation").select(key.alias("k"), F.round(km, 4).alias("km"))

AMOUNTS = {"customer": "c_acctbal", "supplier": "s_acctbal", "orders": "o_totalprice"}


@query(" UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS n, round(avg({c}::DOUBLE), 4) AS amount_avg, round(stddev_samp({c}::DOUBLE), 4) AS amount_std FROM {t}" for t, c in AMOUNTS.items()))
def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the amounts in each of three files, read as one."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]*\.parquet)(?:/[^/]*)?$", 1)
    frames = [table(spark, sf_dir, t).select(F.col(c).cast("double").alias("amount"), name.alias("file")) for t, c in AMOUNTS.items()]
    made = by_file(union_all(frames), ["amount"])
    return made.select("file", "n", F.round("amount_avg", 4).alias("amount_avg"), F.round("amount_std", 4).alias("amount_std"))
