"""Comparison tables: group statistics, pivots, grouping sets, deltas, running best, histograms; great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.operators.lineage import cut

EARTH_KM = 6371.0


def running_totals(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """df with ``run_<value>``: totals of the rows up to each in the order, which must tell all rows apart.

    Rows are dealt out by ranges of the order; totals within a range and those of the ranges before it add up, so no task sees all rows.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("__part").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = parts.select("__part", *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    within = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = dealt.withColumns({f"run_{v}": F.sum(v).over(within) for v in values}).join(F.broadcast(starts), "__part")
    return inner.withColumns({f"run_{v}": F.col(f"run_{v}") + F.col(f"__{v}") for v in values}).drop("__part", *[f"__{v}" for v in values])


def overall_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its place (from 1) in an order that tells all rows apart."""
    return running_totals(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"]).withColumnRenamed("run___one", name).drop("__one")


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample standard deviation of each group."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def grouping_sets(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Mean and count at several levels; keys that a level lacks are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def delta_to_base(df: DataFrame, within: list[str], is_base: Column, value: str) -> DataFrame:
    """Adds delta: the value less that of the base row of its group, null without one."""
    return df.withColumn("delta", F.col(value) - F.max(F.when(is_base, F.col(value))).over(W.partitionBy(*within)))


def running_best(df: DataFrame, within: list[str], order: list[str], value: str) -> DataFrame:
    """Adds best (the maximum so far) and stale (rows since it last rose)."""
    w = W.partitionBy(*within).orderBy(*order)
    best = F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    before = F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    rose = F.when(before.isNull() | (F.col(value) > before), F.row_number().over(w))
    marked = df.withColumns({"best": best, "__rose": rose, "__row": F.row_number().over(w)})
    return marked.withColumn("stale", (F.col("__row") - F.max("__rose").over(w.rowsBetween(W.unboundedPreceding, 0))).cast("long")).drop("__rose", "__row")


def centred_mean(value: str, within: list[str], order: list[str], width: int) -> Column:
    """Rolling mean of ``width`` rows around each; null where the window is not full."""
    w = W.partitionBy(*within).orderBy(*order).rowsBetween(-(width // 2), (width - 1) // 2)
    return F.when(F.count(value).over(w) == width, F.avg(value).over(w))


def log_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): rows in bins of equal width of log10 from 0 to that of the maximum plus 1; values below 1 are in bin 0."""
    top = df.agg(F.log10(F.max(value) + 1).alias("top"))
    place = F.when(F.col(value) < 1, F.lit(0)).otherwise(F.least(F.floor(F.log10(value) / F.col("top") * bins) + 1, F.lit(bins)))
    return df.where(F.col(value).isNotNull()).join(F.broadcast(top)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
