"""Splits, strata, curricula, difficulty, schedules; draws follow hashes, so they repeat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.operators.quantiles import quantiles
from textmill.operators.rollup import overall_rank


def draw(key: Column | str, seed: int = 42) -> Column:
    """A hash that orders rows as if by chance, the same each time: the hexadecimal digits of md5."""
    return F.md5(F.concat_ws(":", F.col(key) if isinstance(key, str) else key, F.lit(seed)).cast("binary"))


def uniform(key: Column | str, seed: int = 42) -> Column:
    """A number in (0, 1] from the first eight digits of ``draw``."""
    return (F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)


def quantile_bins(df: DataFrame, value: str, edges: tuple[float, ...] = (0.25, 0.5, 0.75), name: str = "bin") -> DataFrame:
    """Bins (from 0) between exact quantiles, right-closed; equal edges fall together. A null value is in bin 0."""
    cuts = sorted({c for c in quantiles(df, value, list(edges)) if c is not None})
    return df.withColumn(name, sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(0)))


def percentile_counts(df: DataFrame, value: str, percents: tuple[int, ...] = (10, 25, 50, 75, 90, 100)) -> DataFrame:
    """(percent, threshold, n): rows at or below each percentile, counted in one pass; no rows for a column without values."""
    cuts = [c for c in zip(percents, quantiles(df, value, [p / 100 for p in percents])) if c[1] is not None]
    if not cuts:
        return df.sparkSession.createDataFrame([], "percent int, threshold double, n long")
    counts = df.agg(*[F.count_if(F.col(value) <= c).alias(f"n{p}") for p, c in cuts])
    rows = F.array(*[F.struct(F.lit(p).alias("percent"), F.lit(float(c)).alias("threshold"), F.col(f"n{p}").alias("n")) for p, c in cuts])
    return counts.select(F.inline(rows))


def phases(df: DataFrame, order: list[Column], key: str, shares: dict[str, float]) -> DataFrame:
    """(phase, key): the int(share * n) first rows of the order for each phase."""
    total = df.agg(F.count("*").alias("__all"))
    placed = overall_rank(df, order, "__place").join(F.broadcast(total))
    every = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(s).alias("share")) for p, s in shares.items()])
    return placed.select(key, "__place", "__all", F.inline(every)).where(F.col("__place") <= F.floor(F.col("share") * F.col("__all"))).select("phase", key)


def stage(df: DataFrame, score: str, key: str, percentile: float, least: int = 100) -> DataFrame:
    """Rows whose score is at most its percentile; if these are fewer than min(least, n / 10), the so many of least score."""
    top = quantiles(df, score, [percentile])[0]
    chosen = df.where(F.col(score) <= F.lit(top))
    wanted = min(least, df.count() // 10)
    if chosen.count() >= wanted:
        return chosen
    return overall_rank(df, [F.col(score), F.col(key)], "__place").where(F.col("__place") <= wanted).drop("__place")


def easiest(df: DataFrame, score: str, key: str, ratio: float, least: int = 1000) -> DataFrame:
    """The max(least, min(int(n * ratio), n)) rows of least score."""
    n = df.count()
    wanted = max(least, min(int(n * ratio), n))
    return overall_rank(df, [F.col(score), F.col(key)], "__place").where(F.col("__place") <= wanted).drop("__place")


def rank_normalised(df: DataFrame, score: str, key: str, name: str = "normalised") -> DataFrame:
    """df with (place - 1) / (n - 1) by score, ties by key; 0 for a single row."""
    total = df.agg(F.count("*").alias("__all"))
    placed = overall_rank(df, [F.col(score), F.col(key)], "__place").join(F.broadcast(total))
    share = F.coalesce(F.try_divide((F.col("__place") - 1).cast("double"), (F.col("__all") - 1).cast("double")), F.lit(0.0))
    return placed.withColumn(name, share).drop("__place", "__all")


def bucket_split(key: Column, test_percent: int, buckets: int = 100) -> Column:
    """train or test by the remainder of an integer key's hash-free value."""
    return F.when(F.pmod(key, F.lit(buckets)) < test_percent, "test").otherwise("train")


def positional_split(df: DataFrame, order: list[Column], train: float = 0.95) -> DataFrame:
    """df with ``split``: train for the int(train * n) first rows of an order that tells all rows apart, test for the rest; found by ranges of the order."""
    n = df.count()
    return overall_rank(df, order, "__place").withColumn("split", F.when(F.col("__place") <= int(train * n), "train").otherwise("test")).drop("__place")


def per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group, those first by ``draw``. Each group keeps its n first within tasks before rows meet."""
    order = W.partitionBy(group).orderBy(draw(key, seed), key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def weighted_without_replacement(df: DataFrame, weight: Column, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn with the given weights: the least of -ln(u) / weight."""
    return df.orderBy(-F.ln(uniform(key, seed)) / weight, key).limit(n)


def weighted_choice(key: Column | str, weights: dict[str, float], seed: int = 42) -> Column:
    """One of the names, each with its share of the weights, by ``uniform``."""
    total, at, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        at += w
        hit = uniform(key, seed) <= at / total
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(list(weights)[-1])


def stratified_batch(df: DataFrame, label: str, key: str, plan: dict[int, int], anchors: DataFrame, strata: DataFrame, size: int = 64) -> DataFrame:
    """Rows of an anchor label and of labels of its strata: ``plan`` maps the place of a label in its stratum to how many rows it gives; filled to ``size``."""
    wanted = anchors.select(F.col("a").alias(label), F.lit(plan.get(0, 0)).alias("__n")).distinct()
    for place, n in plan.items():
        if place:
            wanted = wanted.unionByName(anchors.join(strata, "a").where(F.col("place") == place).select(F.col("b").alias(label), F.lit(n).alias("__n")).distinct())
    order = W.partitionBy(label).orderBy(draw(key, 7), key)
    best = wanted.groupBy(label).agg(F.max("__n").alias("__n"))
    return df.join(best, label).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("__n")).drop("__r", "__n").limit(size)


def difficulty(length: Column, spans: Column, rarity: Column) -> Column:
    """0.2 length/256 + 0.3 spans/10 + 0.3 rarity + 0.2 of ten times the density, each at most 1."""
    one = F.lit(1.0)
    density = F.coalesce(F.try_divide(spans.cast("double"), length.cast("double")), F.lit(0.0))
    return 0.2 * F.least(length / 256.0, one) + 0.3 * F.least(spans / 10.0, one) + 0.3 * rarity + 0.2 * F.least(10 * density, one)


def scaled_difficulty(df: DataFrame, parts: dict[str, float]) -> DataFrame:
    """df with difficulty: columns over their 95th percentile, at most 1, weighted."""
    total = F.lit(0.0)
    for c, w in parts.items():
        share = F.try_divide(F.col(c).cast("double"), F.lit(quantiles(df, c, [0.95])[0]).cast("double"))
        total = total + w * F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0))
    return df.withColumn("difficulty", total)


def schedule(step: Column, warmup: int, start: float, end: float, kind: str = "linear") -> Column:
    """A value that moves from start to a larger end over ``warmup`` steps: linear, cosine or exponential; clamped."""
    x = step / float(warmup)
    if kind == "cosine":
        made = start + (end - start) * (1 - F.cos(x * math.pi)) / 2
    elif kind == "exponential":
        made = start * F.pow(F.lit(end / start), x)
    else:
        made = start + (end - start) * x
    return F.when(step >= warmup, F.lit(end)).otherwise(F.greatest(F.least(made, F.lit(end)), F.lit(start)))
