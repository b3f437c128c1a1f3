"""Scores: calibrated three-way sentiment, detector ratios, soft-label losses, sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.functions import text as fx


def calibrated(p: Column) -> Column:
    """struct(neg, neu, pos) of an ensemble's positive probability, piecewise, clamped to 0..1 and made to sum to 1."""
    zero, one = F.lit(0.0), F.lit(1.0)
    neg = F.when(p < 0.4, 1.0 - p).when(p < 0.45, 0.6 - p).otherwise(F.greatest(zero, 0.4 - p * 0.5))
    pos = F.when(p > 0.6, p).when(p > 0.55, p - 0.1).otherwise(F.greatest(zero, p * 0.5 - 0.1))
    clamp = lambda x: F.greatest(zero, F.least(one, x))

    def normal(s: Column) -> Column:
        total = s["neg"] + s["neu"] + s["pos"]
        return F.struct(*[F.when(total > 0, s[k] / total).otherwise(s[k]).alias(k) for k in ("neg", "neu", "pos")])

    raw = F.struct(clamp(neg).alias("neg"), clamp(1.0 - (neg + pos)).alias("neu"), clamp(pos).alias("pos"))
    return fx.let(raw, normal)


def category(s: Column) -> Column:
    """The strictly largest of a calibrated struct; ties are neutral."""
    return F.when(s["pos"] > F.greatest(s["neg"], s["neu"]), "Positive").when(s["neg"] > F.greatest(s["pos"], s["neu"]), "Negative").otherwise("Neutral")


def ensemble(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of probabilities."""
    return sum((c * w for c, w in parts), F.lit(0.0)) / sum(w for _, w in parts)


def log_ratio(value: Column, perturbed_mean: Column, epsilon: float = 1e-10) -> Column:
    """ln of a likelihood less that of the mean of its perturbations."""
    return F.ln(value + epsilon) - F.ln(perturbed_mean + epsilon)


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """Distance from the mean in deviations; the plain distance where nothing deviates."""
    return F.when(deviation > 0, (value - mean) / deviation).otherwise(value - mean)


def sample_weight(quality: Column, relevance: Column) -> list[Column]:
    """Weights for drawing and for the loss: quality times one plus (half) the relevance."""
    return [(quality * (1 + relevance)).alias("sample_weight"), (quality * (1 + relevance / 2)).alias("loss_weight")]


def soft_cross_entropy(df: DataFrame, group: str, logit: str, target: str) -> DataFrame:
    """(group, loss): cross-entropy of softmax(logit) against targets that are normalised to sum to 1 in each group."""
    top = df.groupBy(group).agg(F.max(logit).alias("__top"), F.sum(target).alias("__all"))
    both = df.join(top, group)
    parts = both.groupBy(group).agg(
        F.ln(F.sum(F.exp(F.col(logit) - F.col("__top")))).alias("__log"), F.first("__top").alias("__top"),
        F.sum(F.col(target) / F.col("__all") * F.col(logit)).alias("__mean"),
    )
    return parts.select(group, (F.col("__log") + F.col("__top") - F.col("__mean")).alias("loss"))


def transitions(df: DataFrame, within: str, order: list[str], value: str) -> DataFrame:
    """(before, after, n, percent) of each value and the next of its group; percent of all pairs."""
    after = F.lead(value).over(W.partitionBy(within).orderBy(*order))
    pairs = df.select(F.col(value).alias("before"), after.alias("after")).where("after is not null").groupBy("before", "after").agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("all"))
    return pairs.join(F.broadcast(total)).select("before", "after", "n", (100 * F.col("n") / F.col("all")).alias("percent"))


def first_valid(df: DataFrame, key: str, order: str, valid: Column, value: str) -> DataFrame:
    """(key, value): of the first alternative of each key that is valid; null if none is."""
    return df.groupBy(key).agg(F.min_by(value, F.when(valid, F.col(order))).alias(value))
