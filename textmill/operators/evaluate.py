"""Extraction quality: greedy and scalar matching, exact spans, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.functions import text as fx
from textmill.operators.rollup import running_totals


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 with 0 for empty denominators."""
    p, r = fx.ratio(tp, tp + fp), fx.ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), fx.ratio(2 * p * r, p + r).alias("f1")]


def greedy_match(found: Column, labels: Column) -> Column:
    """struct(tp, fp, fn, precision, recall, f1): each found item in order takes the first unused label that contains it or is in it.

    Both empty count as perfect with no hit; one empty as 0.
    """
    start = F.struct(F.lit(0).alias("tp"), F.array().cast("array<int>").alias("used"))

    def step(state: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: ~F.array_contains(state["used"], i) & (F.contains(F.get(labels, i), x) | F.contains(x, F.get(labels, i))))
        hit = F.get(free, F.lit(0))
        return F.struct((state["tp"] + hit.isNotNull().cast("int")).alias("tp"), F.when(hit.isNotNull(), F.array_append(state["used"], hit)).otherwise(state["used"]).alias("used"))

    none = (F.size(found) == 0) & (F.size(labels) == 0)
    tp = F.when((F.size(found) == 0) | (F.size(labels) == 0), F.lit(0)).otherwise(F.aggregate(found, start, step, lambda s: s["tp"]))

    def whole(n: Column) -> Column:
        fp, fn = F.size(found) - n, F.size(labels) - n
        counts = [c.cast("long").alias(name) for c, name in ((n, "tp"), (fp, "fp"), (fn, "fn"))]
        rates = zip(scores(n, fp, fn), ("precision", "recall", "f1"))
        return F.struct(*counts, *[F.when(none, F.lit(1.0)).otherwise(c).alias(name) for c, name in rates])

    return fx.let(tp, whole)


def scalar_match(found: Column, label: Column) -> Column:
    """tp, fp, fn of one value: a hit if one contains the other; nothing for two empty ones."""
    has, want = F.coalesce(found, F.lit("")) != "", F.coalesce(label, F.lit("")) != ""
    hit = has & want & (F.contains(found, label) | F.contains(label, found))
    return F.struct(hit.cast("long").alias("tp"), (has & ~hit).cast("long").alias("fp"), (want & ~hit).cast("long").alias("fn"))


def correct(found: Column, label: Column, empty_counts: bool = False) -> Column:
    """Whether one contains the other; an empty prediction is wrong unless ``empty_counts``. Null without a label."""
    has = (F.coalesce(found, F.lit("")) != "") | F.lit(empty_counts)
    x = F.coalesce(found, F.lit(""))
    return F.when(F.coalesce(label, F.lit("")) != "", has & (F.contains(x, label) | F.contains(label, x)))


def list_accuracy(found: Column, labels: Column) -> Column:
    """struct(all_found, any_found, missing, extra): labels contained in some found item, labels that are not, and found items without a label."""
    has = lambda p: F.exists(found, lambda f: F.contains(f, p))
    extra = F.filter(found, lambda f: ~F.exists(labels, lambda p: F.contains(f, p)))
    return F.struct(F.forall(labels, has).alias("all_found"), F.exists(labels, has).alias("any_found"), F.filter(labels, lambda p: ~has(p)).alias("missing"), extra.alias("extra"))


def exact_spans(found: DataFrame, gold: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn and scores of distinct spans that agree in all keys, for each ``by``."""
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full_outer")
    made = both.groupBy(*by).agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return made.select(*by, "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def roll_up(rows: DataFrame, by: list[str]) -> DataFrame:
    """Macro means (4 places), totals, and micro scores from the rounded means' totals."""
    made = rows.groupBy(*by).agg(*[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    micro_p, micro_r = F.round(fx.ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4), F.round(fx.ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4)
    p, r = F.col("micro_precision"), F.col("micro_recall")
    return made.withColumns({"micro_precision": micro_p, "micro_recall": micro_r}).withColumn("micro_f1", F.round(fx.ratio(2 * p * r, p + r), 4))


def threshold_sweep(df: DataFrame, score: str, label: str) -> DataFrame:
    """The first threshold of best accuracy of ``score >= t``, and its rates, from running counts by distinct score."""
    counts = df.groupBy(F.col(score).alias("t")).agg(F.sum(label).cast("long").alias("pos"), F.count("*").alias("n"))
    run = running_totals(counts, [F.desc("t")], ["pos", "n"]).select("t", F.col("run_pos").alias("tp"), F.col("run_n").alias("above"))
    total = counts.agg(F.sum("pos").alias("p"), F.sum("n").alias("all"))
    both = run.join(F.broadcast(total)).withColumn("right", F.col("tp") + (F.col("all") - F.col("p")) - (F.col("above") - F.col("tp")))
    best = both.agg(F.max_by(F.struct("t", "tp", "above", "p", "all", "right"), F.struct("right", -F.col("t"))).alias("b")).select("b.*")
    positives, negatives = F.col("p"), F.col("all") - F.col("p")
    false = F.col("above") - F.col("tp")
    return best.select(
        F.col("t").alias("threshold"), fx.ratio(F.col("right"), F.col("all")).alias("accuracy"),
        fx.ratio(F.col("tp"), positives).alias("tpr"), fx.ratio(negatives - false, negatives).alias("tnr"),
    )


STRATEGIES = ("cycling", "random", "all", "combined")


def rounds(steps: DataFrame, step: str, datasets: DataFrame, name: str, types: str, strategy: str, skipped: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """(step, dataset, examples, types): which data sets each step evaluates, with their examples and sorted entity types.

    ``datasets`` has a row an example, with the data set's name and an array of types. cycling takes the data sets in turn, in the order of their names; random draws one by hash of
    the step; all takes each of them; combined is one set of all but those ``skipped``, with the union of their types. Steps count from 0.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown evaluation strategy: {strategy}")
    wanted = datasets.where(~F.col(name).isin(*skipped)).withColumn(name, F.lit("combined")) if strategy == "combined" else datasets
    kinds = wanted.select(name, F.explode_outer(types).alias("t")).groupBy(name).agg(F.array_sort(F.collect_set("t")).alias("types"))
    sets = wanted.groupBy(name).agg(F.count("*").alias("examples")).join(kinds, name).withColumnRenamed(name, "dataset")
    if strategy in ("all", "combined"):
        return steps.select(F.col(step).alias("step")).crossJoin(F.broadcast(sets))
    # a row a data set; steps look theirs up by place
    placed = sets.withColumn("place", F.row_number().over(W.orderBy("dataset")) - 1)
    n = placed.count()
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(step), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    place = F.pmod(F.col(step) if strategy == "cycling" else draw, F.lit(max(n, 1))).cast("int")
    return steps.select(F.col(step).alias("step"), place.alias("place")).join(F.broadcast(placed), "place").drop("place")
