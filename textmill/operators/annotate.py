"""Annotations and prompts: normal forms of values, entity complexity, masks, choices by hash, hooks for outside models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as fx
from textmill.operators.sampling import draw, uniform

#: What is taken from values before they are compared, by kind: patterns, in any case.
REMOVED = {"vessel": r"mv\s+|m/v\s+", "port": r"laycan|eur\d+", "incoterm": r"terms"}
PREFIXES = ("M/V", "MV", "MT", "MS", "m/v")
SIGNS = (",", "-", "/", "(", ")")


def normal_value(value: Column, kind: str) -> Column:
    """The lower-cased, trimmed value without what its kind leaves out; soybeans are soybean."""
    x = F.lower(F.trim(value))
    if kind in REMOVED:
        return F.trim(F.regexp_replace(x, REMOVED[kind], ""))
    return F.replace(x, F.lit("soybeans"), F.lit("soybean")) if kind == "commodity" else x


def complexity(tokens: Column, label: Column) -> Column:
    """How hard an entity is to find, at most 1: several tokens, a ship's prefix, signs, figures, capitals, and what its label adds."""
    n = F.size(tokens)
    some = lambda test: F.exists(tokens, test)
    parts = (
        F.when(n > 1, 0.2 + 0.1 * F.least(n - 1, F.lit(3))), F.when(some(lambda t: t.isin(*PREFIXES)), 0.15), F.when(some(lambda t: t.isin(*SIGNS)), 0.2),
        F.when(some(lambda t: t.rlike(r"\p{N}")), 0.15), F.when(some(lambda t: (F.length(t) > 1) & (t == F.upper(t)) & (t != F.lower(t))), 0.1),
        F.when((label == "location") & (n > 2), 0.2).when((label == "vessel name") & F.contains(F.array_join(tokens, " "), F.lit("/")), 0.1).when(label == "incoterm", 0.1),
    )
    return F.least(sum((F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0)), F.lit(1.0))


def between(text: Column, start: str, end: str, other_end: str) -> Column:
    """What stands between the first start mark and the first end mark behind it, or else the other end mark, or else the end; null without a start mark."""
    rest = F.substring(text, F.locate(start, text) + len(start), F.length(text))
    upto = lambda mark: F.substring(rest, F.lit(1), F.locate(mark, rest) - 1)
    found = F.when(F.contains(rest, F.lit(end)), upto(end)).when(F.contains(rest, F.lit(other_end)), upto(other_end)).otherwise(rest)
    return F.when(F.contains(text, F.lit(start)), F.trim(found))


def choice(key: Column, names: tuple[str, ...], seed: int) -> Column:
    """One of the names, all alike likely, by hash."""
    return F.get(F.array(*[F.lit(n) for n in names]), F.least(F.floor(uniform(key, seed) * len(names)), F.lit(len(names) - 1)).cast("int"))


def few(key: Column, names: tuple[str, ...], n: int, seed: int) -> Column:
    """n different names in an order drawn by hash."""
    listed = F.array(*[F.struct(draw(F.concat_ws("/", key, F.lit(name)), seed).alias("d"), F.lit(name).alias("name")) for name in names])
    return F.transform(F.slice(F.array_sort(listed), 1, n), lambda x: x["name"])


def masked(tokens: Column, key: Column, share: float = 0.15, mask: str = "[MASK]", seed: int = 42) -> Column:
    """Tokens of which ``share`` are chosen by hash of key and place; of these 80 % become the mask, 10 % another token of the text, 10 % stay."""

    def made(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            other = F.get(ts, F.pmod(i * 7 + 3, F.size(ts)))
            # the hash is made once for a token
            return fx.let(uniform(F.concat_ws("/", key, i), seed) / share, lambda u: F.when(u <= 0.8, mask).when((u > 0.8) & (u <= 0.9), other).otherwise(t))

        return F.transform(ts, one)

    return fx.let(tokens, made)


def listed_entities(text: Column, schema: str) -> Column:
    """A list that was printed with single quotes and None, as an array of structs; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), "'", '"')
    return F.from_json(plain, schema)


def applied(df: DataFrame, model: Callable[[pd.DataFrame], pd.Series], out: str = "answer") -> DataFrame:
    """df with a model's text for each row and ``error``, what it failed with; rows of a batch that fails are tried one by one."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield batch.assign(**{out: model(batch).astype(object), "error": None})
            except Exception:  # noqa: BLE001  whatever the model raises is told in the rows
                answers, errors = [], []
                for i in range(len(batch)):
                    try:
                        answers.append(str(model(batch.iloc[i : i + 1]).iloc[0]))
                        errors.append(None)
                    except Exception as error:  # noqa: BLE001
                        answers.append(None)
                        errors.append(f"{type(error).__name__}: {error}")
                yield batch.assign(**{out: pd.Series(answers, batch.index, dtype=object), "error": pd.Series(errors, batch.index, dtype=object)})

    return df.mapInPandas(run, schema)


def logistic_split(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """accuracy, precision, recall and F1, on the rows it is fitted on, of a logistic regression over features scaled by mean and population deviation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    facts = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    scaled = [((F.col(f) - facts[f"m{i}"]) / (facts[f"s{i}"] or 1.0)).alias(f"x{i}") for i, f in enumerate(features)]
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features").transform(df.select(*scaled, F.col(label).cast("double").alias("label")))
    made = LogisticRegression().fit(rows).transform(rows)
    hit, said, is_one = (F.col("prediction") == F.col("label")), F.col("prediction") == 1, F.col("label") == 1
    counts = made.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count_if(said & is_one).alias("tp"), F.count_if(said).alias("p"), F.count_if(is_one).alias("n"))
    precision, recall = fx.ratio(F.col("tp"), F.col("p")), fx.ratio(F.col("tp"), F.col("n"))
    return counts.select("accuracy", precision.alias("precision"), recall.alias("recall"), fx.ratio(2 * F.col("tp"), F.col("p") + F.col("n")).alias("f1"))
