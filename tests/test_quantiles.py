"""Exact quantiles by selection against the sorted values."""

import math
import random

import duckdb
import pytest

from textmill.operators import sampling
from textmill.operators.quantiles import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]


def plain(values, share):
    held = sorted(v for v in values if v is not None and math.isfinite(v))
    if not held:
        return None
    place = share * (len(held) - 1)
    low = math.floor(place)
    return held[low] + (held[min(low + 1, len(held) - 1)] - held[low]) * (place - low)


RNG = random.Random(5)
CASES = {
    "spread": [RNG.gauss(0, 1) for _ in range(3000)],
    "ties": [RNG.choice([1.0, 1.0, 1.0, 2.0, 7.5]) for _ in range(3000)],
    "one value": [4.0] * 500,
    "extremes": [1.7e308, -1.7e308, 5e-324] + [RNG.random() for _ in range(2000)],
    "close": [1.0 + i * 2**-52 for i in range(2000)],
    "odd": [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 3.0] * 20,
    "empty": [],
    "nulls": [None] * 5,
    "heavy tail": [10 ** RNG.uniform(-200, 200) for _ in range(2000)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("few", [0, 50])
def test_quantiles(spark, name, few):
    values = CASES[name]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    assert quantiles(df, "v", SHARES, cells=64, few=few) == [plain(values, s) for s in SHARES]


def test_same_as_duckdb(spark):
    path = "/root/testdata/sf0.01/lineitem.parquet"
    df = spark.read.parquet(path)
    for column in ("l_extendedprice", "l_quantity"):
        want = duckdb.sql(f"select quantile_cont({column}::double, {SHARES}) from '{path}'").fetchall()[0][0]
        assert quantiles(df, column, SHARES) == pytest.approx(want, rel=1e-12)


def test_no_buffer_of_all_values(spark):
    """The plans that use quantiles have no percentile function, which merges all distinct values in one buffer."""
    df = spark.range(5000).selectExpr("id", "id * 7 % 1000 as v", "id % 10 as w")
    plans = [sampling.quantile_bins(df, "v"), sampling.percentile_counts(df, "v"), sampling.stage(df, "v", "id", 0.3), sampling.scaled_difficulty(df, {"v": 0.6, "w": 0.4})]
    for made in plans:
        assert "percentile(" not in made._jdf.queryExecution().toString()
    assert {r["bin"]: r["count"] for r in plans[0].groupBy("bin").count().collect()} == {0: 1250, 1: 1250, 2: 1250, 3: 1250}
    assert plans[1].orderBy("percent").select("n").collect()[-1][0] == 5000
    assert sampling.percentile_counts(df.where("false"), "v").count() == 0 and sampling.quantile_bins(df.where("false"), "v").count() == 0
