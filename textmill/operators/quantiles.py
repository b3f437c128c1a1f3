"""Exact quantiles by selection: ranges are counted, then the one that holds a rank is cut again.

No task ever holds the distinct values of a column. A pass counts the values of each open range in CELLS equal cells (a row a
cell and task reaches the shuffle), with the least and the largest value that occurs there; a rank's range becomes the
cell that holds it. It is found when all values of the cell are equal, or when so few rows are left that they are read and sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a range and pass; rows of a range that are read instead of being cut again.
CELLS, FEW = 4096, 1000


def finite(value: str) -> Column:
    """The value as a double; nulls, NaN and infinities are null and don't count."""
    x = F.col(value).cast("double")
    return F.when(F.abs(x) < F.lit(math.inf), x)


def quantiles(df: DataFrame, value: str, shares: list[float], cells: int = CELLS, few: int = FEW) -> list[float | None]:
    """The exact continuous quantiles of a column (linear between neighbours); None for each where there is no value.

    The passes are as many as the ranges need: about log(n) / log(cells) for values without extremes, never more than the bits of a double.
    """
    rows = df.select(finite(value).alias("x")).where("x is not null")
    facts = rows.agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).first()
    if not facts["n"]:
        return [None] * len(shares)
    places = [s * (facts["n"] - 1) for s in shares]
    wanted = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found: dict[int, float] = {}
    # an open range: (least, most) -> (rows before it, rows in it, the ranks sought there)
    spans = {(facts["least"], facts["most"]): (0, facts["n"], wanted)}
    while spans:
        small = {s: v for s, v in spans.items() if v[1] <= few and s[0] < s[1]}
        for (low, high), (before, _, ranks) in small.items():
            held = sorted(r.x for r in rows.where(F.col("x").between(low, high)).collect())
            found |= {r: held[r - before] for r in ranks}
        for (low, high), (_, _, ranks) in spans.items():
            if low == high:
                found |= dict.fromkeys(ranks, low)
        spans = cut(rows, {s: v for s, v in spans.items() if s not in small and s[0] < s[1]}, cells)
    low, part = [math.floor(p) for p in places], [p - math.floor(p) for p in places]
    return [found[i] if not f else found[i] + (found[i + 1] - found[i]) * f for i, f in zip(low, part)]


def cut(rows: DataFrame, spans: dict, cells: int) -> dict:
    """The cells of the open ranges that hold sought ranks, as open ranges."""
    if not spans:
        return {}
    names = list(spans)
    x = F.col("x")

    def cell(low: float, high: float) -> Column:
        # halves, so that the width of a range is finite
        return F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * cells), F.lit(cells - 1)).cast("int")

    marks = [F.when(x.between(low, high), F.struct(F.lit(i).alias("span"), cell(low, high).alias("cell"))) for i, (low, high) in enumerate(names)]
    counted = rows.select("x", F.inline(F.filter(F.array(*marks), lambda m: m.isNotNull()))).groupBy("span", "cell")
    made = counted.agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).collect()
    out = {}
    for i, name in enumerate(names):
        before, _, ranks = spans[name]
        for r in sorted((r for r in made if r["span"] == i), key=lambda r: r["cell"]):
            held = [k for k in ranks if before <= k < before + r["n"]]
            if held:
                out[r["least"], r["most"]] = (before, r["n"], held)
            before += r["n"]
    return out
