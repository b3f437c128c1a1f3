"""Fuzzy join with a dictionary: the most similar name, found by shared segments and verified by edit distance.

Names within d edits of a dictionary name that is cut in d + 1 segments hold one segment unchanged, at most d places away. So a
dictionary name is filed under its segments, a value looks up the substrings that could be one, and only pairs that meet are
measured. Work is done once for each distinct value; a segment that very many names share is filed in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as fx

#: Dictionary names under one segment that meet in one task; hot segments (rows of two columns) that are broadcast.
BLOCK, MOST_HOT = 2000, 1_000_000
KEYS = "name string, length int, segment int, piece string, start int"


def most_edits(longer: int, least: float) -> int:
    """The most edits at which names, the longer of ``longer`` characters, can have a similarity of ``least``."""
    return math.floor((1 - least) * longer + 1e-9)


def segments(length: int, least: float) -> list[tuple[int, int]]:
    """(start, end) of the segments of a dictionary name: one more than the edits that any similar name may have."""
    d = most_edits(math.floor(length / least + 1e-9), least)
    parts = min(d + 1, max(length, 1))
    cuts = [length * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def pieces(names: DataFrame, least: float, file: bool) -> DataFrame:
    """KEYS of names: what they are filed under (``file``), or all they may be found by."""

    def filed(name: str) -> Iterator[tuple]:
        for i, (a, b) in enumerate(segments(len(name), least)):
            yield name, len(name), i, name[a:b], a

    def sought(name: str) -> Iterator[tuple]:
        n = len(name)
        for other in range(math.ceil(n * least - 1e-9), math.floor(n / least + 1e-9) + 1):
            d = most_edits(max(n, other), least)
            if abs(n - other) > d:
                continue
            for i, (a, b) in enumerate(segments(other, least)):
                # the segment's place from the start and from the end may each differ by d at most
                for start in range(max(0, a - d, n - other + a - d), min(n - (b - a), a + d, n - other + a + d) + 1):
                    yield name, other, i, name[start : start + b - a], start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = [k for name in batch.column(0).slice(at, 500).to_pylist() for k in (filed if file else sought)(name)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()))], names=["name", "length", "segment", "piece", "start"])

    return names.mapInArrow(run, KEYS)


def candidates(values: DataFrame, names: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(value, name): all pairs of two columns ``name`` that may have a similarity of ``least``, each once."""
    own = ["length", "segment", "piece"]
    filed = pieces(names, least, True).select(F.col("name").alias("known"), *own)
    sought = pieces(values, least, False).select("name", *own).distinct()
    sizes = filed.groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = sizes.select(*own, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    if hot.count() <= MOST_HOT:
        hot = F.broadcast(hot)
    blocks = F.coalesce("blocks", F.lit(1))
    left = filed.join(hot, own, "left").select("known", *own, F.pmod(F.xxhash64("known"), blocks).cast("int").alias("block"))
    right = sought.join(hot, own, "left").select("name", *own, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return left.join(right, [*own, "block"]).select(F.col("name").alias("value"), F.col("known").alias("name")).distinct()


def best_name(df: DataFrame, column: str, names: DataFrame, name: str, least: float = 0.8, out: str = "matched", block: int = BLOCK) -> DataFrame:
    """df with the most similar name of a dictionary, the first by name among equals, or its own if none has a similarity of ``least``.

    Similarity is 1 - edit distance / longer length. Nulls stay null; an empty value is only like an empty name. Neither side has a bound.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie in (0, 1]")
    text = lambda frame, c: frame.select(F.col(c).cast("string").alias("name")).where("name is not null").distinct()
    known, values = text(names, name), text(df, column)
    # a value that is in the dictionary is its own best name
    others = values.join(known, "name", "left_anti")
    pairs = candidates(others, known, least, block).withColumn("s", fx.similarity(F.col("value"), F.col("name"))).where(F.col("s") >= least)
    best = pairs.groupBy("value").agg(F.min_by("name", F.struct(-F.col("s"), F.col("name"))).alias("__best"))
    return df.join(best.withColumnRenamed("value", "__value"), F.col(column) == F.col("__value"), "left").withColumn(out, F.coalesce("__best", F.col(column))).drop("__best", "__value")


def candidate_count(df: DataFrame, column: str, names: DataFrame, name: str, least: float = 0.8) -> int:
    """How many pairs ``best_name`` measures."""
    text = lambda frame, c: frame.select(F.col(c).cast("string").alias("name")).where("name is not null").distinct()
    known, values = text(names, name), text(df, column)
    return candidates(values.join(known, "name", "left_anti"), known, least).count()
