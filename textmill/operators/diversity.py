"""Corpus diversity, verbosity and readability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from textmill.functions import grams
from textmill.functions import text as fx
from textmill.operators.lineage import cut


def ranked(df: DataFrame, by: list[str], key: str, width: int = 4096, name: str = "rank") -> DataFrame:
    """df with its rank (from 1) by an integer key within each group, without sorting a group in one task.

    Keys fall into ranges of ``width``; ranks inside a range and the sizes of the ranges before it add up.
    Keys must be unique within a group, or ties are ranked in any order.
    """
    dealt = df.withColumn("__range", F.floor(F.col(key) / width))
    sizes = dealt.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*by, "__range", before.alias("__before"))
    inner = F.row_number().over(W.partitionBy(*by, "__range").orderBy(key))
    joined = dealt.withColumn("__inner", inner).join(starts, [*by, "__range"])
    return joined.withColumn(name, F.col("__before") + F.col("__inner")).drop("__range", "__inner", "__before")


def ngram_kinds(df: DataFrame, group: str, key: str, text: str, longest: int = 3) -> DataFrame:
    """(group, n, kinds, total): different and all n-grams of up to ``longest`` tokens, by their hashes, of the texts of a group joined in order of the key; n-grams may cross texts.

    Tokens are found in the bytes of texts, which stay where they are. A worker puts the n-grams of a block of texts in sets, and sets are shuffled by parts, in seven bytes a gram. N-grams
    that cross texts lie in the last tokens of one and the first of those that follow: only these are put in order. ``longest`` is 2 at least. Keys are unique; a null key is the last.
    """
    most = longest - 1
    name, place = F.col(group).alias("__name"), F.coalesce(F.col(key), F.lit((1 << 63) - 1)).alias("__key")
    valid = F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("__text")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, offsets, data in grams.text_blocks(grams.lowered(batches, 2), 2):
            row, start, end = grams.token_runs(offsets, data)
            size = np.bincount(row, minlength=block.num_rows)
            full, last = np.flatnonzero(size), np.cumsum(size)
            few = np.minimum(size, most)[full]
            lists = []
            for first in ((last - size)[full], last[full] - few):
                to = np.cumsum(few)
                at = np.repeat(first - (to - few), few) + np.arange(few.sum())
                hashes = grams.word_hashes(data, start[at], end[at]).view(np.int64)
                lists.append(pa.ListArray.from_arrays(np.append(0, to).astype(np.int32), pa.array(hashes)))
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(full)), block.column(1).take(pa.array(full)), *lists], names=["__name", "__key", "__head", "__tail"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for block, offsets, data in grams.text_blocks(grams.lowered(batches, 1), 1):
            row, start, end = grams.token_runs(offsets, data)
            yield block.column(0), np.bincount(row, minlength=block.num_rows), grams.word_hashes(data, start, end), None

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for block in batches:
            size = np.asarray(block.column(1).value_lengths(), np.int64)
            yield block.column(0), size, np.asarray(block.column(1).flatten()).view(np.uint64), size - block.column(2).to_numpy()

    fields = lambda rest: T.StructType([T.StructField("__name", df.schema[group].dataType), *T._parse_datatype_string(rest).fields])
    edges = df.select(name, place, valid).mapInArrow(ends, fields("__key long, __head array<long>, __tail array<long>"))
    # null groups are groups too: structs that hold null are equal
    heads = cut(ranked(cut(edges.select(F.struct("__name").alias("__g"), "__key", "__head", "__tail")), ["__g"], "__key", name="__r"))
    later = lambda i: heads.select("__g", (F.col("__r") - i).alias("__r"), F.col("__head").alias(f"__h{i}"))
    none, follow = F.array().cast("array<long>"), heads
    for i in range(1, most + 1):
        follow = follow.join(later(i), ["__g", "__r"], "left")
    after = F.slice(F.concat(*[F.coalesce(f"__h{i}", none) for i in range(1, most + 1)]), 1, most).alias("__after")
    seams = follow.select("__g.__name", "__tail", after).where(F.size("__after") > 0).select("__name", F.concat("__tail", "__after").alias("__t"), F.size("__after").alias("__extra"))

    rows = fields("n int, part int, total long, grams binary")
    made = df.select(name, valid).mapInArrow(lambda batches: grams.sets(inside(batches), longest), rows)
    made = made.union(seams.mapInArrow(lambda batches: grams.sets(across(batches), longest), rows))
    dealt = made.repartition("__name", "n", "part").sortWithinPartitions("__name", "n", "part")
    sizes = dealt.mapInArrow(grams.set_sizes, fields("n int, kinds long, total long"))
    return sizes.groupBy(F.col("__name").alias(group), "n").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total"))


def distinct_ratios(df: DataFrame, group: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """tokens, distinct_1, distinct_2, distinct_3 and their mean for each group; not a number where a group has no n-gram, as in SQL."""
    by_n = ngram_kinds(df, group, key, text)
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    share = lambda n: F.coalesce(F.try_divide(pick(n, "kinds").cast("double"), pick(n, "total")), F.lit(float("nan"))).alias(f"distinct_{n}")
    wide = by_n.groupBy(group).agg(pick(1, "total").alias("tokens"), *[share(n) for n in (1, 2, 3)])
    return wide.withColumn("mean_ratio", (F.col("distinct_1") + F.col("distinct_2") + F.col("distinct_3")) / 3)


def verbosity(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Words and sentences a document, words a sentence (a ratio of totals)."""
    counts = df.select(*by, F.size(fx.words(text)).alias("w"), F.size(fx.sentences(text)).alias("s"))
    made = counts.groupBy(*by).agg(F.count("*").alias("docs"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    return made.select(*by, "docs", fx.ratio(F.col("w"), F.col("docs")).alias("words_per_doc"), fx.ratio(F.col("s"), F.col("docs")).alias("sentences_per_doc"), fx.ratio(F.col("w"), F.col("s")).alias("words_per_sentence"))


def reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch reading ease of totals."""
    return 206.835 - 1.015 * fx.ratio(words, sentences) - 84.6 * fx.ratio(syllables, words)


def mean_pairwise_cosine(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """n and 1 - mean cosine of all pairs, from the sum of unit vectors, without pairs; 0 for fewer than two rows."""
    norm = F.sqrt(fx.dot(F.col(vector), F.col(vector)))
    unit = F.transform(vector, lambda x: x.cast("double"))
    cells = df.select(*by, F.posexplode(unit).alias("i", "x"), norm.alias("norm")).select(*by, "i", (F.col("x") / F.col("norm")).alias("x"))
    sums = cells.groupBy(*by, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    mean = (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return total.select(*by, "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(1 - mean).alias("diversity"))


def mean_pairwise_difference(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n and the mean of |x - y| over all pairs, by distinct values and running counts; 0 for fewer than two rows."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    before = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    less = counts.withColumn("n0", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("s0", F.coalesce(F.sum(F.col("c") * F.col(value)).over(before), F.lit(0)))
    total = less.groupBy(*by).agg(F.sum(F.col("c") * (F.col("n0") * F.col(value) - F.col("s0"))).alias("d"), F.sum("c").alias("n"))
    return total.select(*by, "n", fx.ratio(F.col("d"), F.col("n") * (F.col("n") - 1) / 2).alias("distance"))
