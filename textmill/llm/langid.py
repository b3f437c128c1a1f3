"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts with Spark; the smoothed log-probability matrix (buckets x languages) goes to the workers as a
broadcast variable, in blocks of at most BLOCK languages, one pass a block. Scoring multiplies each block's sparse matrix of n-gram occurrences with it in numpy.

A calibrated model also tells texts that are in none of its languages: the mean log-probability of their n-grams under the best
language is more than ``MARGIN`` below the median of held-out texts of that language. In sf0.1 the held-out text
labelled as good that lies lowest is 1.3 below; gibberish, shuffled letters and other languages lie 2.3 to 9 below.

Defined results: a text that is null, has no letter or is told to be in no language is ``und`` with score 0; equal texts get equal answers, and whole texts count, however long; ties go
to the first language by name; every label is a language, however many there are; without training rows every text is ``und``; an empty table gives no rows; columns to keep whose names
clash with those of the result give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import cut_lineage, map_text, text_blocks

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages of a matrix that is broadcast (of 128 kB each).
BLOCK = 256
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
MARGIN = 2.0


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the lower-cased texts, which never cross a text, and the text that each is from."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    found, owner = [], []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in ORDERS:
            inside = doc[:m] == doc[n - 1 :]
            mixed = h ^ (h >> np.uint32(15))
            mixed = mixed * np.uint32(0x2C1B3C6D)
            found.append(((mixed >> np.uint32(17)) & np.uint32(BUCKETS - 1))[inside])
            owner.append(doc[:m][inside])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owner)


class NaiveBayes:
    """log_prob: float32 matrix, a row a bucket, a column a language. least: the mean log-probability that a text of each language has."""

    def __init__(self, languages: list[str], log_prob: np.ndarray) -> None:
        self.languages, self.log_prob = languages, log_prob
        self.least = np.full(len(languages), -np.inf)


def fit(df: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5, block: int = BLOCK) -> NaiveBayes:
    """Learns from all rows with text and label."""
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("lang"))
    languages = sorted(r["lang"] for r in df.where(F.col(label).isNotNull()).select(F.col(label).alias("lang")).distinct().collect())
    parts = [counted(rows, languages[i : i + block]) for i in range(0, len(languages), block)]
    counts = np.concatenate([np.zeros((0, BUCKETS)), *parts]) + smoothing
    log_prob = np.log(counts) - np.log(counts.sum(1, keepdims=True))
    return NaiveBayes(languages, np.ascontiguousarray(log_prob.T.astype(np.float32)))


def counted(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """How often each bucket occurs in the texts of each language."""
    own = rows.where(F.col("lang").isin(languages))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        index = {lang: i for i, lang in enumerate(languages)}
        for block in text_blocks(batches, 0):
            bucket, doc = grams(block.column(0).to_pylist())
            lang = np.array([index[x] for x in block.column(1).to_pylist()], np.int64)
            total += np.bincount(lang[doc] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    cells = own.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy()
    return counts.reshape(len(languages), BUCKETS)


def scored(df: DataFrame, model: NaiveBayes, text: str, keep: list[str], block: int = BLOCK) -> DataFrame:
    """keep and __best (a place among the languages), __top (its log-probability), __total (of all languages, relative to it), __grams, __letter.

    A pass scores the languages of one block; passes are joined row by row, so no task holds more than a block of the matrix.
    """
    made = None
    starts = range(0, max(1, len(model.languages)), block)
    for low in starts:
        shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.log_prob[:, low : low + block].T))

        def make(shared=shared, low=low):
            columns = shared.value

            def run(column: pa.Array) -> list:
                texts = [t or "" for t in column.to_pylist()]
                bucket, doc = grams(texts)
                log = np.stack([np.bincount(doc, c[bucket], len(texts)) for c in columns], 1) if len(columns) else np.zeros((len(texts), 1))
                best, top = log.argmax(1), log.max(1)
                letter = np.array([bool(LETTER.search(t)) for t in texts], bool)
                return [best + low, top.astype(np.float64), np.exp(log - top[:, None]).sum(1), np.bincount(doc, minlength=len(texts)), letter]

            return run

        new = ["__best", "__top", "__total", "__grams", "__letter"]
        if made is None:
            rows = df.withColumn("__said", F.col(f"`{text}`").cast("string")) if len(starts) > 1 else df
            made = map_text(rows, make, "__best long, __top double, __total double, __grams long, __letter boolean", text, keep + ["__said"] * (len(starts) > 1))
            continue
        more = map_text(cut_lineage(made), make, "__b2 long, __t2 double, __s2 double, __g2 long, __l2 boolean", "__said", [*keep, "__said", *new])
        ahead = F.col("__t2") > F.col("__top")
        top = F.greatest("__t2", "__top")
        total = F.col("__total") * F.exp(F.col("__top") - top) + F.col("__s2") * F.exp(F.col("__t2") - top)
        made = more.withColumns({"__best": F.when(ahead, F.col("__b2")).otherwise(F.col("__best")), "__top": top, "__total": total}).drop("__b2", "__t2", "__s2", "__g2", "__l2")
    return made


def calibrate(df: DataFrame, model: NaiveBayes, text: str = "text", margin: float = MARGIN, block: int = BLOCK) -> NaiveBayes:
    """Sets the model's ``least`` from held-out rows; a language without any takes the lowest of the others, and without rows none is set."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))
    if not model.languages or rows.isEmpty():
        return model
    mean = F.col("__top") / F.greatest("__grams", F.lit(1))
    told = scored(rows, model, "text", [], block).where("__letter").select(F.col("__best").alias("best"), F.round(mean, 3).alias("mean"))
    # rounded means are few, so a group's buffer is of a bounded size
    found = told.groupBy("best").agg(F.percentile("mean", F.lit(0.5)).alias("middle")).collect()
    if found:
        model.least[:] = min(r["middle"] for r in found) - margin
        for r in found:
            model.least[r["best"]] = r["middle"] - margin
    return model


def predict(df: DataFrame, model: NaiveBayes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """``keep`` and lang_pred, score (the posterior of that language under equal priors)."""
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in ("lang_pred", "score")]
    made = scored(df, model, text, kept, block)
    own = [F.col(f"`{c}`") for c in kept]
    if not model.languages:
        return made.select(*own, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("__best") + 1).cast("int"))
    known = F.col("__letter")
    if np.isfinite(model.least).any():
        known = known & (F.col("__top") / F.greatest("__grams", F.lit(1)) >= pick(model.least.tolist()))
    return made.select(*own, F.when(known, pick(model.languages)).when(~known, UNKNOWN).alias("lang_pred"), F.when(known, 1 / F.col("__total")).when(~known, 0.0).alias("score"))
