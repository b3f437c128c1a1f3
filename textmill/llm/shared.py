"""Helpers shared by the operators: Arrow text blocks, shared-folder checkpoints, column bookkeeping."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 19


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the cluster's spark.checkpoint.dir; a folder of our own only where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="textmill-"))
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sample_texts(df: DataFrame, text: str, key: str, bound: int, chars: int) -> list[str]:
    """At most ``bound`` texts, the first by hash of the key (ties by hash of the text), each cut to ``chars`` code points; for fitting only."""
    share = min(1.0, 2 * bound / max(1, df.count()))
    place = F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1_000_000))
    rows = df.select(place.alias("place"), F.xxhash64(text).alias("tie"), F.substring(F.col(text), 1, chars).alias("text"))
    return [r["text"] or "" for r in rows.where(F.col("place") < int(share * 1_000_000 + 1)).orderBy("place", "tie", "text").limit(bound).collect()]


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in one column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, first = np.cumsum(sizes), 0
        while first < len(sizes):
            before = total[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(first, end - first)
            first = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (from 0) and bytes of a text column; null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    if not len(array):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.Array], list]], out: str, text: str, keep: list[str]) -> DataFrame:
    """Adds the columns ``out`` (a DDL string) to ``keep``: make() is called once a task and gives a function from a text column to arrays.

    Columns of ``keep`` whose names clash with ``out`` give way. Rows keep their order and number.
    """
    added = T._parse_datatype_string(out)
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in {f.name.lower() for f in added.fields}]
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for block in text_blocks(batches, len(keep)):
            arrays = f(block.column(len(keep)))
            yield pa.RecordBatch.from_arrays([block.column(i) for i in range(len(keep))] + [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
