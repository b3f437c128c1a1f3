"""Readers: the driver's tables, JSON, JSON lines, CSV and text files by suffix, and guarded projections."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly to a few tasks a core, for costly work on short rows: a small file is one task otherwise."""
    session = df.sparkSession
    return df.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """.json (one array or object a file), .jsonl, .csv (with header and quoted line breaks), .parquet or .txt, by suffix."""
    reader = spark.read.schema(schema) if schema else spark.read
    suffix = path.rstrip("/*").rpartition(".")[2].lower()
    if suffix == "json":
        return reader.option("multiLine", True).json(path)
    if suffix in ("jsonl", "ndjson"):
        return reader.json(path)
    if suffix == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix == "txt":
        return reader.text(path)
    raise ValueError(f"no reader for .{suffix}")


def write_any(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of .json, .jsonl, .csv, .parquet or .txt files, by suffix of its name."""
    suffix = path.rpartition(".")[2].lower()
    writer = df.write.mode(mode)
    if suffix in ("json", "jsonl"):
        writer.json(path)
    elif suffix == "csv":
        writer.csv(path, header=True, escape='"')
    elif suffix == "parquet":
        writer.parquet(path)
    elif suffix == "txt":
        writer.text(path)
    else:
        raise ValueError(f"no writer for .{suffix}")


def read_files(spark: SparkSession, paths: list[str], schema: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the rows of many JSON, JSON-lines or CSV files with the ``file`` they come from, and the files that could not be read, or not whole.

    A file that is malformed does not end the job: rows that parse stay, and ``bad`` tells (file, reason, records) of files with rows that do not, and of files without any row. Paths
    may be patterns; files of any of the three suffixes may lie among them, others are left out. ValueError if fewer than ``least`` files can be read.
    """
    kinds = {"json": ("json", {"multiLine": True}), "jsonl": ("json", {}), "csv": ("csv", {"header": True, "multiLine": True, "escape": '"', "enforceSchema": True})}
    listed = spark.read.text(paths).inputFiles()
    parts = []
    for suffix, (kind, options) in kinds.items():
        own = [unquote(x) for x in listed if x.lower().endswith(f".{suffix}")]
        if own:
            made = spark.read.schema(f"{schema}, __bad string").options(columnNameOfCorruptRecord="__bad", **options).format(kind).load(own)
            parts.append(made.withColumn("file", F.col("_metadata.file_path")))
    if not parts:
        raise ValueError("no file to read")
    every = cut(union_all(parts))
    rows = every.where("__bad is null").drop("__bad")
    malformed = every.where("__bad is not null").groupBy("file").agg(F.lit("malformed").alias("reason"), F.count("*").alias("records"))
    names = spark.createDataFrame([(x,) for x in listed if x.lower().rpartition(".")[2] in kinds], "path string")
    # both listings name a file by its last part and its folder; schemes differ between them
    tail = lambda c: F.regexp_extract(F.try_url_decode(c), r"([^/]*/[^/]*)$", 1)
    seen = every.select(tail(F.col("file")).alias("tail")).distinct()
    empty = names.withColumn("tail", tail(F.col("path"))).join(seen, "tail", "left_anti").select(F.col("path").alias("file"), F.lit("empty").alias("reason"), F.lit(0).cast("long").alias("records"))
    bad = malformed.unionByName(empty)
    if rows.select("file").distinct().count() < least:
        raise ValueError(f"fewer than {least} files can be read")
    return rows, bad


def by_file(rows: DataFrame, values: list[str], file: str = "file") -> DataFrame:
    """(file, n, <value>_avg, <value>_std): a row a file, with the sample standard deviation."""
    stats = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("avg", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy(file).agg(F.count("*").alias("n"), *stats)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``names`` that df has, renamed."""
    return df.select([F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns])


def non_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(F.col(column)) != "")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (all if fewer), the same ones each time: those first by md5 of key and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key), F.lit(seed)).cast("binary")), key).limit(n)
