"""Streams: answers that arrive as files are appended once each, new keys only, windows and sessions of late events.

Everything is Structured Streaming: offsets and state live in a checkpoint folder that executors share, so a query that is started again goes on where it
stopped, and files that were read are not read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmill.operators import chains


def answer_stream(spark: SparkSession, source: str, archive: str | None = None) -> DataFrame:
    """custom_id, position and content of the JSON lines in the files of a folder, as they come; read files move to ``archive`` if one is named."""
    reader = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1000)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return chains.results(reader.text(source))


def append_to(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to a Parquet folder, each row once, and ends."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_results(spark: SparkSession, source: str, target: str, checkpoint: str, archive: str | None = None) -> None:
    """One round of appending the answers that have come since the last."""
    append_to(answer_stream(spark, source, archive), target, checkpoint).awaitTermination()


def first_of_each(stream: DataFrame, keys: list[str], time: str | None = None, lateness: str = "1 day") -> DataFrame:
    """The first row of each key: of all time, or with ``time`` within that lateness, so state stays bounded."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windows(stream: DataFrame, time: str, length: str, lateness: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of each closed window of event time; rows later than ``lateness`` are dropped, as Spark does."""
    made = stream.withWatermark(time, lateness).groupBy(F.window(time, length).alias("w"), *by).agg(*aggregates)
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in made.columns if c != "w"])


def sessions(stream: DataFrame, time: str, gap: str, lateness: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of each closed session: events of a key with less than ``gap`` between them."""
    made = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggregates)
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in made.columns if c != "w"])
