"""The corpus pipeline: quality rules, language identification, near-duplicate removal, secret redaction, packing.

Every stage takes the documents that the stage before it kept and gives them back with the same columns (the last one gives pieces of sequences); columns it
does not know pass through, whatever their names, unless they begin with two underscores. A table without a column ``lang`` or ``source`` is taken as if it held nulls there. An
empty table gives no rows in any stage. Each stage's result is a Parquet table in the shared folder, from which the next one starts, so
a lost executor repeats tasks of one stage only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import langid, neardup, packing, quality, secrets
from textmill.llm.queries import TOKENIZER, held_out

NEAR_PERCENT = 80
#: No SQL form: classifiers, sketches and a tokenizer take part.
ORACLE_SQL = None


def completed(docs: DataFrame) -> DataFrame:
    """docs with null columns for lang and source where it lacks them."""
    return docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the robust distance of their language and source reject.

    Null and empty texts have no words and go; a null language or source is a group of its own; repeated rows and equal texts of a group stay or go
    together; a text of any length is judged whole.
    """
    return quality.keep_good(completed(docs)).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages, calibrated on held-out rows; the predicted language replaces the label.

    Texts that are null, empty or without a letter go; so do those far below what the texts of their language score. Equal texts get equal languages. Only the columns text and
    lang are read or written. Without a single label (or a column lang) nothing can be learnt, and all documents stay as they are.
    """
    labelled = completed(docs)
    if labelled.where("lang is not null").isEmpty():
        return docs
    model = langid.calibrate(labelled.where(held_out()), langid.fit(labelled.where(~held_out())))
    # the row travels as one value, so no column can clash with those of the prediction
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__said"))
    named = langid.predict(rows, model, text="__said", keep=("__row",)).where(F.col("lang_pred") != langid.UNKNOWN)
    found = F.col("lang_pred")
    return named.select(*[found.cast(docs.schema[c].dataType).alias(c) if c == "lang" else F.col("__row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (NEAR_PERCENT of the distinct five-word shingles): the one of the least doc_id.

    Texts that are null or without words, and rows with a null doc_id, are no one's duplicates and stay. Rows that share a doc_id stay or go together.
    """
    return neardup.without_near_duplicates(docs, percent=NEAR_PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts and brings n_chars up to date. All rows stay; null texts stay null, with a null n_chars."""
    clean = secrets.redact(docs, secrets.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, with their ids. A null or empty text is the one id that ends a document."""
    return packing.pack_documents(docs, TOKENIZER, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("packing", packed)]


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; one of our own only in local mode where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='textmill-')).rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each but the last returns is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
