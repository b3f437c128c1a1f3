"""Queries on sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.lineage import new_folder
from textmill.plans.registry import query
from textmill.sources.sheets import SheetSource
from textmill.sources.tables import table


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal::DOUBLE), 2) AS total FROM customer GROUP BY 1")
def sheet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as spreadsheets, a workbook a task, and added up from what is read again, by ranges of rows."""
    spark.dataSource.register(SheetSource)
    path = new_folder(spark, "customers") + ".xlsx"
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    customers.write.format("sheets").mode("append").save(path)
    rows = spark.read.schema(customers.schema).format("sheets").option("range_rows", 20_000).load(path)
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
