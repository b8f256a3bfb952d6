"""Sinks: tables by convention, exports, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of the session."""
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def bins(df: DataFrame, path: str, partitions: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """Header and rows, one file for each partition of df."""
    df.write.mode("overwrite").option("header", True).csv(path)


def prediction_documents(series: DataFrame, path: str, method: str, per_bin: int, parts: Column) -> None:
    """Prediction documents, one for each value of ``parts``: entities with their ordered series."""
    e = series.withColumn("_part", parts).groupBy("_part", "id", "status", "onset").agg(F.array_sort(F.collect_list(F.struct("frame", "length"))).alias("s"))
    e = e.select("_part", F.struct("id", "status", "onset", F.col("s.frame").alias("frames"), F.col("s.length").alias("px"), F.array().cast("array<string>").alias("flags")).alias("e"))
    docs = e.groupBy("_part").agg(F.collect_list("e").alias("entities")).select(F.lit("pred.v1").alias("schema"), F.lit(method).alias("method"), F.lit(per_bin).alias("per_bin"), "entities")
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)  # a document is a file


def export_rows(df: DataFrame, words: dict[str, str], calibrated: bool) -> DataFrame:
    """Entity export: status words by lookup, blanks for null, flags joined, unit columns only if calibrated."""
    lookup = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    cols = [
        F.col("id"), F.coalesce(lookup[F.col("status")], F.col("status")).alias("status"), F.coalesce(F.col("onset").cast("string"), F.lit("")).alias("onset"),
        F.array_join("flags", ";").alias("flags"), F.format_string("%.2f", "px").alias("px"),
    ]
    if calibrated:
        cols.append(F.format_string("%.2f", F.col("px") * F.col("um")).alias("um"))
    return df.select(*cols)


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """place, line: a markdown table of a small report, rows in the order of its first column."""
    cell = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    body = df.select(F.col(columns[0]).cast("string").alias("place"), F.concat(F.lit("| "), cell, F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([("", "| " + " | ".join(columns) + " |"), (" ", "|" + " --- |" * len(columns))], "place string, line string")
    return head.unionByName(body)
