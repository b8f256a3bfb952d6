"""Scans into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schemas of the documents: predictions and labels by entity id.
PREDICTIONS = "schema string, method string, per_bin long, entities array<struct<id: string, status: string, onset: long, frames: array<long>, px: array<double>, flags: array<string>>>"
LABELS = "schema string, labels map<string, struct<verdict: string, last_absent: long, first_visible: long, traces: map<string, struct<state: string, length: double>>>>"


def documents(spark: SparkSession, path: str, schema: str | StructType, tag: str | None = None) -> DataFrame:
    """Whole-document JSON files with an explicit schema; rows of another schema tag are an error, not skipped."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    if tag is not None:
        bad = F.assert_true(F.col("schema") == tag, F.concat(F.lit("unexpected schema tag in "), F.col("file")))
        df = df.withColumn("_ok", bad).where(F.col("_ok").isNull()).drop("_ok")
    return df


def prediction_series(docs: DataFrame) -> DataFrame:
    """One row for each entity and frame of prediction documents."""
    e = docs.select("file", "per_bin", F.explode("entities").alias("e")).select("file", "per_bin", "e.*")
    return e.select("file", "id", "status", "onset", F.expr("inline(arrays_zip(frames, px))")).withColumnsRenamed({"frames": "frame", "px": "length"})


def label_rows(docs: DataFrame) -> DataFrame:
    """One row for each entity and trace of label documents, traces in the order of their number."""
    e = docs.select("file", F.explode("labels").alias("id", "l")).select("file", "id", "l.verdict", "l.last_absent", "l.first_visible", F.explode_outer("l.traces").alias("bin", "t"))
    return e.select("file", "id", "verdict", "last_absent", "first_visible", F.col("bin").cast("long").alias("bin"), "t.state", "t.length")


def csv_series(spark: SparkSession, path: str, key: str, order: str, values: list[str], schema: str) -> DataFrame:
    """CSV rows as one ordered series per key; of repeated (key, order) the first by the other columns stays."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    first = rows.groupBy(key, order).agg(F.min(F.struct(*values)).alias("v"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "v.*"))).alias("series"))


def run_folders(spark: SparkSession, root: str, marker: str) -> DataFrame:
    """Folders under root that hold a file named ``marker``, found by Spark's own listing: folder, size."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", marker).option("recursiveFileLookup", True).load(root)
    return found.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.col("length").alias("size"))


def counted(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, object]:
    """The rows unchanged, and an observation of their number and other aggregates, filled when they have been read."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures), seen
