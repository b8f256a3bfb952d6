"""Registration, result normalisation and the base relations of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SURVEY: dict[str, str] = {}

KEYS = ["entity"]
START = "2024-01-01"

#: DuckDB: readings r and day bins b, as ``readings`` and ``day_bins`` below.
BASE = """WITH r AS (
  SELECT user_id AS entity, event_id, ts, event_type, value, date_diff('day', TIMESTAMP '2024-01-01', ts) AS bin,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, CAST(props->>'$.k' AS BIGINT) AS k
  FROM events
), b0 AS (
  SELECT entity, bin, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v, count(*) AS n FROM r GROUP BY 1, 2
), b AS (
  SELECT *, max(v) OVER (PARTITION BY entity ORDER BY bin) AS length, row_number() OVER (PARTITION BY entity ORDER BY bin) - 1 AS i FROM b0
)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def normal(df: DataFrame) -> DataFrame:
    """Whole numbers as long, other numbers as double with 9 places."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("long")
        elif kind in ("float", "double") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 9)
        elif kind in ("array<int>",):
            c = c.cast("array<bigint>")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(survey: str, sql: str | None = None, name: str | None = None):
    """Register a function of (spark, directory); sql runs on the same tables in DuckDB."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, d: normal(f(ship(spark), d))
        SURVEY[key] = survey
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def readings(spark: SparkSession, d: str) -> DataFrame:
    """entity, event_id, ts, event_type, value, bin (day), frame (rank in time), k."""
    # named before it is ranked, so that rows lie by entity for all that follows
    e = table(spark, d, "events").withColumnRenamed("user_id", "entity")
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    return e.select(
        "entity", "event_id", "ts", "event_type", "value", F.datediff("ts", F.lit(START)).cast("long").alias("bin"),
        (F.row_number().over(w) - 1).cast("long").alias("frame"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def unranked(spark: SparkSession, d: str) -> DataFrame:
    """readings without the rank in time: no window, no sort."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("entity"), "event_id", "ts", "event_type", "value", F.datediff("ts", F.lit(START)).cast("long").alias("bin"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def day_bins(spark: SparkSession, d: str) -> DataFrame:
    """entity, bin, v (mean), n, length (running maximum), i (rank of the bin)."""
    r = unranked(spark, d)
    b = r.groupBy("entity", "bin").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("v"), F.count("value").alias("n"))
    w = Window.partitionBy("entity").orderBy("bin")
    return b.withColumn("length", F.max("v").over(w)).withColumn("i", (F.row_number().over(w) - 1).cast("long"))


def c(name: str) -> Column:
    return F.col(name)
