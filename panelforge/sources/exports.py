"""Exports of whole runs: reviewed curves with units, and a movie's tables as one bundle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reviewed_growth(curves: DataFrame, checks: DataFrame, per_bin: int, um: float | None, seconds: float | None) -> DataFrame:
    """grain, bin, frame, minutes, length_px, length_um, checked_lengths as texts; units that are not known are blank.

    curves: grain, bin, length (corrected); checks: grain, n (lengths that a person checked).
    """
    frame = F.col("bin") * per_bin + per_bin // 2
    blank = F.lit("")
    two = lambda x: F.round(x.cast("decimal(18,6)"), 2).cast("decimal(18,2)").cast("string")
    return curves.join(checks, "grain", "left").select(
        "grain", "bin", frame.alias("frame"), (two(frame * F.lit(seconds) / 60.0) if seconds else blank).alias("minutes"),
        two(F.col("length")).alias("length_px"), (two(F.col("length") * F.lit(um)) if um else blank).alias("length_um"),
        F.coalesce("n", F.lit(0)).alias("checked_lengths"),
    )


def bundle(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], path: str, by: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """by, name, n: rows of each part of each table written under ``path``/name, read back from there.

    A table that cannot be made is an error, unless it is optional: then its error stands in ``error`` and the others are
    written. Tables are CSV, a folder for each value of ``by``.
    """
    told = []
    for name, make in tables.items():
        try:
            df = make()
            df.write.mode("overwrite").option("header", True).partitionBy(by).csv(f"{path}/{name}")
            back = spark.read.option("header", True).csv(f"{path}/{name}")
            told.append(back.groupBy(F.col(by).cast(df.schema[by].dataType).alias(by)).agg(F.count(F.lit(1)).alias("n")).select(by, F.lit(name).alias("name"), "n", F.lit(None).cast("string").alias("error")))
        except Exception as failed:
            if name not in optional:
                raise
            told.append(spark.range(1).select(F.lit(None).cast("long").alias(by), F.lit(name).alias("name"), F.lit(0).cast("long").alias("n"), F.lit(str(failed)[:200]).alias("error")))
    out = told[0]
    for part in told[1:]:
        out = out.unionByName(part)
    return out
