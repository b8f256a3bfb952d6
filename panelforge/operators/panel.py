"""Binning, densifying and filling of entity time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_mean(value: Column) -> Column:
    """Mean over a decimal sum, so that it does not depend on the order of rows."""
    return F.sum(value.cast("decimal(18,2)")).cast("double") / F.count(value)


def bin_average(rows: DataFrame, keys: list[str], frame: str, value: str, per_bin: int) -> DataFrame:
    """Mean and count by keys and frame DIV per_bin: one partial and one final aggregation."""
    return rows.groupBy(*keys, F.expr(f"`{frame}` div {per_bin}").alias("bin")).agg(exact_mean(F.col(value)).alias("v"), F.count(value).alias("n"))


def bin_centre(bin_: Column, per_bin: int) -> Column:
    return bin_ * per_bin + per_bin // 2


def densify(rows: DataFrame, keys: list[str], at: str, first: Column, last: Column) -> DataFrame:
    """All integer places from first to last of each key, left-joined with rows (first, last: aggregates)."""
    grid = rows.groupBy(*keys).agg(first.cast("long").alias("a"), last.cast("long").alias("b"))
    grid = grid.select(*keys, F.explode(F.sequence("a", "b")).alias(at))
    return grid.join(rows, [*keys, at], "left")


def empty_bins(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Places between a key's first and last that have no row (anti join with the grid)."""
    grid = rows.groupBy(*keys).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    grid = grid.select(*keys, F.explode(F.sequence("a", "b")).alias(at))
    return grid.join(rows.select(*keys, at), [*keys, at], "left_anti")


def running(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def hold_last(rows: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Last known value carried forward."""
    w = running(keys, [at]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def fill_ends(rows: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Carried forward; places before the first known value take that one."""
    forward = running(keys, [at]).rowsBetween(Window.unboundedPreceding, 0)
    back = running(keys, [at]).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(forward), F.first(value, ignorenulls=True).over(back)))


def linear_fill(rows: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Interior gaps on the line between their neighbours, the tail held; ``filled`` marks what was missing."""
    forward = running(keys, [at]).rowsBetween(Window.unboundedPreceding, 0)
    back = running(keys, [at]).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    both = (
        rows.withColumn("_v0", F.last(value, ignorenulls=True).over(forward))
        .withColumn("_t0", F.last(known, ignorenulls=True).over(forward))
        .withColumn("_v1", F.first(value, ignorenulls=True).over(back))
        .withColumn("_t1", F.first(known, ignorenulls=True).over(back))
    )
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    fill = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(line)
    return both.withColumn(out, fill).withColumn("filled", F.col(value).isNull()).drop("_v0", "_t0", "_v1", "_t1")


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.max(value).over(running(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def running_median(rows: DataFrame, keys: list[str], order: list[str], value: str, half: int, out: str) -> DataFrame:
    """Median of the rows from half before to half after, fewer at the ends."""
    return rows.withColumn(out, F.percentile(value, F.lit(0.5)).over(running(keys, order).rowsBetween(-half, half)))


def replace_outliers(rows: DataFrame, keys: list[str], order: list[str], value: str, half: int, most: float, out: str) -> DataFrame:
    """Values further than ``most`` from the running median become that median."""
    rows = running_median(rows, keys, order, value, half, "_m")
    off = F.abs(F.col(value) - F.col("_m")) > most
    return rows.withColumn("outlier", off).withColumn(out, F.when(off, F.col("_m")).otherwise(F.col(value))).drop("_m")


def jumps(rows: DataFrame, keys: list[str], order: list[str], value: str, most: float) -> DataFrame:
    """Rows whose step from the row before exceeds ``most``."""
    return rows.withColumn("step", F.abs(F.col(value) - F.lag(value).over(running(keys, order)))).where(F.col("step") > most)


def rate_with_breaks(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Change per unit of order; a missing value leaves this rate and the next one null."""
    w = running(keys, [order])
    return rows.withColumn(out, (F.col(value) - F.lag(value).over(w)) / (F.col(order) - F.lag(order).over(w)))


def local_contrast(rows: DataFrame, keys: list[str], order: list[str], value: str, half: int, out: str) -> DataFrame:
    """Value minus the mean around it."""
    return rows.withColumn(out, F.col(value) - F.avg(value).over(running(keys, order).rowsBetween(-half, half)))


def recent_growth(rows: DataFrame, keys: list[str], order: list[str], value: str, k: int, out: str) -> DataFrame:
    """Mean of the last k rows minus the mean of the k before."""
    w = running(keys, order)
    return rows.withColumn(out, F.avg(value).over(w.rowsBetween(1 - k, 0)) - F.avg(value).over(w.rowsBetween(1 - 2 * k, -k)))


def flat_field(rows: DataFrame, keys: list[str], at: str, value: str, out: str, sigma: float = 2.0) -> DataFrame:
    """rows with ``out``: the value over its slow background (a Gaussian mean over rows ``at``, three sigmas wide, 1 at
    least), times the key's median, so that the level stays. ``at`` counts rows without gaps."""
    reach = int(3 * sigma)
    offset = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    near = rows.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_v"), offset.alias("_d"))
    near = near.select(*keys, (F.col("_at") + F.col("_d")).alias(at), "_v", F.exp(-(F.col("_d") * F.col("_d")) / (2.0 * sigma * sigma)).alias("_w"))
    ground = near.groupBy(*keys, at).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_ground"))
    level = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_level"))
    met = rows.join(ground, [*keys, at]).join(level, keys)
    return met.withColumn(out, F.col(value) / F.greatest(F.col("_ground"), F.lit(1.0)) * F.col("_level")).drop("_ground", "_level")
