"""Interval-censored event times (L, R]: null L is unbounded before, null R is right-censored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_distance(t: Column, lo: Column, hi: Column) -> Column:
    """0 inside (lo, hi]; else the signed distance from the nearer end (t = lo is outside, at distance 0)."""
    return F.when(lo.isNotNull() & (t <= lo), t - lo).when(hi.isNotNull() & (t > hi), t - hi).otherwise(t - t)


def onset_intervals(first_seen: DataFrame, onset: str, start: str, end: str) -> DataFrame:
    """lo and hi of each row: within (onset - 1, onset], at the start (null, start], never by the end (end, null)."""
    at_start = F.col(onset) <= F.col(start)
    lo = F.when(F.col(onset).isNull(), F.col(end)).when(at_start, F.lit(None)).otherwise(F.col(onset) - 1)
    return first_seen.withColumn("lo", lo).withColumn("hi", F.col(onset))


def innermost_intervals(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(q, p] where a left end is directly followed by a right end among all ends in order (right before left at ties)."""
    left = rows.select(*keys, F.coalesce(F.col(lo).cast("double"), F.lit(-1e300)).alias("x"), F.lit(1).alias("side"))
    right = rows.select(*keys, F.coalesce(F.col(hi).cast("double"), F.lit(1e300)).alias("x"), F.lit(0).alias("side"))
    w = Window.partitionBy(*keys).orderBy("x", "side")
    ends = left.union(right).distinct().withColumn("nx", F.lead("x").over(w)).withColumn("ns", F.lead("side").over(w))
    return ends.where("side = 1 AND ns = 0").select(
        *keys, F.when(F.col("x") > -1e300, F.col("x")).alias("q"), F.when(F.col("nx") < 1e300, F.col("nx")).alias("p")
    )


def self_consistent(first: np.ndarray, last: np.ndarray, weight: np.ndarray, n: int, tol: float = 1e-9, most: int = 100_000) -> np.ndarray:
    """Masses of n cells under weighted observations, each known to lie in the cells first..last: the fixpoint at which a
    cell's mass is its expected share of the observations.

    An observation's share of a cell is the cell's mass over the mass of its own range, so a round needs running sums
    alone: of the masses, to weigh ranges, and of what ranges that begin and end at each cell hand out.
    """
    mass = np.full(n, 1 / n)
    for _ in range(most):
        upto = np.concatenate([[0.0], np.cumsum(mass)])
        given = weight / (upto[last + 1] - upto[first])
        edges = np.bincount(first, given, n + 1) - np.bincount(last + 1, given, n + 1)
        new = mass * np.cumsum(edges)[:n] / weight.sum()
        new = np.maximum(new, 0.0) / np.maximum(new, 0.0).sum()
        if np.abs(new - mass).max() < tol:
            return new
        mass = new
    raise RuntimeError(f"masses did not settle in {most} rounds")


def cell_ranges(rows: DataFrame, inner: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """keys, first, last, w: how many rows cover which innermost intervals (numbered by ``i``), equal ranges counted together."""
    counted = rows.groupBy(*keys, F.coalesce(F.col(lo).cast("double"), F.lit(-1e300)).alias("_lo"), F.coalesce(F.col(hi).cast("double"), F.lit(1e300)).alias("_hi")).agg(F.count(F.lit(1)).alias("w"))
    for end, column, before in (("q", "_lo", 1), ("p", "_hi", 0)):  # at equal places a row stands before q and after p
        cells = inner.select(*keys, F.coalesce(end, F.lit(-1e300 if end == "q" else 1e300)).alias("_x"), F.lit(before).alias("_side"), F.lit(1).alias("_one"))
        both = counted.withColumn("_x", F.col(column)).withColumn("_side", F.lit(1 - before)).unionByName(cells, allowMissingColumns=True)
        w = Window.partitionBy(*keys).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
        counted = both.withColumn(f"_n{end}", F.coalesce(F.sum("_one").over(w), F.lit(0))).where("_one IS NULL").drop("_x", "_side", "_one")
    return counted.groupBy(*keys, F.col("_nq").alias("first"), (F.col("_np") - 1).alias("last")).agg(F.sum("w").alias("w"))


def turnbull(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """keys, q, p, mass, cum of the innermost intervals. A group holds the distinct ranges of them that rows cover, and is
    solved in time that grows with their number."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("p"))
    inner = innermost_intervals(rows, keys, lo, hi).withColumn("i", F.row_number().over(order) - 1)
    ranges = cell_ranges(rows, inner, keys, lo, hi).join(inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    kinds = ", ".join(f"`{k}` {ranges.schema[k].dataType.simpleString()}" for k in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        mass = self_consistent(pdf["first"].to_numpy(np.int64), pdf["last"].to_numpy(np.int64), pdf["w"].to_numpy(float), int(pdf["n"].iloc[0]))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "i": np.arange(len(mass)), "mass": mass})

    masses = ranges.groupBy(*keys).applyInPandas(solve, f"{kinds}, i int, mass double")
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return inner.join(masses, [*keys, "i"]).withColumn("cum", F.sum("mass").over(upto)).select(*keys, "q", "p", "mass", "cum")


def kaplan_meier(rows: DataFrame, keys: list[str], at: str, event: str) -> DataFrame:
    """keys, t, at_risk, events, survival at the event times; ``event`` is 0 for censored rows."""
    by_time = rows.groupBy(*keys, F.col(at).alias("t")).agg(F.sum(F.col(event).cast("long")).alias("events"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("t")
    at_risk = F.sum("n").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(0, Window.unboundedFollowing))
    out = by_time.withColumn("at_risk", at_risk)
    # a survivor share of 0 ends the product
    factor = F.sum(F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(-1e3))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("survival", F.when(factor <= -1e3, F.lit(0.0)).otherwise(F.exp(factor))).where("events > 0").select(*keys, "t", "at_risk", "events", "survival")


def t50(masses: DataFrame, keys: list[str], slack: float = 0.0) -> DataFrame:
    """keys, t50: end of the first mass whose running sum reaches a half (less ``slack``), null if that end is unbounded."""
    return masses.groupBy(*keys).agg(F.min(F.when(F.col("cum") >= 0.5 - slack, F.col("p"))).alias("t50"))


def t50_on_grid(masses: DataFrame, keys: list[str], lo: float, hi: float, points: int = 600) -> DataFrame:
    """keys, t50: first of ``points`` even times where the linear distribution function reaches a half."""
    grid = masses.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("t", F.lit(lo) + F.col("i") * ((hi - lo) / (points - 1)))
    part = F.when(F.col("p") <= F.col("t"), F.col("mass")).when(
        (F.col("q") < F.col("t")) & (F.col("p") > F.col("q")), F.col("mass") * (F.col("t") - F.col("q")) / (F.col("p") - F.col("q"))
    )
    share = grid.join(masses.where("p is not null"), keys).groupBy(*keys, "i", "t").agg(F.sum(part).alias("s"))
    return share.groupBy(*keys).agg(F.min(F.when(F.col("s") >= 0.5, F.col("t"))).alias("t50"))
