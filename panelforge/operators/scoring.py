"""Scores of predictions against answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, human: str, model: str) -> DataFrame:
    """Counts by (answer, prediction or 'missing')."""
    return rows.groupBy(F.col(human).alias("human"), F.coalesce(F.col(model).cast("string"), F.lit("missing")).alias("model")).agg(F.count(F.lit(1)).alias("n"))


def within_tolerance(error: Column, truth: Column, absolute: float, relative: float) -> Column:
    return F.abs(error) <= F.greatest(F.lit(absolute), F.abs(truth) * relative)


def score_report(rows: DataFrame, keys: list[str], truth: str, guess: str, absolute: float, relative: float) -> DataFrame:
    """Hits, counts, median and mean absolute error, bias by key; early and late count errors beyond the tolerance."""
    rows = rows.withColumn("_e", F.col(guess) - F.col(truth))
    hit = within_tolerance(F.col("_e"), F.col(truth), absolute, relative)
    return rows.groupBy(*keys).agg(
        F.count("_e").alias("n"),
        F.count_if(hit).alias("hits"),
        F.percentile(F.abs("_e"), F.lit(0.5)).alias("median_error"),
        F.avg(F.abs("_e")).alias("mean_error"),
        F.avg("_e").alias("bias"),
        F.count_if(~hit & (F.col("_e") < 0)).alias("early"),
        F.count_if(~hit & (F.col("_e") > 0)).alias("late"),
    )


def growth_rate_10_90(rows: DataFrame, keys: list[str], at: str, value: str, least: float) -> DataFrame:
    """keys, rate between the first places at 10 % and 90 % of the final value; null if that is small or they coincide."""
    final = rows.groupBy(*keys).agg(F.max_by(value, at).alias("final"))
    both = rows.join(final, keys)
    first = both.groupBy(*keys, "final").agg(
        F.min_by(F.struct(at, value), F.when(F.col(value) >= 0.1 * F.col("final"), F.col(at))).alias("a"),
        F.min_by(F.struct(at, value), F.when(F.col(value) >= 0.9 * F.col("final"), F.col(at))).alias("b"),
    )
    ok = (F.col("final") >= least) & (F.col(f"b.{at}") > F.col(f"a.{at}"))
    return first.select(*keys, F.when(ok, (F.col(f"b.{value}") - F.col(f"a.{value}")) / (F.col(f"b.{at}") - F.col(f"a.{at}"))).alias("rate"))


def slopes(rows: DataFrame, keys: list[str], x: str, y: str, least_rows: int, least_span: int) -> DataFrame:
    """Least-squares slope by key, of keys with enough rows over enough span."""
    out = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("n"), (F.max(x) - F.min(x)).alias("span"))
    return out.where((F.col("n") >= least_rows) & (F.col("span") >= least_span))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank of a value within its keys, ties sharing their mean rank."""
    same = Window.partitionBy(*keys, value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2


def rank_correlation(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman and Pearson by key; null below three rows."""
    rows = rows.withColumn("_rx", average_rank(x, keys)).withColumn("_ry", average_rank(y, keys))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("n"), F.when(n >= 3, F.corr("_rx", "_ry")).alias("spearman"), F.when(n >= 3, F.corr(x, y)).alias("pearson"))


def robust_sigma(rows: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """keys, median, 1.4826 times the median distance from it, ``floor`` at least."""
    centre = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    both = rows.join(centre, keys)
    return both.groupBy(*keys, "median").agg(F.greatest(1.4826 * F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)), F.lit(floor)).alias("sigma"))


def bootstrap_interval(pairs: DataFrame, keys: list[str], value: str, draws: int, seed: int) -> DataFrame:
    """keys, mean, lo, hi of the mean under resampling with Poisson weights drawn by hash, one partial sum per draw."""
    draw = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.pmod(F.xxhash64(*keys, value, "row", "draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, edge, total = F.lit(0), 0.0, 1.0
    for k in range(1, 7):
        edge += 0.36787944117144233 / total
        total *= k
        weight = weight + (u >= edge).cast("int")
    sums = draw.withColumn("_w", weight).groupBy(*keys, "draw").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("m"))
    interval = sums.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return pairs.groupBy(*keys).agg(F.avg(value).alias("mean")).join(interval, keys)


def overlapping_groups(rows: DataFrame, groups: dict[str, Column], value: str) -> DataFrame:
    """Count and mean by named conditions, which may overlap; one pass."""
    named = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()])))
    return rows.withColumn("grp", named).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
