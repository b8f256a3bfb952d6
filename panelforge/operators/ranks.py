"""Exact order statistics of many values under few keys, without all of a key's values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch errs by less than n / ACCURACY ranks; the bracket round a rank is MARGIN of these wide on both sides.
ACCURACY, MARGIN = 2000, 10


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n, least, and for each name the value at that rank (a column over n, from 0) of the values not null.

    A sketch of bounded size brackets each rank by two values; what lies below is counted, and only the distinct values
    inside the bracket, a few per cent of the rows, are put in order. So one partial aggregation bounds what a key sends.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL")
    count = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("least"), F.percentile_approx("_x", [k / ACCURACY for k in range(ACCURACY + 1)], 4 * ACCURACY).alias("_q"))
    out = count.select(*keys, "n", "least")
    for name, rank in ranks.items():
        place = F.floor(ACCURACY * (rank / F.greatest(F.col("n") - 1, F.lit(1)))).cast("int")
        edge = lambda k: F.element_at("_q", F.least(F.greatest(k, F.lit(0)), F.lit(ACCURACY)) + 1)
        low = F.when(place <= MARGIN, F.col("least")).otherwise(edge(place - MARGIN))
        high = F.when(place + MARGIN >= ACCURACY, F.lit(float("inf"))).otherwise(edge(place + MARGIN))
        want = count.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], rank.cast("long").alias("_rank"), low.alias("_low"), high.alias("_high"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        at = x.join(want, same).where("_x <= _high")
        inside = F.when(F.col("_x") >= F.col("_low"), F.col("_x"))  # null: below the bracket, counted only
        cells = at.groupBy(*keys, "_rank", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        found = cells.withColumn("_upto", upto).where("_v IS NOT NULL AND _upto > _rank").groupBy(*keys).agg(F.min("_v").alias(name))
        right = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
        out = out.join(right, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out


def at_share(df: DataFrame, keys: list[str], value: str, weight: str, share: float, name: str, cells: int = 1024) -> DataFrame:
    """keys, n, least, and the value at rank floor((n - 1) * share) of values that each stand ``weight`` times (n in all).

    Values are counted in cells of equal width between the least and the largest; only the distinct ones of the cell that
    holds the rank are put in order.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("_x"), F.col(weight).cast("long").alias("_w"))
    span = x.groupBy(*keys).agg(F.sum("_w").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("_most"))
    span = span.withColumn("_rank", F.floor((F.col("n") - 1) * share))
    cell = F.when(F.col("_most") > F.col("least"), F.floor((F.col("_x") - F.col("least")) / (F.col("_most") - F.col("least")) * (cells - 1))).otherwise(F.lit(0).cast("long"))
    x = x.join(span, keys).withColumn("_c", cell)
    upto = lambda by: F.sum("_w").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    counted = x.groupBy(*keys, "n", "least", "_rank", "_c").agg(F.sum("_w").alias("_w")).withColumn("_upto", upto("_c"))
    at = counted.where("_upto > _rank AND _upto - _w <= _rank").select(*keys, "_c", (F.col("_upto") - F.col("_w")).alias("_below"))
    inside = x.join(at, [*keys, "_c"]).groupBy(*keys, "n", "least", "_rank", "_below", "_x").agg(F.sum("_w").alias("_w"))
    return inside.withColumn("_upto", F.col("_below") + upto("_x")).where("_upto > _rank").groupBy(*keys, "n", "least").agg(F.min("_x").alias(name))


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, n, the mean of the two middle values."""
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    both = at_ranks(df, keys, value, {"_lo": low, "_hi": high})
    return both.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))
