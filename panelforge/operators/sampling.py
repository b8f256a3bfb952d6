"""Orders, caps and reproducible samples; a hash of (id, seed) stands for chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chance(id_: str, seed: int) -> Column:
    """Hex digest that orders rows at random but always alike."""
    return F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.lit(str(seed))))


def stratified_rotation(rows: DataFrame, stratum: str, id_: str, n: int, seed: int) -> DataFrame:
    """n rows, one of each stratum in turn, in random order within it."""
    w = Window.partitionBy(stratum).orderBy(chance(id_, seed), id_)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def capped_mixture(rows: DataFrame, part: str, quotas: dict[str, int], owner: str, cap: int, id_: str, seed: int) -> DataFrame:
    """Up to a quota of rows of each part, at most cap of one owner within a part."""
    by_owner = Window.partitionBy(part, owner).orderBy(chance(id_, seed), id_)
    by_part = Window.partitionBy(part).orderBy(chance(id_, seed), id_)
    few = rows.withColumn("_o", F.row_number().over(by_owner)).where(F.col("_o") <= cap)
    ranked = few.withColumn("_p", F.row_number().over(by_part))
    keep = F.lit(False)
    for name, quota in quotas.items():
        keep = keep | ((F.col(part) == name) & (F.col("_p") <= quota))
    return ranked.where(keep).drop("_o", "_p")


def one_of_each(rows: DataFrame, group: str, id_: str, seed: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(chance(id_, seed), id_)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most cap rows of each key, at even ranks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (cap - 1)).cast("int"))
    return rows.where((F.col("_n") <= cap) | F.array_contains(picks, F.col("_r"))).drop("_r", "_n")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def planned_bins(first: Column, n_bins: Column, early: int = 6, apart: int = 8) -> Column:
    """Bins to ask about: soon after the first, at 40 % and 70 % of the last full bin, and that bin; close ones merge
    into the last of them."""
    last = n_bins - 2
    want = F.array(first + early, F.bround(last * F.lit(0.4)).cast("long"), F.bround(last * F.lit(0.7)).cast("long"), last)
    want = F.array_sort(F.array_distinct(F.filter(want, lambda b: (b >= first + early) & (b <= last))))
    fold = F.aggregate(
        want,
        F.array().cast("array<bigint>"),
        lambda kept, b: F.when(
            (F.size(kept) > 0) & (b - F.element_at(kept, -1) < apart), F.when(b == last, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(b))).otherwise(kept)
        ).otherwise(F.concat(kept, F.array(b))),
    )
    return fold
