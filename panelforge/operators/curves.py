"""A measured curve drawn through points that were checked by hand, in windows over each entity's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def through_checks(rows: DataFrame, keys: list[str], at: str, curve: str, check: str, first: str, reach: int, still: float = 0.5) -> DataFrame:
    """keys, at and the curve, moved so that it passes through the values of ``check`` (null where nothing was checked).

    Places before ``first`` are 0 (all of them, where it is null), and the result never falls. A check's error counts in full at
    its place; it grows to that over the ``reach`` places before and is gone after as many. If the curve was short by more
    than 2 and more than a tenth, and had been level (within ``still``) for longer, it grows from where the curve went level.
    Neither growth nor decay crosses another check, and between two checks the result keeps between their values.
    """
    along = Window.partitionBy(*keys).orderBy(at)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    earlier, onward = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(0, Window.unboundedFollowing)
    names = ", ".join(f"`{k}`" for k in keys)  # a frame of fractions has no form outside of SQL
    level_from = F.expr(f"min(`{at}`) OVER (PARTITION BY {names} ORDER BY base RANGE BETWEEN {float(still)}D PRECEDING AND CURRENT ROW)")
    x, live = F.col(at), F.coalesce(F.col(at) >= F.col(first), F.lit(False))

    known = F.coalesce(F.nanvl(F.col(curve).cast("double"), F.lit(0.0)), F.lit(0.0))
    checked = F.when(live, F.col(check).cast("double"))
    out = rows.select(*keys, at, first, F.when(live, F.max(known).over(so_far)).otherwise(0.0).alias("base"), F.when(checked.isNotNull(), F.max(checked).over(so_far)).alias("goal"))
    out = out.withColumn("error", F.col("goal") - F.col("base")).withColumn("level_from", level_from)
    out = out.withColumn("last", F.last(F.when(F.col("goal").isNotNull(), F.struct(x.alias("at"), "goal", "error")), ignorenulls=True).over(earlier))

    bound = F.coalesce(F.col("last.at"), F.col(first) - 1)
    begin = F.greatest(x - reach, bound)
    short = F.col("error") > F.greatest(F.lit(2.0), F.col("goal") / 10)
    begin = F.when(short, F.least(begin, F.greatest(F.col("level_from"), bound, F.lit(0)))).otherwise(begin)
    coming = F.first(F.when(F.col("goal").isNotNull(), F.struct(x.alias("at"), begin.alias("begin"), "goal", "error")), ignorenulls=True).over(onward)
    out = out.withColumn("next", coming)

    grown = F.when(F.col("next").isNotNull(), _share((x - F.col("next.begin")) / F.greatest(F.col("next.at") - F.col("next.begin"), F.lit(1)))).otherwise(0.0)
    left = F.coalesce(F.col("last.error") * _share(1 - (x - F.col("last.at")) / F.lit(reach)), F.lit(0.0))
    moved = F.col("base") + (1 - grown) * left + grown * F.coalesce("next.error", F.lit(0.0))
    between = F.greatest(F.coalesce("last.goal", F.lit(0.0)), F.least(moved, F.col("next.goal")))  # least() passes over a null
    return out.select(*keys, at, F.max(F.when(live, F.coalesce("goal", between)).otherwise(0.0)).over(so_far).alias(curve))
