"""Greedy non-max suppression in rounds, equal to taking points one after another by score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suppressed(points: DataFrame, keys: list[str], factor: float, most: int = 1000) -> DataFrame:
    """keys, id of the points that stay: best score first (least id at a tie), each at ``factor`` times the smaller radius
    or more from all that stay before it. points: keys, id, x, y, r (greater than zero), score.

    Points of one grid cell always suppress each other (its diagonal is shorter than the least reach), so only a cell's
    best live point can stay in a round: it stays if no better live point lies in reach, and what it suppresses goes. Live
    points meet the best of the cells round them alone, so no round lists the pairs of a crowded place.
    """
    live = points.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "r")], "score").checkpoint()
    low, high = live.agg(F.min("r"), F.max("r")).first()
    if low is None:
        return live.select(*keys, "id")
    if low <= 0:
        raise ValueError("a radius is greater than zero")
    edge = factor * low / 1.5  # below the square root of two, so that a cell's diagonal is shorter than the reach
    ring = int(factor * high / edge) + 1
    cell = [*keys, "cx", "cy"]
    live = live.withColumn("cx", F.floor(F.col("x") / edge)).withColumn("cy", F.floor(F.col("y") / edge))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1)]))
    rank = F.struct(F.col("score").alias("score"), (-F.col("id")).alias("least"))

    def near(of: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of ``of`` beside the others (as struct o) that lie in reach."""
        moved = others.select(*keys, "cx", "cy", F.struct("id", "x", "y", "r", rank.alias("rank")).alias("_o")).withColumn("_m", around)
        moved = moved.select(*keys, (F.col("cx") + F.col("_m.i")).alias("cx"), (F.col("cy") + F.col("_m.j")).alias("cy"), "_o")
        dx, dy = F.col("x") - F.col("_o.x"), F.col("y") - F.col("_o.y")
        reach = F.lit(factor) * F.least(F.col("r"), F.col("_o.r"))
        return of.join(moved, cell).where((F.col("id") != F.col("_o.id")) & (F.sqrt(dx * dx + dy * dy) < reach))

    kept = None
    for _ in range(most):
        best = live.groupBy(*cell).agg(F.max_by(F.struct("id", "x", "y", "r", "score"), rank).alias("p")).select(*cell, "p.*").checkpoint()
        if not best.limit(1).count():
            return kept if kept is not None else live.select(*keys, "id")
        # any better live point may stay and suppress a cell's best, not another cell's best alone
        beaten = near(live, best).where(rank > F.col("_o.rank")).select(*keys, F.col("_o.id").alias("id")).distinct()
        stay = best.join(beaten, [*keys, "id"], "left_anti").checkpoint()
        gone = near(live, stay).select(*keys, "id").union(stay.select(*keys, "id")).distinct()
        live = live.join(gone, [*keys, "id"], "left_anti").checkpoint()
        new = stay.select(*keys, "id")
        kept = new if kept is None else kept.union(new).checkpoint()
    raise RuntimeError(f"suppression did not settle in {most} rounds")
