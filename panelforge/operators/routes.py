"""Cheapest routes over grids: costs from seeds in checkpointed rounds over tiles, predecessors, and the routes themselves.

A movie's grid may hold any number of cells: a task holds one tile of it. A round solves the tiles whose borders were
offered something cheaper, and offers their own border cells to the tiles around; it ends when no offer is cheaper. So
rounds are as many as the most tiles that a cheapest route crosses, for all movies together.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 64
STEPS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _moves() -> Column:
    step = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(np.sqrt(i * i + j * j))).alias("far"))
    return F.explode(F.array(*[step(i, j) for i, j in STEPS]))


def settle(tile: pd.DataFrame) -> np.ndarray:
    """Costs of a tile's cells (x, y, price, cost so far or offered): each cell's price times the step into it, over 8 neighbours."""
    at = {xy: k for k, xy in enumerate(zip(tile["x"].tolist(), tile["y"].tolist()))}
    price, cost = tile["price"].tolist(), tile["cost"].fillna(np.inf).tolist()
    heap = [(c, k) for k, c in enumerate(cost) if c < np.inf]
    heapify(heap)
    places = list(at)
    far = {s: float(np.sqrt(s[0] * s[0] + s[1] * s[1])) for s in STEPS}
    while heap:
        c, k = heappop(heap)
        if c > cost[k]:
            continue
        x, y = places[k]
        for (i, j), d in far.items():
            n = at.get((x + i, y + j))
            if n is not None and c + price[n] * d < cost[n]:
                cost[n] = c + price[n] * d
                heappush(heap, (cost[n], n))
    return np.array(cost)


def cheapest_costs(cells: DataFrame, seeds: DataFrame, keys: list[str], tile: int = TILE, most: int = 10_000) -> DataFrame:
    """keys, x, y, price, cost of the cheapest way from a key's seeds (x, y and, if there is one, start_cost), for all cells reached.

    cells: keys, x, y, price (greater than zero). Seeds off the cells start nothing.
    """
    if cells.where("price <= 0").limit(1).count():
        raise ValueError("prices are greater than zero")
    at = [*keys, "x", "y"]
    start = F.col("start_cost").cast("double") if "start_cost" in seeds.columns else F.lit(0.0)
    offers = seeds.select(*at, start.alias("offer")).groupBy(*at).agg(F.min("offer").alias("offer"))
    tiled = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in ("x", "y")]
    own = [*keys, "tx", "ty"]
    state = cells.select(*at, F.col("price").cast("double").alias("price"), F.lit(None).cast("double").alias("cost"), *tiled).checkpoint()
    kinds, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields), state.columns

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        new = settle(pdf.assign(cost=np.fmin(pdf["cost"].to_numpy(float), pdf["offer"].to_numpy(float))))
        return pdf.assign(cost=np.where(np.isinf(new), np.nan, new), fresh=new < pdf["cost"].fillna(np.inf).to_numpy())[[*names, "fresh"]]

    for _ in range(most):
        cheaper = state.join(offers, at).where("cost IS NULL OR offer < cost").select(*at, *["tx", "ty"], "offer").checkpoint()
        if not cheaper.limit(1).count():
            break
        busy = cheaper.select(*own).distinct()
        met = state.join(busy, own, "left_semi").join(cheaper.drop("tx", "ty"), at, "left")
        done = met.groupBy(*own).applyInPandas(solve, f"{kinds}, fresh boolean").checkpoint()
        done = done.withColumn("cost", F.when(~F.isnan("cost"), F.col("cost")))
        state = state.join(busy, own, "left_anti").unionByName(done.drop("fresh")).checkpoint()
        # what changed is offered to the cells around it that lie in other tiles; the price of the cell entered is added there
        out = done.where("fresh").withColumn("_m", _moves()).select(*keys, (F.col("x") + F.col("_m.i")).alias("x"), (F.col("y") + F.col("_m.j")).alias("y"), "cost", "_m.far", "tx", "ty")
        out = out.where((F.floor(F.col("x") / tile) != F.col("tx")) | (F.floor(F.col("y") / tile) != F.col("ty")))
        entered = out.join(state.select(*at, "price"), at)
        offers = entered.groupBy(*at).agg(F.min(F.col("cost") + F.col("price") * F.col("far")).alias("offer"))
    else:
        raise RuntimeError(f"costs did not settle in {most} rounds")
    return state.where("cost IS NOT NULL").select(*at, "price", "cost")


def predecessors(costs: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, cost, px, py: the cell before each on its cheapest way (least cost through it, then least x and y), null at seeds."""
    at = [*keys, "x", "y"]
    start = F.col("start_cost").cast("double") if "start_cost" in seeds.columns else F.lit(0.0)
    starts = seeds.select(*at, start.alias("offer")).groupBy(*at).agg(F.min("offer").alias("offer"))
    out = costs.withColumn("_m", _moves()).select(
        *keys, (F.col("x") + F.col("_m.i")).alias("x"), (F.col("y") + F.col("_m.j")).alias("y"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("cost").alias("before"), "_m.far"
    )
    way = F.struct((F.col("before") + F.col("price") * F.col("far")).alias("cost"), "px", "py")
    best = out.join(costs, at).groupBy(*at).agg(F.min(way).alias("way"))
    met = costs.join(best, at, "left").join(starts, at, "left")
    through = F.coalesce(F.col("offer") > F.col("way.cost"), F.col("offer").isNull())
    return met.select(*at, "cost", F.when(through, F.col("way.px")).alias("px"), F.when(through, F.col("way.py")).alias("py"))


def routes(before: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, step, x, y, cost: the cells from a seed (step 0) to each target (id, x, y) that is reached.

    Ways back double: round k joins every place of every route with the place 2^k cells before it, so a route of n cells
    takes log2 n rounds.
    """
    at = [*keys, "x", "y"]
    jump = before.where("px IS NOT NULL").select(*at, "px", "py").checkpoint()
    found = targets.select(*keys, "id", "x", "y").join(before.select(*at), at).select(*keys, "id", "x", "y", F.lit(0).cast("long").alias("back")).checkpoint()
    hop = 1
    while True:
        further = found.join(jump, at).select(*keys, "id", F.col("px").alias("x"), F.col("py").alias("y"), (F.col("back") + hop).alias("back")).checkpoint()
        if not further.limit(1).count():
            break
        found = found.unionByName(further).checkpoint()
        next_ = jump.select(*keys, F.col("x").alias("px"), F.col("y").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"))
        jump = jump.join(next_, [*keys, "px", "py"]).select(*at, F.col("qx").alias("px"), F.col("qy").alias("py")).checkpoint()
        hop *= 2
    length = found.groupBy(*keys, "id").agg(F.max("back").alias("n"))
    return found.join(length, [*keys, "id"]).join(before.select(*at, "cost"), at).select(*keys, "id", (F.col("n") - F.col("back")).alias("step"), "x", "y", "cost")


def measures(routes: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, cells, length, cost, covered (share of the cells that were seen), longest_gap (cells in a row not seen).

    seen: keys, x, y of the cells with evidence.
    """
    at = [*keys, "x", "y"]
    w = Window.partitionBy(*keys, "id").orderBy("step")
    r = routes.join(seen.select(*at).distinct().withColumn("_seen", F.lit(1)), at, "left").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    r = r.withColumn("_d", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).withColumn("_run", F.sum("_seen").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = r.where("_seen = 0").groupBy(*keys, "id", "_run").agg(F.count(F.lit(1)).alias("_g")).groupBy(*keys, "id").agg(F.max("_g").alias("longest_gap"))
    out = r.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("cells"), F.sum("_d").alias("length"), F.max("cost").alias("cost"), F.avg("_seen").alias("covered"))
    return out.join(gaps, [*keys, "id"], "left").fillna(0, ["longest_gap"])
