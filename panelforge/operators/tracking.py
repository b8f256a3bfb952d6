"""Tracks of detections: assignment between neighbouring frames, then assignment of track ends to starts over a gap.

A metric is a function of two box columns that builds a cost column, with the cost beyond which two detections never
link and how far boxes are widened so that candidates meet in grid cells. Both assignments minimise the links' costs plus
a price for each end left alone: ``FACTOR`` times the value at the ``SHARE`` quantile (lower) of the candidates' costs of
the frame (of the key, over gaps); each link pays the least candidate cost on top.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import geometry
from panelforge.operators import assignment, matching, nearness, ranks
from panelforge.session import written

FACTOR, SHARE = 1.05, 0.9


@dataclass(frozen=True)
class Metric:
    cost: Callable[[Column, Column], Column]
    costs: Callable[[np.ndarray, np.ndarray], np.ndarray]  # the same of all boxes of two arrays
    cutoff: float
    reach: float | None  # candidates' centres lie this near; None: their boxes meet


def squared_distance(radius: float) -> Metric:
    """Squared distance of the boxes' centres, up to a radius."""
    if radius <= 0:
        raise ValueError("a radius is greater than zero")
    return Metric(geometry.centre_distance_squared, geometry.centre_distances_squared, radius * radius, radius)


def box_overlap(least: float) -> Metric:
    """1 - intersection over union, down to a least overlap."""
    if not 0 < least < 1:
        raise ValueError("a least overlap lies between 0 and 1")
    return Metric(geometry.iou_distance, geometry.iou_distances, 1 - least, None)


def candidates(left: DataFrame, right: DataFrame, keys: list[str], metric: Metric, size: float) -> DataFrame:
    """keys, a, b, distance (the metric's cost) of the pairs of rows (id, box) that may link; met in grid cells of edge ``size``."""
    if metric.reach is not None:
        centre = lambda lo, hi: (F.col(f"box.{lo}") + F.col(f"box.{hi}")) / 2
        point = lambda df: df.select(*keys, "id", "box", centre("x0", "x1").alias("x"), centre("y0", "y1").alias("y"))
        near = matching.pairs_within(point(left), point(right), keys, metric.reach)
        a = left.select(*keys, F.col("id").alias("a"), F.col("box").alias("abox"))
        b = right.select(*keys, F.col("id").alias("b"), F.col("box").alias("bbox"))
        near = near.drop("distance").join(a, [*keys, "a"]).join(b, [*keys, "b"])
    else:
        near = matching.box_pairs(left.select(*keys, "id", "box"), right.select(*keys, "id", "box"), keys, size)
    return near.select(*keys, "a", "b", metric.cost(F.col("abox"), F.col("bbox")).alias("distance")).where(F.col("distance") <= metric.cutoff)


def weighed(left: DataFrame, right: DataFrame, keys: list[str], metric: Metric, size: float) -> DataFrame:
    """``candidates`` of copied rows (id, box, n), with na and nb, how many rows their a and b stand for."""
    pairs = candidates(left, right, keys, metric, size)
    for x, df in (("a", left), ("b", right)):
        pairs = pairs.join(df.select(*keys, F.col("id").alias(x), F.col("n").alias(f"n{x}")), [*keys, x])
    return pairs.select(*keys, "a", "b", "distance", "na", "nb")


def weight(pairs: DataFrame) -> Column:
    return F.col("na") * F.col("nb") if "na" in pairs.columns else F.lit(1)


def priced(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with ``alone``, the price of an end without a link, and ``least``, what a link pays on top."""
    lone = ranks.at_share(pairs.withColumn("_n", weight(pairs)), keys, "distance", "_n", SHARE, "_q")
    return pairs.join(lone.select(*keys, (F.col("_q") * FACTOR).alias("alone"), "least"), keys)


def assigned(pairs: DataFrame, keys: list[str], most: int = matching.PAIRS_A_TASK) -> DataFrame:
    """keys, a, b, distance of the cheapest one-to-one links of priced candidates, and ``units``, how many links of copies each
    stands for."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        alone = pdf["alone"].to_numpy()
        taken, _, units = assignment.matched_units(pdf, alone, alone - pdf["least"].to_numpy())
        by = np.argsort(taken)
        return pdf.iloc[taken[by]][[*keys, "a", "b", "distance"]].assign(units=units[by])

    return matching.dealt(matching.in_parts(pairs, keys, most), [*keys, "_part"]).groupBy(*keys, "_part").applyInPandas(solve, f"{kinds}, a long, b long, distance double, units long")


def copied(points: DataFrame, keys: list[str], frame: str) -> tuple[DataFrame, DataFrame]:
    """Equal boxes of a frame as one row with a number of copies: those of the frame, and those of the next one under its number."""
    own = written(nearness.copies(points.select(*keys, frame, "id", "box"), [*keys, frame], "box"))
    return own, own.withColumn(frame, F.col(frame) - 1)


EDGES = ("x0", "y0", "x1", "y1")
#: Costs up to the cutoff are counted in so many cells before those of one cell are put in order.
CELLS = 4096


@dataclass(frozen=True)
class Meeting:
    """Boxes of two sides whose pairs may link, as rows (keys, side, id, n, box edges, centre x and y, _part): those of
    different keys or parts never meet. A part is one task's, and its pairs are looked at in blocks and never listed."""

    rows: DataFrame
    keys: list[str]
    metric: Metric

    def each(self, run: Callable, kinds: str, rows: DataFrame | None = None) -> DataFrame:
        """Rows of ``run(a, b, near, cost, pdf)`` for each part: the tables of both sides, blocks of numbers that meet (of b and a,
        if near is called with True) and their matrix of costs, infinite beyond the cutoff."""
        names, metric, rows = self.keys, self.metric, self.rows if rows is None else rows
        at = [*names, "_part"]

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = (pdf[pdf["side"] == k].sort_values("id") for k in (0, 1))
            box, other = (df[list(EDGES)].to_numpy(float) for df in (a, b))
            size = lambda x: max((x[:, 2] - x[:, 0]).max(), (x[:, 3] - x[:, 1]).max()) if len(x) else 0.0
            reach = metric.reach or (size(box) + size(other)) / 2 or 1.0
            places = [df[c].to_numpy(float) for df in (a, b) for c in ("x", "y")]

            def cost(i, j):
                d = metric.costs(box[i], other[j])
                return np.where(d <= metric.cutoff, d, np.inf)

            near = lambda turned: nearness.blocks(*places[2:], *places[:2], reach) if turned else nearness.blocks(*places, reach)
            out = run(a, b, near, cost, pdf)
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(next(iter(out.values()))) for k in names}, **out})

        return matching.dealt(rows, at).groupBy(*at).applyInPandas(part, f"{nearness.kinds_of(rows, names)}, {kinds}")


def meeting(left: DataFrame, right: DataFrame, keys: list[str], metric: Metric, most: int = matching.PAIRS_A_TASK) -> Meeting:
    """Copied rows (id, box, n) of two sides; those of a key beyond ``most`` rows in all meet by regions."""
    edges = [F.col(f"box.{c}").cast("double").alias(c) for c in EDGES]
    sides = [df.select(*keys, F.lit(k).alias("side"), "id", "n", *edges) for k, df in enumerate((left, right))]
    rows = sides[0].unionByName(sides[1])
    for k in (*keys, *EDGES):
        rows = rows.where(F.abs(k) < float("inf") if k in EDGES else F.col(k).isNotNull())
    rows = written(rows.withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2))
    reach = metric.reach or rows.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    return Meeting(written(matching.regions(rows, keys, reach * 1.000001, most)), keys, metric)


def priced_meeting(met: Meeting) -> DataFrame:
    """keys, alone, least as in ``priced``: costs are counted in cells, then those of the cell that holds the rank."""
    keys, cutoff = met.keys, met.metric.cutoff
    cell = lambda d: np.minimum(d * (CELLS / cutoff), CELLS - 1).astype(np.int64)

    def weights(a: pd.DataFrame, b: pd.DataFrame) -> Callable:
        na, nb = (df["n"].to_numpy(float) for df in (a, b))
        return lambda i, j, use: (na[i][:, None] * nb[j])[use]

    def count(a, b, near, cost, pdf) -> dict:
        total, least, weight = np.zeros(CELLS), np.full(CELLS, np.inf), weights(a, b)
        for i, j in near(False):
            d = cost(i, j)
            use = d < np.inf
            total += np.bincount(cell(d[use]), weight(i, j, use), CELLS)
            least[0] = min(least[0], d.min())
        held = np.flatnonzero(total)
        return {"cell": held, "k": total[held].astype(np.int64), "least": np.full(len(held), least[0])}

    def inside(a, b, near, cost, pdf) -> dict:
        want, weight = pdf["_cell"].iloc[0], weights(a, b)
        values = [np.empty(0)], [np.empty(0)]
        for i, j in near(False):
            d = cost(i, j)
            use = d < np.inf
            use[use] = cell(d[use]) == want
            values[0].append(d[use])
            values[1].append(weight(i, j, use))
        x, of = np.unique(np.concatenate(values[0]), return_inverse=True)
        return {"value": x, "k": np.bincount(of.ravel(), np.concatenate(values[1]), len(x)).astype(np.int64)}

    upto = lambda by: F.sum("k").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    cells = written(met.each(count, "cell long, k long, least double")).groupBy(*keys, "cell").agg(F.sum("k").alias("k"), F.min("least").alias("least"))
    whole = Window.partitionBy(*keys)
    cells = cells.withColumn("least", F.min("least").over(whole)).withColumn("_rank", F.floor((F.sum("k").over(whole) - 1) * SHARE)).withColumn("_upto", upto("cell"))
    at = written(cells.where("_upto > _rank AND _upto - k <= _rank").select(*keys, F.col("cell").alias("_cell"), (F.col("_upto") - F.col("k")).alias("_below"), "_rank", "least"))
    values = met.each(inside, "value double, k long", met.rows.join(at.select(*keys, "_cell"), keys)).groupBy(*keys, "value").agg(F.sum("k").alias("k"))
    values = values.join(at, keys).withColumn("_upto", F.col("_below") + upto("value")).where("_upto > _rank")
    return values.groupBy(*keys, "least").agg((F.min("value") * FACTOR).alias("alone"))


def assigned_meeting(met: Meeting) -> DataFrame:
    """``assigned`` of all pairs that meet, at their price."""

    def solve(a, b, near, cost, pdf) -> dict:
        alone, least = pdf["alone"].iloc[0], pdf["least"].iloc[0]
        got = assignment.solved_near(len(a), len(b), cost, near, alone, alone - least, *(df["n"].to_numpy(np.int64) for df in (a, b)))
        links = [(r, c, units) for r, partners in enumerate(got.held[0]) for c, units in partners.items()]
        r, c, units = (np.array(v, np.int64) for v in zip(*links)) if links else (np.empty(0, np.int64),) * 3
        distance = np.array([cost(np.array([x]), np.array([y]))[0, 0] for x, y in zip(r, c)])
        return {"a": a["id"].to_numpy()[r], "b": b["id"].to_numpy()[c], "distance": distance.astype(float), "units": units}

    return met.each(solve, "a long, b long, distance double, units long", met.rows.join(written(priced_meeting(met)), met.keys))


def single_pairs(met: Meeting) -> DataFrame:
    """keys, a, b of the pairs whose two ends may link with no other, not even with a copy of the one they have."""

    def alone(a, b, near, cost, pdf) -> dict:
        na, nb = (df["n"].to_numpy(np.int64) for df in (a, b))
        many, of, other = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for i, j in near(False):
            use = cost(i, j) < np.inf
            many[i], of[i] = use @ nb[j], j[use.argmax(axis=1)]
            np.add.at(other, j, na[i] @ use)
        one = np.flatnonzero(many == 1)
        one = one[other[of[one]] == 1]
        return {"a": a["id"].to_numpy()[one], "b": b["id"].to_numpy()[of[one]]}

    return met.each(alone, "a long, b long")


def frame_meeting(points: DataFrame, keys: list[str], frame: str, metric: Metric) -> tuple[Meeting, DataFrame]:
    """Boxes of each frame and those of the next one, and the former alone."""
    own, ahead = copied(points, keys, frame)
    return meeting(own, ahead, [*keys, frame], metric), own


def frame_links(points: DataFrame, keys: list[str], frame: str, metric: Metric, met: tuple[Meeting, DataFrame] | None = None) -> DataFrame:
    """keys, frame (of a), a, b, distance: links of detections (id, box) to those of the next frame."""
    at = [*keys, frame]
    met, own = met or frame_meeting(points, keys, frame, metric)
    flows = written(assigned_meeting(met))
    ids = nearness.members(points, own, at, "box")
    return nearness.unfolded(flows, ids, ids.withColumn(frame, F.col(frame) - 1), at)


def gap_links(tracks: DataFrame, keys: list[str], frame: str, gap_frames: int, gap_distance: float) -> DataFrame:
    """keys, a, b, distance: links of tracks' last detections (a) to later tracks' first ones (b), ``gap_frames`` missing at most."""
    ends = written(tracks.groupBy(*keys, "track").agg(
        F.min(frame).alias("first"), F.max(frame).alias("last"), F.min_by(F.struct("id", "box"), frame).alias("start"), F.max_by(F.struct("id", "box"), frame).alias("end")
    ))
    side = lambda at, which: ends.select(*keys, at, F.col(f"{which}.id").alias("id"), F.col(f"{which}.box").alias("box"))
    one = {which: written(nearness.copies(side(at, which), [*keys, at], "box")) for at, which in (("last", "end"), ("first", "start"))}
    left = one["end"].select(*keys, F.explode(F.sequence(F.col("last") + 1, F.col("last") + gap_frames + 1)).alias(frame), "id", "box", "n")
    right = one["start"].withColumnRenamed("first", frame)
    pairs = written(weighed(left, right, [*keys, frame], squared_distance(gap_distance), gap_distance).drop(frame))
    flows = written(assigned(priced(pairs, keys), keys))
    ids = [nearness.members(side(at, which), one[which], [*keys, at], "box").drop(at) for at, which in (("last", "end"), ("first", "start"))]
    return nearness.unfolded(flows, *ids, keys)


def track(points: DataFrame, keys: list[str], frame: str, metric: Metric, gap_frames: int = 0, gap_distance: float | None = None) -> DataFrame:
    """points (id, unique over all keys; box) with ``track``, the least id of their track."""
    if gap_frames and not (gap_distance or metric.reach):
        raise ValueError("closing gaps needs a distance greater than zero")
    nodes = points.select("id")
    links = written(frame_links(points, keys, frame, metric).select("a", "b"))
    tracks = points.join(matching.components(nodes, links).withColumnRenamed("component", "track"), "id")
    if gap_frames:
        links = links.union(gap_links(written(tracks), keys, frame, gap_frames, gap_distance or metric.reach).select("a", "b"))
        tracks = points.join(matching.components(nodes, links).withColumnRenamed("component", "track"), "id")
    return tracks.select(*points.columns, "track")


def filled(tracks: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """keys, track, frame, id, x, y (centres), method: detections (``auto``), and straight lines over their gaps (``interpolated``, no id)."""
    w = Window.partitionBy(*keys, "track").orderBy(frame)
    at = tracks.select(*keys, "track", frame, "id", ((F.col("box.x0") + F.col("box.x1")) / 2).alias("x"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("y"))
    at = at.withColumn("_n", F.lead(F.struct(frame, "x", "y")).over(w))
    steps = F.sequence(F.lit(0), F.coalesce(F.col(f"_n.{frame}") - F.col(frame) - 1, F.lit(0)))
    at = at.withColumn("_s", F.explode(steps))
    share = F.col("_s") / (F.col(f"_n.{frame}") - F.col(frame))
    move = lambda c: F.when(F.col("_s") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * share)
    method = F.when(F.col("_s") == 0, "auto").otherwise("interpolated")
    return at.select(*keys, "track", (F.col(frame) + F.col("_s")).alias(frame), F.when(F.col("_s") == 0, F.col("id")).alias("id"), move("x").alias("x"), move("y").alias("y"), method.alias("method"))
