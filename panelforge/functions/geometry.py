"""Boxes, angles, points and polylines (arrays of structs x, y)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def box_intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


#: Sides and centres of boxes are taken to so many places: those of equal boxes are equal wherever the boxes stand.
PLACES = 9


def iou_distance(a: Column, b: Column) -> Column:
    """1 - intersection over union; 1 if the union is empty."""
    both = box_intersection(a, b)
    area = lambda x: F.round(x["x1"] - x["x0"], PLACES) * F.round(x["y1"] - x["y0"], PLACES)
    union = area(a) + area(b) - both
    return F.when(union > 0, 1 - both / union).otherwise(F.lit(1.0))


def centre_distance_squared(a: Column, b: Column) -> Column:
    dx, dy = (F.round((a[f"{c}0"] + a[f"{c}1"]) / 2, PLACES) - F.round((b[f"{c}0"] + b[f"{c}1"]) / 2, PLACES) for c in "xy")
    return dx * dx + dy * dy


def centre_distances_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``centre_distance_squared`` of all boxes a and all b (rows of x0, y0, x1, y1)."""
    dx, dy = (np.round((a[:, k] + a[:, k + 2]) / 2, PLACES)[:, None] - np.round((b[:, k] + b[:, k + 2]) / 2, PLACES) for k in (0, 1))
    return dx * dx + dy * dy


def iou_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``iou_distance`` of all boxes a and all b (rows of x0, y0, x1, y1)."""
    w, h = (np.maximum(np.minimum(a[:, k + 2][:, None], b[:, k + 2]) - np.maximum(a[:, k][:, None], b[:, k]), 0.0) for k in (0, 1))
    area = [np.round(x[:, 2] - x[:, 0], PLACES) * np.round(x[:, 3] - x[:, 1], PLACES) for x in (a, b)]
    both = w * h
    union = area[0][:, None] + area[1] - both
    return np.where(union > 0, 1 - both / np.where(union > 0, union, 1.0), 1.0)


def overlap_fraction(a: Column, b: Column) -> Column:
    """Intersection over a's area; 1 if either holds the other, 0 if they are apart."""
    inside = lambda p, q: (p["x0"] >= q["x0"]) & (p["x1"] <= q["x1"]) & (p["y0"] >= q["y0"]) & (p["y1"] <= q["y1"])
    both = box_intersection(a, b)
    return F.when(inside(a, b) | inside(b, a), F.lit(1.0)).when(both > 0, both / box_area(a)).otherwise(F.lit(0.0))


def wrap_degrees(angle: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def path_length(path: Column) -> Column:
    """Length of a polyline; 0 below two points."""
    return F.aggregate(
        F.zip_with(path, F.slice(path, F.lit(2), F.greatest(F.size(path), F.lit(1))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])),
        F.lit(0.0),
        lambda total, d: total + F.coalesce(d, F.lit(0.0)),
    )


def turned(path: Column, degrees: Column, px: Column, py: Column) -> Column:
    """Rotated about (px, py)."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(
        path,
        lambda p: F.struct(
            (px + (p["x"] - px) * c - (p["y"] - py) * s).alias("x"), (py + (p["x"] - px) * s + (p["y"] - py) * c).alias("y")
        ),
    )


def straightness(path: Column) -> Column:
    """Net displacement over path length; 0 without a path."""
    first, last = F.get(path, F.lit(0)), F.element_at(path, -1)
    total = path_length(path)
    return F.when(total > 0, F.hypot(last["x"] - first["x"], last["y"] - first["y"]) / total).otherwise(F.lit(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(F.lit(0.0))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray crossing parity."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - F.lit(ay)) / F.lit(by - ay) + F.lit(ax))
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def arc_points(path: Column) -> Column:
    """The path with s, the length up to each point: array of structs s, x, y."""
    step = lambda acc, p: F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["s"] + F.hypot(p["x"] - F.element_at(acc, -1)["x"], p["y"] - F.element_at(acc, -1)["y"])).alias("s"), p["x"].alias("x"), p["y"].alias("y"))))
    first = F.element_at(path, 1)
    start = F.array(F.struct(F.lit(0.0).alias("s"), first["x"].alias("x"), first["y"].alias("y")))
    return F.aggregate(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), start, step)


def _between(a: Column, b: Column, s: Column) -> Column:
    """Point at arc length s on the line from a to b (structs s, x, y)."""
    t = F.when(b["s"] > a["s"], (s - a["s"]) / (b["s"] - a["s"])).otherwise(F.lit(0.0))
    return F.struct(s.alias("s"), (a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))


def point_at(arcs: Column, s: Column) -> Column:
    """Point of arc_points() at arc length s, held at the ends."""
    after = F.coalesce(F.try_element_at(F.filter(arcs, lambda p: p["s"] >= s), F.lit(1)), F.element_at(arcs, -1))
    before = F.coalesce(F.try_element_at(F.filter(arcs, lambda p: p["s"] < s), F.lit(-1)), F.element_at(arcs, 1))
    return _between(before, after, F.least(F.greatest(s, F.lit(0.0)), F.element_at(arcs, -1)["s"]))


def segments(arcs: Column) -> Column:
    """array of structs i, a, b: neighbouring points of arc_points()."""
    pairs = F.zip_with(F.slice(arcs, F.lit(1), F.size(arcs) - 1), F.slice(arcs, F.lit(2), F.size(arcs)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["a"].alias("a"), p["b"].alias("b")))


def marks(segment: Column, step: float) -> Column:
    """Points of one segment whose arc length is a multiple of ``step`` (its start only on the first segment): structs k, s, x, y."""
    first = F.when(segment["i"] == 0, F.lit(0)).otherwise(F.floor(segment["a"]["s"] / step) + 1).cast("long")
    last = F.floor(segment["b"]["s"] / step).cast("long")
    inside = F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("k"), _between(segment["a"], segment["b"], k * F.lit(step)).alias("p")))
    return F.when(first <= last, inside).otherwise(F.array().cast("array<struct<k:bigint,p:struct<s:double,x:double,y:double>>>"))


def cut_at(arcs: Column, length: Column) -> Column:
    """The path up to an arc length, its last point interpolated; unchanged if shorter."""
    kept = F.filter(arcs, lambda p: p["s"] < length)
    return F.when(F.element_at(arcs, -1)["s"] <= length, arcs).otherwise(F.concat(kept, F.array(point_at(arcs, length))))


def cut_at_circle(path: Column, cx: Column, cy: Column, r: Column) -> Column:
    """The part outside a circle from the first crossing on; all if it starts outside, the last point if it never leaves."""
    away = lambda p: F.hypot(p["x"] - cx, p["y"] - cy)
    k = F.aggregate(F.transform(path, away), F.struct(F.lit(0).alias("i"), F.lit(0).alias("hit")), lambda a, d: F.struct((a["i"] + 1).alias("i"), F.when((a["hit"] == 0) & (d >= r), a["i"] + 1).otherwise(a["hit"]).alias("hit")))["hit"]
    b, a = F.get(path, k - 1), F.get(path, k - 2)
    t = (r - away(a)) / (away(b) - away(a))
    edge = F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
    return F.when(k == 0, F.slice(path, F.size(path), F.lit(1))).when(k == 1, path).otherwise(F.concat(F.array(edge), F.slice(path, k, F.size(path))))


def projection(path: Column, px: Column, py: Column) -> Column:
    """struct(d, s): distance of a point from its nearest place on the path, and the arc length there; first at ties."""
    arcs = arc_points(path)

    def near(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / size))).otherwise(F.lit(0.0))
        return F.when(b.isNotNull(), F.struct(F.hypot(px - a["x"] - t * dx, py - a["y"] - t * dy).alias("d"), (a["s"] + t * F.sqrt(size)).alias("s")))

    return F.array_min(F.filter(F.zip_with(arcs, F.slice(arcs, F.lit(2), F.size(arcs)), near), lambda x: x.isNotNull()))
