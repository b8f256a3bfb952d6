"""Growth of a tube through a map of arrivals, one entity's bounded window of cells a group.

Cells arrive in the order of their bins. A disjoint-set forest over all that has arrived knows, for each connected piece,
when its first cell far from the entity came; so whether a fresh piece is the leading end of something older is one look.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelforge.operators import matching

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


@dataclass(frozen=True)
class Rules:
    """Cells within ``halo`` of the rim are never claimed. A tube starts on a fresh piece that reaches the next ``band`` of
    cells, spans ``arc`` degrees round the entity at most, and hangs together with no cell that lies over ``old_far`` from the
    rim and came over ``old_bins`` bins before. It grows by fresh pieces within ``bridge`` of the cells it claimed in its
    last ``recent`` bins. If it stops for more than ``give_up`` bins before it is ``least`` long, it is forgotten."""

    halo: float = 3.0
    band: float = 4.0
    arc: float = 60.0
    old_far: float = 10.0
    old_bins: int = 3
    bridge: float = 4.0
    recent: int = 12
    give_up: int = 40
    least: float = 8.0


class Arrived:
    """Disjoint sets of arrived cells with the first arrival of each set's far cells."""

    def __init__(self):
        self.up: dict[tuple, tuple] = {}
        self.far: dict[tuple, float] = {}

    def root(self, c: tuple) -> tuple:
        while self.up[c] != c:
            self.up[c] = self.up[self.up[c]]
            c = self.up[c]
        return c

    def add(self, c: tuple, far: float) -> None:
        self.up[c], self.far[c] = c, far
        for i, j in AROUND:
            n = (c[0] + i, c[1] + j)
            if n in self.up:
                a, b = self.root(c), self.root(n)
                if a != b:
                    self.up[a] = b
                    self.far[b] = min(self.far[a], self.far[b])


def pieces(cells: set[tuple]) -> list[list[tuple]]:
    """8-connected pieces, each in order; the piece of the least cell first."""
    left, out = set(cells), []
    for first in sorted(cells):
        if first in left:
            left.discard(first)
            piece = [first]
            for x, y in piece:
                for i, j in AROUND:
                    n = (x + i, y + j)
                    if n in left:
                        left.discard(n)
                        piece.append(n)
            out.append(sorted(piece))
    return out


def reached(piece: list[tuple], start: dict[tuple, float]) -> dict[tuple, float]:
    """Distances inside a piece from cells with known ones."""
    out, heap, inside = dict(start), [(d, c) for c, d in start.items()], set(piece)
    heapify(heap)
    while heap:
        d, (x, y) = heappop(heap)
        if d > out[x, y]:
            continue
        for i, j in AROUND:
            n, far = (x + i, y + j), d + float(np.hypot(i, j))
            if n in inside and far < out.get(n, np.inf):
                out[n] = far
                heappush(heap, (far, n))
    return out


def span(piece: list[tuple]) -> float:
    """Degrees that a piece covers round the origin, measured from its mean direction."""
    angle = np.arctan2([y for _, y in piece], [x for x, _ in piece])
    turned = np.angle(np.exp(1j * (angle - np.angle(np.exp(1j * angle).mean()))))
    return float(np.degrees(np.ptp(turned)))


def grow(arrival: dict[tuple, int], radius: float, bins: int, w: Rules = Rules()) -> tuple[int | None, list[float], dict[tuple, int]]:
    """(bin of emergence, length in each bin, bin in which each of the tube's cells was claimed).

    arrival: the bin of each cell (x, y), the entity's centre at (0, 0) and its rim at ``radius``; blocked cells left out.
    """
    rim = {c: float(np.hypot(*c)) - radius for c in arrival}
    at: dict[int, set[tuple]] = {}
    for c, b in arrival.items():
        if rim[c] >= w.halo and b < bins:
            at.setdefault(b, set()).add(c)
    arrived, tube, dist, emerged, grew, lengths = Arrived(), {}, {}, None, 0, []
    for b in range(bins):
        if emerged is not None and b - grew > w.give_up and not any(rim[c] > w.least for c in tube):
            tube, dist, emerged, lengths = {}, {}, None, [0.0] * b
        fresh = at.get(b, set())
        for c in sorted(fresh):
            arrived.add(c, b if rim[c] > w.old_far else np.inf)
        latest = max(tube.values(), default=0)
        tip = [c for c, t in tube.items() if t >= latest - w.recent and c in dist]
        tips, known = np.array(tip, float).reshape(-1, 2), np.array([dist[c] for c in tip])
        starting = not tube
        for piece in pieces(fresh):
            if starting:
                begin = {c: rim[c] for c in piece if rim[c] <= w.halo + w.band}
                if not begin or span(piece) > w.arc or arrived.far[arrived.root(piece[0])] < b - w.old_bins:
                    continue
            else:
                begin = {}
                for c in piece:
                    hop = np.hypot(tips[:, 0] - c[0], tips[:, 1] - c[1])
                    close = hop <= w.bridge
                    if close.any():
                        begin[c] = float((known + hop)[close].min())
                if not begin:
                    continue
            dist.update(reached(piece, begin))
            tube.update(dict.fromkeys(piece, b))
            emerged, grew = b if emerged is None else emerged, b
        lengths.append(max(dist.values(), default=0.0))
    return emerged, np.maximum.accumulate(lengths).tolist() if lengths else [], tube


def flood(cells: DataFrame, keys: list[str], bins: int, w: Rules = Rules()) -> DataFrame:
    """keys, bin, length, emerged (null: never) for bins 0 to bins - 1. cells: keys, x, y, arrival, radius."""
    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arrival = dict(zip(zip(pdf["x"].tolist(), pdf["y"].tolist()), pdf["arrival"].tolist()))
        emerged, lengths, _ = grow(arrival, float(pdf["radius"].iloc[0]), bins, w)
        out = pd.DataFrame({"bin": range(bins), "length": lengths})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out.assign(emerged=pd.Series([emerged] * bins, dtype="Int64"))

    return matching.dealt(cells, keys).groupBy(*keys).applyInPandas(run, f"{kinds}, bin long, length double, emerged long")
