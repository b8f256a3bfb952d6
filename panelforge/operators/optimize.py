"""Iterative estimators over short series: folds over arrays, or one grouped numpy pass for each entity.

Series are bounded by the number of bins of one recording, so a group is small whatever the number of entities.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series(rows: DataFrame, keys: list[str], at: str, value: str, out: str = "ys") -> DataFrame:
    """keys, values in order of ``at``."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]).alias(out))


def per_entity(rows: DataFrame, keys: list[str], at: str, f: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """Columns of ``f`` (arrays of one length) for each entity, its rows in order."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        out = pd.DataFrame(f(pdf))
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def front_score(gains: Column, levels: int, most: int) -> Column:
    """Best total over fronts that never fall and rise by ``most`` at most per step.

    gains: one array for each step, its entry f (0 to ``levels``) the evidence behind a front at f. One array of scores
    is folded over the steps: levels * most operations each.
    """
    grid = F.sequence(F.lit(0), F.lit(levels))
    start = F.transform(grid, lambda f: F.lit(0.0))
    step = lambda score, row: F.transform(grid, lambda f: F.get(row, f) + F.array_max(F.slice(score, F.greatest(f - most, F.lit(0)) + 1, F.least(f, F.lit(most)) + 1)))
    return F.array_max(F.aggregate(gains, start, step))


def monotone_front(gains: np.ndarray, most: int) -> np.ndarray:
    """The front itself, from (steps, levels + 1) gains; ties take the lowest predecessor and the lowest last level."""
    n = gains.shape[1]
    score, back = np.zeros(n), []
    before = np.arange(n)[:, None] + np.arange(-most, 1)
    none, own = before < 0, np.arange(n)
    for row in gains:
        best = before[own, np.where(none, -np.inf, score[before]).argmax(axis=1)]
        back.append(best)
        score = row + score[best]
    at, out = int(score.argmax()), []
    for best in reversed(back):
        out.append(at)
        at = int(best[at])
    return np.array(out[::-1], np.int64)


def viterbi(score: np.ndarray, penalty: float, most: int, pin: int | None = None) -> np.ndarray:
    """States (steps, states) -> best path: sum of scores less penalty times change, changes of ``most`` at most, last state pinned."""
    steps, n = score.shape
    change = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    cost = np.where(change <= most, -penalty * change, -np.inf)
    total, back = score[0].copy(), []
    for t in range(1, steps):
        both = total[:, None] + cost
        back.append(both.argmax(axis=0))
        total = both.max(axis=0) + score[t]
    at = int(total.argmax()) if pin is None else pin
    path = [at]
    for best in reversed(back):
        at = int(best[at])
        path.append(at)
    return np.array(path[::-1], np.int64)


def candidate_path(values: np.ndarray, present: np.ndarray, most: float, miss: float, idle: float) -> np.ndarray:
    """State by bin: 0 not started, 1 on the candidate, 2 held; starting is free once, a step over ``most`` costs its excess."""
    inf, n = -1e18, len(values)
    total, back, last = np.array([0.0, inf, inf]), [], values[0]
    for t in range(n):
        step = max(0.0, abs(values[t] - last) - most) if t else 0.0
        gain = np.array([-idle * present[t], present[t] - step if present[t] else inf, -miss])
        both = np.array([[total[0], inf, inf], [total[0], total[1], total[2]], [inf, total[1], total[2]]])
        back.append(both.argmax(axis=1))
        total = both.max(axis=1) + gain
        last = values[t] if present[t] else last
    at, out = int(total.argmax()), []
    for best in reversed(back):
        out.append(at)
        at = int(best[at])
    return np.array(out[::-1], np.int64)


def isotonic(y: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit."""
    blocks: list[list[float]] = []
    for v in y:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1]]
    return np.concatenate([np.full(int(n), s / n) for s, n in blocks]) if blocks else np.zeros(0)


def correlation_shift(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Lag of b against a (within ``most``) with the largest correlation of the overlap."""
    best, out = -np.inf, 0
    for lag in sorted(range(-most, most + 1), key=lambda k: (abs(k), k)):
        x, y = (a[lag:], b[: len(b) - lag]) if lag >= 0 else (a[:lag], b[-lag:])
        if len(x) > 2 and x.std() > 0 and y.std() > 0:
            r = float(np.corrcoef(x, y)[0, 1])
            if r > best + 1e-12:
                best, out = r, lag
    return out


def matched_filter(vector: Column, template: list[float]) -> Column:
    """Projection on the zero-mean, unit-norm template."""
    t = np.array(template, float)
    t = (t - t.mean()) / np.linalg.norm(t - t.mean())
    weights = F.array(*[F.lit(float(x)) for x in t])
    return F.aggregate(F.zip_with(vector, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)


def spread(cells: DataFrame, seeds: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """keys, x, y, owner, steps: nearest seed (id; smaller at a tie) of each cell within ``most`` steps over 8-connected cells.

    The frontier advances one step a round by a join with the moved frontier; each round is checkpointed.
    """
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    at = [*keys, "x", "y"]
    done = cells.select(*at).join(seeds.select(*at, F.col("id").alias("owner")), at).groupBy(*at).agg(F.min("owner").alias("owner")).withColumn("steps", F.lit(0)).checkpoint()
    front = done
    for step in range(1, most + 1):
        moved = front.withColumn("m", moves).select(*keys, (F.col("x") + F.col("m.i")).alias("x"), (F.col("y") + F.col("m.j")).alias("y"), "owner")
        front = moved.groupBy(*at).agg(F.min("owner").alias("owner")).join(cells.select(*at), at, "left_semi").join(done.select(*at), at, "left_anti")
        front = front.withColumn("steps", F.lit(step)).checkpoint()
        if not front.limit(1).count():
            break
        done = done.unionByName(front)
    return done
