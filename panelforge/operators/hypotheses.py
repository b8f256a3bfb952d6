"""Several candidate paths of one entity: each is read by its own best front, scored, and the best one taken."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import matching, optimize


@dataclass(frozen=True)
class Weights:
    """A path's score is the evidence behind its front, weighed by the share of the path that is a ridge; a path on something
    that was there before its front left (``moved`` levels out) is foreign and keeps ``foreign`` of a positive score, or loses
    ``fine``: at least half of the cells near its exit had changed, by the median over the bins from ``early`` to ``late`` before."""

    most: int = 2
    ridge: float = 0.5
    moved: int = 3
    early: int = 8
    late: int = 2
    share: float = 0.5
    foreign: float = 0.25
    fine: float = 10.0


def score(gains: np.ndarray, near: np.ndarray, ridge: float, w: Weights = Weights()) -> dict:
    """gains: (bins, levels + 1) evidence behind each front; near: share of changed cells at the exit in each bin."""
    front = optimize.monotone_front(gains, w.most)
    explained = float(gains[np.arange(len(front)), front].sum())
    beyond = float((gains[:, -1] - gains[np.arange(len(front)), front]).clip(0).sum())
    left = np.flatnonzero(front >= w.moved)
    before = near[max(0, left[0] - w.early) : max(0, left[0] - w.late)] if len(left) else near[:0]
    through = bool(len(before) and np.median(before) >= w.share)
    value = explained * ((1 - w.ridge) + w.ridge * ridge) if explained > 0 else explained
    if through:
        value = value * w.foreign if value > 0 else value - w.fine
    return {"explained": explained, "beyond": beyond, "through": through, "final": int(front[-1]), "score": value}


def scored(bins: DataFrame, keys: list[str], path: str, at: str, w: Weights = Weights()) -> DataFrame:
    """keys, path, explained, beyond, through, final, score. bins: keys, path, at, gains, near, ridge (the same in all bins of a path)."""
    kinds = ", ".join(f"`{k}` {bins.schema[k].dataType.simpleString()}" for k in [*keys, path])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One result for each run of rows of a path; the last run of a batch waits for the next batch."""
        rest = None
        for pdf in chain(batches, [None]):
            last = pdf is None
            pdf = rest if last else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf is None or not len(pdf):
                continue
            of = pdf.groupby([*keys, path], dropna=False, sort=False).ngroup().to_numpy()
            first = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
            if not last:
                rest = pdf.iloc[first[-2] :]
                first = first[:-1]
            if len(first) < 2:
                continue
            gains, near, ridge = pdf["gains"].to_numpy(), pdf["near"].to_numpy(float), pdf["ridge"].to_numpy(float)
            got = pd.DataFrame([score(np.stack(gains[i:j]), near[i:j], float(ridge[i]), w) for i, j in zip(first[:-1], first[1:])])
            yield pd.concat([pdf[[*keys, path]].iloc[first[:-1]].reset_index(drop=True), got], axis=1)

    rows = matching.dealt(bins, [*keys, path]).sortWithinPartitions(*keys, path, at)
    return rows.mapInPandas(run, f"{kinds}, explained double, beyond double, through boolean, final long, score double")


def best(scored: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The path with the largest score of each key, the least one at a tie, and the margin to the next."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), path)
    rows = scored.withColumn("_r", F.row_number().over(order)).withColumn("margin", F.col("score") - F.lead("score").over(order))
    return rows.where("_r = 1").drop("_r")
