"""Following an entity by a bank of looks: batch and stream share one step."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """A look is accepted if its correlation with any of the bank reaches ``least`` (``again`` once two in a row have been
    missed); it is learned, as the mean of the last three accepted, if its correlation lies between ``low`` and ``high`` and
    ``every`` looks have passed; the bank is the first look and the ``size`` latest learned. More than ``most`` misses in a
    row lose the entity, from the first of them on."""

    least: float = 0.45
    again: float = 0.6
    low: float = 0.5
    high: float = 0.9
    every: int = 4
    size: int = 4
    most: int = 6


@dataclass
class Bank:
    """State of one entity: bounded, whatever the number of looks."""

    seen: int = 0
    accepted: int = 0
    misses: int = 0
    learned_at: int = 0
    lost_from: int | None = None
    first: list = field(default_factory=list)
    bank: list = field(default_factory=list)
    recent: list = field(default_factory=list)
    first_miss: int = -1

    def look(self, vector: np.ndarray, at: int, w: Rules) -> tuple[float | None, str]:
        """(correlation, what became of the look): the first three make the reference."""
        self.seen += 1
        if self.lost_from is not None:
            return None, "lost"
        vector = vector - vector.mean()
        if len(self.first) < 3:
            self.first.append(vector)
            if len(self.first) == 3:
                self.bank = [np.mean(self.first, axis=0)]
            return None, "reference"
        norm = float(np.linalg.norm(vector))
        score = max(float(b @ vector) / max(float(np.linalg.norm(b)) * norm, 1e-12) for b in self.bank)
        if score < (w.least if self.misses < 2 else w.again):
            self.first_miss = at if not self.misses else self.first_miss
            self.misses += 1
            if self.misses > w.most:
                self.lost_from = self.first_miss
            return score, "missed"
        self.accepted, self.misses = self.accepted + 1, 0
        self.recent = [*self.recent[-2:], vector]
        if w.low <= score < w.high and self.seen - self.learned_at >= w.every and len(self.recent) == 3:
            self.bank = [self.bank[0], *[*self.bank[1:], np.mean(self.recent, axis=0)][-w.size :]]
            self.learned_at = self.seen
        return score, "accepted"


def batch(looks: DataFrame, key: str, at: str, vector: str, w: Rules = Rules()) -> DataFrame:
    """key, at, score, outcome of each look in order; a group is one entity's looks, read in turn."""
    kinds = f"`{key}` {looks.schema[key].dataType.simpleString()}, `{at}` {looks.schema[at].dataType.simpleString()}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, pdf = Bank(), pdf.sort_values(at)
        got = [state.look(np.array(v, float), int(t), w) for t, v in zip(pdf[at], pdf[vector])]
        return pdf[[key, at]].assign(score=[s for s, _ in got], outcome=[o for _, o in got])

    return looks.select(key, at, vector).groupBy(key).applyInPandas(run, f"{kinds}, score double, outcome string")


def stream(looks: DataFrame, key: str, at: str, vector: str, w: Rules = Rules()) -> DataFrame:
    """key, seen, accepted, bank, lost_from (-1: never) after each batch; the bank is the key's state."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bank = pickle.loads(state.get[0]) if state.exists else Bank()
        rows = pd.concat(list(batches)).sort_values(at)
        for t, v in zip(rows[at], rows[vector]):
            bank.look(np.array(v, float), int(t), w)
        state.update((pickle.dumps(bank),))
        yield pd.DataFrame({key: [keys[0]], "seen": [bank.seen], "accepted": [bank.accepted], "bank": [len(bank.bank)], "lost_from": [-1 if bank.lost_from is None else bank.lost_from]})

    kind = looks.schema[key].dataType.simpleString()
    got = looks.select(key, at, vector).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, seen long, accepted long, bank long, lost_from long", "bank binary", "update", "NoTimeout")
    return got


def summary(rows: DataFrame, key: str, at: str, w: Rules = Rules()) -> DataFrame:
    """key, seen, accepted, lost_from of batch rows, as the stream has them."""
    from pyspark.sql import Window

    over = Window.partitionBy(key).orderBy(at)
    run = F.row_number().over(over) - F.row_number().over(Window.partitionBy(key, (F.col("outcome") == "missed")).orderBy(at))
    misses = rows.withColumn("_run", run).where("outcome = 'missed'").groupBy(key, "_run").agg(F.min(at).alias("from"), F.count(F.lit(1)).alias("n")).where(F.col("n") > w.most)
    lost = misses.groupBy(key).agg(F.min("from").alias("lost_from"))
    count = rows.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("outcome") == "accepted").alias("accepted"))
    return count.join(lost, key, "left").select(key, "seen", "accepted", F.coalesce("lost_from", F.lit(-1)).alias("lost_from"))
