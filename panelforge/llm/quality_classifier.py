"""Operator 2: document quality by random Fourier features, ridge regression and isotonic calibration.

One pass turns each whole text into ``STATISTICS`` numbers (stored once, some
sixty bytes a row). Random Fourier features of the standardised numbers
approximate a Gaussian kernel; each partition sums its share of the normal
equations, the sums meet row by row of the matrix, and the driver solves one
system of ``FEATURES`` + 1 unknowns. Ridge scores of the labelled rows are
counted in ``BINS`` bins, and pool-adjacent-violators turns the bins into a
monotone probability. What reaches the driver has a fixed size.

Defined results: null and blank texts are scored from zero statistics;
without labelled rows every score is 0.5; repeated rows are scored alike, very long texts
whole; a label that is given twice for a doc_id counts once, two different ones count each; null
ids stay; only the text is an input of a score; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialized, with_rest
from panelforge.llm.quality_rules import STOP_WORDS
from panelforge.llm.textnum import Words, chunks, distinct

STATISTICS = (
    "log_words", "word_bytes", "symbols", "shouts", "pipes", "upper", "digits", "stop_words",
    "types", "trigrams", "doubled", "stops", "lines", "other_bytes",
)
FEATURES, WIDTH, RIDGE, BINS, SEED, SPREAD = 192, 3.0, 1.0, 1024, 11, 64

#: Byte classes that are counted.
_KINDS = {"symbols": b"#*$%&<>", "pipes": b"|", "shouts": b"!", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "stops": b".,;:?", "lines": b"\n", "other": bytes(range(128, 256)), "lower": bytes(range(97, 123))}
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _k, _chars in enumerate(_KINDS.values()):
    _CLASS[list(_chars)] = _k
_STOP = np.unique(Words(pa.array([" ".join(STOP_WORDS)])).hashes[0])


def statistics(col: pa.Array) -> np.ndarray:
    """Statistics of each whole text, (rows, len(STATISTICS)), all near 0 to 3."""
    words = Words(col)
    n = len(words.counts)
    kinds = _CLASS[words.raw]
    tally = np.array([np.bincount(kinds[a:b], minlength=len(_KINDS) + 1) for a, b in zip(words.offsets[:-1], words.offsets[1:])], float).reshape(n, -1)
    symbols, pipes, shouts, upper, digits, stops, lines, other, lower = tally.T[: len(_KINDS)] if n else np.zeros((len(_KINDS), 0))
    symbols = symbols + pipes
    count = words.counts.astype(float)
    least = np.maximum(count, 1)
    h = words.hashes[0]
    row = np.repeat(np.arange(n), words.counts)
    _, trigrams = words.rolling(3)
    types, triples = distinct(h, words.rows[1:])[1], distinct(trigrams, np.cumsum(np.maximum(0, words.counts - 2)))[1]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    stop = np.bincount(row[np.isin(h, _STOP)], minlength=n)
    size = np.diff(words.offsets).astype(float)
    letters = np.maximum(1, upper + lower + other)
    log = np.log1p(count)
    return np.stack(
        [
            log / 3, np.log1p(size / least), np.log1p(4 * symbols / least), np.log1p(4 * shouts / least), np.log1p(4 * pipes / least),
            3 * np.sqrt(upper / letters), 3 * np.sqrt(digits / np.maximum(1, size)), 3 * np.sqrt(stop / least),
            np.log1p(types) / np.maximum(log, 1) * 3, 3 * (triples / np.maximum(1, count - 2)),
            3 * np.sqrt(np.bincount(row[same], minlength=n) / least), np.log1p(4 * stops / least), np.log1p(8 * lines / least), np.sqrt(other / np.maximum(1, size)),
        ],
        axis=1,
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = statistics(part.column(1)).astype(np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(float)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Cosines whose inner products approximate exp(-|a - b|^2 / (2 width^2)), and a constant."""
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(size=(x.shape[1], features)) / width, rng.uniform(0, 2 * np.pi, features)
    z = np.cos(((x - mean) / scale).clip(-4, 4) @ turn + shift) * np.sqrt(2 / features)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Monotone shares of ones by pool-adjacent-violators; empty bins lie between their neighbours."""
    blocks: list[list[float]] = []
    filled = np.flatnonzero(total)
    for k in filled:
        blocks.append([ones[k], total[k], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a)]
    shares = np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])
    return np.interp(np.arange(len(total)), filled, shares) if len(filled) else np.full(len(total), 0.5)


def _bin(ridge: np.ndarray, bins: int) -> np.ndarray:
    return np.floor((ridge.clip(-0.5, 1.5) + 0.5) / 2 * (bins - 1)).astype(int)


def fit(labelled: DataFrame, ridge: float = RIDGE) -> dict:
    """Model from rows of x (statistics) and y (0 or 1). Two passes over the small table."""
    size = len(STATISTICS)
    at = labelled.select(*[F.col("x")[k].cast("double").alias(f"x{k}") for k in range(size)])
    got = at.agg(F.count(F.lit(1)).alias("n"), *[f(f"x{k}").alias(f"{n}{k}") for k in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not got["n"]:
        return {}
    mean, scale = np.array([got[f"m{k}"] for k in range(size)]), np.array([got[f"s{k}"] for k in range(size)]) + 1e-3

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = fourier(_matrix(batch.column(0)), mean, scale)
                total += z.T @ np.concatenate([z, batch.column(1).to_numpy()[:, None]], axis=1)
        if total.any():
            part = [TaskContext.get().partitionId() % SPREAD] * (FEATURES + 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(part, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "part", "line"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].to_list()[:1], "part": pdf["part"].to_list()[:1], "line": [sum(np.frombuffer(b) for b in pdf["line"]).tobytes()]})

    lines = labelled.select("x", F.col("y").cast("double").alias("y")).mapInArrow(sums, "i int, part int, line binary")
    for keys in (["i", "part"], ["i"]):  # by a share of the partitions first, so no group has a line of each
        lines = lines.groupBy(*keys).applyInPandas(add, "i int, part int, line binary")
    whole = np.stack([np.frombuffer(bytes(r["line"])) for r in sorted(lines.collect(), key=lambda r: r["i"])])  # FEATURES + 1 lines
    weights = np.linalg.solve(whole[:, :-1] + ridge * np.eye(FEATURES + 1), whole[:, -1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ones = np.zeros(BINS, int), np.zeros(BINS, int)
        for batch in batches:
            if batch.num_rows:
                k, y = _bin(fourier(_matrix(batch.column(0)), mean, scale) @ weights, BINS), batch.column(1).to_numpy()
                total += np.bincount(k, minlength=BINS)
                ones += np.bincount(k[y > 0], minlength=BINS)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k]), pa.array(ones[k])], names=["k", "total", "ones"])

    bins = labelled.select("x", F.col("y").cast("double").alias("y")).mapInArrow(count, "k long, total long, ones long").groupBy("k").agg(F.sum("total"), F.sum("ones")).collect()
    total, ones = np.zeros(BINS), np.zeros(BINS)
    for k, t, o in bins:
        total[k], ones[k] = t, o
    return {"mean": mean, "scale": scale, "weights": weights, "curve": isotonic(total, ones)}


def score(stats: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (probability of label 1) of each row of document_statistics()."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if m and batch.num_rows:
                out = m["curve"][_bin(fourier(_matrix(batch.column(1)), m["mean"], m["scale"]) @ m["weights"], BINS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, score of each row and, if asked, its text and other columns in the struct rest: one pass, no join."""
    shared, more = docs.sparkSession.sparkContext.broadcast(model), 2 if rest is None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                out = np.full(part.num_rows, 0.5)
                if m:
                    x = statistics(part.column(1)).astype(np.float32).astype(float)
                    out = m["curve"][_bin(fourier(x, m["mean"], m["scale"]) @ m["weights"], BINS)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out), *part.columns[more:]], names=["doc_id", "score", *part.schema.names[more:]])

    named, schema = with_rest(docs, id_col, text_col, rest)
    return named.mapInArrow(run, f"doc_id long, score double{schema}")


def fit_documents(stats: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """Model from document_statistics() and the labels of rows where ``train_rows`` (a condition on doc_id) holds."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & train_rows).distinct()
    return fit(stats.join(known, "doc_id").select("x", "y"))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score every row of docs; labels of rows where ``train_rows`` (a condition on doc_id) holds are learned from."""
    stats = materialized(document_statistics(docs, id_col, text_col))
    return score(stats, fit_documents(stats, labels, train_rows, id_col, label_col))
