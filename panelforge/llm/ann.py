"""Operator 3: approximate nearest neighbours by multi-index hashing.

Vectors (augmented by one number, so that the largest inner product is the
smallest angle) are turned by rotations learned from a bounded sample
(iterative quantisation) and give ``BITS`` sign bits, split into m 16-bit
substrings. The index is cut into blocks of rows by a hash of the id, and the
queries into blocks too; each pair of blocks is one task, so memory stays bounded
whatever the sizes. In a block every substring has a table from its value
to the rows that hold it. A code within Hamming distance R of the query lies
within R // m of it in one substring at least (the pigeonhole; the first
R % m + 1 substrings are probed to R // m bits, the others to one less), so
looking up these values in the tables returns every such code, and no other row
of the block is touched. Full codes of what the tables return are compared, and
the floats rerank what lies inside the radius r. R is learned from the sample so
that the tables return ``HOLD`` of the true neighbours of ``HOLD`` of its vectors, r likewise; where a
block's tables return fewer than k rows for a query, R grows by m at a time.

How many rows the tables return depends on how near the neighbours are: for
vectors without any structure some fifth of them at 50,000 rows, most of them at
500 (README has the figures), for clustered ones few.

Defined results: vectors null, zero or with null or non-finite components (or
another length than the first vector's) take no part; equal scores go by
smaller id; repeated ids are separate candidates but never their own query's;
equal rows of one query id are one query, different vectors of one id get a list
each; fewer candidates than k are all returned; other columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import smallest

BITS, PART_BITS = 1024, 16
SAMPLE, HOLD, ROUNDS, SEED = 4096, 0.95, 10, 5
INDEX_ROWS, QUERY_ROWS, LEAST = 16384, 16384, 5

#: All 16-bit masks by their number of bits, and how many of them have t bits at most.
MASKS = np.argsort(np.bitwise_count(np.arange(1 << PART_BITS, dtype=np.uint16)), kind="stable").astype(np.uint16)
WITHIN = np.cumsum(np.bincount(np.bitwise_count(MASKS)))


def valid(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return out.where(F.size("v") == dim) if dim else out


def learn(x: np.ndarray, most: float, k: int, rows: int, seed: int = SEED) -> dict:
    """Rotations (each learned by iterative quantisation from another start) and the radius, from sample vectors."""
    rng = np.random.default_rng(seed)
    a = augmented(x, most)
    mean = a.mean(axis=0)
    a = a - mean
    turns = []
    while sum(t.shape[1] for t in turns) < BITS:
        turn = np.linalg.qr(rng.normal(size=(a.shape[1], a.shape[1])))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.sign(a @ turn).T @ a)
            turn = (u @ w).T
        turns.append(turn)
    model = {"mean": mean, "turn": np.concatenate(turns, axis=1)[:, :BITS], "most": most}
    q = rng.permutation(len(x))[:256]
    own, asked = codes(x, model), codes(x[q], model, True)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    take = int(min(len(x) - 1, max(1, -(-k * len(x) // max(1, rows)))))
    if take < 1:
        return model | {"probe": 0, "radius": BITS}
    best = np.argpartition(-near, take - 1, axis=1)[:, :take]
    apart = np.bitwise_count(asked[:, None, :] ^ own[best]).astype(np.int64)
    parts = apart.shape[2]
    # the least R whose probes reach a neighbour: substring j is probed to d bits from m d + j on
    reach = (parts * apart + np.arange(parts)).min(axis=2)
    # HOLD of each query's neighbours, for HOLD of the queries: those far from their neighbours count as much as others
    each = lambda d: int(np.quantile(np.quantile(d, HOLD, axis=1, method="higher"), HOLD, method="higher"))
    return model | {"probe": each(reach), "radius": each(apart.sum(axis=2)) + 1}


def augmented(x: np.ndarray, most: float, query: bool = False) -> np.ndarray:
    """Candidates get sqrt(most^2 - |x|^2), queries 0: inner products stay, and all candidates have one length."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, most * most - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1) / most


def codes(x: np.ndarray, model: dict, query: bool = False) -> np.ndarray:
    """Sign bits as (rows, BITS / 16) uint16."""
    if query:
        x = x * (model["most"] / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    bits = (augmented(x, model["most"], query) - model["mean"]) @ model["turn"] > 0
    return np.packbits(bits, axis=1).view(np.uint16)


class Tables:
    """A table for each substring of the codes of a block: rows in the order of their value, and where each value begins."""

    def __init__(self, own: np.ndarray):
        self.rows, self.parts = own.shape
        self.order = np.empty((self.parts, self.rows), np.int32)
        self.start = np.zeros((self.parts, (1 << PART_BITS) + 1), np.int32)
        for j in range(self.parts):
            self.order[j] = np.argsort(own[:, j], kind="stable")
            np.cumsum(np.bincount(own[:, j], minlength=1 << PART_BITS), out=self.start[j, 1:])
        self.seen = np.zeros(self.rows, bool)

    def probe(self, asked: np.ndarray, radius: int, after: int = -1) -> np.ndarray:
        """Rows that hold a value within the pigeonhole's bits of ``asked`` in one substring; with ``after``, only values not probed for that radius."""
        out = []
        for a, b, t in ((0, radius % self.parts + 1, radius // self.parts), (radius % self.parts + 1, self.parts, radius // self.parts - 1)):
            if t < 0 or a >= b:
                continue
            j = np.arange(a, b)[:, None]
            known = after // self.parts - 1 if after >= 0 else -1
            masks = MASKS[WITHIN[min(known, PART_BITS)] if known >= 0 else 0 : WITHIN[min(t, PART_BITS)]]
            value = (asked[a:b, None] ^ masks).astype(np.int64)
            first = self.start[j, value]
            size = self.start[j, value + 1] - first
            full = np.flatnonzero(size)
            first, size = (first + j * self.rows).ravel()[full], size.ravel()[full]
            flat = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append(self.order.ravel()[flat])
        for rows in out:
            self.seen[rows] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, model: dict, k: int, counts: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, ids and scores of the k best of the block found; counts takes how many rows the tables returned."""
    own, asked = codes(x, model), codes(q, model, True)
    tables = Tables(own)
    whole, goal = own.view(np.uint64), asked.view(np.uint64)
    for i in range(len(q)):
        radius = model["probe"]
        found = tables.probe(asked[i], radius)
        found = found[ids[found] != q_ids[i]]
        while len(found) < k and radius < tables.parts * (PART_BITS + 1):
            radius, last = radius + tables.parts, radius
            more = tables.probe(asked[i], radius, last)
            found = np.union1d(found, more[ids[more] != q_ids[i]])
        if counts is not None:
            counts.append(len(found))
        apart = np.bitwise_count(whole[found] ^ goal[i]).sum(axis=1)
        inside = np.flatnonzero(apart <= model["radius"])
        if len(inside) < LEAST * k:
            inside = np.argsort(apart, kind="stable")[: LEAST * k]
        found = found[inside]
        score = x[found] @ q[i]
        best = np.lexsort((ids[found], -score))[:k]
        yield i, ids[found][best], score[best]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the largest inner products found for each query."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    first = valid(vectors, id_col, vector_col).select(F.size("v").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    x, q = valid(vectors, id_col, vector_col, first["d"]), valid(queries, id_col, vector_col, first["d"])
    size = x.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).alias("most")).first()
    q = q.dropDuplicates(["vec_id", "v"]).withColumn("h", F.xxhash64("v"))
    asked = q.count()
    sample = np.array([r["v"] for r in smallest(x.select(F.xxhash64("v").alias("h"), "v"), "h", SAMPLE).collect()])
    model = spark.sparkContext.broadcast(learn(sample, size["most"], k, size["n"]))
    blocks, query_blocks = max(1, -(-size["n"] // index_rows)), max(1, -(-asked // query_rows))

    def placed(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(n)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = placed(x, "block", blocks, "asks", query_blocks).groupBy("block", "asks")
    right = placed(q, "asks", query_blocks, "block", blocks).groupBy("block", "asks")

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "h", "vec_id", "score"]
        if not len(rows) or not len(asks):
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        got = list(search_block(np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy(), np.stack(asks["v"].to_numpy()), asks["vec_id"].to_numpy(), model.value, k))
        at = np.repeat([i for i, *_ in got], [len(f) for _, f, _ in got])
        return pd.DataFrame(dict(zip(names, (asks["vec_id"].to_numpy()[at], asks["h"].to_numpy()[at], np.concatenate([f for _, f, _ in got]), np.concatenate([s for *_, s in got])))))

    pieces = left.cogroup(right).applyInPandas(meet, "query_id long, h long, vec_id long, score double")
    # k of each block: Spark keeps the k best of each task before it shuffles them
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return pieces.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
