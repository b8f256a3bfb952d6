"""Operator 13: codes of vectors by product quantisation, codebooks refined by heap Lloyd.

Vectors become integers floor(1024 x) and lie in blocks, each a row of the
table: its vectors, and for each of four parts the entry each vector has, a key
and heaps of the vectors of each entry, least key on top. A key is the lower
bound of the distance to any other entry, minus the upper bound of the distance
to the own one, plus the drift that the entry had gathered when the key was made.
After a round, entry e's gathered drift grows by how far e itself and the
farthest other entry of its part moved; a vector whose key lies above it surely
keeps its entry. So a pass pops only the tops at or below the drift, compares
these vectors with all entries exactly (integers, ties to the lower index), and
pushes them onto the heap of the entry they get; entries' sums change by what
moved.

A pass is one map over blocks. Blocks go to the shared folder, where the next
pass, and whoever replaces a lost executor, reads them; the pass before the last
is deleted. What reaches the driver is the codebook's sums: entries x parts
lines, added up by Spark.

Defined results: vectors that are null or hold null or non-finite components
have no code; the codebook has as many entries as there are vectors, if fewer
than 256; the smallest ids (nulls last) make it, equal ids in order of their
vectors; repeated rows each have their code; vectors whose length is not the
most frequent one divisible by four (ties to the shorter) have no code; an empty
table gives no rows; components of 2^17 and more are an error, since sums of
their squares would not stay whole numbers of 64 bits; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import dropped, materialized

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK = 4, 256, 4, 1024, 4096
LARGEST = 1 << 27
#: Whole numbers below this bound are exact in float64, whose products are faster.
EXACT = 1 << 53
_STATE = "ids array<long>, labels array<long>, vectors binary, codes binary, keys binary, heaps binary, part int, entry int, line array<long>"
_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema(
    [("ids", _LONGS), ("labels", _LONGS), *[(c, pa.binary()) for c in ("vectors", "codes", "keys", "heaps")], ("part", pa.int32()), ("entry", pa.int32()), ("line", _LONGS)]
)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, x of the vectors that take part."""
    at = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    at = at.where(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % PARTS == 0) & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    length = at.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return at.where(F.size("x") == F.lit(length["n"] if length else 0))


def whole(x: np.ndarray) -> np.ndarray:
    out = np.floor(SCALE * x)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError("a vector's component is too large for exact codes")
    return out.astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors (n, d) from entries (k, d)."""
    most = max(int(np.abs(a).max(initial=0)) for a in (x, book))
    kind = np.float64 if 4 * most * most * x.shape[1] < EXACT else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


@dataclass
class Book:
    """Entries (part, entry, component), their sums and counts, and the drift that each has gathered."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    drift: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Book:
        n, d = vectors.shape
        entries = vectors.reshape(n, PARTS, d // PARTS).transpose(1, 0, 2).copy()
        return cls(entries, np.zeros_like(entries), np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n)))

    def move(self, changes: list) -> None:
        """Add up what moved and put entries at their vectors' floored means."""
        for part, entry, *line in changes:
            self.counts[part, entry] += line[0]
            self.sums[part, entry] += line[1:]
        used = self.counts > 0
        new = np.where(used[..., None], self.sums // np.maximum(self.counts, 1)[..., None], self.entries)
        far = np.sqrt(((new - self.entries) ** 2).sum(2).astype(np.float64))
        self.entries = new
        if far.shape[1] > 1:
            first, second = -np.sort(-far, axis=1)[:, :2].T
            other = np.where((far == first[:, None]) & (np.arange(far.shape[1]) == far.argmax(1)[:, None]), second[:, None], first[:, None])
            self.drift += far + other

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Block:
    """Vectors of one block with their codes, keys and heaps."""

    def __init__(self, ids: list, labels: list, vectors: np.ndarray, entries: int):
        n = len(ids)
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.codes, self.keys = np.zeros((PARTS, n), np.uint8), np.zeros((PARTS, n))
        self.heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(entries)] for _ in range(PARTS)]

    @classmethod
    def load(cls, row: dict, entries: int) -> Block:
        ids = row["ids"]
        out = cls(ids, row["labels"], np.frombuffer(row["vectors"], "<i4").reshape(len(ids), -1).astype(np.int64), entries)
        out.codes = np.frombuffer(row["codes"], np.uint8).reshape(PARTS, -1).copy()
        out.keys = np.frombuffer(row["keys"], "<f8").reshape(PARTS, -1).copy()
        order = np.frombuffer(row["heaps"], "<i4").reshape(PARTS, -1)
        for p in range(PARTS):  # each entry's stretch lies in heap order
            members = list(zip(out.keys[p][order[p]].tolist(), order[p].tolist()))
            ends = np.cumsum(np.bincount(out.codes[p], minlength=entries)).tolist()
            out.heaps[p] = [members[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def row(self) -> dict:
        order = np.array([[i for heap in heaps for _, i in heap] for heaps in self.heaps], "<i4")
        return {
            "ids": self.ids, "labels": self.labels, "vectors": self.vectors.astype("<i4").tobytes(), "codes": self.codes.tobytes(),
            "keys": self.keys.astype("<f8").tobytes(), "heaps": order.tobytes(), "part": None, "entry": None, "line": None,
        }

    def part(self, p: int) -> np.ndarray:
        d = self.vectors.shape[1] // PARTS
        return self.vectors[:, p * d : (p + 1) * d]

    def violated(self, p: int, drift: np.ndarray) -> list[int]:
        """Take the vectors whose key the entry's drift has reached off their heaps (rounding errs to their side)."""
        out = []
        for e, heap in enumerate(self.heaps[p]):
            reach = drift[p, e] * (1 + 1e-12) + 1e-6
            while heap and heap[0][0] <= reach:
                out.append(heapq.heappop(heap)[1])
        return out

    def scan(self, p: int, at: list[int], book: Book, lines: np.ndarray, fresh: bool) -> None:
        """Give the vectors ``at`` their nearest entries; lines (entry; count and sums) change by what moved."""
        if not at:
            return
        places = np.array(at)
        x = self.part(p)[places]
        far = distances(x, book.entries[p])
        new = far.argmin(1)
        nearest = far[np.arange(len(at)), new]
        far[np.arange(len(at)), new] = np.iinfo(np.int64).max
        gap = np.sqrt(far.min(1).astype(np.float64)) - np.sqrt(nearest.astype(np.float64))
        self.keys[p, places] = gap + book.drift[p, new]
        moved = np.ones(len(at), bool) if fresh else new != self.codes[p, places]
        if not fresh:
            np.subtract.at(lines[:, 0], self.codes[p, places[moved]], 1)
            np.subtract.at(lines[:, 1:], self.codes[p, places[moved]], x[moved])
        np.add.at(lines[:, 0], new[moved], 1)
        np.add.at(lines[:, 1:], new[moved], x[moved])
        self.codes[p, places] = new
        for i, e, key in zip(at, new.tolist(), self.keys[p, places].tolist()):
            heapq.heappush(self.heaps[p][e], (key, i))

    def errors(self, book: Book) -> np.ndarray:
        return sum(((self.part(p) - book.entries[p][self.codes[p]]) ** 2).sum(1) for p in range(PARTS))


def _blocks(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[Block]:
    """Blocks of a split's vectors."""
    ids, labels, xs = [], [], []

    def made() -> Block:
        return Block(ids, labels, np.concatenate(xs), entries)

    for batch in batches:
        x = batch.column("x")
        x = whole(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)) if len(x) else np.zeros((0, 0), np.int64)
        some_ids, some_labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        for at in range(0, len(x), BLOCK):
            ids += some_ids[at : at + BLOCK]
            labels += some_labels[at : at + BLOCK]
            xs.append(x[at : at + BLOCK])
            if len(ids) >= BLOCK:
                yield made()
                ids, labels, xs = [], [], []
    if ids:
        yield made()


def _passed(blocks: Iterator[Block], book: Book, fresh: bool, lines: np.ndarray) -> Iterator[Block]:
    for block in blocks:
        for p in range(PARTS):
            block.scan(p, list(range(len(block.ids))) if fresh else block.violated(p, book.drift), book, lines[p], fresh)
        yield block


def _pass(state: DataFrame, book: Book, fresh: bool = False) -> DataFrame:
    """Blocks with every vector at its nearest entry, and a line for each entry whose members a task changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, k, d = book.entries.shape
        lines = np.zeros((PARTS, k, 1 + d), np.int64)
        blocks = _blocks(batches, k) if fresh else (Block.load(r, k) for b in batches for r in _rows(b))
        for block in _passed(blocks, book, fresh, lines):
            yield pa.RecordBatch.from_pylist([block.row()], _ARROW)
        changed = [{"part": p, "entry": e, "line": lines[p, e].tolist()} for p, e in np.argwhere(lines.any(2)).tolist()]
        if changed:
            yield pa.RecordBatch.from_pylist(changed, _ARROW)

    return (state if fresh else state.where("part IS NULL")).mapInArrow(run, _STATE)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def _changes(state: DataFrame, width: int) -> list:
    sums = [F.sum(F.get("line", F.lit(i))).alias(f"s{i}") for i in range(width)]
    return state.where("part IS NOT NULL").groupBy("part", "entry").agg(*sums).collect()


def _last(state: DataFrame, book: Book) -> DataFrame:
    """vec_id, label, code, error: each vector at its nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, k, d = book.entries.shape
        lines = np.zeros((PARTS, k, 1 + d), np.int64)
        for block in _passed((Block.load(r, k) for b in batches for r in _rows(b)), book, False, lines):
            code = [c.tobytes().hex() for c in block.codes.T]
            columns = [pa.array(block.ids, pa.int64()), pa.array(block.labels, pa.int64()), pa.array(code), pa.array(block.errors(book), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return state.where("part IS NULL").mapInArrow(run, "vec_id long, label long, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Book | None]:
    """(vec_id, label, code, error) of each vector that takes part, in shared storage, and the codebooks."""
    at = valid(vectors, id_col, vector_col, label_col)
    first = at.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    if not first:
        return at.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    book = Book.of(whole(np.array([r["x"] for r in first])))
    width = 1 + book.entries.shape[2]
    state = materialized(_pass(at, book, fresh=True))
    for k in range(rounds):
        book.move(_changes(state, width))
        if k < rounds - 1:
            old, state = state, materialized(_pass(state, book))
            dropped(old)
    out = materialized(_last(state, book))
    dropped(state)
    return out, book


def with_label_errors(codes: DataFrame, most: int = 100_000) -> DataFrame:
    """label_error beside each row: errors summed over equal labels, nulls together. Few labels (counted) are broadcast, many joined."""
    sums = materialized(codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= most:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
