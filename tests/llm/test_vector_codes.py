"""Vector codes against plain Lloyd rounds."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import queries, vector_codes
from panelforge.session import ship
from tests.oracle import DATA, run_sql, same_kind

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, error string, ids string, of_label string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(3)


def brute(rows, rounds=4):
    """{(vec_id, label, code, error): count} and the hash, every part compared with every entry in every round."""
    kept = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % 4 == 0 and all(v is not None and np.isfinite(v) for v in r[1])]
    if not kept:
        return Counter(), ""
    n = Counter(len(r[1]) for r in kept)
    n = min(n, key=lambda k: (-n[k], k))
    kept = sorted((r for r in kept if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(1024 * np.array([r[1] for r in kept], float)).astype(np.int64).reshape(len(kept), 4, -1)
    book = x[:256].transpose(1, 0, 2).copy()

    def nearest():
        far = ((x[:, :, None, :] - book[None]) ** 2).sum(3)
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(4):
            for e in set(at[:, p].tolist()):
                own = x[at[:, p] == e, p]
                book[p, e] = own.sum(0) // len(own)
    at, far = nearest()
    rows = Counter((r[0], r[2], "".join(f"{e:02x}" for e in a), int(f.sum())) for r, a, f in zip(kept, at, far))
    return rows, hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def clusters(n, dim=16, seed=1, centres=12, noise=0.2):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    return [(i, [float(np.float32(v)) for v in at[i % centres] + noise * rng.normal(size=dim)], i % 5 if i % 11 else None) for i in range(n)]


def ties():
    """Grid points, many copies, ids that repeat or are null, vectors that take no part."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) / 1024 for v in rng.integers(-2, 3, 8)], int(i % 3)) for i in range(700)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], None), (900, rows[8][1], None)]
    return rows + [(901, None, 1), (902, [], 1), (903, [1.0, None] * 4, 1), (904, [float("nan")] * 8, 1), (905, [float("inf")] + [0.0] * 7, 1), (906, [0.0] * 4, 1), (907, [0.0] * 7, 1), (908, [-0.00001] * 8, 2)]


@pytest.mark.parametrize("rows", [clusters(1500), clusters(90, 4), ties(), ties()[-8:-1], []], ids=["clusters", "few", "ties", "odd", "empty"])
def test_codes_equal_plain_rounds(spark, rows, monkeypatch):
    ship(spark)
    codes, book = vector_codes.compress(frame(spark, rows))
    want, digest = brute(rows)
    assert Counter((r["vec_id"], r["label"], r["code"], r["error"]) for r in codes.collect()) == want
    assert (book.sha256() if book else "") == digest
    by = Counter()
    for (_, label, _, error), n in want.items():
        by[label] += error * n
    for most in (0, 100):  # sums joined, sums broadcast
        assert all(r["label_error"] == by[r["label"]] for r in vector_codes.with_label_errors(codes, most).collect())


@pytest.mark.parametrize("centres, noise, most", [(256, 0.01, 0.2), (12, 0.2, 0.9)], ids=["apart", "crowded"])
def test_a_pass_pops_only_what_drift_reached(centres, noise, most):
    """Where entries lie apart hardly any part is looked at again; where many share a cluster most are, and codes stay exact."""
    rows = clusters(4000, centres=centres, noise=noise)
    x = vector_codes.whole(np.array([r[1] for r in rows]))
    book = vector_codes.Book.of(x[:256])
    block = vector_codes.Block(list(range(len(x))), [None] * len(x), x, 256)
    lines = np.zeros((4, 256, 5), np.int64)
    for p in range(4):
        block.scan(p, list(range(len(x))), book, lines[p], True)
    shares = []
    for _ in range(6):
        book.move([(p, e, *lines[p, e].tolist()) for p, e in np.argwhere(lines.any(2)).tolist()])
        block = vector_codes.Block.load(block.row(), 256)
        lines[:] = 0
        popped = 0
        for p in range(4):
            at = block.violated(p, book.drift)
            popped += len(at)
            block.scan(p, at, book, lines[p], False)
            assert (block.codes[p] == vector_codes.distances(block.part(p), book.entries[p]).argmin(1)).all()
            for heap in block.heaps[p]:
                assert all(heap[(i - 1) // 2] <= heap[i] for i in range(1, len(heap)))
        shares.append(popped / (4 * len(x)))
    assert shares[-1] < most and shares[-1] <= shares[0], shares


def test_large_components():
    rng = np.random.default_rng(0)
    x, book = rng.integers(-(2**27), 2**27, (50, 16)), rng.integers(-(2**27), 2**27, (20, 16))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in book] for u in x]
    assert vector_codes.distances(x, book).tolist() == want
    with pytest.raises(ValueError):
        vector_codes.whole(np.array([[2.0**18]]))


def test_intermediate_blocks_are_removed(spark, tmp_path):
    import os

    ship(spark)
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(shared))
    codes, _ = vector_codes.compress(frame(spark, clusters(300)))
    assert len(set(os.listdir(shared)) - before) == 1 and codes.count() == 300


def test_query_equals_sql(spark):
    same_kind(queries.QUERIES["op13_vector_codes"](spark, DATA), *run_sql(queries.ORACLE_SQL["op13_vector_codes"]))
