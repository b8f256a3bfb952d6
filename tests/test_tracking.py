"""Assignment, its margins, ranks and tracks against brute force and known answers."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import assignment, ranks, tracking
from panelforge.session import ship

BOX = "m long, frame long, id long, box struct<x0: double, y0: double, x1: double, y1: double>"


def cheapest(edges, alone, credit, banned=None):
    """(cost, pairs) by trying every set of compatible pairs."""
    edges = [e for e in edges if e[:2] != banned]
    rows = sorted({a for a, *_ in edges} | set(alone))
    best = (float("inf"), None)

    def walk(k, used, cost, taken):
        nonlocal best
        if k == len(rows):
            best = min(best, (cost, tuple(taken)), key=lambda x: x[0])
            return
        walk(k + 1, used, cost + alone[rows[k]], taken)
        for a, b, x in edges:
            if a == rows[k] and b not in used:
                walk(k + 1, used | {b}, cost + x - credit, [*taken, (a, b)])

    walk(0, frozenset(), 0.0, [])
    return best


@pytest.mark.parametrize("credit", [0.0, 3.0])
def test_matches_and_margins_equal_all_matchings(credit):
    rng = np.random.default_rng(int(credit))
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        edges = [(a, 10 + b, round(float(rng.random() * 10), 3)) for a in range(n) for b in range(m) if rng.random() < 0.6]
        if not edges:
            continue
        alone = {a: 4.0 for a in {a for a, *_ in edges}}
        pairs = pd.DataFrame(edges, columns=["a", "b", "distance"])
        taken, gaps = assignment.matched(pairs, np.full(len(pairs), 4.0), credit, margins=True)
        want, chosen = cheapest(edges, alone, credit)
        got = [edges[k][:2] for k in taken]
        cost = sum(edges[k][2] - credit for k in taken) + 4.0 * (len(alone) - len(taken))
        assert abs(cost - want) < 1e-9 and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        for pair, gap in zip(got, gaps):
            other, _ = cheapest(edges, alone, credit, pair)
            assert abs(gap - (other - want)) < 1e-9, (edges, pair)


def test_a_long_component_is_solved_quickly():
    """A chain of 4000 pairs in one component."""
    edges = [(k, k + d, 1.0 + 0.1 * ((7 * k + d) % 10)) for k in range(2000) for d in (0, 1)]
    pairs = pd.DataFrame(edges, columns=["a", "b", "distance"])
    taken, _ = assignment.matched(pairs, np.full(len(pairs), 50.0))
    assert len(taken) == 2000


def detections(spark, frames):
    rows = [(0, f, 100 * f + i, (float(x0), 0.0, float(x0 + 10), 10.0)) for f, xs in enumerate(frames) for i, x0 in enumerate(xs)]
    return spark.createDataFrame(rows, BOX)


def sizes(spark, frames, *args):
    ship(spark)
    got = tracking.track(detections(spark, frames), ["m"], "frame", *args).groupBy("track").agg(F.sort_array(F.collect_list("frame")).alias("f")).collect()
    return sorted(r["f"] for r in got)


def test_a_short_gap_keeps_the_track(spark):
    frames = [[0], [2], [], [4]]
    assert sizes(spark, frames, tracking.squared_distance(5), 2, 5.0) == [[0, 1, 3]]
    assert sizes(spark, frames, tracking.squared_distance(5)) == [[0, 1], [3]]
    assert sizes(spark, [[0], [2], [], [], [4]], tracking.squared_distance(5), 2, 5.0) == [[0, 1, 4]]
    assert sizes(spark, [[0], [2], [], [], [], [4]], tracking.squared_distance(5), 2, 5.0) == [[0, 1], [5]]


def test_distant_tips_stay_apart(spark):
    assert sizes(spark, [[0, 90], [2, 88]], tracking.squared_distance(5)) == [[0, 1], [0, 1]]


def test_least_overlap_is_kept(spark):
    assert sizes(spark, [[0], [8]], tracking.box_overlap(0.10)) == [[0, 1]]
    assert sizes(spark, [[0], [8]], tracking.box_overlap(0.20)) == [[0], [1]]


def test_empty_frames_and_bad_parameters(spark):
    ship(spark)
    assert tracking.track(detections(spark, [[], []]), ["m"], "frame", tracking.squared_distance(5), 1).count() == 0
    for bad in (lambda: tracking.squared_distance(0), lambda: tracking.box_overlap(1.0), lambda: tracking.track(detections(spark, [[0]]), ["m"], "frame", tracking.box_overlap(0.5), 2)):
        with pytest.raises(ValueError):
            bad()


def test_size_estimates_do_not_multiply_over_rounds(spark):
    """Each round of components joins its labels twice: as products of products, Spark's estimates took more and more digits."""
    from panelforge.operators import matching

    ship(spark)
    estimate = lambda df: len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    nodes = spark.range(300)
    edges = nodes.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("b < 300")
    got = matching.components(nodes, edges)
    assert got.where("component = 0").count() == 300 and estimate(got) < 30
    tracks = tracking.track(detections(spark, [[0], [2], [], [4]]), ["m"], "frame", tracking.squared_distance(5), 2, 5.0)
    assert tracks.count() == 3 and estimate(tracks) < 60


def test_only_missing_places_are_marked(spark):
    ship(spark)
    got = tracking.filled(tracking.track(detections(spark, [[0], [], [4]]), ["m"], "frame", tracking.squared_distance(5), 1), ["m"], "frame").orderBy("frame").collect()
    assert [(r["frame"], r["x"], r["method"], r["id"]) for r in got] == [(0, 5.0, "auto", 0), (1, 7.0, "interpolated", None), (2, 9.0, "auto", 200)]


@pytest.mark.parametrize("most", [2, 10**6])
def test_frame_links_equal_all_matchings(spark, most, monkeypatch):
    """The cheapest links of each frame at the frame's own price, also where components are dealt over tasks."""
    from panelforge.operators import matching

    ship(spark)
    rng = np.random.default_rng(8)
    rows = [(int(m), f, 1000 * int(m) + 100 * f + i, (x, y, x + 2, y + 2)) for m in range(2) for f in range(4) for i, (x, y) in enumerate((rng.random((5, 2)) * 12).round(3).tolist())]
    points, at = spark.createDataFrame(rows, BOX), ["m", "frame"]
    metric = tracking.squared_distance(6)
    pairs = tracking.priced(tracking.candidates(points, points.withColumn("frame", F.col("frame") - 1), at, metric, 10.0), at)
    got = {}
    for r in tracking.assigned(pairs, at, most).collect():
        got.setdefault((r["m"], r["frame"]), []).append((r["a"], r["b"]))
    by = {}
    for m, f, a, (x0, y0, *_) in rows:
        for m2, f2, b, (x1, y1, *_) in rows:
            if m == m2 and f2 == f + 1 and (x0 - x1) ** 2 + (y0 - y1) ** 2 <= 36:
                by.setdefault((m, f), []).append((a, b, (x0 - x1) ** 2 + (y0 - y1) ** 2))
    assert set(got) <= set(by)
    for key, edges in by.items():
        costs = sorted(x for *_, x in edges)
        price = 1.05 * costs[int((len(costs) - 1) * 0.9)]
        want, chosen = cheapest(edges, {a: price for a, *_ in edges}, price - costs[0])
        cost = {(a, b): x for a, b, x in edges}
        have = sum(cost[p] - price + costs[0] for p in got.get(key, [])) + price * (len({a for a, *_ in edges}) - len(got.get(key, [])))
        assert abs(have - want) < 1e-6


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(2)
    values = {0: rng.lognormal(0, 6, 30_000), 1: rng.integers(0, 5, 20_000).astype(float), 2: np.array([3.0]), 3: np.array([1.0, 2.0]), None: np.arange(10.0)}
    pdf = pd.concat([pd.DataFrame({"k": pd.array([k] * len(v), "Int64"), "v": v}) for k, v in values.items()])
    df = spark.createDataFrame([(None if pd.isna(k) else int(k), float(v)) for k, v in zip(pdf["k"], pdf["v"])] + [(0, None), (9, None)], "k long, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.31, "c": 0.9, "d": 1.0}
    got = {r["k"]: r for r in ranks.at_ranks(df, ["k"], "v", {n: F.floor((F.col("n") - 1) * q) for n, q in shares.items()}).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        v = np.sort(v)
        assert got[k]["n"] == len(v) and got[k]["least"] == v[0]
        assert all(got[k][n] == v[int((len(v) - 1) * q)] for n, q in shares.items()), k
    assert {r["k"]: r["median"] for r in ranks.median(df, ["k"], "v").collect()} == {k: np.median(v) for k, v in values.items()}


@pytest.mark.parametrize("size", [None, 3.0, 1000.0])
def test_union_area_equals_counted_cells(spark, size):
    from panelforge.operators import matching

    ship(spark)
    rng = np.random.default_rng(5)
    boxes, want = [], {}
    for m in range(3):
        grid = np.zeros((60, 60), bool)
        for _ in range(40):
            x, y, w, h = (int(v) for v in (*rng.integers(-20, 20, 2), *rng.integers(0, 15, 2)))
            boxes.append((m, float(x), float(y), float(x + w), float(y + h)))
            grid[x + 20 : x + w + 20, y + 20 : y + h + 20] = True
        want[m] = float(grid.sum())
    df = spark.createDataFrame(boxes + boxes[:10], "m long, x0 double, y0 double, x1 double, y1 double")
    got = {r["m"]: r["area"] for r in matching.union_area(df, ["m"], size).collect()}
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-6 for m in want)


def test_union_area_of_many_boxes_of_one_key(spark):
    """A hundred thousand boxes that all overlap others: slabs by boxes would be some ten thousand million rows."""
    import time

    from panelforge.operators import matching

    ship(spark)
    df = spark.range(100_000).selectExpr("0L m", "id * 0.01 x0", "id * 7919 % 1000 * 0.1 y0", "id * 0.01 + 5 x1", "id * 7919 % 1000 * 0.1 + 5 y1")
    start = time.time()
    area = matching.union_area(df, ["m"]).first()["area"]
    assert 0.98 * 1005 * 105 < area <= 1005 * 105 and time.time() - start < 90


def test_copies_share_one_solution(spark):
    """Matches of rows with copies cost what they cost with all copies listed, and each row is linked once."""
    ship(spark)
    rng = np.random.default_rng(11)
    for _ in range(60):
        n, m = rng.integers(1, 4, 2)
        edges = [(a, 10 + b, float(rng.integers(0, 8))) for a in range(n) for b in range(m) if rng.random() < 0.8]
        if not edges:
            continue
        na, nb = rng.integers(1, 4, n), rng.integers(1, 4, m)
        pairs = pd.DataFrame([(a, b, x, na[a], nb[b - 10]) for a, b, x in edges], columns=["a", "b", "distance", "na", "nb"])
        taken, gaps, units = assignment.matched_units(pairs, np.full(len(pairs), 4.0), margins=True)
        listed = [(100 * a + i, 100 * b + j, x) for a, b, x in edges for i in range(na[a]) for j in range(nb[b - 10])]
        alone = {a for a, *_ in listed}
        one, margins = assignment.matched(pd.DataFrame(listed, columns=["a", "b", "distance"]), np.full(len(listed), 4.0), margins=True)
        cost = lambda rows, k: sum(x * w for x, w in zip(rows, k)) + 4.0 * (len(alone) - sum(k))
        assert abs(cost(pairs["distance"].to_numpy()[taken], units) - cost([listed[k][2] for k in one], [1] * len(one))) < 1e-9
        assert all(g == 0 for g, k in zip(gaps, taken) if pairs["na"][k] > 1 or pairs["nb"][k] > 1)


def test_frames_of_very_many_copies(spark):
    """3000 copies of each of two detections in two frames: 1.8 * 10^7 pairs may link, and 6000 do."""
    ship(spark)
    rows = [(0, f, 10_000 * f + k, (4.0 * (k % 2) + f, 0.0, 4.0 * (k % 2) + f + 2, 2.0)) for f in (0, 1) for k in range(6000)]
    links = tracking.frame_links(spark.createDataFrame(rows, BOX), ["m"], "frame", tracking.squared_distance(5)).collect()
    assert len({r["a"] for r in links}) == len({r["b"] for r in links}) == len(links) == 6000
    assert all(r["distance"] == 1.0 and r["a"] % 2 == r["b"] % 2 for r in links)


def test_the_cheapest_matching_without_a_list_of_pairs():
    """Few of the pairs in reach are listed, and the result costs what it costs over all of them."""
    from panelforge.operators import nearness

    rng = np.random.default_rng(4)
    for n, m, side, alone, copies in ((300, 290, 40.0, 30.0, 1), (60, 200, 20.0, 2.0, 1), (80, 70, 30.0, 9.0, 3)):
        (ax, ay), (bx, by) = (rng.random((2, k)) * side for k in (n, m))
        na, nb = rng.integers(1, copies + 1, n), rng.integers(1, copies + 1, m)
        d = np.sqrt((ax[:, None] - bx) ** 2 + (ay[:, None] - by) ** 2)
        d[d > 15] = np.inf
        near = lambda turned: nearness.blocks(bx, by, ax, ay, 15.0) if turned else nearness.blocks(ax, ay, bx, by, 15.0)
        got = assignment.solved_near(n, m, lambda i, j: d[np.ix_(i, j)], near, alone, 1.0, na, nb)
        i, j = np.nonzero(d < np.inf)
        whole = assignment.Assignment(i, j, d[i, j] - 1.0, np.full(n, alone), na, nb)
        cost = lambda s: sum((d[r, c] - 1.0) * k for r, held in enumerate(s.held[0]) for c, k in held.items()) + alone * sum(s.lone[0])
        assert abs(cost(got) - cost(whole)) < 1e-6
        assert n < 300 or sum(map(len, got.edges[0])) < len(i) / 2


@pytest.mark.parametrize("metric", [tracking.squared_distance(6), tracking.box_overlap(0.3)])
def test_prices_and_single_pairs_without_a_list(spark, metric):
    """The price of each key is that of the listed candidates, and so are the pairs that have no other candidate."""
    ship(spark)
    rng = np.random.default_rng(3)
    rows = [[(m, 100 * s + k, (x, y, x + w, y + w), int(c)) for m, n, side in ((0, 40, 20.0), (1, 60, 90.0)) for k, (x, y, w, c) in enumerate(zip(*(rng.random((2, n)) * side).round(2).tolist(), rng.integers(4, 7, n).tolist(), 1 + (rng.random(n) < 0.2)))] for s in (0, 1)]
    left, right = (spark.createDataFrame(r, "m long, id long, box struct<x0: double, y0: double, x1: double, y1: double>, n long") for r in rows)
    for most in (10, 10**6):
        met = tracking.meeting(left, right, ["m"], metric, most)
        pairs = tracking.weighed(left, right, ["m"], metric, 10.0)
        want = {(r["m"], r["alone"], r["least"]) for r in tracking.priced(pairs, ["m"]).select("m", "alone", "least").distinct().collect()}
        assert {(r["m"], r["alone"], r["least"]) for r in tracking.priced_meeting(met).collect()} == want
        listed = [(r["m"], r["a"], r["b"], r["na"], r["nb"]) for r in pairs.collect()]
        single = {p[:3] for p in listed if sum(q[4] for q in listed if q[:2] == p[:2]) == 1 and sum(q[3] for q in listed if (q[0], q[2]) == (p[0], p[2])) == 1}
        assert single and {(r["m"], r["a"], r["b"]) for r in tracking.single_pairs(met).collect()} == single


def test_long_chains_settle_in_few_rounds(spark):
    """Labels in no order along a chain: a label takes over what any of its members meets."""
    from panelforge.operators import matching

    ship(spark)
    order = np.random.default_rng(1).permutation(2_000).tolist()
    edges = spark.createDataFrame(pd.DataFrame({"a": order[:-1], "b": order[1:]}))
    got = matching.components(spark.range(2_000), edges)
    assert got.where("component = 0").count() == 2_000
