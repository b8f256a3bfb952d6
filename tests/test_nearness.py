"""Nearness without pair lists, against brute force, with many copies of one place."""

import math

import numpy as np
import pandas as pd

from panelforge.operators import matching, nearness, suppression


def points(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["m", "id", "x", "y"]).astype({"m": "int64", "id": "int64", "x": "float64", "y": "float64"}))


def some(seed, n, first=0, side=60):
    """Points on whole numbers, so that distances tie, some of them copies."""
    rng = np.random.default_rng(seed)
    return [(int(m), first + k, float(x), float(y)) for k, (m, x, y) in enumerate(zip(rng.integers(0, 2, n), rng.integers(0, side, n), rng.integers(0, side, n)))]


def reach(left, right, radius):
    out = {}
    for m, a, x, y in left:
        out[a] = sorted((d, b) for o, b, u, v in right if o == m and (d := math.sqrt((x - u) * (x - u) + (y - v) * (y - v))) <= radius)
    return out


def test_nearest_and_mutual(spark):
    left, right = some(1, 150), some(2, 40, 1000)
    there, back = reach(left, right, 7.0), reach(right, left, 7.0)
    a, b = points(spark, left), points(spark, right)
    got = {r["a"]: (r["distance"], r["b"], r["second"]) for r in nearness.nearest(a, b, ["m"], 7.0).collect()}
    assert got == {k: (*v[0], v[1][0] if len(v) > 1 else None) for k, v in there.items() if v}
    want = {(k, v[0][1]) for k, v in there.items() if v and back[v[0][1]][0][1] == k}
    assert {(r["a"], r["b"]) for r in nearness.mutual(a, b, ["m"], 7.0).collect()} == want


def test_clusters(spark):
    rows = some(3, 120)
    near = reach(rows, rows, 5.0)
    label = {k: k for k in near}
    while any(label[b] < label[a] for a, v in near.items() for _, b in v):
        label = {a: min(label[b] for _, b in v) for a, v in near.items()}
    assert {r["id"]: r["component"] for r in matching.clusters(points(spark, rows), ["m"], 5.0).collect()} == label


def test_greedy_by_regions(spark):
    left, right = some(4, 150), some(5, 60, 1000)
    near, used, want = reach(left, right, 3.0), set(), set()
    for a in sorted(near):
        free = [(d, -b) for d, b in near[a] if b not in used]
        if free:
            used.add(-min(free)[1])
            want.add((a, -min(free)[1]))
    for most in (10**6, 10):
        assert {(r["a"], r["b"]) for r in matching.greedy_near(points(spark, left), points(spark, right), ["m"], 3.0, most).collect()} == want


def test_places_with_very_many_copies(spark):
    """40,000 points at two places: 4 * 10^8 pairs lie in reach."""
    rows = [(0, k, float(k % 2) * 3, 0.0) for k in range(40_000)]
    p = points(spark, rows)
    assert nearness.mutual(p, p, ["m"], 5.0).count() == 2
    assert matching.nearest_neighbour(p, ["m"], 5.0).where("distance = 0").count() == 40_000
    assert matching.clusters(p, ["m"], 5.0).where("component = 0").count() == 40_000
    assert matching.frame_links(p.withColumn("f", p["id"] % 2), ["m"], "f", 5.0).count() == 1
    other = p.selectExpr("m", "id + 100000 AS id", "x", "y")
    assert matching.match_by_id_or_near(p, other, ["m"], 1.0).count() == 40_000


def test_better_point_of_a_cell_in_which_it_is_not_the_best(spark):
    """Best first: 1 stays and beats 2, so 3 (in 2's cell) stays and beats 4. In the first round 4 meets no better best of a cell."""
    rows = [(0, 1, -45.0, 1.0, 60.0, 9), (0, 2, 1.0, 1.0, 60.0, 8), (0, 3, 47.0, 1.0, 60.0, 7), (0, 4, 100.0, 1.0, 60.0, 6)]
    df = spark.createDataFrame(rows, "m long, id long, x double, y double, r double, score long")
    assert sorted(r["id"] for r in suppression.suppressed(df, ["m"], 1.2).collect()) == [1, 3]


def test_change_points_over_zero(spark):
    """A median of zero before a change is no error: there is no ratio."""
    from panelforge.operators import events

    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([0.0, 0.0, 1.0, 1.0, 8.0, 8.0])], "m long, t long, v double")
    got = events.change_points(df, ["m"], "t", "v", 2, 1.5).collect()
    assert [(r["t"], r["change"]) for r in got] == [(3, math.log(9.0))]


def test_change_points_over_zero_equal_sql(spark, tmp_path):
    """Single readings of zero at the start, at the end and in a row: the query's changes are infinite or NaN as in its SQL."""
    import datetime

    import __spark_entry__ as entry
    from tests.oracle import run_sql, same_kind

    series = [[0.0, 5.0, 5.0, 5.0, 9.0], [7.0, 7.0, 7.0, 0.0], [0.0, 0.0, 0.0, 0.0, 0.0, 3.0, 3.0, 3.0], [4.0, 4.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0, 9.0], [-2.0, 4.0, 4.0, 4.0]]
    rows = [(100 * u + k, datetime.datetime(2024, 1, 1 + k, 12), u, "view", v, '{"k": 1}') for u, vs in enumerate(series) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    columns, want = run_sql(entry.oracle_sql()["change_points"].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet/*.parquet')"))
    assert {r[columns.index("change")] for r in want} >= {math.inf, -math.inf}
    same_kind(entry.queries()["change_points"](spark, str(tmp_path)), columns, want)


def test_paths_are_scored_across_batches(spark):
    """Each path once, though its rows are cut by the end of a batch."""
    from panelforge.operators import hypotheses
    from panelforge.session import ship

    ship(spark)
    rng = np.random.default_rng(6)
    rows = [(e, p, t, [0.0, *map(float, rng.integers(-5, 9, 5))], float(rng.random()), 0.5) for e in range(6) for p in range(3) for t in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(rows, "e long, p long, t long, gains array<double>, near double, ridge double")
    want = {}
    for e, p in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == (e, p)]
        want[e, p] = hypotheses.score(np.array([r[3] for r in own]), np.array([r[4] for r in own]), 0.5)["score"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = hypotheses.scored(df, ["e"], "p", "t").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r["e"], r["p"]): r["score"] for r in got} == want


def test_optimal_matches_without_a_list_of_pairs(spark, monkeypatch):
    """Matches and margins are those over all listed pairs, and no pair of points is joined."""
    from panelforge.session import ship

    ship(spark)
    left, right = some(7, 90), some(8, 40, 1000)
    pairs = spark.createDataFrame([(next(r[0] for r in left if r[1] == a), a, b, d) for a, v in reach(left, right, 12.0).items() for d, b in v], "m long, a long, b long, distance double")
    rows = lambda df: {(r["m"], r["a"], r["b"], round(r["distance"], 9), round(r["margin"], 6)) for r in df.collect()}
    want = rows(matching.optimal_match(pairs, ["m"], 15.0, 0.5))
    monkeypatch.setattr(matching, "pairs_within", None)
    for most in (10**6, 10):
        got = rows(matching.optimal_near(points(spark, left), points(spark, right), ["m"], 12.0, 15.0, 0.5, most))
        assert len(got) > 5 and got == want
