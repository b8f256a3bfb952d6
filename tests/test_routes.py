"""Routes and suppression against the sequential rules."""

import heapq

import numpy as np
import pytest

from panelforge.operators import routes, suppression
from panelforge.session import ship


def dijkstra(price, starts):
    cost, heap = {}, [(c, xy) for xy, c in starts.items() if xy in price]
    heapq.heapify(heap)
    while heap:
        c, (x, y) = heapq.heappop(heap)
        if (x, y) in cost:
            continue
        cost[x, y] = c
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                n = (x + i, y + j)
                if (i or j) and n in price and n not in cost:
                    heapq.heappush(heap, (c + price[n] * float(np.sqrt(i * i + j * j)), n))
    return cost


@pytest.mark.parametrize("tile", [3, 64])
def test_costs_and_routes_equal_one_search_a_movie(spark, tile):
    ship(spark)
    rng = np.random.default_rng(tile)
    cells, seeds, price, starts = [], [], {}, {}
    for m in range(3):
        for x in range(-4, 9):
            for y in range(10):
                if rng.random() < 0.8:
                    price[m, x, y] = float(rng.integers(1, 9))
                    cells.append((m, x, y, price[m, x, y]))
        for k in range(2):
            x, y = int(rng.integers(-4, 9)), int(rng.integers(0, 10))
            seeds.append((m, x, y, float(k * 5)))
            starts[m, x, y] = min(starts.get((m, x, y), 1e9), float(k * 5))
    seeds.append((0, 500, 500, 0.0))  # off the cells
    cell_df, seed_df = spark.createDataFrame(cells, "m long, x long, y long, price double"), spark.createDataFrame(seeds, "m long, x long, y long, start_cost double")
    costs = routes.cheapest_costs(cell_df, seed_df, ["m"], tile).checkpoint()
    got = {(r["m"], r["x"], r["y"]): r["cost"] for r in costs.collect()}
    want = {(m, *xy): c for m in range(3) for xy, c in dijkstra({k[1:]: v for k, v in price.items() if k[0] == m}, {k[1:]: v for k, v in starts.items() if k[0] == m}).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    targets = [(m, k, x, y) for k, (m, x, y) in enumerate(sorted(price)) if k % 3 == 0]
    paths = {}
    for r in routes.routes(routes.predecessors(costs, seed_df, ["m"]), spark.createDataFrame(targets, "m long, id long, x long, y long"), ["m"]).collect():
        paths.setdefault((r["m"], r["id"]), []).append((r["step"], r["x"], r["y"], r["cost"]))
    assert paths.keys() == {(m, k) for m, k, x, y in targets if (m, x, y) in want}
    for m, k, x, y in targets:
        if (m, k) in paths:
            way = sorted(paths[m, k])
            assert [p[0] for p in way] == list(range(len(way))) and way[-1][1:3] == (x, y)
            total = starts[(m, *way[0][1:3])]
            for (_, ax, ay, _), (_, bx, by, c) in zip(way, way[1:]):
                assert max(abs(ax - bx), abs(ay - by)) == 1
                total += price[m, bx, by] * float(np.hypot(ax - bx, ay - by))
                assert abs(total - c) < 1e-9
            assert abs(total - want[m, x, y]) < 1e-9


def test_prices_are_positive(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0.0)], "m long, x long, y long, price double")
    with pytest.raises(ValueError):
        routes.cheapest_costs(cells, cells.select("m", "x", "y"), ["m"])


def greedy(points, factor):
    kept = []
    for i, x, y, r, s in sorted(points, key=lambda p: (-p[4], p[0])):
        if all(np.sqrt((x - b) ** 2 + (y - c) ** 2) >= factor * min(r, q) for _, b, c, q, _ in kept):
            kept.append((i, x, y, r, s))
    return {p[0] for p in kept}


@pytest.mark.parametrize("spread, radii", [(100, (10, 11)), (30, (4, 16)), (2, (5, 6))])
def test_suppression_equals_one_point_after_another(spark, spread, radii):
    rng = np.random.default_rng(spread)
    points = {m: [(1000 * m + i, float(x), float(y), float(r), int(s)) for i, (x, y, r, s) in enumerate(zip(*(rng.random((2, 150)) * spread).round(2), rng.uniform(*radii, 150).round(2), rng.integers(0, 20, 150)))] for m in range(2)}
    df = spark.createDataFrame([(m, *p) for m, ps in points.items() for p in ps], "m long, id long, x double, y double, r double, score long")
    got = {}
    for r in suppression.suppressed(df, ["m"], 1.2).collect():
        got.setdefault(r["m"], set()).add(r["id"])
    assert got == {m: greedy(ps, 1.2) for m, ps in points.items()}


def test_a_crowd_in_one_place_lists_no_pairs(spark):
    """40,000 points in one spot and its rim: pairs would be 1.6 thousand million."""
    df = spark.range(40_000).selectExpr("0L m", "id", "CASE WHEN id % 1000 = 0 THEN 11.0 ELSE 0.0 END x", "0.0D y", "10.0D r", "id * 7919 % 40009 score")
    kept = {r["id"] for r in suppression.suppressed(df, ["m"], 1.0).collect()}
    assert len(kept) == 2 and sum(k % 1000 == 0 for k in kept) == 1


def test_no_points(spark):
    assert suppression.suppressed(spark.createDataFrame([], "m long, id long, x double, y double, r double, score long"), ["m"], 1.0).count() == 0
