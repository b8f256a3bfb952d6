"""Operators against brute force and known answers, where SQL does not state them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import geometry, text, units
from panelforge.operators import curves, matching, optimize, review, routes, sampling, suppression, survival
from panelforge.session import ship
from panelforge.sources import readers, writers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("t,lo,hi,want", [(500, 300, 600, 0), (300, 300, 600, 0), (250, 300, 600, -50), (700, 300, 600, 100), (10, None, 600, 0)])
def test_interval_distance(spark, t, lo, hi, want):
    got = one(spark, survival.interval_distance(F.lit(t), F.lit(lo).cast("int"), F.lit(hi)))
    assert got == want


@pytest.mark.parametrize("first,n,want", [(20, 176, [26, 70, 122, 174]), (68, 176, [74, 122, 174]), (173, 176, [])])
def test_planned_bins(spark, first, n, want):
    assert one(spark, sampling.planned_bins(F.lit(first).cast("long"), F.lit(n).cast("long"))) == want


@pytest.mark.parametrize("rows,want", [
    ([(0, 10), (0, 10), (10, 20), (20, None)], {(0, 10): 0.5, (10, 20): 0.25, (20, None): 0.25}),
    ([(0, 10), (5, 15)], {(5, 10): 1.0}),
    ([(None, 3), (None, 3)], {(None, 3): 1.0}),
])
def test_turnbull_known_answers(spark, rows, want):
    df = spark.createDataFrame([("g", None if a is None else float(a), None if b is None else float(b)) for a, b in rows], "k string, lo double, hi double")
    got = {(r["q"], r["p"]): r["mass"] for r in survival.turnbull(df, ["k"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_turnbull_likelihood_is_a_maximum(spark):
    rng = np.random.default_rng(1)
    lo = rng.integers(0, 10, 30).astype(float)
    hi = lo + rng.integers(1, 6, 30)
    got = survival.turnbull(spark.createDataFrame([("g", a, b) for a, b in zip(lo.tolist(), hi.tolist())], "k string, lo double, hi double"), ["k"]).collect()
    q, p, mass = (np.array(x) for x in zip(*((r["q"], r["p"], r["mass"]) for r in got)))
    holds = (lo[:, None] <= q) & (p <= hi[:, None])
    best = np.log(holds @ mass).sum()
    for _ in range(200):
        other = np.abs(mass + rng.normal(size=len(mass)) * 0.02)
        assert np.log(holds @ (other / other.sum())).sum() <= best + 1e-6


def test_masses_that_do_not_settle_are_an_error():
    first, last = np.array([0, 1, 0]), np.array([1, 2, 2])
    assert abs(survival.self_consistent(first, last, np.ones(3), 3).sum() - 1) < 1e-9
    with pytest.raises(RuntimeError, match="settle"):
        survival.self_consistent(first, last, np.array([1.0, 2.0, 3.0]), 3, most=2)


def test_masses_of_very_many_intervals(spark):
    """Distinct intervals by the ten thousand under one key: no intervals x cells matrix."""
    rng = np.random.default_rng(3)
    lo = rng.random(20_000) * 1000
    rows = spark.createDataFrame([(0, a, a + b) for a, b in zip(lo.tolist(), (0.5 + rng.random(20_000) * 400).tolist())], "k long, lo double, hi double")
    inner = survival.innermost_intervals(rows, ["k"]).withColumn("i", F.row_number().over(Window.orderBy("p")) - 1)
    ranges = survival.cell_ranges(rows, inner, ["k"]).collect()
    cells = inner.orderBy("i").collect()
    q, p = (np.array([r[x] for r in cells]) for x in "qp")
    for r in rng.choice(len(ranges), 50):
        r = ranges[int(r)]
        assert 0 <= r["first"] <= r["last"] < len(q)
    assert sum(r["w"] for r in ranges) == 20_000
    mass = survival.self_consistent(*(np.array([r[x] for r in ranges]) for x in ("first", "last")), np.array([r["w"] for r in ranges], float), len(q), tol=1e-6)
    assert abs(mass.sum() - 1) < 1e-9


def test_isotonic_is_the_min_max_formula():
    rng = np.random.default_rng(2)
    for n in (1, 2, 17):
        y = rng.normal(size=n)
        want = [max(min(y[j : k + 1].mean() for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        assert np.allclose(optimize.isotonic(y), want)


def test_monotone_front_is_optimal(spark):
    rng = np.random.default_rng(3)
    for _ in range(12):
        gains = np.concatenate([np.zeros((5, 1)), np.cumsum(rng.normal(size=(5, 3)), axis=1)], axis=1)
        value = lambda f: sum(gains[t, x] for t, x in enumerate(f))
        front = optimize.monotone_front(gains, 2)
        assert all(0 <= b - a <= 2 for a, b in zip(front, front[1:]))
        best = max(value(f) for f in itertools.product(range(4), repeat=5) if all(0 <= b - a <= 2 for a, b in zip(f, f[1:])))
        assert abs(value(front) - best) < 1e-9
        assert abs(one(spark, optimize.front_score(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in gains]), 3, 2)) - best) < 1e-9


def test_monotone_front_waits_for_what_lasts():
    """A transient at step 4 is left out; growth of a level a step from step 10 is followed."""
    e = np.full((30, 20), -1.0)
    e[4, :6] = 1.0
    for t in range(10, 30):
        e[t, : t - 9] = 1.0
    front = optimize.monotone_front(np.concatenate([np.zeros((30, 1)), np.cumsum(e, axis=1)], axis=1), 2)
    assert front[4] == front[9] == 0 and front[20] == 11 and front[29] == 20


def test_viterbi_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        s = rng.normal(size=(4, 5))
        value = lambda p: sum(s[t, x] for t, x in enumerate(p)) - 0.3 * sum(abs(a - b) for a, b in zip(p, p[1:]))
        ok = [p for p in itertools.product(range(5), repeat=4) if all(abs(a - b) <= 2 for a, b in zip(p, p[1:])) and p[-1] == 1]
        assert abs(value(optimize.viterbi(s, 0.3, 2, 1)) - max(map(value, ok))) < 1e-9


def test_curve_through_checks_known_answers(spark):
    def drawn(curve, first, checks, reach):
        rows = [("a", k, float(v), dict(checks).get(k), first) for k, v in enumerate(curve)]
        df = spark.createDataFrame(rows, "entity string, i long, length double, seen double, first long")
        return np.array([r["length"] for r in curves.through_checks(df, ["entity"], "i", "length", "seen", "first", reach).orderBy("i").collect()])

    model = np.array([max(0, 2.0 * (b - 4)) for b in range(80)])
    got = drawn(model, 5, [(30, 60.0)], 20)
    assert got[30] == 60 and got[20] == model[20] + 4 and got[40] == model[40] + 4
    assert np.array_equal(got[:11], model[:11]) and np.array_equal(got[50:], model[50:]) and (np.diff(got) >= 0).all()
    assert np.array_equal(drawn([1.0, 3, 2, float("nan")], 0, [], 5), [1, 3, 3, 3])
    assert not drawn(model, None, [(30, 60.0)], 20).any() and not drawn(model, 90, [(30, 60.0)], 20).any()
    flat = np.minimum(model, 20.0)  # stops growing at 14: the missing growth is spread from there
    late = drawn(flat, 5, [(60, 100.0)], 20)
    assert late[14] == 20 and abs(late[37] - 60) < 1e-9 and late[60] == 100 and late[79] == 100
    two = drawn(model, 5, [(20, 30.0), (40, 80.0)], 20)
    assert two[20] == 30 and two[40] == 80 and ((two[20:41] >= 30) & (two[20:41] <= 80)).all()
    assert drawn(model, 5, [(20, 50.0), (40, 30.0)], 20)[40] == 50  # a later check is no shorter than an earlier one


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 20, (4, 6)).astype(float)
    got = assign(cost)
    assert len(set(got.tolist())) == 4
    best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(6), 4))
    assert cost[np.arange(4), got].sum() == best


def test_greedy_match_ties_and_order(spark):
    pairs = spark.createDataFrame([(0, 1, 10, 5.0), (0, 1, 11, 5.0), (0, 2, 11, 1.0), (0, 3, 12, 9.0), (1, 1, 10, 2.0)], "m long, a long, b long, distance double")
    got = sorted((r["m"], r["a"], r["b"]) for r in matching.greedy_match(pairs, ["m"]).collect())
    assert got == [(0, 1, 11), (0, 3, 12), (1, 1, 10)]


def test_box_pairs_and_area_equal_brute_force(spark):
    rng = random.Random(5)
    boxes = [(k, *(lambda x, y: (x, y, x + rng.uniform(1, 60), y + rng.uniform(1, 60)))(rng.uniform(-100, 100), rng.uniform(-100, 100))) for k in range(40)]
    df = spark.createDataFrame([(0, *b) for b in boxes], "m long, id long, x0 double, y0 double, x1 double, y1 double")
    s = df.select("m", "id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    got = sorted((r["a"], r["b"]) for r in matching.box_pairs(s, s, ["m"], 25.0).collect())
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert got == want
    area = matching.union_area(df, ["m"]).first()["area"]
    grid = np.zeros((400, 400), bool)
    xs = np.arange(400) - 149.5
    for _, x0, y0, x1, y1 in boxes:
        grid |= ((xs >= x0) & (xs <= x1))[:, None] & ((xs >= y0) & (xs <= y1))[None, :]
    assert abs(area - grid.sum()) < 0.02 * area + 60


def test_pairs_within_equal_brute_force(spark):
    rng = random.Random(6)
    pts = [(k % 2, k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(60)]
    df = spark.createDataFrame(pts, "m long, id long, x double, y double")
    got = {(r["a"], r["b"]) for r in matching.pairs_within(df, df, ["m"], 12.0).collect()}
    assert got == {(a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and np.hypot(a[2] - b[2], a[3] - b[3]) <= 12}


def test_redirects_and_cycles(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(37)], "node long, next long")
    assert {r["target"] for r in review.resolve_redirects(chain).collect()} == {37}
    with pytest.raises(ValueError):
        review.resolve_redirects(spark.createDataFrame([(1, 2), (2, 1)], "node long, next long"))


def test_suppression_and_costs(spark):
    p = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 5), (0, 2, 5.0, 0.0, 10.0, 9), (0, 3, 20.0, 0.0, 10.0, 1), (0, 4, 40.0, 0.0, 10.0, 0)], "m long, id long, x double, y double, r double, score long")
    assert sorted(r["id"] for r in suppression.suppressed(p, ["m"], 1.2).collect()) == [2, 3, 4]
    cells = spark.createDataFrame([(0, x, y, 1.0 + (x == 1 and y < 2) * 50) for x in range(3) for y in range(3)], "m long, x long, y long, price double")
    seeds = spark.createDataFrame([(0, 0, 0)], "m long, x long, y long")
    got = {(r["x"], r["y"]): r["cost"] for r in routes.cheapest_costs(cells, seeds, ["m"]).collect()}
    assert abs(got[2, 0] - (1 + 2 * np.sqrt(2) + 1)) < 1e-9 and got[0, 0] == 0


def test_units_and_text(spark):
    f = lambda v: F.lit(v).cast("double")
    assert one(spark, units.minutes(f(120), f(None))) is None and one(spark, units.time_or_frames(f(120), f(None))) == 120
    assert one(spark, units.duration_seconds(f(None), f(None), f(None))) is None and one(spark, units.duration_seconds(f(1), f(None), f(30))) == 3630
    assert one(spark, units.duration_seconds(f(0), f(0), f(None))) is None
    with pytest.raises(Exception, match="negative"):
        one(spark, units.duration_seconds(f(1), f(-1), f(0)))
    for minutes, words in ((143, "143 min (2 h 23 min)"), (123, "123 min (2 h 03 min)"), (59.4, "59 min"), (59.7, "60 min"), (9.96, "10.0 min"), (3.14, "3.1 min"), (None, "-")):
        assert one(spark, units.format_minutes(f(minutes))) == words
    for seconds, words in ((26_280, "7 h 18 min"), (2700, "45 min"), (2720, "45 min 20 s"), (50, "50 s"), (0, "-"), (None, "-")):
        assert one(spark, units.format_duration(f(seconds))) == words
    for raw, kind in (("3", "int"), ("3.5", "float"), ("True", "bool"), ("a", "text"), ("a,b", "tuple"), ("(1)", "tuple")):
        assert one(spark, text.value_kind(F.lit(raw))) == kind
    assert [one(spark, text.number_text(f(v))) for v in (None, 3.14159, 12.34, -10)] == ["", "3.142", "12.3", "-10.0"]
    assert [one(spark, text.safe_name(F.lit(v))) for v in ("_a b/c_", "..x.y..", "_.!")] == ["a_b_c", "x.y", "movie"]
    phrases = {"touches": "touches {}", "rotates": "turns {}"}
    for flag, words in (("touches:7", "touches 7"), ("rotates:5deg", "turns 5°"), ("path_coverage:0.42", "growth off the tube (42% on it)"), ("no_tube:a_b", "no tube:a b")):
        assert one(spark, text.flag_phrase(F.lit(flag), phrases)) == words


def test_geometry_known_answers(spark):
    path = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (3, 4), (3, 10)]])
    assert one(spark, geometry.path_length(path)) == 11 and abs(one(spark, geometry.straightness(path)) - np.hypot(3, 10) / 11) < 1e-12
    assert one(spark, geometry.path_length(F.slice(path, 1, 1))) == 0 and one(spark, geometry.straightness(F.slice(path, 1, 1))) == 0
    near = one(spark, geometry.projection(path, F.lit(5.0), F.lit(7.0)))
    assert (near["d"], near["s"]) == (2.0, 8.0)
    half = one(spark, geometry.cut_at(geometry.arc_points(path), F.lit(8.0)))
    assert (half[-1]["x"], half[-1]["y"]) == (3.0, 7.0)
    assert one(spark, geometry.wrap_degrees(F.lit(-190.0))) == 170


def test_documents_refuse_another_schema_tag(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("other.v2",)], "schema string").write.json(path)
    with pytest.raises(Exception, match="unexpected schema tag"):
        readers.documents(spark, path, readers.PREDICTIONS, "pred.v1").collect()


def test_scratch_paths_are_new(spark):
    assert writers.scratch(spark) != writers.scratch(spark)


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest one-to-one assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column = row, -1
        while True:
            reduced = np.where(done, np.inf, cost[at] - u[at] - v + (0 if column < 0 else least[column]))
            better = reduced < least
            least[better], back[better] = reduced[better], column
            free = np.where(done, np.inf, least)
            column = int(free.argmin())
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        end = least[column]
        seen = done & (owner >= 0)
        u[owner[seen]] += end - least[seen]
        u[row] += end
        v[done] -= end - least[done]
        while column >= 0:
            before = back[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


@pytest.mark.parametrize("most", [5, 10**6])
def test_matches_are_alike_in_parts(spark, most):
    rng = np.random.default_rng(4)
    rows = sorted({(int(k), int(a), int(b)): float(round(rng.random() * 9, 3)) for k, a, b in zip(rng.integers(0, 2, 60), rng.integers(0, 15, 60), rng.integers(0, 15, 60))}.items())
    pairs = spark.createDataFrame([(*key, x) for key, x in rows], "k long, a long, b long, distance double")
    greedy = set()
    for k in (0, 1):
        used = set()
        for a in range(15):
            near = [(x, -b) for (kk, aa, b), x in rows if kk == k and aa == a and b not in used]
            if near:
                used.add(-min(near)[1])
                greedy.add((k, a, -min(near)[1]))
    assert {(r["k"], r["a"], r["b"]) for r in matching.greedy_match(pairs, ["k"], most).collect()} == greedy
    got = {(r["k"], r["a"], r["b"], round(r["margin"], 6)) for r in matching.optimal_match(pairs, ["k"], 5.0, 0.0, most).collect()}
    for k in (0, 1):
        cost = np.full((15, 30), 5e6)
        cost[np.arange(15), 15 + np.arange(15)] = 5.0
        for (kk, a, b), x in rows:
            if kk == k:
                cost[a, b] = x
        best = assign(cost)
        assert {(k, a, int(b)) for a, b in enumerate(best) if b < 15} == {r[:3] for r in got if r[0] == k}


def test_saves_are_atomic_and_history_grows(spark):
    from panelforge.operators import review

    table = lambda rows: spark.createDataFrame(rows, "uuid long, revision long, kind string, size long")
    old, history = table([(1, 2, "x", 5), (2, 1, "x", 6)]), table([(1, 1, "x", 4), (1, 2, "x", 5), (2, 1, "x", 6), (3, 1, "x", 9), (3, -1, "x", 9)])
    write = lambda rows: spark.createDataFrame(rows, "uuid long, expected long, kind string, size long")
    now, more = review.save(old, history, write([(1, 2, "x", 7), (3, None, "x", 8)]), "uuid", "expected")
    assert {tuple(r) for r in now.collect()} == {(1, 3, "x", 7), (2, 1, "x", 6), (3, 2, "x", 8)} and more.count() == 7
    for bad, options in (([(1, 1, "x", 7), (2, 1, "x", 7)], {}), ([(3, 1, "x", 7)], {}), ([(1, 2, "x", 7), (1, 2, "x", 8)], {}), ([(1, 2, "x", 7)], {"create_only": True})):
        with pytest.raises(ValueError):
            review.save(old, history, write(bad), "uuid", "expected", **options)
    dead = review.delete(now, more, spark.createDataFrame([(1, "x"), (9, "x")], "uuid long, kind string"), "uuid")
    assert {r["uuid"] for r in dead[0].collect()} == {2, 3}
    assert {tuple(r) for r in dead[1].where("revision = -1 AND uuid <> 3").collect()} == {(1, -1, "x", 7), (9, -1, "x", None)}


def test_exclusion_reaches_all_levels_and_circles_end(spark):
    from panelforge.operators import review

    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)] + [(200, 201), (201, 200), (300, 300)], "id long, parent long")
    got = {r["id"]: r["out"] for r in review.excluded_closure(rows, "id", "parent", F.col("id").isin(37, 201), most=9).collect()}
    assert {i for i, out in got.items() if out} == {*range(37, 100), 200, 201} and len(got) == 103


def test_onset_needs_the_tail_above(spark):
    from panelforge.operators import events

    series = {1: [1, 2, 1, 2] + [9] * 12, 2: [1, 2, 1, 2] + [9] * 4 + [1] * 9}
    rows = spark.createDataFrame([(e, i, float(v)) for e, vs in series.items() for i, v in enumerate(vs)], "entity long, bin long, v double")
    rows = events.above_noise(rows, ["entity"], "bin", "v", 4, 1.0, 3.0, 0.25)
    assert {round(r["threshold"], 4) for r in rows.collect()} == {round(1.5 + 3 * 1.4826 * 0.5, 4)}
    got = events.sustained_onset(rows, ["entity"], "bin", F.col("v") > F.col("threshold"), [(2, 0.8), (4, 0.7)], tail=10)
    assert {r["entity"]: r["onset"] for r in got.collect()} == {1: 4, 2: None}
