"""Optimisers, filters over series and state machines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import curves, flood, hypotheses, lattice, matching, optimize, registration, routes, suppression
from panelforge.operators import events as ev
from panelforge.plans.base import BASE, KEYS, c, day_bins, query, readings, table, unranked
from panelforge.sources import exports, writers


LEVELS = 10


def gains(s, d):
    """entity, bin, gains: evidence (readings over 100, by level k div 10) behind a front at each of the levels 0 to 10."""
    e = unranked(s, d).groupBy("entity", "bin", F.expr("k div 10").alias("level")).agg((F.sum(F.round("value")) - 100 * F.count("*")).alias("e"))
    level = [F.sum(F.when(c("level") == k, c("e")).otherwise(0.0)) for k in range(LEVELS)]
    rows = [F.lit(0.0)]
    for x in level:
        rows.append(rows[-1] + x)
    return e.groupBy("entity", "bin").agg(F.array(*rows).alias("gains"))


DP = BASE.replace("WITH r", "WITH RECURSIVE r", 1) + """, y AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY bin) - 1 AS i, gains FROM (SELECT entity, bin, [""" + ", ".join(f"coalesce(sum(round(value) - 100) FILTER (k < {10 * f}), 0)::DOUBLE" for f in range(11)) + """] AS gains FROM r GROUP BY 1, 2)),
dp AS (SELECT entity, 0::BIGINT AS i, list_transform(range(0, 11), lambda f: 0.0::DOUBLE) AS sc FROM y WHERE i = 0
  UNION ALL SELECT y.entity, dp.i + 1, list_transform(range(0, 11), lambda f: y.gains[f + 1] + list_max(list_slice(dp.sc, greatest(f - 2, 0) + 1, f + 1))) FROM dp JOIN y ON y.entity = dp.entity AND y.i = dp.i)"""


@query("2.11-1", DP + " SELECT entity, round(list_max(arg_max(sc, i)), 9) AS score FROM dp GROUP BY 1")
def front_score(s, d):
    y = optimize.series(gains(s, d), KEYS, "bin", "gains")
    return y.select("entity", optimize.front_score(c("ys"), LEVELS, 2).alias("score"))


FRONT = (
    DP.replace("AS sc FROM y WHERE i = 0", "AS sc, CAST([] AS BIGINT[][]) AS back FROM y WHERE i = 0").replace(
        " FROM dp JOIN y",
        ", list_append(dp.back, list_transform(range(0, 11), lambda f: greatest(f - 2, 0) + list_position(list_slice(dp.sc, greatest(f - 2, 0) + 1, f + 1), "
        "list_max(list_slice(dp.sc, greatest(f - 2, 0) + 1, f + 1))) - 1)) FROM dp JOIN y",
    )
    + """, fin AS (SELECT entity, max(i) AS n, arg_max(back, i) AS back, arg_max(sc, i) AS sc FROM dp GROUP BY 1),
tr AS (SELECT entity, n - 1 AS i, list_position(sc, list_max(sc)) - 1 AS front FROM fin UNION ALL SELECT t.entity, t.i - 1, f.back[t.i + 1][t.front + 1] FROM tr t JOIN fin f ON f.entity = t.entity WHERE t.i > 0),
pos AS (SELECT entity, bin, row_number() OVER (PARTITION BY entity ORDER BY bin) - 1 AS i FROM (SELECT DISTINCT entity, bin FROM r))
SELECT tr.entity, pos.bin, CAST(tr.front AS BIGINT) AS front FROM tr JOIN pos ON pos.entity = tr.entity AND pos.i = tr.i"""
)


@query("2.11-1", FRONT)
def monotone_front(s, d):
    return optimize.per_entity(gains(s, d), KEYS, "bin", lambda p: {"bin": p["bin"].to_numpy(), "front": optimize.monotone_front(np.stack(p["gains"].to_numpy()), 2)}, "bin long, front long")


@query("2.11-2")
def angle_track(s, d):
    b = day_bins(s, d).select("entity", "bin", "v")

    def track(p):
        score = np.cos(np.radians(p["v"].to_numpy()[:, None] - np.arange(0, 360, 15)))
        return {"bin": p["bin"].to_numpy(), "angle": optimize.viterbi(score, 0.1, 3, 0) * 15}

    return optimize.per_entity(b, KEYS, "bin", track, "bin long, angle long")


#: Evidence of 24 directions in each bin, the first and the last bin pinned to the direction of their own value.
ANGLES = (
    BASE.replace("WITH r", "WITH RECURSIVE r", 1)
    + """, a AS (SELECT entity, i, v, max(i) OVER (PARTITION BY entity) AS last FROM b),
e AS (SELECT entity, i, last, CASE WHEN i IN (0, last) THEN list_transform(range(0, 24), lambda s: CASE WHEN s = CAST(floor(v / 15) AS BIGINT) % 24 THEN 1 - abs(v - 15 * s) / 360 ELSE '-infinity'::DOUBLE END)
  ELSE list_transform(range(0, 24), lambda s: 1 - abs(v - 15 * s) / 360) END AS sc FROM a),
dp AS (SELECT entity, i, sc AS tot, CAST([] AS BIGINT[][]) AS back FROM e WHERE i = 0
  UNION ALL SELECT entity, i, list_transform(opt, lambda o, s: list_max(o) + sc[s]), list_append(back, list_transform(opt, lambda o: list_position(o, list_max(o)) - 1)) FROM (
    SELECT e.entity, e.i, e.sc, dp.back, list_transform(range(0, 24), lambda s: list_transform(dp.tot, lambda t, p: CASE WHEN abs(p - 1 - s) <= 3 THEN t - 0.125 * abs(p - 1 - s) ELSE '-infinity'::DOUBLE END)) AS opt
    FROM dp JOIN e ON e.entity = dp.entity AND e.i = dp.i + 1)),
fin AS (SELECT entity, max(i) AS n, arg_max(back, i) AS back, arg_max(tot, i) AS tot FROM dp GROUP BY 1),
tr AS (SELECT entity, n AS i, list_position(tot, list_max(tot)) - 1 AS s FROM fin UNION ALL SELECT t.entity, t.i - 1, f.back[t.i][t.s + 1] FROM tr t JOIN fin f ON f.entity = t.entity WHERE t.i > 0)
SELECT tr.entity, b.bin, CAST(15 * s AS BIGINT) AS angle FROM tr JOIN b ON b.entity = tr.entity AND b.i = tr.i"""
)


@query("2.11-2", ANGLES)
def anchored_angles(s, d):
    b = day_bins(s, d).select("entity", "bin", "v")

    def track(p):
        v = p["v"].to_numpy()
        score = 1 - np.abs(v[:, None] - np.arange(0, 360, 15)) / 360
        pins = {t: int(v[t] // 15) % 24 for t in (0, len(v) - 1)}
        return {"bin": p["bin"].to_numpy(), "angle": lattice.anchored(score, 0.125, 3, pins) * 15}

    return optimize.per_entity(b, KEYS, "bin", track, "bin long, angle long")


TRAJECTORY = lattice.Trajectory(start=2.0, reach=60.0)
#: Totals of all candidates in turn, each over all earlier ones; then the path back from the cheapest end.
TRAJECTORIES = (
    BASE.replace("WITH r", "WITH RECURSIVE r", 1)
    + """, c AS (SELECT entity, bin, event_id AS id, round(value / 10) AS l, k AS x, (k % 7 - 4) / 4.0::DOUBLE AS u, row_number() OVER (PARTITION BY entity ORDER BY bin, event_id) AS j FROM r WHERE event_type IN ('view', 'click')),
a AS (SELECT entity, list(bin ORDER BY j) AS bs, list(l ORDER BY j) AS ls, list(x ORDER BY j) AS xs, list(u ORDER BY j) AS us, list(id ORDER BY j) AS ids, count(*) AS n, min(bin) AS first, max(bin) AS last FROM c GROUP BY 1),
dp AS (SELECT entity, 0::BIGINT AS j, CAST([] AS DOUBLE[]) AS tot, CAST([] AS BIGINT[]) AS back FROM a
  UNION ALL SELECT entity, j + 1, list_append(tot, list_min(opt) + u), list_append(back, list_position(opt, list_min(opt)) - 1) FROM (
    SELECT d.*, a.us[d.j + 1] AS u, list_prepend({start} + {far} * greatest(0.0, a.ls[d.j + 1] - {first}), list_transform(range(1, d.j + 1), lambda q: CASE
      WHEN a.bs[q] < a.bs[d.j + 1] AND a.ls[d.j + 1] - a.ls[q] >= -{shrink} AND a.ls[d.j + 1] - a.ls[q] <= {speed} * (a.bs[d.j + 1] - a.bs[q]) AND abs(a.xs[d.j + 1] - a.xs[q]) <= {reach}
      THEN d.tot[q] + {hold} * (a.bs[d.j + 1] - a.bs[q] - 1) + CASE WHEN a.bs[d.j + 1] - a.bs[q] > 1 THEN {again} ELSE 0 END + {slope} * greatest(0.0, a.ls[q] - a.ls[d.j + 1])
        + {pull} * greatest(0.0, abs(a.xs[d.j + 1] - a.xs[q]) - {free})
      ELSE 'infinity'::DOUBLE END)) AS opt
    FROM dp d JOIN a ON a.entity = d.entity AND d.j < a.n)),
fin AS (SELECT a.entity, back, list_prepend(0.0, list_transform(range(1, n + 1), lambda q: tot[q] + {hold} * (last - bs[q]))) AS ends FROM dp JOIN a ON a.entity = dp.entity AND dp.j = a.n),
tr AS (SELECT entity, list_position(ends, list_min(ends)) - 1 AS j FROM fin UNION ALL SELECT t.entity, f.back[t.j] FROM tr t JOIN fin f ON f.entity = t.entity WHERE t.j > 0),
rd AS (SELECT t.entity, a.bs[t.j] AS bin, a.ids[t.j] AS id, a.ls[t.j] AS length FROM tr t JOIN a ON a.entity = t.entity WHERE t.j > 0),
g AS (SELECT entity, unnest(range(first, last + 1)) AS bin FROM a),
h AS (SELECT g.entity, g.bin, rd.id, last_value(rd.length IGNORE NULLS) OVER (PARTITION BY g.entity ORDER BY g.bin) AS length FROM g LEFT JOIN rd ON rd.entity = g.entity AND rd.bin = g.bin)
SELECT h.entity, h.bin, CASE WHEN id IS NOT NULL THEN 'read' WHEN length IS NOT NULL THEN 'held' ELSE 'none' END AS state, id, length, list_min(ends) AS total FROM h JOIN fin ON fin.entity = h.entity""".format(**vars(TRAJECTORY))
)


@query("2.11-3", TRAJECTORIES)
def candidate_trajectories(s, d):
    e = unranked(s, d).where("event_type IN ('view', 'click')")
    e = e.select("entity", "bin", c("event_id").alias("id"), F.round(c("value") / 10).alias("length"), c("k").cast("double").alias("x"), F.lit(0.0).alias("y"), ((c("k") % 7 - 4) / 4.0).alias("cost"))
    return lattice.trajectories(e, KEYS, TRAJECTORY)


@query("2.11-12")
def joint_cap_states(s, d):
    """Two neighbouring owners at a time, some caps of one being in reach of the other too."""
    e = unranked(s, d).where("event_type IN ('view', 'click')").select("entity", c("bin").alias("frame"), c("event_id").alias("cap"), (c("value") / 10).alias("x"), c("k").cast("double").alias("y"))
    pair = F.floor(c("entity") / 2) * 2
    own = e.select(c("entity").alias("owner"), "frame", "cap", "x", "y", (c("y") / 64).alias("score"))
    other = e.where("cap % 3 = 0").select((2 * pair + 1 - c("entity")).alias("owner"), "frame", "cap", "x", "y", (c("y") / 96).alias("score"))
    both = own.unionByName(other)
    frames = e.select(pair.alias("pair"), "frame").distinct()
    none = frames.select(F.explode(F.array("pair", c("pair") + 1)).alias("owner"), "frame", F.lit(None).cast("long").alias("cap"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("score"))
    return lattice.joint(both.unionByName(none), lattice.Joint(beam=1024))


STATES = (
    BASE.replace("WITH r", "WITH RECURSIVE r", 1)
    + """, dp AS (SELECT entity, 0::BIGINT AS j, [0.0, -1e18, -1e18] AS tot, CAST([] AS BIGINT[][]) AS back, 0.0::DOUBLE AS last FROM b WHERE i = 0
  UNION ALL SELECT entity, j + 1, list_transform(opt, lambda o, s: list_max(o) + gain[s]), list_append(back, list_transform(opt, lambda o: list_position(o, list_max(o)) - 1)), keep FROM (
    SELECT d.entity, d.j, d.back, [[d.tot[1], -1e18, -1e18], d.tot, [-1e18, d.tot[2], d.tot[3]]] AS opt, CASE WHEN n >= 2 THEN length WHEN d.j = 0 THEN length ELSE d.last END AS keep,
      [CASE WHEN n >= 2 THEN -0.6 ELSE -0.0 END, CASE WHEN n >= 2 THEN 1.0 - CASE WHEN d.j = 0 THEN 0 ELSE greatest(0.0, abs(length - d.last) - 60.0) END ELSE -1e18 END, -0.4]::DOUBLE[] AS gain
    FROM dp d JOIN b ON b.entity = d.entity AND b.i = d.j)),
fin AS (SELECT entity, max(j) AS n, arg_max(back, j) AS back, arg_max(tot, j) AS tot FROM dp GROUP BY 1),
tr AS (SELECT entity, n - 1 AS i, list_position(tot, list_max(tot)) - 1 AS s FROM fin UNION ALL SELECT t.entity, t.i - 1, f.back[t.i + 1][t.s + 1] FROM tr t JOIN fin f ON f.entity = t.entity WHERE t.i > 0)
SELECT tr.entity, b.bin, CAST(s AS BIGINT) AS state FROM tr JOIN b ON b.entity = tr.entity AND b.i = tr.i"""
)


@query("2.11-3", STATES)
def candidate_states(s, d):
    b = day_bins(s, d).select("entity", "bin", "length", "n")
    return optimize.per_entity(b, KEYS, "bin", lambda p: {"bin": p["bin"].to_numpy(), "state": optimize.candidate_path(p["length"].to_numpy(), (p["n"] >= 2).to_numpy().astype(float), 60.0, 0.4, 0.6)}, "bin long, state long")


@query("2.11-4", BASE + ", m AS (SELECT a.entity, a.i AS j, k.i AS k, (SELECT sum(x.v) / count(*) FROM b x WHERE x.entity = a.entity AND x.i BETWEEN a.i AND k.i) AS mean FROM b a JOIN b k ON a.entity = k.entity AND a.i <= k.i), t AS (SELECT b.entity, b.i, m.j, min(mean) AS mn FROM b JOIN m ON m.entity = b.entity AND m.j <= b.i AND m.k >= b.i GROUP BY 1, 2, 3) SELECT entity, i, round(max(mn), 6) AS fit FROM t GROUP BY 1, 2")
def isotonic_fit(s, d):
    b = day_bins(s, d).select("entity", "i", "v")
    fit = optimize.per_entity(b, KEYS, "i", lambda p: {"i": p["i"].to_numpy(), "fit": optimize.isotonic(p["v"].to_numpy())}, "i long, fit double")
    return fit.withColumn("fit", F.round("fit", 6))


GRID = "WITH RECURSIVE cl AS (SELECT DISTINCT user_id % 10 AS movie, CAST(floor(value / 40) AS BIGINT) AS x, CAST(props->>'$.k' AS BIGINT) // 10 AS y FROM events WHERE value < 320)"


def grid(s, d):
    r = unranked(s, d).where("value < 320")
    return r.select((c("entity") % 10).alias("movie"), F.floor(c("value") / 40).alias("x"), F.expr("k div 10").alias("y")).distinct()


@query("2.11-6", GRID + ", sd AS (SELECT movie, x, y, x * 10 + y AS id FROM cl WHERE (x * 3 + y) % 7 = 0), w AS (SELECT movie, x, y, id AS owner, 0 AS steps FROM sd UNION SELECT cl.movie, cl.x, cl.y, w.owner, w.steps + 1 FROM w JOIN cl ON cl.movie = w.movie AND abs(cl.x - w.x) <= 1 AND abs(cl.y - w.y) <= 1 AND (cl.x <> w.x OR cl.y <> w.y) WHERE w.steps < 12), n AS (SELECT movie, x, y, min(steps) AS steps FROM w GROUP BY 1, 2, 3) SELECT n.movie, n.x, n.y, min(w.owner) AS owner, n.steps FROM n JOIN w USING (movie, x, y, steps) GROUP BY ALL")
def nearest_seed_cells(s, d):
    cells = grid(s, d)
    return optimize.spread(cells, cells.where("(x * 3 + y) % 7 = 0").withColumn("id", c("x") * 10 + c("y")), ["movie"], 12)


def priced_grid(s, d):
    """Cells with a price, and the first cell of each movie as its seed."""
    cells = grid(s, d).withColumn("price", 1.0 + (c("x") * 7 + c("y") * 3) % 5)
    return cells, cells.groupBy("movie").agg(F.min(F.struct("x", "y")).alias("p")).select("movie", "p.x", "p.y")


ROUTES = (
    GRID
    + """, pr AS (SELECT *, 1.0::DOUBLE + (x * 7 + y * 3) % 5 AS price FROM cl), sd AS (SELECT movie, min({'x': x, 'y': y}) AS p FROM cl GROUP BY 1),
bf AS (SELECT pr.movie, x, y, price, CASE WHEN p.x = x AND p.y = y THEN 0.0::DOUBLE ELSE 'infinity'::DOUBLE END AS cost, 0 AS n FROM pr JOIN sd ON sd.movie = pr.movie
  UNION ALL SELECT c.movie, c.x, c.y, c.price, min(b.cost + CASE WHEN c.x = b.x AND c.y = b.y THEN 0 ELSE c.price * sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) END), b.n + 1
  FROM bf b JOIN pr c ON c.movie = b.movie AND abs(c.x - b.x) <= 1 AND abs(c.y - b.y) <= 1 WHERE b.n < 60 GROUP BY c.movie, c.x, c.y, c.price, b.n),
best AS (SELECT movie, x, y, price, cost FROM bf WHERE n = 60 AND cost < 'infinity'::DOUBLE),
pred AS (SELECT c.movie, c.x, c.y, min({'cost': o.cost + c.price * sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y)), 'x': o.x, 'y': o.y}) AS w
  FROM best c JOIN best o ON c.movie = o.movie AND abs(c.x - o.x) <= 1 AND abs(c.y - o.y) <= 1 AND (c.x <> o.x OR c.y <> o.y) WHERE c.cost > 0 GROUP BY 1, 2, 3),
tr AS (SELECT movie, x * 10 + y AS id, x, y, 0::BIGINT AS back FROM best WHERE (x + y) % 5 = 0 UNION ALL SELECT t.movie, t.id, p.w.x, p.w.y, t.back + 1 FROM tr t JOIN pred p ON p.movie = t.movie AND p.x = t.x AND p.y = t.y),
rt AS (SELECT t.movie, t.id, max(back) OVER (PARTITION BY t.movie, t.id) - back AS step, t.x, t.y, b.cost FROM tr t JOIN best b ON b.movie = t.movie AND b.x = t.x AND b.y = t.y)"""
)


@query("2.11-7", ROUTES + " SELECT movie, x, y, round(cost, 9) AS cost FROM best")
def cheapest_path_costs(s, d):
    return routes.cheapest_costs(*priced_grid(s, d), ["movie"], tile=4).drop("price")


def routed(s, d):
    cells, seeds = priced_grid(s, d)
    before = routes.predecessors(routes.cheapest_costs(cells, seeds, ["movie"], tile=4), seeds, ["movie"]).checkpoint()
    return routes.routes(before, cells.where("(x + y) % 5 = 0").withColumn("id", c("x") * 10 + c("y")), ["movie"])


@query("2.11-7 2.11-33", ROUTES + " SELECT movie, id, step, x, y, round(cost, 9) AS cost FROM rt")
def cheapest_routes(s, d):
    """Cells of the cheapest route from each movie's seed to each target."""
    return routed(s, d)


@query("2.11-33 2.3-34", ROUTES + """, g AS (SELECT *, (x + 2 * y) % 3 <> 0 AS seen, lag(x) OVER w AS px, lag(y) OVER w AS py, count(*) FILTER ((x + 2 * y) % 3 <> 0) OVER w AS run FROM rt WINDOW w AS (PARTITION BY movie, id ORDER BY step)),
q AS (SELECT movie, id, max(k) AS longest_gap FROM (SELECT movie, id, run, count(*) AS k FROM g WHERE NOT seen GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT g.movie, g.id, count(*) AS cells, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 9) AS length, round(max(cost), 9) AS cost,
  round(count(*) FILTER (seen) / count(*), 9) AS covered, coalesce(any_value(longest_gap), 0) AS longest_gap FROM g LEFT JOIN q ON q.movie = g.movie AND q.id = g.id GROUP BY 1, 2""")
def route_diagnostics(s, d):
    """Length, cost, evidence and longest gap of each route."""
    return routes.measures(routed(s, d), grid(s, d).where("(x + 2 * y) % 3 <> 0"), ["movie"])


CORRECTED = BASE + """, f AS (
  SELECT entity, i, length, CASE WHEN n >= 4 THEN v END AS seen, min(CASE WHEN v > 40 THEN i END) OVER (PARTITION BY entity) AS first FROM b
), m AS (
  SELECT entity, i, first, coalesce(i >= first, false) AS live, CASE WHEN i >= first THEN length ELSE 0 END AS base, CASE WHEN i >= first THEN seen END AS seen FROM f
), g AS (
  SELECT *, CASE WHEN seen IS NOT NULL THEN max(seen) OVER (PARTITION BY entity ORDER BY i) END AS goal,
    min(i) OVER (PARTITION BY entity ORDER BY base RANGE BETWEEN 0.5 PRECEDING AND CURRENT ROW) AS level_from FROM m
), c AS (SELECT entity, i, goal, goal - base AS error, base, level_from, first, lag(i) OVER w AS before FROM g WHERE goal IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY i)
), k AS (
  SELECT entity, i, goal, error, CASE WHEN error > greatest(2, goal / 10)
    THEN least(greatest(i - 10, coalesce(before, first - 1)), greatest(level_from, coalesce(before, first - 1), 0)) ELSE greatest(i - 10, coalesce(before, first - 1)) END AS begin FROM c
), p AS (SELECT g.*, k.i AS l_at, k.goal AS l_goal, k.error AS l_error FROM g ASOF LEFT JOIN k ON g.entity = k.entity AND g.i > k.i
), q AS (SELECT p.*, k.i AS n_at, k.goal AS n_goal, k.error AS n_error, k.begin AS n_begin FROM p ASOF LEFT JOIN k ON p.entity = k.entity AND p.i <= k.i
), y AS (
  SELECT *, CASE WHEN n_at IS NULL THEN 0 ELSE greatest(0, least(1, (i - n_begin) / greatest(n_at - n_begin, 1))) END AS grown, coalesce(l_error * greatest(0, least(1, 1 - (i - l_at) / 10)), 0) AS rest FROM q
), z AS (SELECT entity, i, CASE WHEN live THEN coalesce(goal, greatest(coalesce(l_goal, 0), least(base + (1 - grown) * rest + grown * coalesce(n_error, 0), n_goal))) ELSE 0 END AS x FROM y)
SELECT entity, i, round(max(x) OVER (PARTITION BY entity ORDER BY i), 9) AS length FROM z"""


@query("2.11-8 2.2-9", CORRECTED)
def corrected_curves(s, d):
    b = day_bins(s, d).select("entity", "i", "length", F.when(c("n") >= 4, c("v")).alias("seen"), F.min(F.when(c("v") > 40, c("i"))).over(Window.partitionBy("entity")).alias("first"))
    return curves.through_checks(b, KEYS, "i", "length", "seen", "first", 10)


@query("2.2-9", "SELECT entity AS grain, z.i AS bin, z.i * 300 + 150 AS frame, CAST(CAST(round(CAST((z.i * 300 + 150) * 2.5 / 60.0 AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS minutes, CAST(CAST(round(CAST(length AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS length_px, CAST(CAST(round(CAST(length * 0.65 AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS length_um, coalesce(n, 0) AS checked_lengths FROM ("
    + CORRECTED.replace("SELECT entity, i, round(", "SELECT entity, i, (") .replace(", 9) AS length FROM z", ") AS length FROM z") + ") z LEFT JOIN (" + BASE + " SELECT entity, count(*) AS n FROM b WHERE n >= 4 GROUP BY 1) k USING (entity)")
def reviewed_growth_export(s, d):
    """Corrected curves as a long table with units, written as CSV and read back."""
    checks = day_bins(s, d).where("n >= 4").groupBy(c("entity").alias("grain")).agg(F.count("*").alias("n"))
    rows = exports.reviewed_growth(corrected_curves(s, d).select(c("entity").alias("grain"), c("i").alias("bin"), "length"), checks, 300, 0.65, 2.5)
    path = writers.scratch(s)
    writers.csv(rows, path)
    return s.read.option("header", True).schema("grain long, bin long, frame long, minutes string, length_px string, length_um string, checked_lengths long").csv(path)


@query("2.11-9 2.12-4", BASE + ", g AS (SELECT entity, bin, v, CASE WHEN bin - lag(bin) OVER (PARTITION BY entity ORDER BY bin) > 2 THEN 1 ELSE 0 END AS cut FROM b WHERE v > 40), q AS (SELECT *, sum(cut) OVER (PARTITION BY entity ORDER BY bin ROWS UNBOUNDED PRECEDING) AS spell FROM g) SELECT entity, CAST(spell AS BIGINT) AS spell, min(bin) AS first, max(bin) AS last, count(*) AS n, round(sum(v), 6) AS grown FROM q GROUP BY 1, 2")
def idle_reset_spells(s, d):
    w = Window.partitionBy("entity").orderBy("bin")
    g = day_bins(s, d).where("v > 40").withColumn("cut", (c("bin") - F.lag("bin").over(w) > 2).cast("int"))
    q = g.withColumn("spell", F.sum(F.coalesce("cut", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return q.groupBy("entity", "spell").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("grown"))


RULES = flood.Rules(halo=0.0, band=1.5, arc=120.0, old_far=3.0, old_bins=3, bridge=1.5, recent=6, give_up=8, least=1.0)


@query("2.11-9")
def arrival_flood(s, d):
    """Growth round each entity's centre through cells that arrive with its first reading there."""
    e = unranked(s, d).where("value < 360").groupBy("entity", (F.floor(c("value") / 40) - 4).alias("x"), (F.expr("k div 12") - 4).alias("y")).agg(F.min("bin").alias("arrival"))
    return flood.flood(e.withColumn("radius", F.lit(1.0)), KEYS, 30, RULES)


@query("2.11-10 2.12-3", BASE + ", g AS (SELECT entity, i, v < 60 AS miss, i - row_number() OVER (PARTITION BY entity, v < 60 ORDER BY i) AS g FROM b), q AS (SELECT entity, g, min(i) AS s, count(*) AS k FROM g WHERE miss GROUP BY 1, 2) SELECT b.entity, count(*) AS n, (SELECT min(s) FROM q WHERE q.entity = b.entity AND k > 3) AS lost_from FROM b GROUP BY 1")
def lost_after_misses(s, d):
    b = day_bins(s, d)
    runs = ev.islands(b, KEYS, "i", c("v") < 60).where("n > 3").groupBy("entity").agg(F.min("first").alias("lost_from"))
    return b.groupBy("entity").agg(F.count("*").alias("n")).join(runs, "entity", "left").select("entity", "n", "lost_from")


@query("2.11-11 2.5-5", "WITH RECURSIVE p AS (SELECT c_nationkey AS movie, c_custkey AS id, c_acctbal / 10 AS x, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS y FROM customer), e AS (SELECT a.id AS a, o.id AS b FROM p a JOIN p o ON a.movie = o.movie AND a.id <> o.id AND sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2)) <= 100), w AS (SELECT id, id AS c FROM p UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.id), m AS (SELECT id, min(c) AS component FROM w GROUP BY 1) SELECT id, component, count(*) OVER (PARTITION BY component) AS clump_size FROM m")
def clumps(s, d):
    p = table(s, d, "customer").select(c("c_nationkey").alias("movie"), c("c_custkey").alias("id"), (c("c_acctbal") / 10).alias("x"), (c("c_custkey") * 37 % 1000).cast("double").alias("y"))
    got = matching.clusters(p, ["movie"], 100.0).select("id", "component").checkpoint()
    return got.join(got.groupBy("component").agg(F.count("*").alias("clump_size")), "component").select("id", "component", "clump_size")


@query("2.11-13", BASE + ", h AS (SELECT entity, max(v) AS m, arg_max(bin, struct_pack(v := v, b := -bin)) AS t FROM b GROUP BY 1), x AS (SELECT b.entity, b.bin, b.i, b.v >= m / 2 AS hi, t FROM b JOIN h ON b.entity = h.entity), g AS (SELECT *, i - row_number() OVER (PARTITION BY entity ORDER BY bin) AS g FROM x WHERE hi), q AS (SELECT entity, g, (min(bin) + max(bin)) / 2 AS centre, max(bin) - min(bin) + 1 AS width, bool_or(bin = t) AS peak FROM g GROUP BY 1, 2) SELECT entity, centre, width FROM q WHERE peak")
def band_centre(s, d):
    b = day_bins(s, d)
    top = b.groupBy("entity").agg(F.max("v").alias("m"), F.max_by("bin", F.struct(c("v"), -c("bin"))).alias("t"))
    x = b.join(top, "entity").withColumn("hi", c("v") >= c("m") / 2).where("hi")
    x = x.withColumn("g", c("i") - F.row_number().over(Window.partitionBy("entity").orderBy("bin")))
    q = x.groupBy("entity", "g").agg(((F.min("bin") + F.max("bin")) / 2).alias("centre"), (F.max("bin") - F.min("bin") + 1).alias("width"), F.bool_or(c("bin") == c("t")).alias("peak"))
    return q.where("peak").select("entity", "centre", "width")


@query("2.11-14")
def registration_lag(s, d):
    b = day_bins(s, d).select("entity", "bin", "v", "n")
    return optimize.per_entity(b, KEYS, "bin", lambda p: {"lag": [optimize.correlation_shift(p["v"].to_numpy(), p["n"].to_numpy(float), 4)]}, "lag long")


@query("2.11-14", "SELECT vec_id, a.n AS \"at\", CAST(CASE WHEN a.n = 0 THEN 0 WHEN vec_id * 3 % 8 > 4 THEN vec_id * 3 % 8 - 8 ELSE vec_id * 3 % 8 END AS DOUBLE) AS dx, CAST(CASE WHEN a.n = 0 THEN 0 WHEN vec_id * 5 % 8 > 4 THEN vec_id * 5 % 8 - 8 ELSE vec_id * 5 % 8 END AS DOUBLE) AS dy FROM embeddings, range(2) a(n)")
def registered_patches(s, d):
    """Each vector as a patch of 8 x 8 cells, rolled by a known shift, against itself."""
    v = table(s, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("at"))
    dx, dy = c("vec_id") * 3 % 8 * c("at"), c("vec_id") * 5 % 8 * c("at")
    rolled = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.element_at("v", (F.pmod(F.floor(p / 8) - dy, F.lit(8)) * 8 + F.pmod(p % 8 - dx, F.lit(8)) + 1).cast("int")))
    return registration.shifts(v.select("vec_id", "at", rolled.alias("patch")), ["vec_id"], "at", 8, 8, reference=1)


@query("2.11-14 2.7-9")
def corrected_shifts(s, d):
    """Shifts of each label's patches against its first three, outliers replaced by the running median."""
    v = table(s, d, "embeddings").select("label", "vec_id", c("embedding").cast("array<double>").alias("patch"))
    return registration.corrected(registration.shifts(v, ["label"], "vec_id", 8, 8), ["label"], "vec_id", 2.5)


TEMPLATE = [float((k * 13) % 17) for k in range(64)]
UNIT = (np.array(TEMPLATE) - np.mean(TEMPLATE)) / np.linalg.norm(np.array(TEMPLATE) - np.mean(TEMPLATE))


@query("2.11-15", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], [" + ", ".join(f"{x!r}" for x in UNIT.tolist()) + "]), 6) AS response FROM embeddings")
def matched_filter(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(optimize.matched_filter(c("embedding"), TEMPLATE), 6).alias("response"))


@query("2.11-16 2.11-24", BASE + ", x AS (SELECT entity, frame % 3 AS path, sum(CAST(value AS DECIMAL(18,2))) AS ev, avg(CASE WHEN k < 50 THEN 1.0 ELSE 0 END) AS ridge FROM r GROUP BY 1, 2), y AS (SELECT *, round(CAST(ev AS DOUBLE) * ridge * CASE WHEN ev > 3000 THEN 0.8 ELSE 1 END, 6) AS score FROM x) SELECT entity, arg_max(path, struct_pack(s := score, p := -path)) AS best, max(score) AS score FROM y GROUP BY 1")
def best_hypothesis(s, d):
    x = readings(s, d).groupBy("entity", (c("frame") % 3).alias("path")).agg(F.sum(c("value").cast("decimal(18,2)")).alias("ev"), F.avg(F.when(c("k") < 50, 1.0).otherwise(0.0)).alias("ridge"))
    y = x.withColumn("score", F.round(c("ev").cast("double") * c("ridge") * F.when(c("ev") > 3000, 0.8).otherwise(1.0), 6))
    return y.groupBy("entity").agg(F.max_by("path", F.struct(c("score"), -c("path"))).alias("best"), F.max("score").alias("score"))


#: Three paths of each entity; a path's readings are those whose number leaves its own rest by three.
HYPOTHESES = (
    FRONT[: FRONT.rindex("\nSELECT")].replace("user_id AS entity", "user_id * 3 + event_id % 3 AS entity").replace("PARTITION BY user_id ORDER", "PARTITION BY user_id * 3 + event_id % 3 ORDER")
    + """,
nr AS (SELECT entity, i, near, ridge FROM (SELECT entity, bin, avg(CASE WHEN k < 60 THEN 1.0 ELSE 0 END) AS near, row_number() OVER (PARTITION BY entity ORDER BY bin) - 1 AS i FROM r GROUP BY 1, 2)
  JOIN (SELECT entity, avg(CASE WHEN k < 50 THEN 1.0 ELSE 0 END) AS ridge FROM r GROUP BY 1) USING (entity)),
lf AS (SELECT entity, min(i) FILTER (front >= 3) AS l, arg_max(front, i) AS final FROM tr GROUP BY 1),
th AS (SELECT lf.entity, l, final, coalesce(median(near) FILTER (nr.i >= greatest(0, l - 8) AND nr.i < greatest(0, l - 2)) >= 0.5, false) AS through, any_value(ridge) AS ridge FROM lf JOIN nr ON nr.entity = lf.entity GROUP BY 1, 2, 3),
sc AS (SELECT th.entity // 3 AS entity, th.entity % 3 AS path, list_max(fin.sc) AS explained, through, final, ridge FROM th JOIN fin ON fin.entity = th.entity),
v AS (SELECT *, CASE WHEN explained > 0 THEN explained * (0.5 + 0.5 * ridge) ELSE explained END AS raw FROM sc),
o AS (SELECT *, CASE WHEN NOT through THEN raw WHEN raw > 0 THEN raw * 0.25 ELSE raw - 10 END AS score FROM v)
SELECT entity, path, round(explained, 9) AS explained, through, CAST(final AS BIGINT) AS final, round(score, 9) AS score, round(score - lead(score) OVER w, 9) AS margin FROM o
WINDOW w AS (PARTITION BY entity ORDER BY score DESC, path) QUALIFY row_number() OVER w = 1"""
)


@query("2.11-16", HYPOTHESES)
def best_path_hypothesis(s, d):
    """The best of three paths of each entity by evidence, ridge and what was there before."""
    r = unranked(s, d).withColumn("path", c("event_id") % 3)
    e = r.groupBy("entity", "path", "bin", F.expr("k div 10").alias("level")).agg((F.sum(F.round("value")) - 100 * F.count("*")).alias("e"))
    rows = [F.lit(0.0)]
    for k in range(LEVELS):
        rows.append(rows[-1] + F.sum(F.when(c("level") == k, c("e")).otherwise(0.0)))
    g = e.groupBy("entity", "path", "bin").agg(F.array(*rows).alias("gains"))
    near = r.groupBy("entity", "path", "bin").agg(F.avg(F.when(c("k") < 60, 1.0).otherwise(0.0)).alias("near"))
    ridge = r.groupBy("entity", "path").agg(F.avg(F.when(c("k") < 50, 1.0).otherwise(0.0)).alias("ridge"))
    bins = g.join(near, ["entity", "path", "bin"]).join(ridge, ["entity", "path"])
    return hypotheses.best(hypotheses.scored(bins, KEYS, "path", "bin"), KEYS, "path").drop("beyond")


@query("2.11-18", "SELECT e AS entity, t, sum(CASE WHEN t < 5 + e % 9 OR (t - e) % 6 = 0 OR t > 40 THEN 0 ELSE 1 + e % 4 END) OVER (PARTITION BY e ORDER BY t ROWS UNBOUNDED PRECEDING) AS length FROM range(50) a(e), range(48) b(t)")
def synthetic_growth(s, d):
    """Seeded schedules of onset, rate, pauses and stop for 50 entities of 48 bins."""
    g = s.range(50).select(c("id").alias("entity"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long"))).alias("t"))
    still = (c("t") < 5 + c("entity") % 9) | ((c("t") - c("entity")) % 6 == 0) | (c("t") > 40)
    w = Window.partitionBy("entity").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("length", F.sum(F.when(still, 0).otherwise(1 + c("entity") % 4)).over(w))


@query("2.11-22")
def follow_onsets(s, d):
    """First bin from which a greedy chain of near readings covers half of the next eight bins."""
    b = day_bins(s, d).select("entity", "bin", "v")

    def follow(p):
        bins, v = p["bin"].to_numpy(), p["v"].to_numpy()
        for k in range(len(v)):
            last, met, path = v[k], 0, 0.0
            for j in range(k + 1, len(v)):
                if bins[j] > bins[k] + 8:
                    break
                if abs(v[j] - last) <= 60:
                    path += abs(v[j] - last)
                    last, met = v[j], met + 1
            if met >= 4 and abs(last - v[k]) > 0.3 * path > 0:
                return {"onset": [float(bins[k])]}
        return {"onset": [None]}

    return optimize.per_entity(b, KEYS, "bin", follow, "onset double").withColumn("onset", c("onset").cast("long"))


@query("2.11-25", BASE + ", lo AS (SELECT entity, min(bin) AS lost FROM b WHERE v > 280 GROUP BY 1) SELECT b.entity, b.bin, max(CASE WHEN lost IS NULL OR b.bin < lost THEN length END) OVER (PARTITION BY b.entity ORDER BY b.bin) AS length, coalesce(b.bin >= lost, false) AS held FROM b LEFT JOIN lo ON b.entity = lo.entity")
def hold_after_loss(s, d):
    b = day_bins(s, d)
    lost = b.where("v > 280").groupBy("entity").agg(F.min("bin").alias("lost"))
    known = F.when(c("lost").isNull() | (c("bin") < c("lost")), c("length"))
    return b.join(lost, "entity", "left").select("entity", "bin", F.max(known).over(Window.partitionBy("entity").orderBy("bin")).alias("length"), F.coalesce(c("bin") >= c("lost"), F.lit(False)).alias("held"))


@query("2.11-31", BASE + ", a AS (SELECT entity, bin, v, lead(bin) OVER (PARTITION BY entity ORDER BY bin) AS nb, lead(v) OVER (PARTITION BY entity ORDER BY bin) AS nv FROM b WHERE n >= 2), g AS (SELECT *, unnest(range(bin, nb)) AS t FROM a WHERE nb IS NOT NULL) SELECT entity, t AS bin, round(v + (nv - v) * (t - bin) / (nb - bin), 6) AS pose, abs(nv - v) / (nb - bin) <= 80 AS accepted FROM g")
def motion_between_anchors(s, d):
    w = Window.partitionBy("entity").orderBy("bin")
    a = day_bins(s, d).where("n >= 2").select("entity", "bin", "v", F.lead("bin").over(w).alias("nb"), F.lead("v").over(w).alias("nv")).where("nb IS NOT NULL")
    g = a.withColumn("t", F.explode(F.sequence("bin", c("nb") - 1)))
    span = c("nb") - c("bin")
    return g.select("entity", c("t").alias("bin"), F.round(c("v") + (c("nv") - c("v")) * (c("t") - c("bin")) / span, 6).alias("pose"), (F.abs(c("nv") - c("v")) / span <= 80).alias("accepted"))


@query("2.8-2", """WITH RECURSIVE p AS (SELECT c_nationkey AS movie, c_custkey AS id, c_acctbal / 10 AS x, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS y,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey * 7919 % 1009 DESC, c_custkey) AS i FROM customer),
k AS (SELECT DISTINCT movie, 0::BIGINT AS i, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) AS kept FROM p
  UNION ALL SELECT p.movie, p.i, CASE WHEN len(list_filter(k.kept, lambda q: sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < 72)) = 0 THEN list_append(k.kept, {'id': p.id, 'x': p.x, 'y': p.y}) ELSE k.kept END
  FROM k JOIN p ON p.movie = k.movie AND p.i = k.i + 1)
SELECT movie, unnest(list_transform(arg_max(kept, i), lambda q: q.id)) AS id FROM k GROUP BY 1""")
def non_max_suppression(s, d):
    p = table(s, d, "customer").select(c("c_nationkey").alias("movie"), c("c_custkey").alias("id"), (c("c_acctbal") / 10).alias("x"), (c("c_custkey") * 37 % 1000).cast("double").alias("y"), F.lit(60.0).alias("r"), (c("c_custkey") * 7919 % 1009).alias("score"))
    return suppression.suppressed(p, ["movie"], 1.2)


@query("2.12-6", BASE + ", g AS (SELECT entity, frame, epoch_us(ts) AS u, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity ORDER BY frame) AS gap FROM r), e AS (SELECT entity, frame, avg(gap) OVER w AS m, count(gap) OVER w AS k, max(frame) OVER (PARTITION BY entity) AS last FROM g WINDOW w AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT entity, frame, CASE WHEN k >= 3 THEN round(m / 1000000.0 * (last - frame), 3) END AS eta FROM e")
def progress_eta(s, d):
    w = Window.partitionBy("entity").orderBy("frame")
    g = readings(s, d).withColumn("u", F.unix_micros(c("ts").cast("timestamp"))).withColumn("gap", c("u") - F.lag("u").over(w))
    ten = w.rowsBetween(-9, 0)
    e = g.select("entity", "frame", F.avg("gap").over(ten).alias("m"), F.count("gap").over(ten).alias("k"), F.max("frame").over(Window.partitionBy("entity")).alias("last"))
    return e.select("entity", "frame", F.when(c("k") >= 3, F.round(c("m") / 1000000.0 * (c("last") - c("frame")), 3)).alias("eta"))
