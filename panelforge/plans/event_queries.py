"""Onsets, stalls, change points, streaks, event lists and the flagship summary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import scores
from panelforge.operators import events as ev
from panelforge.operators import sampling, scoring, survival
from panelforge.plans.base import BASE, KEYS, c, day_bins, query, readings

WE = "PARTITION BY entity ORDER BY bin"
A = f"avg(CASE WHEN v >= 60 THEN 1.0 ELSE 0 END) OVER ({WE} ROWS BETWEEN CURRENT ROW AND"
ONSET = BASE + f""", a AS (SELECT *, {A} 2 FOLLOWING) AS s3, {A} 7 FOLLOWING) AS s8 FROM b),
o AS (SELECT entity, min(CASE WHEN v >= 60 AND s3 >= 0.6 AND s8 >= 0.4 THEN bin END) AS onset FROM a GROUP BY 1)"""


def onsets(s, d):
    return ev.sustained_onset(day_bins(s, d), KEYS, "bin", c("v") >= 60, [(3, 0.6), (8, 0.4)])


@query("2.7-1", ONSET + " SELECT entity, onset FROM o")
def sustained_onset(s, d):
    return onsets(s, d)


@query(
    "2.7-1",
    BASE
    + f""", m AS (SELECT entity, median(v) AS mu FROM b WHERE i < 8 GROUP BY 1),
t AS (SELECT b.entity, mu + greatest(10, 0.5 * greatest(1.4826 * median(abs(v - mu)), 0.25)) AS thr FROM b JOIN m ON b.entity = m.entity WHERE i < 8 GROUP BY b.entity, mu),
u AS (SELECT b.entity, bin, CASE WHEN v > thr THEN 1.0 ELSE 0 END AS up FROM b JOIN t ON b.entity = t.entity),
x AS (SELECT *, avg(up) OVER ({WE} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS hold, avg(up) OVER ({WE} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS persist,
  row_number() OVER (PARTITION BY entity ORDER BY bin DESC) AS behind FROM u)
SELECT entity, CASE WHEN avg(up) FILTER (behind <= 10) >= 0.5 THEN min(CASE WHEN up = 1 AND hold >= 0.8 AND persist >= 0.7 THEN bin END) END AS onset FROM x GROUP BY 1""",
)
def calibrated_onset(s, d):
    rows = ev.above_noise(day_bins(s, d), KEYS, "bin", "v", 8, 10.0, 0.5, 0.25)
    return ev.sustained_onset(rows, KEYS, "bin", c("v") > c("threshold"), [(2, 0.8), (6, 0.7)], tail=10)


@query("2.7-2", BASE + f", a AS (SELECT *, min(CASE WHEN v >= 80 THEN 1 ELSE 0 END) OVER w AS m, count(*) OVER w AS k FROM b WINDOW w AS ({WE} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT entity, min(CASE WHEN m = 1 AND k = 3 THEN bin END) AS onset FROM a GROUP BY 1")
def held_onset(s, d):
    return ev.held_onset(day_bins(s, d), KEYS, "bin", c("v") >= 80, 3)


@query("2.7-3", BASE + f", a AS (SELECT *, {A} UNBOUNDED FOLLOWING) AS m FROM b) SELECT entity, min(CASE WHEN v >= 60 AND m >= 0.7 THEN bin END) AS onset FROM a GROUP BY 1")
def arrival_to_end(s, d):
    return ev.sustained_onset(day_bins(s, d), KEYS, "bin", c("v") >= 60, [(0, 0.7)])


@query("2.7-4 2.10-7", BASE + f", a AS (SELECT *, {A} 4 FOLLOWING) AS m FROM b) SELECT entity, min(CASE WHEN v >= 60 AND m >= 0.8 THEN bin END) AS onset FROM a GROUP BY 1")
def arrival_fixed_horizon(s, d):
    return ev.sustained_onset(day_bins(s, d), KEYS, "bin", c("v") >= 60, [(5, 0.8)])


@query("2.7-5", ONSET + """, p AS (SELECT b.entity, o.onset, b.bin, min(CASE WHEN b.bin = o.onset OR b.v > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY b.entity ORDER BY b.bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok
FROM b JOIN o ON b.entity = o.entity WHERE b.bin BETWEEN o.onset - 6 AND o.onset) SELECT entity, onset, min(CASE WHEN ok = 1 THEN bin END) AS start FROM p GROUP BY 1, 2""")
def onset_walk_back(s, d):
    b = day_bins(s, d)
    return ev.walk_back(b.join(onsets(s, d), "entity"), KEYS, "bin", "onset", c("v") > 40, 6)


@query("2.7-6", BASE + f""", a AS (SELECT *, abs(v - lag(v) OVER ({WE})) AS st FROM b), m AS (SELECT entity, median(st) AS md FROM a GROUP BY 1),
x AS (SELECT a.entity, a.bin, max(st) OVER w AS mx, count(st) OVER w AS k, md FROM a JOIN m ON a.entity = m.entity WINDOW w AS (PARTITION BY a.entity ORDER BY a.bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT entity, min(CASE WHEN mx < 1.2 * md AND k = 3 THEN bin END) AS start FROM x GROUP BY 1""")
def settled_start(s, d):
    return ev.settled_start(day_bins(s, d), KEYS, "bin", "v", 1.2, 3)


@query("2.7-7", BASE + f""", a AS (SELECT *, ln(median(v) OVER ({WE} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) / median(v) OVER ({WE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS ch FROM b),
x AS (SELECT *, CASE WHEN ch > ln(1.5) THEN 1 WHEN ch < -ln(1.5) THEN -1 ELSE 0 END AS sg FROM a), y AS (SELECT *, CASE WHEN sg <> coalesce(lag(sg) OVER ({WE}), 9) THEN 1 ELSE 0 END AS nw FROM x),
z AS (SELECT *, sum(nw) OVER ({WE} ROWS UNBOUNDED PRECEDING) AS g FROM y), q AS (SELECT *, row_number() OVER (PARTITION BY entity, g ORDER BY abs(ch) DESC, bin) AS rn FROM z WHERE sg <> 0)
SELECT entity, bin, round(ch, 9) AS change FROM q WHERE rn = 1""")
def change_points(s, d):
    return ev.change_points(day_bins(s, d), KEYS, "bin", "v", 3, 1.5, endless=True)


STALL = BASE + f", a AS (SELECT *, length - lag(length) OVER ({WE}) AS dl FROM b), t AS (SELECT entity, max(CASE WHEN dl > 0.25 THEN bin END) AS g, max(bin) AS e, arg_max(length, bin) AS l FROM a GROUP BY 1), st AS (SELECT entity, CASE WHEN e - g >= 5 AND l >= 8 THEN g END AS stall FROM t)"


@query("2.7-11", STALL + " SELECT * FROM st")
def stall_bins(s, d):
    return ev.stalls(day_bins(s, d), KEYS, "bin", "length", 0.25, 5, 8.0)


CONF = BASE + f""", a AS (SELECT *, length - lag(length) OVER ({WE}) AS dl FROM b),
q AS (SELECT entity, bin, length, bin - coalesce(max(CASE WHEN dl > 0.25 THEN bin END) OVER ({WE} ROWS UNBOUNDED PRECEDING), min(bin) OVER (PARTITION BY entity)) AS stall FROM a),
f AS (SELECT *, 1 / (1 + exp(-(-0.41 - 0.63 * ln(1 + stall) + 0.50 * ln(1 + greatest(length, 0))))) AS conf FROM q)"""


def confidences(s, d):
    b = ev.stall_length(day_bins(s, d), KEYS, "bin", "length", 0.25, "stall")
    return b.withColumn("conf", scores.reading_confidence(c("length"), c("stall")))


@query("2.3-10 2.10-6", CONF + " SELECT entity, bin, stall, round(conf, 9) AS conf FROM f")
def reading_confidence(s, d):
    return confidences(s, d).select("entity", "bin", "stall", "conf")


@query("2.3-11", CONF + " SELECT entity, round(min(conf), 9) AS conf FROM f WHERE bin IN (10, 14, 20, 28) GROUP BY 1")
def entity_confidence(s, d):
    return confidences(s, d).where(c("bin").isin(10, 14, 20, 28)).groupBy("entity").agg(F.min("conf").alias("conf"))


@query("2.7-17", BASE + f", a AS (SELECT entity, bin, row_number() OVER ({WE}) - sum(CASE WHEN v >= 80 THEN 1 ELSE 0 END) OVER ({WE} ROWS UNBOUNDED PRECEDING) AS g, v FROM b) SELECT entity, min(bin) AS first, max(bin) AS last, count(*) AS n FROM a WHERE v >= 80 GROUP BY entity, g HAVING count(*) >= 3")
def streaks(s, d):
    return ev.islands(day_bins(s, d), KEYS, "bin", c("v") >= 80).where("n >= 3")


@query("2.7-21", ONSET + f", a2 AS (SELECT *, length - lag(length) OVER ({WE}) AS dl FROM b), e AS (SELECT entity, max(CASE WHEN dl > 0.25 THEN bin END) AS g, max(bin) AS e, arg_max(v, bin) AS v FROM a2 GROUP BY 1) SELECT entity, onset AS bin, 'onset' AS kind FROM o WHERE onset IS NOT NULL UNION ALL SELECT entity, g, 'last growth' FROM e WHERE g IS NOT NULL UNION ALL SELECT entity, e, 'end' FROM e")
def event_list(s, d):
    b = day_bins(s, d)
    w = Window.partitionBy("entity").orderBy("bin")
    grown = b.withColumn("dl", c("length") - F.lag("length").over(w)).groupBy("entity").agg(F.max(F.when(c("dl") > 0.25, c("bin"))).alias("g"), F.max("bin").alias("e"))
    return ev.event_list({"onset": onsets(s, d).withColumnRenamed("onset", "bin"), "last growth": grown.select("entity", c("g").alias("bin")), "end": grown.select("entity", c("e").alias("bin"))}, KEYS, "bin")


@query("2.7-20", BASE + " SELECT entity, min(frame) AS first_frame, max(frame) AS last_frame, arg_min(event_id, abs(frame - 20) * 1000000 + frame) AS nearest FROM r GROUP BY 1")
def nearest_observation(s, d):
    return readings(s, d).groupBy("entity").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by("event_id", F.struct(F.abs(c("frame") - 20), c("frame"))).alias("nearest"))


INTERVALS = ONSET + ", e AS (SELECT entity, min(bin) AS s0, max(bin) AS e0 FROM b GROUP BY 1), iv AS (SELECT o.entity, o.entity % 5 AS grp, CASE WHEN onset IS NULL THEN e0 WHEN onset <= s0 THEN NULL ELSE onset - 1 END AS lo, onset AS hi FROM o JOIN e ON o.entity = e.entity)"


def intervals(s, d):
    ends = day_bins(s, d).groupBy("entity").agg(F.min("bin").alias("s0"), F.max("bin").alias("e0"))
    return survival.onset_intervals(onsets(s, d).join(ends, "entity"), "onset", "s0", "e0").select("entity", (c("entity") % 5).alias("grp"), "lo", "hi")


@query("2.11-27", INTERVALS + " SELECT * FROM iv")
def onset_intervals(s, d):
    return intervals(s, d)


@query("2.5-11 2.6-20", INTERVALS + """, x AS (SELECT DISTINCT grp, coalesce(CAST(lo AS DOUBLE), -1e300) AS x, 1 AS side FROM iv UNION SELECT DISTINCT grp, coalesce(CAST(hi AS DOUBLE), 1e300), 0 FROM iv),
y AS (SELECT *, lead(x) OVER w AS nx, lead(side) OVER w AS ns FROM x WINDOW w AS (PARTITION BY grp ORDER BY x, side)) SELECT grp, CASE WHEN x > -1e300 THEN x END AS q, CASE WHEN nx < 1e300 THEN nx END AS p FROM y WHERE side = 1 AND ns = 0""")
def innermost_intervals(s, d):
    return survival.innermost_intervals(intervals(s, d), ["grp"])


FIRST = BASE + """, f AS (SELECT entity, entity % 5 AS grp, min(CASE WHEN length > 250 THEN bin END) AS hit, 29 AS last FROM b GROUP BY 1),
km0 AS (SELECT grp, coalesce(hit, last) AS t, count(*) AS n, count(hit) AS ev FROM f GROUP BY 1, 2),
km1 AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM km0),
km AS (SELECT grp, t, CAST(risk AS BIGINT) AS at_risk, ev AS events, CASE WHEN min(CASE WHEN ev < risk THEN 1 ELSE 0 END) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN ev < risk THEN ln(1 - ev / risk) END) OVER w) END AS surv FROM km1 WINDOW w AS (PARTITION BY grp ORDER BY t ROWS UNBOUNDED PRECEDING))"""


def first_hits(s, d):
    return day_bins(s, d).groupBy("entity").agg(F.min(F.when(c("length") > 250, c("bin"))).alias("hit")).withColumn("grp", c("entity") % 5)


@query("2.6-20", FIRST + " SELECT grp, t, at_risk, events, round(surv, 9) AS survival FROM km WHERE events > 0")
def kaplan_meier(s, d):
    f = first_hits(s, d).select("grp", F.coalesce("hit", F.lit(29)).alias("t"), c("hit").isNotNull().cast("long").alias("ev"))
    return survival.kaplan_meier(f, ["grp"], "t", "ev")


# a first hit on day t is (t - 1, t]; without one (29, null): the masses are the steps of the product-limit curve
MASS = FIRST + """, ms AS (SELECT grp, t - 1.0 AS q, CAST(t AS DOUBLE) AS p, coalesce(lag(surv) OVER (PARTITION BY grp ORDER BY t), 1) - surv AS mass FROM km WHERE events > 0
  UNION ALL SELECT grp, 29.0, NULL, min(surv) FROM km GROUP BY grp HAVING min(surv) > 0),
mass AS (SELECT *, sum(mass) OVER (PARTITION BY grp ORDER BY p NULLS LAST) AS cum FROM ms)"""


def masses(s, d):
    f = first_hits(s, d).select("grp", F.when(c("hit").isNull(), 29.0).otherwise(c("hit") - 1.0).alias("lo"), c("hit").cast("double").alias("hi"))
    return survival.turnbull(f, ["grp"])


@query("2.6-20 2.11-5 2.2-10", MASS + " SELECT grp, q, p, round(mass, 6) AS mass, round(cum, 6) AS cum FROM mass")
def turnbull(s, d):
    return masses(s, d).select("grp", "q", "p", F.round("mass", 6).alias("mass"), F.round("cum", 6).alias("cum"))


@query("2.6-15", MASS + " SELECT grp, min(CASE WHEN cum >= 0.5 THEN p END) AS t50, min(CASE WHEN cum >= 0.5 - 1e-9 THEN p END) AS t50_slack FROM mass GROUP BY 1")
def t50_steps(s, d):
    m = masses(s, d)
    return survival.t50(m, ["grp"]).join(survival.t50(m, ["grp"], 1e-9).withColumnRenamed("t50", "t50_slack"), "grp")


@query("2.6-15 2.6-31", MASS + """, g AS (SELECT grp, i, i * (29.0 / 599) AS t FROM (SELECT DISTINCT grp FROM mass), range(600) AS x(i)),
s AS (SELECT g.grp, g.t, sum(CASE WHEN p <= t THEN mass WHEN q < t AND p > q THEN mass * (t - q) / (p - q) END) AS s FROM g JOIN mass m ON g.grp = m.grp WHERE p IS NOT NULL GROUP BY 1, 2)
SELECT grp, round(min(CASE WHEN s >= 0.5 THEN t END), 9) AS t50 FROM s GROUP BY 1""")
def t50_on_grid(s, d):
    return survival.t50_on_grid(masses(s, d), ["grp"], 0.0, 29.0)


@query("2.6-14 2.7-18", MASS + " SELECT grp, p AS t, round(sum(mass) OVER (PARTITION BY grp ORDER BY p), 6) AS share FROM mass WHERE p IS NOT NULL")
def envelope(s, d):
    w = Window.partitionBy("grp").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return masses(s, d).where("p is not null").select("grp", c("p").alias("t"), F.round(F.sum("mass").over(w), 6).alias("share"))


@query("2.5-20", MASS + ", g AS (SELECT unnest(range(0, 30)) AS t) SELECT grp, CAST(t AS BIGINT) AS t, round(coalesce(sum(mass) FILTER (p <= t), 0), 6) AS lower, round(coalesce(sum(mass) FILTER (q < t), 0), 6) AS upper FROM mass, g GROUP BY 1, 2")
def population_on_grid(s, d):
    m = masses(s, d).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(29))))
    part = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, c("mass"))), F.lit(0.0)), 6)
    return m.groupBy("grp", "t").agg(part(c("p") <= c("t")).alias("lower"), part(c("q") < c("t")).alias("upper"))


@query("2.6-9", INTERVALS + ", h AS (SELECT entity, min(CASE WHEN length > 250 THEN bin END) AS t FROM b GROUP BY 1) SELECT h.entity, CASE WHEN lo IS NOT NULL AND t <= lo THEN t - lo WHEN hi IS NOT NULL AND t > hi THEN t - hi ELSE t - t END AS distance FROM h JOIN iv ON h.entity = iv.entity")
def interval_distance(s, d):
    return first_hits(s, d).select("entity", "hit").join(intervals(s, d), "entity").select("entity", survival.interval_distance(c("hit"), c("lo"), c("hi")).alias("distance"))


@query("2.6-25", FIRST + " SELECT grp, CAST(t AS BIGINT) AS t, round(count(*) FILTER (hit <= t) / count(*), 9) AS share FROM f, range(30) AS g(t) GROUP BY 1, 2")
def cumulative_share(s, d):
    f = first_hits(s, d).groupBy("grp", "hit").agg(F.count("*").alias("n"))  # at most a row for each day
    g = f.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return g.groupBy("grp", "t").agg((F.coalesce(F.sum(F.when(c("hit") <= c("t"), c("n"))), F.lit(0)) / F.sum("n")).alias("share"))


@query("2.6-31", BASE + """, h AS (SELECT entity, frame % 2 AS side, min(CASE WHEN value > 250 THEN bin END) AS t FROM r GROUP BY 1, 2),
g AS (SELECT side, x.t AS at, count(*) FILTER (h.t <= x.t) / count(*) AS share FROM h, range(30) AS x(t) GROUP BY 1, 2)
SELECT round(max(abs(a.share - b2.share)), 9) AS gap FROM g a JOIN g b2 ON a.at = b2.at WHERE a.side = 0 AND b2.side = 1""")
def curve_gap(s, d):
    h = readings(s, d).groupBy("entity", (c("frame") % 2).alias("side")).agg(F.min(F.when(c("value") > 250, c("bin"))).alias("hit"))
    g = h.groupBy("side", "hit").agg(F.count("*").alias("n")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(29))))
    g = g.groupBy("side", "t").agg((F.coalesce(F.sum(F.when(c("hit") <= c("t"), c("n"))), F.lit(0)) / F.sum("n")).alias("share"))
    both = g.groupBy("t").agg(F.max(F.when(c("side") == 0, c("share"))).alias("a"), F.max(F.when(c("side") == 1, c("share"))).alias("b"))
    return both.agg(F.max(F.abs(c("a") - c("b"))).alias("gap"))


@query("2.6-21 2.6-23", BASE + ", x AS (SELECT entity, max(CASE WHEN v < 20 THEN bin END) AS absent, min(CASE WHEN v > 200 THEN bin END) AS present FROM b GROUP BY 1) SELECT entity, absent, present, CASE WHEN absent >= present THEN 'contradictory' WHEN absent IS NULL AND present IS NULL THEN 'unknown' WHEN absent IS NULL THEN 'left' WHEN present IS NULL THEN 'right' ELSE 'interval' END AS status FROM x")
def emergence_bounds(s, d):
    x = day_bins(s, d).groupBy("entity").agg(F.max(F.when(c("v") < 20, c("bin"))).alias("absent"), F.min(F.when(c("v") > 200, c("bin"))).alias("present"))
    status = F.when(c("absent") >= c("present"), "contradictory").when(c("absent").isNull() & c("present").isNull(), "unknown").when(c("absent").isNull(), "left").when(c("present").isNull(), "right").otherwise("interval")
    return x.withColumn("status", status)


FLAG = INTERVALS + """, fin AS (SELECT entity, arg_max(length, bin) AS fl FROM b GROUP BY 1),
gr AS (SELECT b.entity, fl, min(CASE WHEN length >= 0.1 * fl THEN bin END) AS a, min(CASE WHEN length >= 0.9 * fl THEN bin END) AS z FROM b JOIN fin ON b.entity = fin.entity GROUP BY 1, 2),
rt AS (SELECT gr.entity, CASE WHEN fl >= 8 AND z > a THEN (bz.length - ba.length) / (z - a) END AS rate FROM gr JOIN b ba ON ba.entity = gr.entity AND ba.bin = a JOIN b bz ON bz.entity = gr.entity AND bz.bin = z)"""


@query("2.6-5", FLAG + " SELECT entity, round(rate, 9) AS rate FROM rt")
def growth_rate_10_90(s, d):
    return scoring.growth_rate_10_90(day_bins(s, d), KEYS, "bin", "length", 8.0)


@query("2.6-12 2.6-13 2.2-7", FLAG + " SELECT iv.grp, count(*) AS n, count(hi) AS emerged, round(count(hi) / count(*), 9) AS share, median(hi) AS median_onset, round(median(CASE WHEN rate <> 0 THEN rate END), 9) AS median_rate FROM iv JOIN rt ON iv.entity = rt.entity GROUP BY 1")
def onset_growth_summary(s, d):
    """Flagship: onset share, median onset and median growth rate by group."""
    b = day_bins(s, d)
    rate = scoring.growth_rate_10_90(b, KEYS, "bin", "length", 8.0)
    both = intervals(s, d).join(rate, "entity")
    return both.groupBy("grp").agg(
        F.count("*").alias("n"), F.count("hi").alias("emerged"), (F.count("hi") / F.count("*")).alias("share"),
        F.percentile("hi", F.lit(0.5)).alias("median_onset"), F.percentile(F.when(c("rate") != 0, c("rate")), F.lit(0.5)).alias("median_rate"),
    )


@query("2.8-10", BASE + f""", f AS (SELECT entity, min(bin) AS fv, max(bin) + 2 AS nb FROM b GROUP BY 1) SELECT entity, fv, nb FROM f WHERE nb - 2 >= fv + 6""", name="planned_bins_asked")
def planned_bins_asked(s, d):
    f = day_bins(s, d).groupBy("entity").agg(F.min("bin").alias("fv"), (F.max("bin") + 2).alias("nb"))
    return f.where(F.size(sampling.planned_bins(c("fv"), c("nb"))) > 0)
