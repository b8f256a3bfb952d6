"""Scans, binning, filling and moving windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import panel
from panelforge.plans.base import BASE, KEYS, c, day_bins, query, readings, table, unranked

WE = "PARTITION BY entity ORDER BY bin"


def by_bin():
    return Window.partitionBy("entity").orderBy("bin")


@query("2.1-1", "SELECT user_id AS entity, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def source_probe(s, d):
    return table(s, d, "events").groupBy(c("user_id").alias("entity")).agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"), F.max("value").alias("most"))


@query("2.1-2", BASE + ", f AS (SELECT entity, event_id, CAST(round(epoch_us(ts) / 1000000.0 * 0.01) AS BIGINT) AS idx, ts FROM r) SELECT entity, event_id, idx, coalesce(idx > lag(idx) OVER (PARTITION BY entity ORDER BY ts, event_id), true) AS rising FROM f")
def time_to_frame(s, d):
    r = unranked(s, d).withColumn("idx", F.round(F.unix_micros(c("ts").cast("timestamp")) / 1000000.0 * 0.01).cast("long"))
    return r.select("entity", "event_id", "idx", F.coalesce(c("idx") > F.lag("idx").over(Window.partitionBy("entity").orderBy("ts", "event_id")), F.lit(True)).alias("rising"))


@query("2.1-3 2.1-5", "SELECT event_id, user_id AS entity, value FROM events WHERE event_type = 'signup' AND value BETWEEN 50 AND 200")
def keyframe_scan(s, d):
    return table(s, d, "events").where("event_type = 'signup' AND value BETWEEN 50 AND 200").select("event_id", c("user_id").alias("entity"), "value")


@query("2.1-4", BASE + " SELECT entity, frame, event_id FROM r WHERE frame % 5 = 0")
def every_kth_scan(s, d):
    return readings(s, d).where("frame % 5 = 0").select("entity", "frame", "event_id")


@query("2.1-8", BASE + ", a AS (SELECT DISTINCT entity, unnest([0, 10, 60]) AS frame FROM r) SELECT a.entity, CAST(a.frame AS BIGINT) AS frame, r.event_id, r.event_id IS NOT NULL AS exact FROM a LEFT JOIN r ON a.entity = r.entity AND a.frame = r.frame")
def exact_frame_lookup(s, d):
    r = readings(s, d)
    asks = table(s, d, "events").select(c("user_id").alias("entity")).distinct().withColumn("frame", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 10, 60)])))
    return asks.join(r.select("entity", "frame", "event_id"), ["entity", "frame"], "left").withColumn("exact", c("event_id").isNotNull())


@query("2.2-1 2.6-1 2.12-1", BASE + " SELECT entity, frame // 6 AS bin, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v, count(*) AS n FROM r GROUP BY 1, 2")
def bin_average(s, d):
    return panel.bin_average(readings(s, d), KEYS, "frame", "value", 6)


@query("2.6-1", BASE + ", g AS (SELECT entity, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1) SELECT g.entity, g.bin FROM g ANTI JOIN b ON g.entity = b.entity AND g.bin = b.bin")
def empty_bins(s, d):
    return panel.empty_bins(day_bins(s, d).select("entity", "bin"), KEYS, "bin")


DENSE = BASE + ", g AS (SELECT entity, unnest(range(0, 30)) AS bin FROM (SELECT DISTINCT entity FROM b)), x AS (SELECT g.entity, g.bin, b.v FROM g LEFT JOIN b ON g.entity = b.entity AND g.bin = b.bin)"
FWD, BACK = f"({WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"({WE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def dense(s, d):
    return panel.densify(day_bins(s, d).select("entity", "bin", "v"), KEYS, "bin", F.min(F.lit(0)), F.max(F.lit(29)))


@query("2.3-6 2.7-13", DENSE + f" SELECT entity, bin, v, last_value(v IGNORE NULLS) OVER {FWD} AS held, coalesce(last_value(v IGNORE NULLS) OVER {FWD}, first_value(v IGNORE NULLS) OVER {BACK}) AS padded FROM x")
def fills(s, d):
    return panel.fill_ends(panel.hold_last(dense(s, d), KEYS, "bin", "v", "held"), KEYS, "bin", "v", "padded")


@query("2.7-14", DENSE + f""", y AS (SELECT *, last_value(v IGNORE NULLS) OVER {FWD} AS v0, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER {FWD} AS t0,
  first_value(v IGNORE NULLS) OVER {BACK} AS v1, first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER {BACK} AS t1 FROM x)
SELECT entity, bin, v, round(CASE WHEN v IS NOT NULL THEN v WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (bin - t0) / (t1 - t0) END, 9) AS line, v IS NULL AS filled FROM y""")
def linear_gap_fill(s, d):
    return panel.linear_fill(dense(s, d), KEYS, "bin", "v", "line")


@query("2.7-12 2.7-15", BASE + f", x AS (SELECT *, abs(v - lag(v) OVER ({WE})) AS step FROM b) SELECT entity, bin, length, round(coalesce(sum(step) OVER ({WE} ROWS UNBOUNDED PRECEDING), 0), 9) AS moved FROM x")
def running_max_and_movement(s, d):
    b = day_bins(s, d).withColumn("step", F.abs(c("v") - F.lag("v").over(by_bin())))
    return b.select("entity", "bin", "length", F.coalesce(F.sum("step").over(by_bin().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("moved"))


@query("2.7-8 2.6-3", BASE + f" SELECT entity, bin, round(median(v) OVER ({WE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS m FROM b")
def running_median(s, d):
    return panel.running_median(day_bins(s, d), KEYS, ["bin"], "v", 2, "m").select("entity", "bin", "m")


@query("2.7-9", BASE + f", x AS (SELECT *, median(v) OVER ({WE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM b) SELECT entity, bin, abs(v - m) > 60 AS outlier, round(CASE WHEN abs(v - m) > 60 THEN m ELSE v END, 9) AS clean FROM x")
def outlier_replacement(s, d):
    return panel.replace_outliers(day_bins(s, d), KEYS, ["bin"], "v", 2, 60.0, "clean").select("entity", "bin", "outlier", "clean")


@query("2.7-10", BASE + f", x AS (SELECT *, abs(v - lag(v) OVER ({WE})) AS step FROM b) SELECT entity, bin, round(step, 9) AS step FROM x WHERE step > 150")
def jump_detection(s, d):
    return panel.jumps(day_bins(s, d), KEYS, ["bin"], "v", 150.0).select("entity", "bin", "step")


@query("2.7-16", BASE + ", x AS (SELECT entity, frame, CASE WHEN k % 7 <> 0 THEN value END AS y FROM r) SELECT entity, frame, round((y - lag(y) OVER w) / (frame - lag(frame) OVER w), 9) AS rate FROM x WINDOW w AS (PARTITION BY entity ORDER BY frame)")
def rate_with_breaks(s, d):
    x = readings(s, d).withColumn("y", F.when(c("k") % 7 != 0, c("value")))
    return panel.rate_with_breaks(x, KEYS, "frame", "y", "rate").select("entity", "frame", "rate")


@query("2.3-29 2.3-28", BASE + f" SELECT entity, bin, round(v - avg(v) OVER ({WE} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) AS high FROM b")
def local_contrast(s, d):
    return panel.local_contrast(day_bins(s, d), KEYS, ["bin"], "v", 3, "high").select("entity", "bin", "high")


@query("2.3-28", BASE + """, md AS (SELECT entity, median(v) AS level FROM b GROUP BY 1),
g AS (SELECT a.entity, a.bin, a.v, sum(exp(-((a.i - o.i) * (a.i - o.i)) / 8.0) * o.v) / sum(exp(-((a.i - o.i) * (a.i - o.i)) / 8.0)) AS ground FROM b a JOIN b o ON a.entity = o.entity AND abs(a.i - o.i) <= 6 GROUP BY 1, 2, 3)
SELECT g.entity, bin, round(v / greatest(ground, 1) * level, 6) AS flat FROM g JOIN md ON md.entity = g.entity""")
def flat_field(s, d):
    return panel.flat_field(day_bins(s, d), KEYS, "i", "v", "flat", 2.0).select("entity", "bin", F.round("flat", 6).alias("flat"))


@query("2.7-22", BASE + f" SELECT entity, bin, round(avg(v) OVER ({WE} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - avg(v) OVER ({WE} ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 9) AS growth FROM b")
def recent_window_growth(s, d):
    return panel.recent_growth(day_bins(s, d), KEYS, ["bin"], "v", 3, "growth").select("entity", "bin", "growth")


@query("2.6-2", BASE + " SELECT entity, round(avg(v) FILTER (bin < 5), 9) AS before, round(avg(v) FILTER (bin >= 25), 9) AS after FROM b GROUP BY 1")
def reference_means(s, d):
    return day_bins(s, d).groupBy("entity").agg(F.avg(F.when(c("bin") < 5, c("v"))).alias("before"), F.avg(F.when(c("bin") >= 25, c("v"))).alias("after"))


@query("2.3-33 2.3-28", "SELECT event_type, round(quantile_cont(value, 0.005), 9) AS lo, round(quantile_cont(value, 0.995), 9) AS hi, round(median(value) - 20, 9) AS dark, round(median(value) + 12, 9) AS light FROM events GROUP BY 1")
def display_window(s, d):
    p = lambda q: F.percentile("value", F.lit(q))
    return table(s, d, "events").groupBy("event_type").agg(p(0.005).alias("lo"), p(0.995).alias("hi"), (p(0.5) - 20).alias("dark"), (p(0.5) + 12).alias("light"))


@query("2.10-8", DENSE + f""", y AS (SELECT *, last_value(v IGNORE NULLS) OVER {FWD} AS v0, first_value(v IGNORE NULLS) OVER {BACK} AS v1 FROM x)
SELECT entity, bin, round(coalesce(v0, v1), 9) AS left_knot, round(coalesce(v1, v0), 9) AS right_knot FROM y WHERE v IS NULL""")
def interpolation_knots(s, d):
    x = dense(s, d)
    ahead = by_bin().rowsBetween(0, Window.unboundedFollowing)
    x = x.withColumn("v0", F.last("v", ignorenulls=True).over(by_bin().rowsBetween(Window.unboundedPreceding, 0))).withColumn("v1", F.first("v", ignorenulls=True).over(ahead))
    return x.where("v IS NULL").select("entity", "bin", F.coalesce("v0", "v1").alias("left_knot"), F.coalesce("v1", "v0").alias("right_knot"))


@query("2.2-15", "SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS bin, round(sum(value) FILTER (event_type = 'click'), 6) AS click, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY 1")
def wide_pivot(s, d):
    p = unranked(s, d).groupBy("bin").pivot("event_type", ["click", "view"]).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return p.select("bin", F.round("click_v", 6).alias("click"), F.coalesce("click_n", F.lit(0)).alias("n_click"), F.coalesce("view_n", F.lit(0)).alias("n_view"))


@query("2.2-5", BASE + ", g AS (SELECT entity, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY 1 HAVING max(v) > 200) SELECT g.entity, g.bin, b.v, coalesce(b.n >= 3, false) AS checked FROM g LEFT JOIN b ON g.entity = b.entity AND g.bin = b.bin")
def growth_long_export(s, d):
    b = day_bins(s, d).withColumn("top", F.max("v").over(Window.partitionBy("entity"))).where("top > 200").select("entity", "bin", "v", "n")
    return panel.densify(b, KEYS, "bin", F.min(F.lit(0)), F.max("bin")).select("entity", "bin", "v", F.coalesce(c("n") >= 3, F.lit(False)).alias("checked"))
