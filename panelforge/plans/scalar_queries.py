"""Units, text, geometry and other scalar derivations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import geometry, scores, text, units
from panelforge.plans.base import BASE, KEYS, c, day_bins, query, readings, table, unranked

CAL = "CASE WHEN entity % 3 > 0 THEN 0.5 + entity % 7 END AS um, CASE WHEN entity % 4 > 0 THEN 2.0 + entity % 5 END AS spf"


def calibrated(s, d):
    r = readings(s, d)
    return r.withColumn("um", F.when(c("entity") % 3 > 0, 0.5 + c("entity") % 7)).withColumn("spf", F.when(c("entity") % 4 > 0, 2.0 + c("entity") % 5))


@query("2.3-1", BASE + f", x AS (SELECT *, {CAL} FROM r) SELECT event_id, round(frame * spf / 60, 9) AS minutes, round(value * um, 9) AS um, round(coalesce(frame * spf / 60, frame), 9) AS time, round(coalesce(value * um, value), 9) AS length, round(value * coalesce(um, 1) * CASE WHEN spf IS NULL THEN 1000 ELSE 60 / spf END, 9) AS rate FROM x")
def unit_conversion(s, d):
    x = calibrated(s, d)
    return x.select(
        "event_id", units.minutes(c("frame"), c("spf")).alias("minutes"), units.micrometres(c("value"), c("um")).alias("um"), units.time_or_frames(c("frame"), c("spf")).alias("time"),
        units.length_or_px(c("value"), c("um")).alias("length"), units.growth_rate(c("value"), c("um"), c("spf")).alias("rate"),
    )


@query("2.3-2 2.12-2", """SELECT o_orderkey, round(CASE WHEN o_custkey % 50 > 0 AND o_totalprice > 0 THEN o_totalprice / (o_custkey % 50) END, 9) AS cadence,
  nullif((o_custkey % 5) * 3600 + coalesce(nullif(o_custkey % 7, 3), 0) * 60 + 0.0, 0) AS seconds FROM orders""")
def cadence(s, d):
    key = c("o_custkey")
    seconds = units.duration_seconds(key % 5, F.nullif(key % 7, F.lit(3)), F.lit(None).cast("double"))
    return table(s, d, "orders").select("o_orderkey", units.seconds_per_frame(c("o_totalprice"), key % 50).alias("cadence"), seconds.alias("seconds"))


@query("2.3-3", """WITH x AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN CAST(value AS DECIMAL(18,2)) - 100 END AS v FROM events),
y AS (SELECT event_id, v, CAST(round_even(v, 0) AS BIGINT) AS m, CAST(round_even(greatest(v, 0) * 30, 0) AS BIGINT) AS t FROM x)
SELECT event_id, CASE WHEN v IS NULL THEN '-' WHEN abs(v) < 10 THEN printf('%.1f min', CAST(round_even(v, 1) AS DOUBLE)) WHEN abs(v) < 60 THEN m || ' min'
    ELSE printf('%d min (%d h %02d min)', m, CAST(floor(m / 60) AS BIGINT), m - 60 * CAST(floor(m / 60) AS BIGINT)) END AS words,
  CASE WHEN v IS NULL OR v <= 0 THEN '-' WHEN t >= 3600 THEN printf('%d h %02d min', t // 3600, t % 3600 // 60)
    WHEN t >= 60 THEN printf('%d min', t // 60) || CASE WHEN t % 60 > 0 THEN printf(' %d s', t % 60) ELSE '' END ELSE printf('%d s', t) END AS span FROM y""")
def duration_words(s, d):
    v = F.when(c("event_id") % 9 > 0, c("value").cast("decimal(18,2)") - 100)
    return table(s, d, "events").select("event_id", units.format_minutes(v).alias("words"), units.format_duration(F.when(v.isNotNull(), F.greatest(v, F.lit(0)) * 30)).alias("span"))


@query("2.3-4", BASE + ", m AS (SELECT entity, frame, epoch_us(ts) / 1000000.0 AS t FROM r WHERE k < 70) SELECT r.event_id, round(CASE WHEN r.entity % 2 = 0 THEN m.t ELSE CASE WHEN r.entity % 3 > 0 THEN r.frame * 2.5 END END, 6) AS t FROM r LEFT JOIN m ON r.entity = m.entity AND r.frame = m.frame")
def acquisition_clock(s, d):
    r = readings(s, d)
    mapped = r.where("k < 70").select("entity", "frame", (F.unix_micros(c("ts").cast("timestamp")) / 1000000.0).alias("t"))
    cad = F.when(c("entity") % 3 > 0, F.lit(2.5))
    return r.select("event_id", "entity", "frame").join(mapped, ["entity", "frame"], "left").select("event_id", F.round(units.frame_time(c("frame"), c("t"), c("entity") % 2 == 0, cad), 6).alias("t"))


@query("2.3-5", BASE + ", x AS (SELECT entity, bin, CAST(round(min(value)) AS BIGINT) AS a, CAST(round(max(value)) AS BIGINT) AS z FROM r GROUP BY 1, 2) SELECT entity, bin, CASE WHEN a = z THEN CAST(z AS VARCHAR) ELSE a || '-' || z END AS words FROM x")
def time_range_words(s, d):
    return unranked(s, d).groupBy("entity", "bin").agg(units.time_range(F.min("value"), F.max("value")).alias("words"))


@query("2.3-7", BASE + ", f AS (SELECT entity, min(CASE WHEN v > 150 THEN bin END) AS onset, CASE WHEN entity % 8 = 0 THEN 20 END AS lost FROM b GROUP BY 1) SELECT f.entity, t.t AS bin, CASE WHEN entity % 11 = 0 THEN 'excluded' WHEN entity % 13 = 0 THEN 'unobservable' WHEN t.t >= lost THEN 'lost' WHEN onset <= 2 THEN 'at start' WHEN t.t >= onset THEN 'within' WHEN onset IS NOT NULL THEN 'not yet' ELSE 'never' END AS state FROM f, (SELECT unnest([0, 5, 15, 25])::BIGINT AS t) t")
def state_at_time(s, d):
    f = day_bins(s, d).groupBy("entity").agg(F.min(F.when(c("v") > 150, c("bin"))).alias("onset"))
    f = f.withColumn("bin", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 5, 15, 25)]))).withColumn("lost", F.when(c("entity") % 8 == 0, 20))
    state = F.when(c("entity") % 11 == 0, "excluded").when(c("entity") % 13 == 0, "unobservable").when(c("bin") >= c("lost"), "lost").when(c("onset") <= 2, "at start").when(c("bin") >= c("onset"), "within").when(c("onset").isNotNull(), "not yet").otherwise("never")
    return f.select("entity", "bin", state.alias("state"))


@query("2.3-8 2.3-30", BASE + ", a AS (SELECT entity, list(v ORDER BY bin) AS vs, max(bin) AS e FROM b GROUP BY 1) SELECT entity, t AS asked, round(vs[least(greatest(t, 0), len(vs) - 1) + 1], 9) AS held, coalesce(CASE WHEN t >= 0 THEN CAST(round(vs[t + 1]) AS BIGINT) END, -1) AS source FROM a, (SELECT unnest([-3, 0, 12, 99])::BIGINT AS t) t")
def position_at_bin(s, d):
    a = day_bins(s, d).groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda x: x["v"]).alias("vs"))
    a = a.withColumn("asked", F.explode(F.array(*[F.lit(k).cast("long") for k in (-3, 0, 12, 99)])))
    held = F.get("vs", F.least(F.greatest(c("asked"), F.lit(0)), F.size("vs") - 1).cast("int"))
    return a.select("entity", "asked", held.alias("held"), F.coalesce(F.round(F.get("vs", F.greatest(c("asked"), F.lit(-1)).cast("int"))).cast("long"), F.lit(-1)).alias("source"))


@query("2.3-9 2.11-26", BASE + ", o AS (SELECT entity, min(bin) AS s0, min(CASE WHEN v > 150 THEN bin END) AS fv FROM b GROUP BY 1) SELECT entity, CASE WHEN fv IS NULL THEN 'no_event' WHEN fv <= s0 THEN 'at_start' ELSE 'within' END AS verdict, CASE WHEN fv > 0 THEN fv - 1 END AS last_absent, fv AS first_visible FROM o")
def onset_answer(s, d):
    o = day_bins(s, d).groupBy("entity").agg(F.min("bin").alias("s0"), F.min(F.when(c("v") > 150, c("bin"))).alias("fv"))
    return o.select("entity", F.when(c("fv").isNull(), "no_event").when(c("fv") <= c("s0"), "at_start").otherwise("within").alias("verdict"), F.when(c("fv") > 0, c("fv") - 1).alias("last_absent"), c("fv").alias("first_visible"))


FEATURES = [("l_quantity", 25.0, 14.0, 0.8), ("l_discount", 0.05, 0.03, -1.2), ("l_tax", 0.04, 0.025, 0.4)]


@query("2.3-12 2.4-3", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-0.3 + " + " + ".join(f"({n} - {m}) / {sc} * {w}" for n, m, sc, w in FEATURES) + "))), 9) AS p FROM lineitem")
def logistic_score(s, d):
    p = scores.logistic_score([c(n) for n, *_ in FEATURES], [m for _, m, _, _ in FEATURES], [x for _, _, x, _ in FEATURES], [w for *_, w in FEATURES], -0.3)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))


@query("2.3-13", "WITH x AS (SELECT event_id, least(1 - 1e-5, greatest(1e-5, value / 480)) AS q FROM events) SELECT event_id, round(ln(q / (1 - q)), 9) AS score FROM x")
def log_odds(s, d):
    return table(s, d, "events").select("event_id", scores.logit(c("value") / 480).alias("score"))


@query("2.3-14", BASE + " SELECT entity, t AS bin, CASE WHEN t >= onset THEN round((t - onset) * 2.5, 9) ELSE 0 END AS length FROM (SELECT entity, min(bin) AS onset, unnest(range(8, 29, CASE WHEN entity % 5 = 0 THEN 24 ELSE 12 END)) AS t FROM b GROUP BY 1)")
def truth_projection(s, d):
    o = day_bins(s, d).groupBy("entity").agg(F.min("bin").alias("onset"))
    t = o.withColumn("bin", F.explode(F.sequence(F.lit(8).cast("long"), F.lit(28).cast("long"), F.when(c("entity") % 5 == 0, 24).otherwise(12).cast("long"))))
    return t.select("entity", "bin", F.when(c("bin") >= c("onset"), (c("bin") - c("onset")) * 2.5).otherwise(0.0).alias("length"))


BX = "WITH x AS (SELECT event_id, value AS ax0, CAST(props->>'$.k' AS DOUBLE) AS ay0, value + 40 AS ax1, CAST(props->>'$.k' AS DOUBLE) + 30 AS ay1, 100.0 AS bx0, 20.0 AS by0, 300.0 AS bx1, 90.0 AS by1 FROM events), y AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) AS i FROM x)"


@query("2.3-15 2.3-17 2.13-2", BX + " SELECT event_id, round(1 - i / (1200 + 14000 - i), 9) AS iou_distance, round(pow((ax0 + ax1 - bx0 - bx1) / 2, 2) + pow((ay0 + ay1 - by0 - by1) / 2, 2), 6) AS centre2, round(sqrt(pow((ax0 - bx0) * 0.5, 2) + pow((ay0 - by0) * 2, 2)), 9) AS scaled FROM y")
def box_distances(s, d):
    k = F.get_json_object("props", "$.k").cast("double")
    x = table(s, d, "events").select("event_id", F.struct(c("value").alias("x0"), k.alias("y0"), (c("value") + 40).alias("x1"), (k + 30).alias("y1")).alias("a"), F.struct(F.lit(100.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(90.0).alias("y1")).alias("b"))
    return x.select("event_id", geometry.iou_distance(c("a"), c("b")).alias("iou_distance"), F.round(geometry.centre_distance_squared(c("a"), c("b")), 6).alias("centre2"), F.hypot((c("a.x0") - c("b.x0")) * 0.5, (c("a.y0") - c("b.y0")) * 2).alias("scaled"))


PHRASES = {"view": "looked at {}", "error": "went wrong", "rotates": "turns {}"}


@query("2.3-18 2.10-1", """WITH x AS (SELECT event_id, props->>'$.k' AS k, CASE event_id % 5 WHEN 0 THEN 'path_coverage:0.' || (props->>'$.k') WHEN 1 THEN 'rotates:' || (props->>'$.k') || 'deg' WHEN 2 THEN 'first_seen:a_b' ELSE event_type || ':' || (props->>'$.k') END AS f FROM events)
SELECT event_id, split_part(f, ':', 2) AS argument, CASE WHEN event_id % 5 = 0 THEN printf('growth off the tube (%d%% on it)', CAST(round_even(100 * CAST('0.' || k AS DOUBLE), 0) AS BIGINT))
  WHEN event_id % 5 = 1 THEN 'turns ' || k || '°' WHEN event_id % 5 = 2 THEN 'first seen:a b' WHEN f LIKE 'view:%' THEN 'looked at ' || k WHEN f LIKE 'error:%' THEN 'went wrong' ELSE replace(f, '_', ' ') END AS phrase FROM x""")
def flag_phrases(s, d):
    k, n = F.get_json_object("props", "$.k"), c("event_id") % 5
    f = F.when(n == 0, F.concat(F.lit("path_coverage:0."), k)).when(n == 1, F.concat(F.lit("rotates:"), k, F.lit("deg"))).when(n == 2, "first_seen:a_b").otherwise(F.concat(c("event_type"), F.lit(":"), k))
    return table(s, d, "events").select("event_id", text.flag_argument(f).alias("argument"), text.flag_phrase(f, PHRASES).alias("phrase"))


@query("2.3-19", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'movie' ELSE trim(regexp_replace('._' || p_name || ' / ' || p_brand || '!.', '[^A-Za-z0-9._-]+', '_', 'g'), '_.') END AS name FROM part")
def safe_names(s, d):
    raw = F.when(c("p_partkey") % 7 == 0, "_. !").otherwise(F.concat(F.lit("._"), c("p_name"), F.lit(" / "), c("p_brand"), F.lit("!.")))
    return table(s, d, "part").select("p_partkey", text.safe_name(raw).alias("name"))


@query("2.10-2", "SELECT event_id, CASE WHEN value > 250 THEN '' WHEN abs(value) < 10 THEN printf('%.3f', value) ELSE printf('%.1f', CAST(round_even(CAST(value AS DECIMAL(18,2)), 1) AS DOUBLE)) END AS shown FROM events")
def number_text(s, d):
    return table(s, d, "events").select("event_id", text.number_text(F.when(c("value") <= 250, c("value"))).alias("shown"))


@query("2.10-3", """WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) WHEN 2 THEN 'True' WHEN 3 THEN '(' || event_id || ',1)' ELSE event_type END AS t FROM events)
SELECT event_id, CASE WHEN t LIKE '%,%' OR t LIKE '(%' THEN 'tuple' WHEN try_cast(t AS BIGINT) IS NOT NULL AND t NOT LIKE '%.%' THEN 'int' WHEN try_cast(t AS DOUBLE) IS NOT NULL THEN 'float' WHEN lower(t) IN ('true', 'false') THEN 'bool' ELSE 'text' END AS kind FROM x""")
def value_kinds(s, d):
    n, number = c("event_id") % 5, c("value").cast("decimal(18,2)").cast("string")
    t = F.when(n == 0, c("event_id").cast("string")).when(n == 1, number).when(n == 2, "True").when(n == 3, F.concat(F.lit("("), c("event_id").cast("string"), F.lit(",1)"))).otherwise(c("event_type"))
    return table(s, d, "events").select("event_id", text.value_kind(t).alias("kind"))


@query("2.10-4", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '{\"k\":' || (props->>'$.k') || ',\"type\":\"' || event_type || '\"}' AS packed FROM events")
def json_round_trip(s, d):
    e = table(s, d, "events").withColumn("j", F.from_json("props", "k long"))
    return e.select("event_id", c("j.k").alias("k"), F.to_json(F.struct(c("j.k").alias("k"), c("event_type").alias("type"))).alias("packed"))


@query("2.10-5", "SELECT event_id, round(((value * 7 - 900 + 180) % 360 + 360) % 360 - 180, 6) AS angle FROM events")
def angle_wrap(s, d):
    return table(s, d, "events").select("event_id", F.round(geometry.wrap_degrees(c("value") * 7 - 900), 6).alias("angle"))


@query("2.10-9", BASE + " SELECT entity, list(CAST(bin AS VARCHAR) || '=' || CAST(n AS VARCHAR) ORDER BY bin) AS entries FROM b GROUP BY 1")
def sorted_map_entries(s, d):
    m = day_bins(s, d).groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct(c("bin").cast("string"), "n"))).alias("m"))
    by_number = F.transform(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].alias("n")))), lambda e: F.concat_ws("=", e["i"].cast("string"), e["n"].cast("string")))
    return m.select("entity", by_number.alias("entries"))


@query("2.3-32", BASE + ", x AS (SELECT entity, min(v) AS a, max(v) AS z FROM b GROUP BY 1), y AS (SELECT *, (z - a) / 6 AS raw, pow(10, floor(log10((z - a) / 6))) AS p FROM x WHERE z > a), t AS (SELECT *, p * CASE WHEN raw <= p THEN 1 WHEN raw <= 2 * p THEN 2 WHEN raw <= 5 * p THEN 5 ELSE 10 END AS step FROM y) SELECT entity, CAST(step AS DOUBLE) AS step, CAST(floor(z / step) - ceil(a / step) + 1 AS BIGINT) AS ticks FROM t")
def axis_ticks(s, d):
    x = day_bins(s, d).groupBy("entity").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("z > a")
    x = x.withColumn("raw", (c("z") - c("a")) / 6).withColumn("p", F.pow(F.lit(10.0), F.floor(F.log10("raw"))))
    x = x.withColumn("step", c("p") * F.when(c("raw") <= c("p"), 1).when(c("raw") <= 2 * c("p"), 2).when(c("raw") <= 5 * c("p"), 5).otherwise(10))
    return x.select("entity", "step", (F.floor(c("z") / c("step")) - F.ceil(c("a") / c("step")) + 1).cast("long").alias("ticks"))


#: A path per entity: (frame * 10, value).
PATH = BASE + ", p AS (SELECT entity, frame AS i, frame * 10.0 AS x, value AS y FROM r), st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS ds FROM p WINDOW w AS (PARTITION BY entity ORDER BY i)), ar AS (SELECT *, sum(ds) OVER (PARTITION BY entity ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM st), sg AS (SELECT entity, i, s AS s0, x AS x0, y AS y0, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ar WINDOW w AS (PARTITION BY entity ORDER BY i))"


def paths(s, d):
    p = readings(s, d).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(c("frame").alias("i"), (c("frame") * 10.0).alias("x"), c("value").alias("y")))).alias("p"))
    return p.select("entity", F.transform("p", lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"))).alias("path"))


@query("2.3-22 2.3-34", PATH + ", tt AS (SELECT entity, max(s) AS total FROM ar GROUP BY 1), g AS (SELECT entity, unnest(range(0, CAST(ceil(total / 50) AS BIGINT))) AS k FROM tt) SELECT g.entity, g.k, round(x0 + (x1 - x0) * (k * 50 - s0) / (s1 - s0), 6) AS x, round(y0 + (y1 - y0) * (k * 50 - s0) / (s1 - s0), 6) AS y FROM g JOIN sg ON g.entity = sg.entity AND ((k * 50 > s0 AND k * 50 <= s1) OR (k = 0 AND i = 0))")
def path_resample(s, d):
    g = paths(s, d).withColumn("a", geometry.arc_points(c("path"))).select("entity", F.element_at("a", -1)["s"].alias("total"), F.explode(geometry.segments(c("a"))).alias("g"))
    m = g.select("entity", "total", F.explode(geometry.marks(c("g"), 50.0)).alias("m")).where(c("m.k") * 50.0 < c("total"))
    return m.select("entity", c("m.k").alias("k"), F.round("m.p.x", 6).alias("x"), F.round("m.p.y", 6).alias("y"))


@query("2.3-23", PATH + ", tt AS (SELECT entity, max(s) AS total FROM ar GROUP BY 1) SELECT tt.entity, (SELECT count(*) FROM ar WHERE ar.entity = tt.entity AND s < 400) + CASE WHEN total <= 400 THEN count(*) FILTER (false) + 0 ELSE 1 END AS points, round(CASE WHEN total <= 400 THEN total ELSE 400 END, 6) AS length, round(max(CASE WHEN total > 400 AND s0 < 400 AND s1 >= 400 THEN y0 + (y1 - y0) * (400 - s0) / (s1 - s0) END), 6) AS end_y FROM tt JOIN sg ON tt.entity = sg.entity GROUP BY tt.entity, total")
def path_cut(s, d):
    p = paths(s, d).withColumn("a", geometry.arc_points(c("path"))).withColumn("q", geometry.cut_at(c("a"), F.lit(400.0)))
    last = F.element_at("q", -1)
    return p.select("entity", F.size("q").alias("points"), F.round(last["s"], 6).alias("length"), F.round(F.when(F.element_at("a", -1)["s"] > 400, last["y"]), 6).alias("end_y"))


@query("2.3-24", PATH + ", pr AS (SELECT *, least(1, greatest(0, ((60 - x0) * (x1 - x0) + (200 - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS t FROM sg WHERE x1 IS NOT NULL), di AS (SELECT entity, i, s0 + t * (s1 - s0) AS s, sqrt(pow(60 - x0 - t * (x1 - x0), 2) + pow(200 - y0 - t * (y1 - y0), 2)) AS dd FROM pr) SELECT entity, round(min(dd), 6) AS d, round(arg_min(s, struct_pack(d := dd, i := i)), 6) AS s FROM di GROUP BY 1")
def path_projection(s, d):
    p = paths(s, d).where(F.size("path") > 1).withColumn("q", geometry.projection(c("path"), F.lit(60.0), F.lit(200.0)))
    return p.select("entity", F.round("q.d", 6).alias("d"), F.round("q.s", 6).alias("s"))


@query("2.3-25", PATH + " SELECT entity, i AS k, round(50 + (x - 50) * cos(radians(30)) - (y - 100) * sin(radians(30)), 6) AS x, round(100 + (x - 50) * sin(radians(30)) + (y - 100) * cos(radians(30)), 6) AS y FROM p")
def path_rotation(s, d):
    p = paths(s, d).select("entity", F.posexplode(geometry.turned(c("path"), F.lit(30.0), F.lit(50.0), F.lit(100.0))).alias("k", "a"))
    return p.select("entity", "k", F.round("a.x", 6).alias("x"), F.round("a.y", 6).alias("y"))


@query("2.3-26", PATH + ", tg AS (SELECT entity, i, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY entity ORDER BY i)), av AS (SELECT entity, i, avg(dx) OVER w AS ax, avg(dy) OVER w AS ay FROM tg WINDOW w AS (PARTITION BY entity ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT entity, i AS k, round(-ay / sqrt(ax * ax + ay * ay), 6) AS nx, round(ax / sqrt(ax * ax + ay * ay), 6) AS ny FROM av WHERE ax IS NOT NULL")
def smoothed_normals(s, d):
    w = Window.partitionBy("entity").orderBy("k")
    p = paths(s, d).select("entity", F.posexplode("path").alias("k", "a"))
    t = p.withColumn("dx", c("a.x") - F.lag("a.x").over(w)).withColumn("dy", c("a.y") - F.lag("a.y").over(w))
    around = w.rowsBetween(-2, 2)
    t = t.withColumn("ax", F.avg("dx").over(around)).withColumn("ay", F.avg("dy").over(around)).where("ax IS NOT NULL")
    size = F.sqrt(c("ax") * c("ax") + c("ay") * c("ay"))
    return t.select("entity", "k", F.round(-c("ay") / size, 6).alias("nx"), F.round(c("ax") / size, 6).alias("ny"))


@query("2.3-27", PATH + ", lp AS (SELECT a.entity, max(b.s - a.s) AS loop FROM ar a JOIN ar b ON a.entity = b.entity AND b.i > a.i AND abs(b.y - a.y) <= 15 AND b.s - a.s BETWEEN 40 AND 900 GROUP BY 1) SELECT DISTINCT p.entity, round(coalesce(loop, 0), 6) AS loop FROM p LEFT JOIN lp ON p.entity = lp.entity")
def loop_length(s, d):
    """Longest loop of each path: two points near in height with an arc between; pairs within one short path."""
    a = paths(s, d).withColumn("a", geometry.arc_points(c("path")))
    loops = F.flatten(F.transform("a", lambda p: F.transform(F.filter("a", lambda q: (F.abs(q["y"] - p["y"]) <= 15) & (q["s"] - p["s"] >= 40) & (q["s"] - p["s"] <= 900)), lambda q: q["s"] - p["s"])))
    return a.select("entity", F.round(F.coalesce(F.array_max(loops), F.lit(0.0)), 6).alias("loop"))


@query("2.3-31", PATH + ", aw AS (SELECT entity, i, x, y, sqrt(pow(x - 0, 2) + pow(y - 100, 2)) AS away FROM p), hit AS (SELECT entity, min(CASE WHEN away >= 80 THEN i END) AS h, max(i) AS last FROM aw GROUP BY 1) SELECT hit.entity, CASE WHEN h IS NULL THEN 1 WHEN h = 0 THEN last + 1 ELSE last - h + 2 END AS points, round(CASE WHEN h IS NULL THEN (SELECT y FROM aw WHERE aw.entity = hit.entity AND aw.i = last) WHEN h = 0 THEN b.y ELSE a.y + (b.y - a.y) * (80 - a.away) / (b.away - a.away) END, 6) AS start_y FROM hit LEFT JOIN aw b ON b.entity = hit.entity AND b.i = h LEFT JOIN aw a ON a.entity = hit.entity AND a.i = h - 1")
def cut_at_circle(s, d):
    p = paths(s, d).withColumn("q", geometry.cut_at_circle(c("path"), F.lit(0.0), F.lit(100.0), F.lit(80.0)))
    return p.select("entity", F.size("q").alias("points"), F.round(F.element_at("q", 1)["y"], 6).alias("start_y"))


@query("2.4-15", PATH + ", pr AS (SELECT p.entity, p.i, min(sqrt(pow(p.x - (sg.x0 + t * (x1 - x0)), 2) + pow(p.y - (sg.y0 + t * (y1 - y0)), 2))) AS d FROM p JOIN (SELECT * FROM sg WHERE x1 IS NOT NULL AND i < 6) sg ON p.entity = sg.entity, LATERAL (SELECT least(1, greatest(0, ((p.x - x0) * (x1 - x0) + (p.y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS t) GROUP BY 1, 2) SELECT entity, round(avg(d), 6) AS mean_off, round(max(d), 6) AS most_off, avg(d) <= 40 AND max(d) <= 150 AS nested FROM pr GROUP BY 1")
def nested_candidates(s, d):
    """Distances of a path's points from its own first part: nested if they stay near."""
    p = paths(s, d).where(F.size("path") > 1).withColumn("first", F.slice("path", 1, 7))
    off = p.select("entity", F.transform("path", lambda a: geometry.projection(c("first"), a["x"], a["y"])["d"]).alias("off"))
    off = off.select("entity", (F.aggregate("off", F.lit(0.0), lambda t, x: t + x) / F.size("off")).alias("m"), F.array_max("off").alias("w"))
    return off.select("entity", F.round("m", 6).alias("mean_off"), F.round("w", 6).alias("most_off"), ((c("m") <= 40) & (c("w") <= 150)).alias("nested"))
