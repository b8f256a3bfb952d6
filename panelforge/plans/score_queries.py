"""Scores, summaries, agreement and groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import geometry
from panelforge.operators import report, scoring
from panelforge.plans.base import BASE, KEYS, c, day_bins, query, readings, table, unranked

#: Truth (even readings) and guess (odd readings) by entity and bin.
TWO = BASE + ", ev AS (SELECT entity, bin, max(value) AS truth FROM r WHERE frame % 2 = 0 GROUP BY 1, 2), od AS (SELECT entity, bin, max(value) AS guess FROM r WHERE frame % 2 = 1 GROUP BY 1, 2), tw AS (SELECT ev.entity, ev.entity % 5 AS grp, ev.bin, truth, guess FROM ev LEFT JOIN od ON ev.entity = od.entity AND ev.bin = od.bin)"


def two(s, d):
    r = readings(s, d).groupBy("entity", "bin").agg(F.max(F.when(c("frame") % 2 == 0, c("value"))).alias("truth"), F.max(F.when(c("frame") % 2 == 1, c("value"))).alias("guess"))
    return r.where("truth IS NOT NULL").withColumn("grp", c("entity") % 5)


@query("2.6-4", BASE + ", m AS (SELECT entity, median(v) AS md FROM b GROUP BY 1) SELECT b.entity, round(md, 9) AS median, round(greatest(1.4826 * median(abs(v - md)), 0.5), 9) AS sigma FROM b JOIN m ON b.entity = m.entity GROUP BY b.entity, md")
def robust_sigma(s, d):
    return scoring.robust_sigma(day_bins(s, d), KEYS, "v", 0.5)


@query("2.6-6", BASE + """, a AS (SELECT entity, (length - lag(length, 3) OVER (PARTITION BY entity ORDER BY bin)) / 3 AS adv FROM b),
p AS (SELECT entity, quantile_cont(adv, 0.9) AS p90 FROM a WHERE adv > 0.05 GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(median(p90), 9) END AS scale FROM p""")
def growth_scale(s, d):
    step = (c("length") - F.lag("length", 3).over(Window.partitionBy("entity").orderBy("bin"))) / 3  # by bin
    adv = day_bins(s, d).withColumn("adv", step).where("adv > 0.05")
    p = adv.groupBy("entity").agg(F.percentile("adv", F.lit(0.9)).alias("p90"), F.count("*").alias("n")).where("n >= 5")
    return p.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.percentile("p90", F.lit(0.5))).alias("scale"))


@query("2.6-7", BASE + " SELECT entity, round(regr_slope(length, bin), 9) AS slope, count(*) AS n, max(bin) - min(bin) AS span FROM b GROUP BY 1 HAVING count(*) >= 2 AND max(bin) - min(bin) >= 3")
def lsq_slopes(s, d):
    return scoring.slopes(day_bins(s, d), KEYS, "bin", "length", 2, 3)


@query("2.6-8", TWO + ", rk AS (SELECT grp, truth, guess, rank() OVER (PARTITION BY grp ORDER BY truth) + (count(*) OVER (PARTITION BY grp, truth) - 1) / 2 AS rx, rank() OVER (PARTITION BY grp ORDER BY guess) + (count(*) OVER (PARTITION BY grp, guess) - 1) / 2 AS ry FROM tw WHERE guess IS NOT NULL) SELECT grp, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(rx, ry) END, 9) AS spearman, round(CASE WHEN count(*) >= 3 THEN corr(truth, guess) END, 9) AS pearson FROM rk GROUP BY 1")
def rank_correlation(s, d):
    return scoring.rank_correlation(two(s, d).where("guess IS NOT NULL"), ["grp"], "truth", "guess")


@query("2.6-8", TWO + ", rk AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY truth, entity, bin) AS rx, row_number() OVER (PARTITION BY grp ORDER BY guess, entity, bin) AS ry FROM tw WHERE guess IS NOT NULL) SELECT grp, round(corr(rx, ry), 9) AS ordinal FROM rk GROUP BY 1")
def ordinal_rank_correlation(s, d):
    t = two(s, d).where("guess IS NOT NULL")
    rank = lambda x: F.row_number().over(Window.partitionBy("grp").orderBy(x, "entity", "bin"))
    return t.withColumn("rx", rank("truth")).withColumn("ry", rank("guess")).groupBy("grp").agg(F.corr("rx", "ry").alias("ordinal"))


@query("2.6-9 2.13-6", TWO + ", e AS (SELECT *, guess - truth AS e FROM tw) SELECT grp, count(e) AS n, count(*) FILTER (abs(e) <= greatest(20, abs(truth) * 0.1)) AS hits, round(median(abs(e)), 9) AS median_error, round(avg(abs(e)), 9) AS mean_error, round(avg(e), 9) AS bias, count(*) FILTER (e < -greatest(20, abs(truth) * 0.1)) AS early, count(*) FILTER (e > greatest(20, abs(truth) * 0.1)) AS late FROM e GROUP BY 1")
def score_report(s, d):
    return scoring.score_report(two(s, d), ["grp"], "truth", "guess", 20.0, 0.1)


TOLERANCE = report.Tolerance(onset=6.0)
WHOLE = BASE + """, g AS (SELECT DISTINCT entity, entity % 5 AS movie FROM r WHERE entity % 11 <> 0 AND entity % 4 <> 0),
fv AS (SELECT entity, min(CASE WHEN k >= 50 THEN frame END) AS hi FROM r WHERE event_type = 'purchase' GROUP BY 1),
pr AS (SELECT entity, min(CASE WHEN k >= 50 THEN frame END) AS onset FROM r WHERE event_type = 'click' AND entity % 13 <> 0 GROUP BY 1),
kn AS (SELECT g.entity, g.movie, pr.onset, pr.entity IS NOT NULL AS matched FROM g LEFT JOIN pr ON pr.entity = g.entity),
em AS (SELECT kn.*, hi, CASE WHEN kn.entity % 9 <> 0 THEN hi - 3 END AS lo FROM kn JOIN fv ON fv.entity = kn.entity WHERE hi > 2),
tr AS (SELECT kn.entity, kn.movie, kn.matched, r.event_id, r.frame, r.event_id % 9 = 0 AS contact, round(r.value / 10) AS h, CAST(r.k AS DOUBLE) AS x, round(r.value) AS y,
  CASE WHEN k < 10 THEN 'burst' WHEN k < 15 THEN 'unsure' WHEN k < 20 THEN 'centre' WHEN k < 40 THEN 'no_tube' WHEN k < 80 THEN 'full' ELSE 'partial' END AS state
  FROM r JOIN kn ON kn.entity = r.entity WHERE event_type = 'view'),
sr AS (SELECT entity, frame, CASE WHEN value < 60 THEN 0 ELSE round(value / 10) END AS len, CAST(k AS DOUBLE) AS x, round(value) AS y FROM r WHERE event_type = 'click' AND entity % 13 <> 0),
met AS (SELECT t.movie, t.event_id, t.state, t.h, t.x, t.y, arg_min(s, struct_pack(g := abs(s.frame - t.frame), f := s.frame)) AS s
  FROM tr t JOIN sr s ON s.entity = t.entity WHERE t.matched AND NOT t.contact AND t.state NOT IN ('burst', 'unsure', 'centre') GROUP BY ALL),
er AS (SELECT *, s.len - h AS e, abs(s.len - h) <= greatest(2, 0.1 * h) AS good, sqrt((s.x - x) * (s.x - x) + (s.y - y) * (s.y - y)) AS far FROM met),
fact AS (
  SELECT movie, 'grain' AS kind, NULL::DOUBLE AS error, matched AS ok, NULL::BOOLEAN AS "both" FROM kn
  UNION ALL SELECT movie, 'emerged', NULL, NULL, NULL FROM em
  UNION ALL SELECT movie, 'onset', e, abs(e) <= 6, NULL FROM (SELECT movie, CASE WHEN onset <= lo THEN onset - lo WHEN onset > hi THEN onset - hi ELSE 0 END AS e FROM em WHERE matched AND onset IS NOT NULL)
  UNION ALL SELECT movie, 'burst', NULL, NULL, NULL FROM tr WHERE state = 'burst'
  UNION ALL SELECT movie, 'contact', NULL, NULL, NULL FROM tr WHERE matched AND contact AND state NOT IN ('burst', 'unsure', 'centre')
  UNION ALL SELECT movie, 'full', e, good, NULL FROM er WHERE state = 'full'
  UNION ALL SELECT movie, 'partial', NULL, s.len >= h - 2, NULL FROM er WHERE state = 'partial'
  UNION ALL SELECT movie, 'absence', NULL, s.len < 2, NULL FROM er WHERE state = 'no_tube'
  UNION ALL SELECT movie, 'tip', far, far <= greatest(5, 0.1 * h), good AND far <= greatest(5, 0.1 * h) FROM er WHERE state = 'full' AND s.len > 0)
SELECT movie, count(*) FILTER (kind = 'grain') AS grains_scored, count(*) FILTER (kind = 'grain' AND ok) AS grains_matched, count(*) FILTER (kind = 'onset') AS onsets_timed,
  count(*) FILTER (kind = 'emerged') AS onsets_emerged, count(*) FILTER (kind = 'onset' AND ok) AS onset_hits, round(avg(error) FILTER (kind = 'onset'), 9) AS onset_mean_error,
  count(*) FILTER (kind = 'onset' AND error < -6) AS onsets_early, count(*) FILTER (kind = 'onset' AND error > 6) AS onsets_late, count(*) FILTER (kind = 'full') AS lengths,
  count(*) FILTER (kind = 'full' AND ok) AS lengths_within, round(avg(abs(error)) FILTER (kind = 'full'), 9) AS length_mean_error, round(avg(error) FILTER (kind = 'full'), 9) AS length_bias,
  count(*) FILTER (kind = 'partial') AS partials, count(*) FILTER (kind = 'partial' AND ok) AS partials_consistent, count(*) FILTER (kind = 'absence') AS absences,
  count(*) FILTER (kind = 'absence' AND ok) AS absences_correct, count(*) FILTER (kind = 'tip') AS tips, count(*) FILTER (kind = 'tip' AND ok) AS tips_within,
  count(*) FILTER (kind = 'tip' AND "both") AS lengths_and_tips, count(*) FILTER (kind = 'contact') AS contact_skipped, count(*) FILTER (kind = 'burst') AS burst_skipped,
  round(median(abs(error)) FILTER (kind = 'onset'), 9) AS onset_median_error, round(median(abs(error)) FILTER (kind = 'full'), 9) AS length_median_error, round(median(error) FILTER (kind = 'tip'), 9) AS tip_median
FROM fact GROUP BY movie"""


@query("2.6-9 2.2-11", WHOLE)
def whole_score_report(s, d):
    r, movie, key = readings(s, d), (c("entity") % 5).alias("movie"), c("entity").alias("id")
    grains = r.select(movie, key).distinct().select("movie", "id", (c("id") % 11 == 0).alias("excluded"), (c("id") % 4 != 0).alias("isolated"))
    first = lambda kind: r.where(c("event_type") == kind).groupBy(movie, key).agg(F.min(F.when(c("k") >= 50, c("frame"))).alias("at"))
    verdict = F.when(c("at").isNull(), "no_emergence_by_end").when(c("at") <= 2, "emerged_at_start").otherwise("emerged_within")
    onsets = first("purchase").select("movie", "id", verdict.alias("verdict"), F.when(c("id") % 9 != 0, c("at") - 3).alias("last_absent"), c("at").alias("first_visible"))
    status = F.when(c("at").isNull(), "no_emergence_by_end").otherwise("emerged_within")
    predictions = first("click").where("id % 13 <> 0").select("movie", "id", status.alias("status"), c("at").alias("onset"))
    state = F.lit("partial")
    for below, name in ((80, "full"), (40, "no_tube"), (20, "centre"), (15, "unsure"), (10, "burst")):
        state = F.when(c("k") < below, name).otherwise(state)
    place = [c("k").cast("double").alias("x"), F.round("value").alias("y")]
    traces = r.where("event_type = 'view'").select(movie, key, "frame", state.alias("state"), F.round(c("value") / 10).alias("length"), (c("event_id") % 9 == 0).alias("contact"), *place)
    curve = r.where("event_type = 'click' AND entity % 13 <> 0").select(movie, key, "frame", F.when(c("value") < 60, 0.0).otherwise(F.round(c("value") / 10)).alias("length"), *place)
    return report.report(report.facts(grains, onsets, predictions, traces, curve, "movie", "isolated", TOLERANCE), "movie", TOLERANCE)


@query("2.6-10 2.4-2", "SELECT CAST(d.lang AS VARCHAR) AS human, coalesce(CAST(l.quality AS VARCHAR), 'missing') AS model, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def confusion_matrix(s, d):
    docs, labels = table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").select("doc_id", "quality")
    return scoring.confusion(docs.join(labels, "doc_id", "left"), "lang", "quality")


@query("2.6-11", BASE + ", x AS (SELECT entity, bin, min(value) AS a, max(value) AS z FROM r GROUP BY 1, 2 HAVING count(*) >= 2) SELECT entity % 5 AS grp, count(*) AS n, count(*) FILTER (abs(z - a) <= greatest(50, 0.1 * abs(a))) AS agree, round(median(abs(z - a)), 9) AS median_difference FROM x GROUP BY 1")
def retest_agreement(s, d):
    x = unranked(s, d).groupBy("entity", "bin").agg(F.min("value").alias("a"), F.max("value").alias("z"), F.count("*").alias("k")).where("k >= 2")
    e = c("z") - c("a")
    return x.groupBy((c("entity") % 5).alias("grp")).agg(F.count("*").alias("n"), F.count_if(scoring.within_tolerance(e, c("a"), 50.0, 0.1)).alias("agree"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_difference"))


@query("2.6-16", "SELECT o_orderpriority AS stratum, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total FROM orders GROUP BY 1")
def progress_by_stratum(s, d):
    return table(s, d, "orders").groupBy(c("o_orderpriority").alias("stratum")).agg(F.count_if(c("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"))


@query("2.6-17", "SELECT role AS kind, count(*) AS n FROM conversations GROUP BY 1")
def kind_counts(s, d):
    return table(s, d, "conversations").groupBy(c("role").alias("kind")).agg(F.count("*").alias("n"))


@query("2.6-18", BASE + ", x AS (SELECT *, CASE WHEN value < 20 THEN 'too small' WHEN k >= 95 THEN 'outside' END AS reason FROM r) SELECT event_type, count(*) AS n, count(*) FILTER (reason IS NULL) AS in_scope, list_sort(list_distinct(list(reason))) AS reasons, coalesce(bool_and(k > 0) FILTER (reason IS NULL), true) AND count(DISTINCT entity) FILTER (reason IS NULL) >= 10 AS certified FROM x GROUP BY 1")
def census_report(s, d):
    x = unranked(s, d).withColumn("reason", F.when(c("value") < 20, "too small").when(c("k") >= 95, "outside"))
    inside = c("reason").isNull()
    return x.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("in_scope"), F.array_sort(F.collect_set("reason")).alias("reasons"),
        (F.coalesce(F.every(F.when(inside, c("k") > 0)), F.lit(True)) & (F.count_distinct(F.when(inside, c("entity"))) >= 10)).alias("certified"),
    )


@query("2.6-19 2.9-6 2.9-5", BASE + " SELECT entity, list_sort(list_distinct(list(bin) FILTER (k < 30))) AS frames, CASE WHEN count(DISTINCT event_type) FILTER (k < 5) = 1 THEN min(event_type) FILTER (k < 5) ELSE '' END AS kind, count(DISTINCT event_type) FILTER (k < 5) > 1 AS conflict FROM r GROUP BY 1 HAVING count(*) FILTER (k < 30) > 0")
def evidence_merge(s, d):
    few = F.when(c("k") < 5, c("event_type"))
    x = unranked(s, d).groupBy("entity").agg(
        F.array_sort(F.collect_set(F.when(c("k") < 30, c("bin")))).alias("frames"), F.count_distinct(few).alias("kinds"), F.min(few).alias("one"), F.count_if(c("k") < 30).alias("n")
    )
    return x.where("n > 0").select("entity", "frames", F.when(c("kinds") == 1, c("one")).otherwise("").alias("kind"), (c("kinds") > 1).alias("conflict"))


@query("2.6-22", BASE + ", x AS (SELECT entity, entity % 5 AS grp, max(CASE WHEN v < 20 THEN bin END) AS absent, min(CASE WHEN v > 200 THEN bin END) AS present FROM b GROUP BY 1) SELECT grp, count(*) FILTER (absent < present) AS numerator, count(*) FILTER (absent < present OR present IS NULL) AS denominator, count(*) FILTER (absent >= present) AS quarantined, count(*) FILTER (present IS NULL) AS censored FROM x GROUP BY 1")
def event_report(s, d):
    x = day_bins(s, d).groupBy("entity").agg(F.max(F.when(c("v") < 20, c("bin"))).alias("absent"), F.min(F.when(c("v") > 200, c("bin"))).alias("present"))
    return x.groupBy((c("entity") % 5).alias("grp")).agg(
        F.count_if(F.expr("absent < present")).alias("numerator"), F.count_if(F.expr("coalesce(absent < present, false) OR present IS NULL")).alias("denominator"),
        F.count_if(F.expr("absent >= present")).alias("quarantined"), F.count_if(c("present").isNull()).alias("censored"),
    )


@query("2.6-24", BASE + ", sk AS (SELECT *, min(CASE WHEN v >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m, count(*) OVER (PARTITION BY entity ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM b) SELECT entity, max(CASE WHEN n >= 2 THEN bin END) AS latest_complete, max(bin) AS latest, min(CASE WHEN m = 1 AND k = 3 THEN bin END) AS first_streak, CASE WHEN max(n) < 3 THEN 'few readings' WHEN count(*) < 20 THEN 'few bins' END AS withheld FROM sk GROUP BY 1")
def entity_summaries(s, d):
    w = Window.partitionBy("entity").orderBy("bin").rowsBetween(0, 2)
    b = day_bins(s, d).withColumn("ok", (F.min((c("v") >= 100).cast("int")).over(w) == 1) & (F.count("v").over(w) == 3))
    return b.groupBy("entity").agg(
        F.max(F.when(c("n") >= 2, c("bin"))).alias("latest_complete"), F.max("bin").alias("latest"), F.min(F.when(c("ok"), c("bin"))).alias("first_streak"),
        F.when(F.max("n") < 3, "few readings").when(F.count("*") < 20, "few bins").alias("withheld"),
    )


@query("2.6-26", BASE + " SELECT entity, arg_min(value, frame) AS first_value, arg_max(value, frame) AS last_value, max(frame) - min(frame) AS duration, round((arg_max(value, frame) - arg_min(value, frame)) / nullif(max(frame) - min(frame), 0), 9) AS rate, count(*) FILTER (k % 7 = 0) AS interpolated, list_sort(list_distinct(list(event_type))) AS methods FROM r GROUP BY 1")
def track_summary(s, d):
    first, last, span = F.min_by("value", "frame"), F.max_by("value", "frame"), F.max("frame") - F.min("frame")
    return readings(s, d).groupBy("entity").agg(
        first.alias("first_value"), last.alias("last_value"), span.alias("duration"), ((last - first) / F.nullif(span, F.lit(0))).alias("rate"),
        F.count_if(c("k") % 7 == 0).alias("interpolated"), F.array_sort(F.collect_set("event_type")).alias("methods"),
    )


@query("2.6-27 2.3-21", BASE + ", st AS (SELECT entity, frame, value AS x, CAST(k AS DOUBLE) AS y, value - lag(value) OVER w AS dx, k - lag(k) OVER w AS dy FROM r WINDOW w AS (PARTITION BY entity ORDER BY frame)) SELECT entity, round(sum(sqrt(dx * dx + dy * dy)), 6) AS path, round(coalesce(sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) / nullif(sum(sqrt(dx * dx + dy * dy)), 0), 0), 9) AS straightness FROM st GROUP BY 1")
def straightness_ratio(s, d):
    p = readings(s, d).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("frame", c("value").alias("x"), c("k").cast("double").alias("y")))).alias("path"))
    return p.select("entity", F.round(geometry.path_length(c("path")), 6).alias("path"), geometry.straightness(c("path")).alias("straightness"))


@query("2.6-28")
def bootstrap_interval(s, d):
    t = two(s, d).where("guess IS NOT NULL").withColumn("difference", c("guess") - c("truth")).withColumn("row", c("entity") * 100 + c("bin"))
    return scoring.bootstrap_interval(t, ["grp"], "difference", 400, 3)


GROUPS = {"early": "bin < 10", "late": "bin >= 20", "high": "v > 150", "low": "v < 50", "many": "n > 2", "even": "entity % 2 = 0", "all": "true"}


@query("2.6-29", BASE + ", x AS (SELECT v, unnest([" + ", ".join(f"CASE WHEN {cond} THEN '{g}' END" for g, cond in GROUPS.items()) + "]) AS grp FROM b) SELECT grp, count(*) AS n, round(avg(v), 9) AS mean FROM x WHERE grp IS NOT NULL GROUP BY 1")
def overlapping_groups(s, d):
    return scoring.overlapping_groups(day_bins(s, d), {g: F.expr(cond) for g, cond in GROUPS.items()}, "v")


@query("2.6-30", BASE + ", x AS (SELECT frame % 3 AS seed, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM r GROUP BY 1, 2) SELECT event_type, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DOUBLE) AS total, count(*) AS runs FROM x GROUP BY 1")
def pooled_totals(s, d):
    x = readings(s, d).groupBy((c("frame") % 3).alias("seed"), "event_type").agg(F.count("*").alias("n"), F.sum(c("value").cast("decimal(18,2)")).alias("total"))
    return x.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"), F.count("*").alias("runs"))


@query("2.6-32", BASE + ", m AS (SELECT entity, max(v) AS most FROM b GROUP BY 1), h AS (SELECT m.entity, m.most, count(o.entity) AS above FROM m LEFT JOIN m o ON o.most >= m.most GROUP BY 1, 2) SELECT entity, round(above / (SELECT count(*) FROM m), 9) AS p_value FROM h")
def empirical_p_value(s, d):
    """Share of entities whose largest bin mean is at least as large: one count by value, then a running sum."""
    m = day_bins(s, d).groupBy("entity").agg(F.max("v").alias("most"))
    # the running sum goes over counts of whole-number cells, a bounded table, then inside each cell
    cells = m.groupBy(F.floor("most").alias("cell")).agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("cell"))
    cells = cells.select("cell", F.coalesce(F.sum("n").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("beyond"), F.sum("n").over(Window.partitionBy()).alias("total"))
    w = Window.partitionBy("cell").orderBy(F.desc("most")).rangeBetween(Window.unboundedPreceding, 0)
    ranked = m.withColumn("cell", F.floor("most")).withColumn("inside", F.count("*").over(w)).join(cells, "cell")
    return ranked.select("entity", ((c("inside") + c("beyond")) / c("total")).alias("p_value"))


@query("2.6-33", BASE + ", a AS (SELECT entity, (k * 36 + frame * 7) % 360 // 10 AS cell, sum(CAST(value AS DECIMAL(18,2))) AS w FROM r GROUP BY 1, 2) SELECT entity, round(CAST(max(w) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 9) AS concentration FROM a GROUP BY 1")
def concentration(s, d):
    a = readings(s, d).groupBy("entity", F.floor((c("k") * 36 + c("frame") * 7) % 360 / 10).alias("cell")).agg(F.sum(c("value").cast("decimal(18,2)")).alias("w"))
    return a.groupBy("entity").agg((F.max("w").cast("double") / F.sum("w").cast("double")).alias("concentration"))


@query("2.6-34", "SELECT label, i, round(avg(x), 9) AS x FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def weight_average(s, d):
    return table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(c("x").cast("double")).alias("x"))


@query("2.6-35", BASE + ", p AS (SELECT entity, bin, v, n, lag(v) OVER (PARTITION BY entity ORDER BY bin) AS pv FROM b WHERE v > 60) SELECT entity, round(sum(v - coalesce(pv, v)), 6) AS old, round(sum(sqrt((v - pv) * (v - pv) + n * n)), 6) AS new FROM p GROUP BY 1 HAVING min(v) <= 200")
def rescored_paths(s, d):
    p = day_bins(s, d).where("v > 60").withColumn("pv", F.lag("v").over(Window.partitionBy("entity").orderBy("bin")))
    x = p.groupBy("entity").agg(F.sum(c("v") - F.coalesce("pv", "v")).alias("old"), F.sum(F.sqrt((c("v") - c("pv")) * (c("v") - c("pv")) + c("n") * c("n"))).alias("new"), F.min("v").alias("least"))
    return x.where("least <= 200").select("entity", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"))


@query("2.4-11 2.4-12", BASE + " SELECT event_type, round(count(*) FILTER (k % 3 = 0) / count(*), 9) AS share FROM r GROUP BY 1 HAVING count(*) FILTER (k % 3 = 0) / count(*) > 0.34")
def share_warnings(s, d):
    x = unranked(s, d).groupBy("event_type").agg((F.count_if(c("k") % 3 == 0) / F.count("*")).alias("share"))
    return x.where("share > 0.34")


@query("2.11-21", BASE + ", t AS (SELECT entity, frame // 10 AS track, frame, value, value - lag(value) OVER (PARTITION BY entity, frame // 10 ORDER BY frame) AS dv FROM r) SELECT entity, track, count(*) AS n, max(frame) - min(frame) AS span FROM t GROUP BY 1, 2 HAVING (count(*) >= 8 OR max(frame) - min(frame) >= 9) AND abs(arg_max(value, frame) - arg_min(value, frame)) >= 0.25 * sum(abs(dv))")
def track_filter(s, d):
    r = readings(s, d).withColumn("track", F.expr("frame div 10"))
    t = r.withColumn("dv", F.abs(c("value") - F.lag("value").over(Window.partitionBy("entity", "track").orderBy("frame"))))
    x = t.groupBy("entity", "track").agg(F.count("*").alias("n"), (F.max("frame") - F.min("frame")).alias("span"), F.abs(F.max_by("value", "frame") - F.min_by("value", "frame")).alias("net"), F.sum("dv").alias("path"))
    return x.where("(n >= 8 OR span >= 9) AND net >= 0.25 * path").select("entity", "track", "n", "span")


@query("2.11-23", BASE + ", x AS (SELECT entity, max(bin) AS e, arg_max(v, bin) AS lv, max(v) AS mv, max(n) AS mn, avg(v) AS av FROM b GROUP BY 1) SELECT entity, round(least(1, CASE WHEN e < 29 THEN 0.3 ELSE 0 END + CASE WHEN lv < 0.5 * mv THEN 0.4 ELSE 0 END + CASE WHEN mn >= 5 THEN 0.2 ELSE 0 END + CASE WHEN av > 100 THEN 0.2 ELSE 0 END), 9) AS score FROM x")
def burst_score(s, d):
    x = day_bins(s, d).groupBy("entity").agg(F.max("bin").alias("e"), F.max_by("v", "bin").alias("lv"), F.max("v").alias("mv"), F.max("n").alias("mn"), F.avg("v").alias("av"))
    add = lambda cond, w: F.when(F.expr(cond), w).otherwise(0.0)
    return x.select("entity", F.least(F.lit(1.0), add("e < 29", 0.3) + add("lv < 0.5 * mv", 0.4) + add("mn >= 5", 0.2) + add("av > 100", 0.2)).alias("score"))
