"""Sources, sinks and streams, each written and read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import parameters
from panelforge.plans.base import BASE, c, day_bins, query, readings, table, unranked
from panelforge.sources import backup, exports, readers, writers
from panelforge.streaming import bank, live, streams


@dataclass(frozen=True)
class Limits:
    click: int = 3
    view: float = 0.5
    error: str = "none"


#: A document holds so many entities, whatever the size of the table.
PER_DOCUMENT = 64


def entity_series(s, d):
    b = day_bins(s, d)
    onset = F.min(F.when(c("v") > 150, c("bin")))
    o = b.groupBy("entity").agg(onset.alias("onset"))
    return b.join(o, "entity").select(c("entity").cast("string").alias("id"), F.when(c("onset").isNull(), "never").otherwise("within").alias("status"), "onset", c("bin").alias("frame"), "length")


@query("2.2-2 2.1-7", BASE + ", o AS (SELECT entity, min(CASE WHEN v > 150 THEN bin END) AS onset FROM b GROUP BY 1) SELECT CAST(b.entity AS VARCHAR) AS id, CASE WHEN onset IS NULL THEN 'never' ELSE 'within' END AS status, onset, bin AS frame, round(length, 9) AS length FROM b JOIN o ON b.entity = o.entity")
def prediction_documents(s, d):
    path = writers.scratch(s)
    writers.prediction_documents(entity_series(s, d), path, "windows", 1, F.floor(c("id").cast("long") / PER_DOCUMENT))
    return readers.prediction_series(readers.documents(s, path, readers.PREDICTIONS, "pred.v1")).select("id", "status", "onset", "frame", "length")


@query("2.1-7 2.1-10 2.10-9", BASE + ", o AS (SELECT entity, min(CASE WHEN v > 150 THEN bin END) AS fv FROM b GROUP BY 1) SELECT CAST(b.entity AS VARCHAR) AS id, CASE WHEN fv IS NULL THEN 'no_event' ELSE 'within' END AS verdict, CASE WHEN fv > 0 THEN fv - 1 END AS last_absent, fv AS first_visible, bin, CASE WHEN n >= 3 THEN 'full' ELSE 'partial' END AS state, round(length, 9) AS length FROM b JOIN o ON b.entity = o.entity")
def label_documents(s, d):
    b = day_bins(s, d)
    o = b.groupBy("entity").agg(F.min(F.when(c("v") > 150, c("bin"))).alias("fv"))
    trace = F.struct(c("bin").cast("string").alias("bin"), F.struct(F.when(c("n") >= 3, "full").otherwise("partial").alias("state"), "length").alias("t"))
    per = b.groupBy("entity").agg(F.map_from_entries(F.collect_list(trace)).alias("traces")).join(o, "entity")
    answer = F.struct(F.when(c("fv").isNull(), "no_event").otherwise("within").alias("verdict"), F.when(c("fv") > 0, c("fv") - 1).alias("last_absent"), c("fv").alias("first_visible"), "traces")
    docs = per.groupBy(F.floor(c("entity") / PER_DOCUMENT).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(c("entity").cast("string"), answer))).alias("labels"))
    path = writers.scratch(s)
    docs.select(F.lit("bench.v1").alias("schema"), "labels").write.option("maxRecordsPerFile", 1).json(path)
    return readers.label_rows(readers.documents(s, path, readers.LABELS, "bench.v1")).drop("file")


@query("2.1-9 2.2-3", BASE + ", f AS (SELECT entity, bin, min(event_id) AS event_id FROM r GROUP BY 1, 2) SELECT entity, count(*) AS n, min(bin) AS first_bin, max(bin) AS last_bin, CAST(sum(event_id) AS BIGINT) AS ids FROM f GROUP BY 1")
def csv_round_trip(s, d):
    path = writers.scratch(s)
    writers.csv(unranked(s, d).select("entity", "bin", "event_id", "value"), path)
    series = readers.csv_series(s, path, "entity", "bin", ["event_id", "value"], "entity long, bin long, event_id long, value double")
    ids = F.aggregate("series", F.lit(0).cast("long"), lambda t, x: t + x["event_id"])
    return series.select("entity", F.size("series").alias("n"), c("series")[0]["bin"].alias("first_bin"), F.element_at("series", -1)["bin"].alias("last_bin"), ids.alias("ids"))


@query("2.1-6 2.2-1 2.2-20", BASE + " SELECT entity, bin, round(v, 9) AS v, n FROM b")
def partitioned_bins(s, d):
    """Bins by day partition, read back with an explicit schema."""
    path = writers.scratch(s)
    writers.bins(day_bins(s, d).select("entity", "bin", "v", "n"), path, ["bin"])
    return s.read.schema("entity long, v double, n long, bin long").parquet(path)


@query("2.1-17 2.2-6", "SELECT 'grp=' || g AS folder, true AS found FROM (SELECT DISTINCT user_id % 5 AS g FROM events)")
def run_discovery(s, d):
    path = writers.scratch(s)
    unranked(s, d).select((c("entity") % 5).alias("grp"), "event_id").repartition("grp").write.partitionBy("grp").json(path)
    return readers.run_folders(s, path, "part-*").groupBy("folder").agg((F.sum("size") > 0).alias("found"))


@query("2.1-5", "SELECT count(*) AS n, max(event_id) AS last FROM events")
def counted_scan(s, d):
    df, seen = readers.counted(table(s, d, "events"), "scan", F.max("event_id").alias("last"))
    df.write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(seen.get["rows"], seen.get["last"])], "n long, last long")


@query("2.1-16", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def dimension_lookup(s, d):
    """Fixed-size dimensions; Spark broadcasts them by their measured size."""
    n = table(s, d, "nation").join(table(s, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return table(s, d, "customer").join(n, c("c_nationkey") == c("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


WORDS = {"view": "looked", "click": "pressed", "error": "failed"}


@query("2.2-4 2.2-14", "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'looked' WHEN 'click' THEN 'pressed' WHEN 'error' THEN 'failed' ELSE event_type END AS status, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 30 AS VARCHAR) ELSE '' END AS onset, CASE WHEN value > 100 THEN 'long;' || event_type ELSE event_type END AS flags, printf('%.2f', value) AS px, printf('%.2f', value * 2) AS um FROM events")
def entity_export(s, d):
    e = table(s, d, "events").select(c("event_id").alias("id"), c("event_type").alias("status"), F.when(c("event_id") % 3 == 0, c("event_id") % 30).alias("onset"), F.array_compact(F.array(F.when(c("value") > 100, "long"), c("event_type"))).alias("flags"), c("value").alias("px"), F.lit(2.0).alias("um"))
    return writers.export_rows(e, WORDS, True)


@query("2.2-11", "SELECT '' AS place, '| kind | n | most |' AS line UNION ALL SELECT ' ', '| --- | --- | --- |' UNION ALL SELECT event_type, '| ' || event_type || ' | ' || count(*) || ' | ' || max(event_id) || ' |' FROM events GROUP BY event_type")
def markdown_report(s, d):
    r = table(s, d, "events").groupBy(c("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("most"))
    return writers.markdown(r, ["kind", "n", "most"])


@query("2.2-12", BASE + ", x AS (SELECT entity, count(*) FILTER (n < 2) AS bad, min(v) AS conf FROM b GROUP BY 1) SELECT entity, row_number() OVER (PARTITION BY entity % 5 ORDER BY bad DESC, conf, entity) AS card FROM x")
def gallery_order(s, d):
    x = day_bins(s, d).groupBy("entity").agg(F.count_if(c("n") < 2).alias("bad"), F.min("v").alias("conf"))
    return x.select("entity", F.row_number().over(Window.partitionBy(c("entity") % 5).orderBy(F.desc("bad"), "conf", "entity")).alias("card"))


@query("2.2-23", BASE + ", m AS (SELECT entity, frame, event_id FROM r WHERE frame % 5 = 0) SELECT r.entity, r.frame, coalesce(m.event_id, -1) AS source, CASE WHEN r.event_type = 'error' THEN 'review_burst_candidate' WHEN r.value < 20 THEN 'review_not_started' ELSE 'pass' END AS qc_status FROM r LEFT JOIN m ON r.entity = m.entity AND r.frame = m.frame")
def pilot_export(s, d):
    r = readings(s, d)
    m = r.where("frame % 5 = 0").select("entity", "frame", c("event_id").alias("source"))
    qc = F.when(c("event_type") == "error", "review_burst_candidate").when(c("value") < 20, "review_not_started").otherwise("pass")
    return r.join(m, ["entity", "frame"], "left").select("entity", "frame", F.coalesce("source", F.lit(-1)).alias("source"), qc.alias("qc_status"))


@query("2.12-1", "SELECT user_id AS entity, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 9) AS v FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    return streams.caught_up(streams.tumbling(streams.events(s, d), "1 day"), writers.scratch(s), ["entity", "day"])


@query("2.12-3", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events), q AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS entity, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, count(*) AS n FROM q GROUP BY user_id, k")
def stream_sessions(s, d):
    return streams.caught_up(streams.sessions(streams.events(s, d), "12 hours"), writers.scratch(s), ["entity", "first"], "complete")


@query("2.12-5 2.12-8", "SELECT user_id AS entity, max(event_id) AS last_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_latest(s, d):
    return streams.caught_up(streams.latest(streams.events(s, d)), writers.scratch(s), ["entity"])


@query("2.12-3 2.11-10", "WITH r AS (SELECT user_id AS entity, event_id, value < 100 AS miss, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY entity, miss ORDER BY i) AS g FROM r), q AS (SELECT entity, g, arg_min(event_id, i) AS e, min(i) AS i FROM g WHERE miss GROUP BY 1, 2 HAVING count(*) > 3), l AS (SELECT entity, arg_min(e, i) AS lost FROM q GROUP BY 1) SELECT r.entity, count(*) AS seen, coalesce(max(lost), -1) AS lost_at FROM r LEFT JOIN l ON r.entity = l.entity GROUP BY 1")
def stream_follow(s, d):
    return streams.caught_up(streams.follow(streams.events(s, d), 100.0, 3), writers.scratch(s), ["entity"])


LIVE = """WITH e AS (SELECT user_id AS entity, event_id, ts, value, event_type <> 'error' AND value >= 5 AS ok FROM events),
o AS (SELECT *, coalesce(ts < max(CASE WHEN ok THEN ts END) OVER (PARTITION BY entity ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM e)
"""


def live_path(s, d):
    path = writers.scratch(s)
    stream = streams.events(s, d)
    live.run(stream, path, "entity", "ts", "event_id", (c("event_type") != "error") & (c("value") >= 5))
    return path


@query("2.12-8 2.2-16", LIVE + "SELECT entity, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, arg_max(value, struct_pack(t := ts, e := event_id)) AS value FROM o WHERE ok AND NOT stale GROUP BY 1")
def live_answers(s, d):
    """Updates taken in by a stream, and the live table replayed from its journal."""
    got = live.replayed(live.journal(s, live_path(s, d)), "entity", "ts", "event_id")
    return got.select("entity", "event_id", "value")


@query("2.12-8", LIVE + "SELECT CASE WHEN ok THEN 'stale' ELSE 'invalid' END AS reason, count(*) AS n FROM o WHERE stale OR NOT ok GROUP BY 1")
def rejected_answers(s, d):
    return s.read.parquet(f"{live_path(s, d)}/rejected").groupBy("reason").agg(F.count("*").alias("n"))


@query("2.2-21", "SELECT o_orderpriority, count(*) AS source_n, count(*) AS copy_n, true AS same FROM orders GROUP BY 1")
def verified_backup(s, d):
    """A copy by priority, each part compared by its digest."""
    return backup.verified(table(s, d, "orders"), writers.scratch(s), ["o_orderpriority"]).select("o_orderpriority", "source_n", "copy_n", "same")


BANK = bank.Rules(least=-0.1, again=0.0, low=0.0, high=0.6, every=4, size=3, most=4)


@query("2.11-10")
def bank_followed(s, d):
    """Each label's vectors as looks in order of their ids."""
    return bank.batch(table(s, d, "embeddings").where("embedding IS NOT NULL").select(c("label").cast("long").alias("label"), "vec_id", "embedding"), "label", "vec_id", "embedding", BANK)


@query("2.11-10 2.12-3")
def stream_bank(s, d):
    looks = streams.source(s, d, "embeddings", "vec_id long, embedding array<float>, label int").where("embedding IS NOT NULL").select(c("label").cast("long").alias("label"), "vec_id", "embedding")
    return streams.caught_up(bank.stream(looks, "label", "vec_id", "embedding", BANK), writers.scratch(s), ["label"])


@query("2.2-6", BASE + """, g AS (SELECT entity % 10 AS movie, 'entities' AS name, count(DISTINCT entity) AS n FROM b GROUP BY 1)
SELECT movie, name, n, CAST(NULL AS VARCHAR) AS error FROM g UNION ALL SELECT entity % 10, 'growth', count(*), NULL FROM b GROUP BY 1""")
def movie_bundle(s, d):
    """All tables of each movie under one folder, and what was written of each."""
    b = day_bins(s, d).withColumn("movie", c("entity") % 10)
    tables = {"entities": lambda: b.groupBy("movie", "entity").agg(F.max("length").alias("final")), "growth": lambda: b.select("movie", "entity", "bin", "length")}
    return exports.bundle(s, tables, writers.scratch(s), "movie")


@query("2.13-1", """WITH e AS (SELECT DISTINCT event_type || '=' || CASE WHEN event_id % 3 = 0 THEN CAST(props->>'$.k' AS VARCHAR) WHEN event_id % 3 = 1 THEN 'yes' ELSE '0.5' END AS line FROM events),
k AS (SELECT line, split_part(line, '=', 1) AS name, split_part(line, '=', 2) AS value FROM e)
SELECT line, name, value, CASE WHEN value = 'yes' THEN 'text' WHEN value = '0.5' THEN 'float' ELSE 'int' END AS kind,
  CASE WHEN name NOT IN ('click', 'view', 'error') THEN 'unknown' WHEN name = 'click' AND (value = 'yes' OR value = '0.5') THEN 'wrong kind' WHEN name = 'view' AND value = 'yes' THEN 'wrong kind' END AS problem FROM k""")
def typed_overrides(s, d):
    """Overrides as texts against typed defaults."""
    n = c("event_id") % 3
    value = F.when(n == 0, F.get_json_object("props", "$.k")).when(n == 1, "yes").otherwise("0.5")
    lines = table(s, d, "events").select(F.concat("event_type", F.lit("="), value).alias("line")).distinct()
    return parameters.judged(lines, "line", Limits())
