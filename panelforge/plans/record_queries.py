"""Versioned records, filters, rules, set operations, orders and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import geometry, text
from panelforge.operators import corrections, review, sampling
from panelforge.plans.base import BASE, KEYS, c, day_bins, query, readings, table, unranked

#: Revisions of records: conversations as (uuid, revision), with a tombstone where the text is short.
REV = "WITH v AS (SELECT conv_id AS uuid, turn AS revision, role AS kind, length(text) AS size, length(text) < 60 AS dead FROM conversations), cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY revision DESC) AS n FROM v) WHERE n = 1)"


def revisions(s, d):
    size = F.length("text")
    return table(s, d, "conversations").select(c("conv_id").alias("uuid"), c("turn").alias("revision"), c("role").alias("kind"), size.alias("size"), (size < 60).alias("dead"))


def current(s, d):
    return review.latest(revisions(s, d), ["uuid"], [F.desc("revision")])


@query("2.1-11 2.7-19", REV + " SELECT uuid, revision, kind, size FROM cur WHERE kind = 'assistant' AND NOT dead")
def current_entities(s, d):
    return review.without_tombstones(current(s, d), c("dead")).where("kind = 'assistant'").select("uuid", "revision", "kind", "size")


@query("2.1-12", REV + " SELECT uuid, revision, kind, size FROM cur WHERE uuid = 7")
def entity_lookup(s, d):
    return review.latest(revisions(s, d).where("uuid = 7"), ["uuid"], [F.desc("revision")]).select("uuid", "revision", "kind", "size")


@query("2.1-13", REV + " SELECT uuid, revision, kind, row_number() OVER (PARTITION BY uuid ORDER BY revision) AS place FROM v")
def revision_history(s, d):
    return revisions(s, d).select("uuid", "revision", "kind", F.row_number().over(Window.partitionBy("uuid").orderBy("revision")).alias("place"))


@query("2.2-17 2.9-1", REV + " SELECT uuid, max(revision) + 1 AS next FROM (SELECT uuid, revision FROM cur UNION ALL SELECT uuid, revision FROM v) GROUP BY 1")
def next_revision(s, d):
    return review.next_revision(current(s, d), revisions(s, d), "uuid", "revision")


@query("2.2-17", REV + ", wr AS (SELECT uuid, revision AS expected, kind FROM v WHERE revision >= 3) SELECT wr.uuid, wr.expected, wr.kind FROM wr ANTI JOIN cur ON wr.uuid = cur.uuid AND wr.expected = cur.revision")
def revision_conflicts(s, d):
    writes = revisions(s, d).where("revision >= 3").select("uuid", c("revision").alias("expected"), "kind")
    return review.revision_conflicts(writes, current(s, d), "uuid", "expected", "revision")


@query(
    "2.2-16 2.2-17 2.2-18",
    REV
    + """, e AS (SELECT uuid, revision, kind, size FROM cur WHERE NOT dead), h AS (SELECT uuid, revision, kind, size FROM v),
w AS (SELECT uuid, revision + 1 AS revision, kind, size + 1 AS size FROM e WHERE uuid % 3 = 0), e2 AS (SELECT * FROM e WHERE uuid % 3 <> 0 UNION ALL SELECT * FROM w),
t AS (SELECT cur.uuid, -1 AS revision, cur.kind, e2.size FROM cur LEFT JOIN e2 ON cur.uuid = e2.uuid WHERE cur.uuid % 7 = 0)
SELECT 'entity' AS part, * FROM e2 WHERE uuid % 7 <> 0 UNION ALL SELECT 'revision', * FROM (SELECT * FROM h UNION ALL SELECT * FROM w UNION ALL SELECT * FROM t)""",
)
def saved_and_deleted(s, d):
    """Both tables after one conditional save and some deletes; the history only grows."""
    cols = ["uuid", "revision", "kind", "size"]
    now, history = current(s, d), revisions(s, d).select(*cols)
    entities = now.where("NOT dead").select(*cols)
    writes = entities.where("uuid % 3 = 0").select("uuid", c("revision").alias("expected"), "kind", (c("size") + 1).alias("size"))
    entities, history = review.save(entities, history, writes, "uuid", "expected")
    entities, history = review.delete(entities, history, now.where("uuid % 7 = 0").select("uuid", "kind"), "uuid")
    return entities.select(F.lit("entity").alias("part"), *cols).unionByName(history.select(F.lit("revision").alias("part"), *cols))


@query("2.2-18 2.9-3", REV + " SELECT uuid, -1 AS revision, kind, revision AS prior FROM cur WHERE dead")
def tombstones(s, d):
    return current(s, d).where("dead").select("uuid", F.lit(-1).alias("revision"), "kind", c("revision").alias("prior"))


@query("2.2-19 2.3-20", REV + " SELECT uuid, sha256(concat_ws(chr(9), CAST(uuid AS VARCHAR), CAST(revision AS VARCHAR), kind)) AS hash FROM cur")
def snapshot_hash(s, d):
    return current(s, d).select("uuid", text.canonical_hash(c("uuid"), c("revision"), c("kind")).alias("hash"))


@query("2.2-21", "SELECT role AS kind, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(concat_ws(chr(9), CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), text)), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM conversations GROUP BY 1")
def table_digest(s, d):
    t = table(s, d, "conversations").withColumnRenamed("role", "kind")
    return review.ordered_digest(t, ["kind"], [c("conv_id").cast("string"), c("turn").cast("string"), c("text")])


@query("2.2-16 2.12-5", BASE + " SELECT entity, max(event_id) AS last_id, arg_max(value, struct_pack(t := ts, e := event_id)) AS value, count(*) AS n FROM r WHERE event_type IN ('click', 'view') GROUP BY 1")
def journal_replay(s, d):
    r = unranked(s, d).where(c("event_type").isin("click", "view"))
    return r.groupBy("entity").agg(F.max("event_id").alias("last_id"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))


@query("2.4-1 2.4-3", "SELECT c_custkey, c_nationkey FROM customer WHERE coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal > 0 END, true) AND c_mktsegment <> 'HOUSEHOLD'")
def isolated_filter(s, d):
    isolated = F.when(c("c_custkey") % 4 != 0, c("c_acctbal") > 0)
    return table(s, d, "customer").where(F.coalesce(isolated, F.lit(True)) & (c("c_mktsegment") != "HOUSEHOLD")).select("c_custkey", "c_nationkey")


@query("2.4-4", BASE + ", x AS (SELECT entity, abs(v - lag(v) OVER w) AS st FROM b WINDOW w AS (PARTITION BY entity ORDER BY bin)), y AS (SELECT entity, max(v) - min(v) AS reach FROM b GROUP BY 1) SELECT x.entity FROM x JOIN y ON x.entity = y.entity GROUP BY x.entity, reach HAVING max(st) <= 300 AND count(*) FILTER (st > 150) <= 10 AND sum(st) <= 4 * reach + 900")
def plausible_drift(s, d):
    b = day_bins(s, d).withColumn("st", F.abs(c("v") - F.lag("v").over(Window.partitionBy("entity").orderBy("bin"))))
    x = b.groupBy("entity").agg(F.max("st").alias("m"), F.count_if(c("st") > 150).alias("k"), F.sum("st").alias("t"), (F.max("v") - F.min("v")).alias("reach"))
    return x.where("m <= 300 AND k <= 10 AND t <= 4 * reach + 900").select("entity")


@query("2.4-5", BASE + ", f AS (SELECT entity, arg_min(v, bin) AS v0 FROM b GROUP BY 1) SELECT b.entity, max(abs(v - v0)) > 3 * 80 AS own_frame FROM b JOIN f ON b.entity = f.entity GROUP BY 1")
def own_frame(s, d):
    first = F.first("v").over(Window.partitionBy("entity").orderBy("bin"))
    return day_bins(s, d).withColumn("m", F.abs(c("v") - first)).groupBy("entity").agg((F.max("m") > 240).alias("own_frame"))


@query("2.4-6", "SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '_')) IN ('4-not_specified', '5-low') OR o_orderstatus = 'F' AS withdrawn FROM orders")
def withdrawn_records(s, d):
    return table(s, d, "orders").select("o_orderkey", (F.lower(F.replace(c("o_orderpriority"), F.lit(" "), F.lit("_"))).isin("4-not_specified", "5-low") | (c("o_orderstatus") == "F")).alias("withdrawn"))


@query("2.4-7", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus <> 'F' THEN NULL WHEN l_discount > 0.05 AND l_tax > 0.04 THEN NULL ELSE l_quantity END AS tip FROM lineitem")
def licensed_point(s, d):
    tip = F.when(c("l_returnflag") == "R", None).when(c("l_linestatus") != "F", None).when((c("l_discount") > 0.05) & (c("l_tax") > 0.04), None).otherwise(c("l_quantity"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", tip.alias("tip"))


@query("2.4-8 2.4-18", "SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 400000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_custkey % 9 = 0 THEN 'owner' END], lambda x: x IS NOT NULL) AS failed FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P' OR o_custkey % 9 = 0")
def record_violations(s, d):
    failed = review.violations(price=c("o_totalprice") > 400000, status=c("o_orderstatus") == "P", owner=c("o_custkey") % 9 == 0)
    return table(s, d, "orders").select("o_orderkey", failed.alias("failed")).where(F.size("failed") > 0)


@query("2.4-9 2.13-1", BASE + ", x AS (SELECT entity, ts <= lag(ts) OVER (PARTITION BY entity ORDER BY frame) AS back, value FROM r) SELECT entity, coalesce(bool_or(back), false) AS not_rising, bool_or(value <= 0) AS not_positive FROM x GROUP BY 1")
def acquisition_checks(s, d):
    r = readings(s, d).withColumn("back", c("ts") <= F.lag("ts").over(Window.partitionBy("entity").orderBy("frame")))
    return r.groupBy("entity").agg(F.coalesce(F.bool_or("back"), F.lit(False)).alias("not_rising"), F.bool_or(c("value") <= 0).alias("not_positive"))


@query("2.4-10 2.10-1", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_type LIKE 'ECO%' THEN 'economy' END, CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_retailprice < 950 THEN 'cheap' END], lambda x: x IS NOT NULL), ';') AS reasons FROM part")
def reasons_to_check(s, d):
    rules = review.violations(economy=c("p_type").startswith("ECO"), small=c("p_size") < 10, cheap=c("p_retailprice") < 950)
    return table(s, d, "part").select("p_partkey", F.array_join(rules, ";").alias("reasons"))


REASON = "CASE WHEN n < 2 THEN 'short' WHEN v > 300 THEN 'lost' WHEN bin < 2 OR bin > 27 THEN 'edge' ELSE 'ok' END"


@query("2.4-13", BASE + f" SELECT {REASON} AS reason, count(*) AS n FROM b GROUP BY 1")
def eligibility_reasons(s, d):
    return day_bins(s, d).groupBy(F.expr(REASON).alias("reason")).agg(F.count("*").alias("n"))


@query("2.4-13 2.8-13", BASE + f", e AS (SELECT entity, bin, row_number() OVER (PARTITION BY entity ORDER BY bin) - 1 AS i FROM b WHERE {REASON} = 'ok'), t AS (SELECT entity, bin, row_number() OVER (PARTITION BY entity ORDER BY bin) - 1 AS k, count(*) OVER (PARTITION BY entity) AS n FROM e WHERE i % 2 = 0) SELECT entity, bin FROM t WHERE n <= 4 OR k IN (round_even(0 * (n - 1) / 3, 0), round_even(1 * (n - 1) / 3, 0), round_even(2 * (n - 1) / 3, 0), round_even(3 * (n - 1) / 3, 0))")
def evenly_spaced_cap(s, d):
    e = day_bins(s, d).where(F.expr(REASON) == "ok").select("entity", "bin", (F.row_number().over(Window.partitionBy("entity").orderBy("bin")) - 1).alias("i"))
    return sampling.evenly_spaced(e.where("i % 2 = 0"), KEYS, ["bin"], 4).select("entity", "bin")


@query("2.4-14", "SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AND c_custkey % 100 BETWEEN 20 AND 70 AS inside FROM customer")
def review_region(s, d):
    return table(s, d, "customer").select("c_custkey", (c("c_acctbal").between(0, 5000) & (c("c_custkey") % 100).between(20, 70)).alias("inside"))


POLYGON = [(0.0, 10.0), (400.0, 0.0), (480.0, 60.0), (200.0, 95.0), (300.0, 50.0)]
CROSS = " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < {bx - ax} * (y - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]))


@query("2.4-16", f"WITH p AS (SELECT event_id, value AS x, CAST(props->>'$.k' AS DOUBLE) AS y FROM events) SELECT event_id, ({CROSS}) % 2 = 1 AS inside FROM p")
def point_in_polygon(s, d):
    e = table(s, d, "events").select("event_id", c("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    return e.select("event_id", geometry.inside_polygon(c("x"), c("y"), POLYGON).alias("inside"))


@query("2.4-17 2.8-11", BASE + " SELECT entity, event_id, rank FROM (SELECT entity, event_id, value, row_number() OVER (PARTITION BY entity ORDER BY value DESC, event_id) AS rank FROM r WHERE value > 120) WHERE rank <= 3")
def ranked_candidates(s, d):
    return sampling.top_k(unranked(s, d).where("value > 120"), KEYS, [F.desc("value"), c("event_id")], 3).select("entity", "event_id", "rank")


@query("2.8-1", "SELECT c_custkey, 'g' || lpad(CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY round_even(c_acctbal / 400, 0), c_custkey) AS VARCHAR), 3, '0') AS id, c_nationkey AS movie FROM customer")
def row_major_ids(s, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.bround(c("c_acctbal") / 400), "c_custkey")
    return table(s, d, "customer").select("c_custkey", F.concat(F.lit("g"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")).alias("id"), c("c_nationkey").alias("movie"))


@query("2.8-3 2.8-4 2.8-12", BASE + ", x AS (SELECT entity, count(*) >= 25 AS done, CASE WHEN max(v) > 200 THEN max(v) END AS conf FROM b GROUP BY 1) SELECT entity, row_number() OVER (ORDER BY done, conf IS NULL, conf, entity) AS place FROM x ORDER BY place LIMIT 40")
def check_list(s, d):
    x = day_bins(s, d).groupBy("entity").agg((F.count("*") >= 25).alias("done"), F.when(F.max("v") > 200, F.max("v")).alias("conf"))
    first = x.orderBy("done", c("conf").isNull(), "conf", "entity").limit(40)  # a report of the first 40
    return first.withColumn("place", F.row_number().over(Window.orderBy("done", c("conf").isNull(), "conf", "entity"))).select("entity", "place")


@query("2.8-5", "SELECT o_custkey, min(o_orderkey) AS next FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def next_unfinished(s, d):
    return table(s, d, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("next"))


def digest(id_: str, seed: int) -> str:
    return f"md5(CAST({id_} AS VARCHAR) || ':{seed}')"


@query("2.8-6", f"SELECT o_orderkey, o_orderpriority, turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {digest('o_orderkey', 5)}, o_orderkey) AS turn FROM orders) ORDER BY turn, o_orderpriority LIMIT 23")
def stratified_rotation(s, d):
    return sampling.stratified_rotation(table(s, d, "orders"), "o_orderpriority", "o_orderkey", 23, 5).select("o_orderkey", "o_orderpriority", "turn")


@query("2.8-7", f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY {digest('o_orderkey', 6)}, o_orderkey) AS o FROM orders), q AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {digest('o_orderkey', 6)}, o_orderkey) AS p FROM f WHERE o <= 3) SELECT o_orderkey, o_orderstatus FROM q WHERE (o_orderstatus = 'F' AND p <= 40) OR (o_orderstatus = 'O' AND p <= 40) OR (o_orderstatus = 'P' AND p <= 20)")
def capped_mixture(s, d):
    return sampling.capped_mixture(table(s, d, "orders"), "o_orderstatus", {"F": 40, "O": 40, "P": 20}, "o_custkey", 3, "o_orderkey", 6).select("o_orderkey", "o_orderstatus")


@query("2.8-8", f"SELECT c_custkey, place, place <= 20 AS sampled FROM (SELECT c_custkey, row_number() OVER (ORDER BY {digest('c_custkey', 9)}, c_custkey) AS place FROM customer) WHERE place <= 30")
def sample_with_reserve(s, d):
    first = table(s, d, "customer").select("c_custkey").withColumn("h", sampling.chance("c_custkey", 9)).orderBy("h", "c_custkey").limit(30)
    return first.withColumn("place", F.row_number().over(Window.orderBy("h", "c_custkey"))).select("c_custkey", "place", (c("place") <= 20).alias("sampled"))


@query("2.8-9", f"SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {digest('c_custkey', 4)}, c_custkey) AS n FROM customer) WHERE n = 1")
def one_of_each(s, d):
    return sampling.one_of_each(table(s, d, "customer"), "c_nationkey", "c_custkey", 4).select("c_custkey", "c_nationkey")


@query("2.8-10", BASE + """, f AS (SELECT entity, min(bin) AS fv, max(bin) + 2 AS nb FROM b GROUP BY 1), w AS (SELECT entity, fv, nb, unnest(list_distinct([fv + 6, round_even((nb - 2)::DOUBLE * 0.4::DOUBLE, 0)::BIGINT, round_even((nb - 2)::DOUBLE * 0.7::DOUBLE, 0)::BIGINT, nb - 2])) AS t FROM f),
o AS (SELECT entity, list_sort(list(t) FILTER (t >= fv + 6 AND t <= nb - 2)) AS ts, nb FROM w GROUP BY entity, nb) SELECT entity, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(ts, lambda t: [t])), lambda k, t: CASE WHEN len(k) > 0 AND t[1] - k[-1] < 8 THEN CASE WHEN t[1] = nb - 2 THEN list_concat(k[:-2], t) ELSE k END ELSE list_concat(k, t) END) AS bins FROM o WHERE ts IS NOT NULL""")
def planned_bins(s, d):
    f = day_bins(s, d).groupBy("entity").agg(F.min("bin").alias("fv"), (F.max("bin") + 2).alias("nb"))
    return f.select("entity", sampling.planned_bins(c("fv"), c("nb")).alias("bins")).where(F.size("bins") > 0)


@query(
    "2.11-28",
    BASE
    + """, x AS (SELECT entity, max(k) > 97 AS excluded, min(bin) AS model_onset, min(bin) FILTER (event_type = 'click' AND k < 40) AS onset,
  count(*) FILTER (event_type = 'click' AND k < 10) AS human, count(*) FILTER (event_type = 'click' AND k < 10 AND value > 180) AS changed,
  count(*) FILTER (event_type = 'view' AND k < 3) AS left_open FROM r GROUP BY 1)
SELECT entity, CASE WHEN excluded THEN 'excluded' WHEN onset > model_onset + 3 OR changed > 0 THEN 'corrected' WHEN onset IS NOT NULL AND left_open = 0 THEN 'checked'
  WHEN onset IS NOT NULL OR human > 0 THEN 'partly checked' ELSE 'model' END AS state FROM x""",
)
def review_states(s, d):
    count = lambda rule: F.count_if(F.expr(rule))
    x = unranked(s, d).groupBy("entity").agg(
        (F.max("k") > 97).alias("excluded"), F.min("bin").alias("model_onset"), F.min(F.when(F.expr("event_type = 'click' AND k < 40"), c("bin"))).alias("seen"),
        count("event_type = 'click' AND k < 10").alias("human"), count("event_type = 'click' AND k < 10 AND value > 180").alias("changed"), count("event_type = 'view' AND k < 3").alias("open"),
    )
    onset = F.when(c("seen").isNull(), "model").when(c("seen") > c("model_onset") + 3, "changed").otherwise("checked")
    return x.select("entity", review.review_state(c("excluded"), onset, c("changed"), c("human"), c("open")).alias("state"))


@query("2.11-28 2.11-32", BASE + ", x AS (SELECT entity, bin, min(value) AS a, max(value) AS z FROM r GROUP BY 1, 2) SELECT entity, bin, abs(z - a) > greatest(2, 0.1 * abs(a)) AS changed FROM x")
def changed_answers(s, d):
    x = unranked(s, d).groupBy("entity", "bin").agg(F.min("value").alias("a"), F.max("value").alias("z"))
    return x.select("entity", "bin", (F.abs(c("z") - c("a")) > F.greatest(F.lit(2.0), 0.1 * F.abs("a"))).alias("changed"))


@query("2.11-30", "SELECT c_custkey AS owner, coalesce(max(o_totalprice), c_acctbal) AS shown, max(o_totalprice) IS NOT NULL AS reviewed FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000 GROUP BY c_custkey, c_acctbal")
def reviewed_inventory(s, d):
    census = table(s, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").groupBy("o_custkey").agg(F.max("o_totalprice").alias("p"))
    cust = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return cust.join(census, cust["c_custkey"] == census["o_custkey"], "left").select(c("c_custkey").alias("owner"), F.coalesce("p", "c_acctbal").alias("shown"), c("p").isNotNull().alias("reviewed"))


@query("2.2-8", BASE + ", m AS (SELECT entity, min(bin) AS model FROM b WHERE v > 150 GROUP BY 1), h AS (SELECT entity, min(bin) AS human FROM r WHERE event_type = 'signup' AND k < 40 GROUP BY 1) SELECT count(*) FILTER (human IS NOT NULL) AS checked, count(*) FILTER (abs(human - model) > 2) AS changed, count(*) FILTER (human IS NULL) AS open, count(*) FILTER (model IS NULL) AS stale FROM m FULL JOIN h ON m.entity = h.entity")
def reviewed_counters(s, d):
    m = day_bins(s, d).where("v > 150").groupBy("entity").agg(F.min("bin").alias("model"))
    h = unranked(s, d).where("event_type = 'signup' AND k < 40").groupBy("entity").agg(F.min("bin").alias("human"))
    x = m.join(h, "entity", "full")
    return x.agg(F.count_if(c("human").isNotNull()).alias("checked"), F.count_if(F.abs(c("human") - c("model")) > 2).alias("changed"), F.count_if(c("human").isNull()).alias("open"), F.count_if(c("model").isNull()).alias("stale"))


#: Commands of people: an action by k, numbered by event; a session is ten users.
COMMANDS = BASE + """, cm AS (SELECT entity // 10 AS who, event_id AS n, entity AS e, bin, round(value / 10) AS value, CASE WHEN event_id % 2 = 0 THEN 'debris' ELSE 'not_a_grain' END AS reason,
  CASE WHEN k < 15 THEN 'undo' WHEN k < 18 THEN 'revert' WHEN k < 40 THEN 'confirm' WHEN k < 50 THEN 'onset' WHEN k < 55 THEN 'no_onset' WHEN k < 75 THEN 'length' WHEN k < 80 THEN 'no_tube'
    WHEN k < 85 THEN 'burst' WHEN k < 92 THEN 'exclude' ELSE 'include' END AS action FROM r),
st AS (SELECT who, list_reduce(list({'n': n, 'undo': action = 'undo'} ORDER BY n), lambda a, c: CASE WHEN c.undo THEN {'gone': a.gone, 'stack': a.stack[:-2]}
  WHEN len(a.stack) >= 50 THEN {'gone': list_append(a.gone, a.stack[1]), 'stack': list_append(a.stack[2:], c.n)} ELSE {'gone': a.gone, 'stack': list_append(a.stack, c.n)} END,
  {'gone': CAST([] AS BIGINT[]), 'stack': CAST([] AS BIGINT[])}) AS f FROM cm GROUP BY 1),
ef AS (SELECT cm.* FROM cm JOIN (SELECT who, unnest(list_concat(f.gone, f.stack)) AS n FROM st) s ON s.who = cm.who AND s.n = cm.n),
sd AS (SELECT ef.* FROM ef LEFT JOIN (SELECT e, max(n) AS last FROM ef WHERE action = 'revert' GROUP BY 1) v ON v.e = ef.e WHERE action <> 'revert' AND (last IS NULL OR n > last)),
md AS (SELECT entity AS e, min(CASE WHEN length > 150 THEN bin END) AS visible FROM b GROUP BY 1),
ow AS (SELECT e, arg_max({'a': action, 'b': bin}, n) FILTER (action IN ('onset', 'no_onset')) AS o, arg_max({'a': action, 'r': reason}, n) FILTER (action IN ('exclude', 'include')) AS x, bool_or(action = 'confirm') AS checked FROM sd GROUP BY 1),
an AS (SELECT md.e, CASE WHEN o IS NULL THEN CASE WHEN visible IS NULL THEN 'no_emergence_by_end' ELSE 'emerged_within' END WHEN o.a = 'no_onset' THEN 'no_emergence_by_end' WHEN o.b <= 0 THEN 'emerged_at_start' ELSE 'emerged_within' END AS verdict,
  CASE WHEN o IS NULL THEN visible WHEN o.a = 'onset' AND o.b > 0 THEN o.b END AS visible, CASE WHEN o IS NULL THEN 'model' ELSE 'human' END AS origin, coalesce(x.a = 'exclude', false) AS excluded,
  CASE WHEN x.a = 'exclude' THEN x.r END AS reason, coalesce(checked, false) AS checked FROM md LEFT JOIN ow ON ow.e = md.e)"""


def said(s, d):
    e, k = unranked(s, d), c("k")
    action = F.lit("include")
    for below, name in ((92, "exclude"), (85, "burst"), (80, "no_tube"), (75, "length"), (55, "no_onset"), (50, "onset"), (40, "confirm"), (18, "revert"), (15, "undo")):
        action = F.when(k < below, name).otherwise(action)
    reason = F.when(c("event_id") % 2 == 0, "debris").otherwise("not_a_grain")
    rows = e.select(F.floor(c("entity") / 10).alias("who"), c("event_id").alias("n"), c("entity").alias("e"), "bin", F.round(c("value") / 10).alias("value"), reason.alias("reason"), action.alias("action"))
    return corrections.since_revert(corrections.effective(rows, "who", "n"), "e", "n")


def model_onsets(s, d):
    m = day_bins(s, d).groupBy(c("entity").alias("e")).agg(F.min(F.when(c("length") > 150, c("bin"))).alias("visible"))
    return m.withColumn("verdict", F.when(c("visible").isNull(), "no_emergence_by_end").otherwise("emerged_within"))


@query("2.11-32", COMMANDS + " SELECT * FROM an")
def corrected_onsets(s, d):
    """Onsets and exclusions after all commands, undone and reverted ones aside."""
    return corrections.onset_answers(said(s, d), model_onsets(s, d), "e", "n")


@query("2.11-32", COMMANDS + """, hu AS (SELECT e, bin, arg_max({'a': action, 'v': value}, n) AS t FROM sd WHERE action IN ('length', 'no_tube', 'burst') GROUP BY 1, 2)
SELECT e, bin, CASE WHEN t.a = 'burst' THEN 'burst' WHEN t.a = 'length' AND t.v >= 2 THEN 'full' ELSE 'no_tube' END AS state, CASE WHEN t.a = 'length' AND t.v >= 2 THEN t.v ELSE 0 END::DOUBLE AS length, 'human' AS origin FROM hu
UNION ALL SELECT b.entity, b.bin, CASE WHEN length >= 2 THEN 'full' ELSE 'no_tube' END, CASE WHEN length >= 2 THEN round(length, 9) ELSE 0 END, 'confirmed' FROM b JOIN an ON an.e = b.entity LEFT JOIN hu ON hu.e = b.entity AND hu.bin = b.bin
WHERE b.bin % 4 = 0 AND checked AND verdict IN ('emerged_within', 'emerged_at_start') AND hu.e IS NULL""")
def corrected_traces(s, d):
    """Lengths that people gave or confirmed."""
    b = day_bins(s, d).select(c("entity").alias("e"), "bin", "length")
    told = said(s, d)
    return corrections.trace_answers(told, corrections.onset_answers(told, model_onsets(s, d), "e", "n"), b.where("bin % 4 = 0").select("e", "bin"), b, "e", "n")


@query("2.11-26", BASE + """, md AS (SELECT entity FROM b WHERE length > 150 GROUP BY 1), g AS (SELECT *, length - lag(length) OVER w > 0.25 AS up FROM b WINDOW w AS (PARTITION BY entity ORDER BY bin)),
h AS (SELECT *, i - coalesce(max(CASE WHEN up THEN i END) OVER (PARTITION BY entity ORDER BY bin), 0) AS still FROM g)
SELECT entity, bin, CASE WHEN length >= 2 THEN 'full' ELSE 'no_tube' END AS state, CASE WHEN length >= 2 THEN round(length, 9) ELSE 0 END AS length,
  round(1 / (1 + exp(0.41 + 0.63 * ln(1 + still) - 0.5 * ln(1 + greatest(length, 0)))), 9) AS confidence FROM h WHERE bin % 4 = 0 AND entity IN (SELECT entity FROM md)""")
def prefilled_answers(s, d):
    b = day_bins(s, d).select("entity", "bin", "length")
    onsets = model_onsets(s, d).withColumnRenamed("e", "entity")
    return corrections.prefilled(b, onsets, b.where("bin % 4 = 0").select("entity", "bin"), "entity")


@query("2.11-24", BASE + """, ch AS (SELECT entity, min(CASE WHEN length > 250 THEN bin END) AS onset, stddev_samp(v) AS threshold, bool_or(n >= 6) AS crowded, bool_or(n >= 5) AS split FROM b GROUP BY 1),
fl AS (SELECT entity, min(CASE WHEN v > 150 THEN bin END) AS onset, round(arg_max(v, bin), 9) AS final, max(bin) AS last FROM b WHERE entity % 7 <> 0 GROUP BY 1),
m AS (SELECT ch.entity, ch.onset AS co, fl.onset AS fo, final, ch.crowded, fl.entity IS NOT NULL AND (ch.crowded OR threshold > 60) AS flood, ch.onset IS NULL AND fl.onset IS NOT NULL AND coalesce(final >= 20, false) AS missed FROM ch LEFT JOIN fl ON fl.entity = ch.entity),
k AS (SELECT *, flood AND NOT crowded AND NOT missed AS keeps FROM m)
SELECT entity, CASE WHEN flood THEN 'flood' ELSE 'change' END AS reader, CASE WHEN flood AND NOT keeps THEN CASE WHEN fo IS NULL THEN 'no_emergence_by_end' ELSE 'emerged_within' END ELSE CASE WHEN co IS NULL THEN 'no_emergence_by_end' ELSE 'emerged_within' END END AS status,
  CASE WHEN flood AND NOT keeps THEN fo ELSE co END AS onset, CASE WHEN keeps THEN 'reader:flood;onset:change' WHEN flood AND missed THEN 'reader:flood;onset:flood_over_change' WHEN flood THEN 'reader:flood' WHEN crowded THEN 'touches:6' ELSE '' END AS flags,
  CASE WHEN keeps AND (co IS NULL OR (SELECT last FROM fl WHERE fl.entity = k.entity) < co) THEN 0 WHEN flood THEN final ELSE (SELECT round(arg_max(length, bin), 9) FROM b WHERE b.entity = k.entity) END AS final FROM k""")
def dispatched_readers(s, d):
    """Which of two readers reads each entity, and the length it ends with."""
    b = day_bins(s, d)
    series = lambda v: F.array_sort(F.collect_list(F.struct("bin", c(v).alias("length")))).alias("lengths")
    status = F.when(c("onset").isNull(), "no_emergence_by_end").otherwise("emerged_within").alias("status")
    change = b.groupBy("entity").agg(F.min(F.when(c("length") > 250, c("bin"))).alias("onset"), F.stddev("v").alias("threshold"), F.when(F.bool_or(c("n") >= 6), F.array(F.lit("touches:6"))).otherwise(F.array().cast("array<string>")).alias("flags"), series("length"))
    flood = b.where("entity % 7 <> 0").groupBy("entity").agg(F.min(F.when(c("v") > 150, c("bin"))).alias("onset"), F.array(F.lit("reader:flood")).alias("flags"), series("v"))
    got = corrections.dispatched(change.select("*", status), flood.select("*", status), "entity", 60.0, 20.0)
    return got.select("entity", "reader", "status", "onset", F.array_join("flags", ";").alias("flags"), F.element_at("lengths", -1)["length"].alias("final"))
