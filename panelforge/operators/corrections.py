"""Answers of people over those of a model: a log of commands folded into answers, pre-filled answers, choice of a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many of a session's commands can be taken back.
DEPTH = 50
#: Tubes shorter than this are none.
LEAST = 2.0


def effective(commands: DataFrame, session: str, order: str, action: str = "action", depth: int = DEPTH) -> DataFrame:
    """commands without ``undo`` and without what an undo took back: the session's last one that still stood, as far back as
    ``depth`` commands. A session is what a person typed; its numbers are folded over a stack, the rows stay where they are.
    """
    one = F.struct(F.col(order).alias("n"), (F.col(action) == "undo").alias("undo"))
    folded = commands.groupBy(session).agg(F.array_sort(F.collect_list(one)).alias("all"))
    nothing = F.array().cast("array<long>")

    def step(at: Column, c: Column) -> Column:
        stack, size = at["stack"], F.size(at["stack"])
        full = size >= depth
        undone = F.struct(at["gone"].alias("gone"), F.slice(stack, 1, F.greatest(size - 1, F.lit(0))).alias("stack"))
        kept = F.struct(
            F.when(full, F.array_append(at["gone"], F.get(stack, F.lit(0)))).otherwise(at["gone"]).alias("gone"),
            F.array_append(F.when(full, F.slice(stack, 2, size)).otherwise(stack), c["n"].cast("long")).alias("stack"),
        )
        return F.when(c["undo"], undone).otherwise(kept)

    end = F.aggregate("all", F.struct(nothing.alias("gone"), nothing.alias("stack")), step)
    stood = folded.select(F.col(session), F.explode(F.concat(end["gone"], end["stack"])).alias(order))
    return commands.join(stood, [session, order], "left_semi")


def since_revert(commands: DataFrame, entity: str, order: str, action: str = "action") -> DataFrame:
    """What was said of each entity after its last ``revert``."""
    last = commands.where(F.col(action) == "revert").groupBy(entity).agg(F.max(order).alias("_last"))
    said = commands.join(last, entity, "left").where((F.col(action) != "revert") & (F.col("_last").isNull() | (F.col(order) > F.col("_last"))))
    return said.drop("_last")


def onset_answers(said: DataFrame, model: DataFrame, entity: str, order: str) -> DataFrame:
    """entity, verdict, visible, origin, excluded, reason, checked: the last onset answer (else the model's), the last word on
    exclusion, and whether anybody confirmed. said: action, bin, reason; model: entity, verdict, visible."""
    lasts = [F.max_by(F.struct("action", "bin", "reason"), F.when(F.col("action").isin(*kinds), F.col(order))).alias(name) for name, kinds in (("_o", ("onset", "no_onset")), ("_x", ("exclude", "include")))]
    own = said.groupBy(entity).agg(*lasts, F.bool_or(F.col("action") == "confirm").alias("checked"))
    met = model.join(own, entity, "full")
    seen, at_start = F.col("_o.action") == "onset", F.col("_o.bin") <= 0
    verdict = F.when(seen & at_start, "emerged_at_start").when(seen, "emerged_within").when(F.col("_o").isNotNull(), "no_emergence_by_end").otherwise(F.col("verdict"))
    visible = F.when(seen & ~at_start, F.col("_o.bin")).when(F.col("_o").isNull(), F.col("visible"))
    excluded = F.coalesce(F.col("_x.action") == "exclude", F.lit(False))
    return met.select(
        entity, verdict.alias("verdict"), visible.alias("visible"), F.when(F.col("_o").isNotNull(), "human").otherwise("model").alias("origin"),
        excluded.alias("excluded"), F.when(excluded, F.col("_x.reason")).alias("reason"), F.coalesce("checked", F.lit(False)).alias("checked"),
    )


def trace_answers(said: DataFrame, onsets: DataFrame, planned: DataFrame, shown: DataFrame, entity: str, order: str) -> DataFrame:
    """entity, bin, state, length, origin: what was said of a time last (``human``), and at planned times that nobody spoke of,
    of entities that emerged and were confirmed, the length that was shown (``confirmed``).

    said: action (length, no_tube, burst), bin, value. planned: entity, bin. shown: entity, bin, length.
    """
    spoken = said.where(F.col("action").isin("length", "no_tube", "burst"))
    last = spoken.groupBy(entity, "bin").agg(F.max_by(F.struct("action", "value"), order).alias("_t"))
    full = (F.col("_t.action") == "length") & (F.col("_t.value") >= LEAST)
    state = F.when(F.col("_t.action") == "burst", "burst").when(full, "full").otherwise("no_tube")
    human = last.select(entity, "bin", state.alias("state"), F.when(full, F.col("_t.value")).otherwise(0.0).alias("length"), F.lit("human").alias("origin"))
    sure = onsets.where("checked AND verdict IN ('emerged_within', 'emerged_at_start')").select(entity)
    open_ = planned.join(sure, entity, "left_semi").join(human, [entity, "bin"], "left_anti").join(shown.select(entity, "bin", F.col("length").alias("_l")), [entity, "bin"], "left")
    seen = F.coalesce("_l", F.lit(0.0))
    return human.unionByName(open_.select(entity, "bin", F.when(seen >= LEAST, "full").otherwise("no_tube").alias("state"), F.when(seen >= LEAST, seen).otherwise(0.0).alias("length"), F.lit("confirmed").alias("origin")))


def prefilled(series: DataFrame, onsets: DataFrame, planned: DataFrame, entity: str, at: str = "bin") -> DataFrame:
    """entity, bin, state, length, confidence of a model's answers at the planned times of entities that emerged.

    Confidence falls with the time since the reading last grew (by over a quarter) and rises with its length.
    """
    w = Window.partitionBy(entity).orderBy(at)
    rows = series.withColumn("_i", F.row_number().over(w) - 1).withColumn("_up", F.col("length") - F.lag("length").over(w) > 0.25)
    grew = F.max(F.when(F.col("_up"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_still", F.col("_i") - F.coalesce(grew, F.lit(0)))
    z = -0.41 - 0.63 * F.log1p("_still") + 0.50 * F.log1p(F.greatest("length", F.lit(0.0)))
    rows = rows.withColumn("confidence", 1 / (1 + F.exp(-z)))
    emerged = onsets.where("verdict IN ('emerged_within', 'emerged_at_start')").select(entity)
    asked = planned.join(emerged, entity, "left_semi").join(rows, [entity, at])
    tube = F.col("length") >= LEAST
    return asked.select(entity, at, F.when(tube, "full").otherwise("no_tube").alias("state"), F.when(tube, F.col("length")).otherwise(0.0).alias("length"), "confidence")


def dispatched(change: DataFrame, flood: DataFrame, entity: str, floor: float, least: float, onset: str = "change_unless_missed") -> DataFrame:
    """entity, reader, status, onset, flags, lengths: the flood where neighbours crowd an entity or its background changes
    more than ``floor``, else the reader of changes.

    change, flood: entity, status, onset (bin), flags, lengths (array of bin, length); change also threshold. Beside a clean
    rim the flood keeps the other reader's onset, and its own lengths from there on, unless ``onset`` is ``flood`` or, with
    ``change_unless_missed``, the other reader saw nothing where the flood ends ``least`` long or more.
    """
    c = change.select(entity, *[F.col(x).alias(f"c_{x}") for x in ("status", "onset", "flags", "lengths", "threshold")])
    f = flood.select(entity, *[F.col(x).alias(f"f_{x}") for x in ("status", "onset", "flags", "lengths")])
    crowded = F.exists("c_flags", lambda x: F.startswith(x, F.lit("touches:")) | F.startswith(x, F.lit("shared_change_split")))
    final = F.coalesce(F.get("f_lengths", F.size("f_lengths") - 1)["length"], F.lit(0.0))
    never = "no_emergence_by_end"
    rows = c.join(f, entity, "left").withColumn("_crowded", crowded)
    rows = rows.withColumn("_flood", F.col("f_status").isNotNull() & (F.col("_crowded") | F.coalesce(F.col("c_threshold") > floor, F.lit(False))))
    rows = rows.withColumn("_missed", F.coalesce((F.col("c_status") == never) & (F.col("f_status") != never) & (final >= least), F.lit(False)))
    spared = F.col("_missed") if onset == "change_unless_missed" else F.lit(onset == "flood")
    rows = rows.withColumn("_keeps", F.col("_flood") & ~F.col("_crowded") & ~spared)
    after = F.transform("f_lengths", lambda p: F.struct(p["bin"].alias("bin"), F.when((F.col("c_status") != never) & (F.col("c_onset").isNull() | (p["bin"] >= F.col("c_onset"))), p["length"]).otherwise(0.0).alias("length")))
    mark = F.when(F.col("_keeps"), F.array(F.lit("onset:change"))).when(F.col("_missed"), F.array(F.lit("onset:flood_over_change"))).otherwise(F.array().cast("array<string>"))
    own = F.col("_flood") & ~F.col("_keeps")
    return rows.select(
        entity, F.when(F.col("_flood"), "flood").otherwise("change").alias("reader"), F.when(own, F.col("f_status")).otherwise(F.col("c_status")).alias("status"),
        F.when(own, F.col("f_onset")).otherwise(F.col("c_onset")).alias("onset"), F.when(F.col("_flood"), F.concat("f_flags", mark)).otherwise(F.col("c_flags")).alias("flags"),
        F.when(F.col("_keeps"), after).when(F.col("_flood"), F.col("f_lengths")).otherwise(F.col("c_lengths")).alias("lengths"),
    )
