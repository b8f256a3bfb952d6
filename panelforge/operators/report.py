"""The whole score of predictions against answers: onsets, lengths, partial lengths, absences and tips, by movie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import matching, ranks


@dataclass(frozen=True)
class Tolerance:
    onset: float = 600.0
    length: float = 2.0
    length_share: float = 0.1
    absent: float = 2.0
    tip: float = 5.0
    tip_share: float = 0.1


def facts(grains: DataFrame, onsets: DataFrame, predictions: DataFrame, traces: DataFrame, readings: DataFrame, movie: str, subset: str, t: Tolerance) -> DataFrame:
    """movie, kind, error, ok, both: a row for each thing that is scored or set aside.

    grains: movie, id, excluded, isolated (``subset`` isolated or all). onsets: id, verdict, last_absent, first_visible.
    predictions: id, status, onset. traces: id, frame, state (full, partial, no_tube, burst, unsure, centre), length, contact,
    x, y. readings (of predictions): id, frame, length, x, y; a trace meets the one nearest in time.
    """
    key = [movie, "id"]
    scored = grains.where(~F.coalesce("excluded", F.lit(False)) & (F.lit(subset == "all") | F.coalesce("isolated", F.lit(True)))).select(*key)
    known = scored.join(predictions.select(*key, "status", "onset", F.lit(True).alias("matched")), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    nothing = [F.lit(None).cast("double").alias("error"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("boolean").alias("both")]

    timed = known.join(onsets, key).where("verdict = 'emerged_within'")
    lo, hi, at = F.col("last_absent"), F.col("first_visible"), F.col("onset")
    error = F.when(lo.isNotNull() & (at <= lo), at - lo).when(hi.isNotNull() & (at > hi), at - hi).otherwise(0).cast("double")
    told = timed.where("matched AND status = 'emerged_within' AND onset IS NOT NULL")

    drawn = traces.join(known.select(*key, "matched"), key)
    burst = drawn.where("state = 'burst'")
    kept = drawn.where("matched AND state NOT IN ('burst', 'unsure', 'centre')")
    touching = kept.where(F.coalesce("contact", F.lit(False)))
    asks = kept.where(~F.coalesce("contact", F.lit(False))).select(*key, "frame", "state", F.col("length").alias("truth"), "x", "y")
    series = readings.select(*key, "frame", F.struct("length", "x", "y").alias("reading"))
    met = matching.nearest_in_time(asks, series, key, "frame", "frame", "reading").where("reading.length IS NOT NULL")
    off = F.col("reading.length") - F.col("truth")
    good = F.abs(off) <= F.greatest(F.lit(t.length), F.lit(t.length_share) * F.col("truth"))
    dx, dy = F.col("reading.x") - F.col("x"), F.col("reading.y") - F.col("y")
    far = F.sqrt(dx * dx + dy * dy)
    near = far <= F.greatest(F.lit(t.tip), F.lit(t.tip_share) * F.col("truth"))
    full = met.where("state = 'full'")

    def row(df: DataFrame, kind: str, error: Column | None = None, ok: Column | None = None, both: Column | None = None) -> DataFrame:
        named = [c.alias(n) if c is not None else none for c, n, none in zip((error, ok, both), ("error", "ok", "both"), nothing)]
        return df.select(movie, F.lit(kind).alias("kind"), *named)

    parts = [
        row(known, "grain", ok=F.col("matched")),
        row(timed, "emerged"),
        row(told, "onset", error, F.abs(error) <= t.onset),
        row(burst, "burst"),
        row(touching, "contact"),
        row(full, "full", off, good),
        row(met.where("state = 'partial'"), "partial", ok=F.col("reading.length") >= F.col("truth") - t.length),
        row(met.where("state = 'no_tube'"), "absence", ok=F.col("reading.length") < t.absent),
        row(full.where(far.isNotNull() & (F.col("reading.length") > 0)), "tip", far, near, near & good),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(facts: DataFrame, movie: str, t: Tolerance = Tolerance()) -> DataFrame:
    """One row for each movie; medians are exact and no buffer holds a movie's errors."""
    of = lambda kind: F.col("kind") == kind
    n = lambda kind: F.count_if(of(kind))
    ok = lambda kind: F.count_if(of(kind) & F.col("ok"))
    mean = lambda kind, x: F.avg(F.when(of(kind), x))
    e = F.col("error")
    out = facts.groupBy(movie).agg(
        n("grain").alias("grains_scored"), ok("grain").alias("grains_matched"),
        n("onset").alias("onsets_timed"), n("emerged").alias("onsets_emerged"), ok("onset").alias("onset_hits"), mean("onset", e).alias("onset_mean_error"),
        F.count_if(of("onset") & (e < -t.onset)).alias("onsets_early"), F.count_if(of("onset") & (e > t.onset)).alias("onsets_late"),
        n("full").alias("lengths"), ok("full").alias("lengths_within"), mean("full", F.abs(e)).alias("length_mean_error"), mean("full", e).alias("length_bias"),
        n("partial").alias("partials"), ok("partial").alias("partials_consistent"), n("absence").alias("absences"), ok("absence").alias("absences_correct"),
        n("tip").alias("tips"), ok("tip").alias("tips_within"), F.count_if(of("tip") & F.col("both")).alias("lengths_and_tips"),
        n("contact").alias("contact_skipped"), n("burst").alias("burst_skipped"),
    )
    errors = facts.where("kind IN ('onset', 'full', 'tip')").select(movie, "kind", F.abs("error").alias("error"))
    medians = ranks.median(errors, [movie, "kind"], "error").groupBy(movie).agg(
        *[F.max(F.when(of(kind), F.col("median"))).alias(name) for kind, name in (("onset", "onset_median_error"), ("full", "length_median_error"), ("tip", "tip_median"))]
    )
    return out.join(medians, movie, "left")
