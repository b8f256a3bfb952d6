"""Frames to physical time and pixels to lengths; every missing calibration gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes(frame: Column, seconds_per_frame: Column) -> Column:
    return frame * seconds_per_frame / 60


def micrometres(px: Column, um_per_px: Column) -> Column:
    return px * um_per_px


def time_or_frames(frame: Column, seconds_per_frame: Column) -> Column:
    """Minutes, or the frame itself if there is no clock."""
    return F.coalesce(minutes(frame, seconds_per_frame), frame.cast("double"))


def length_or_px(px: Column, um_per_px: Column) -> Column:
    return F.coalesce(micrometres(px, um_per_px), px)


def growth_rate(px_per_frame: Column, um_per_px: Column, seconds_per_frame: Column) -> Column:
    """Length per minute; without a clock, length per 1000 frames."""
    per = F.when(seconds_per_frame.isNotNull(), F.lit(60) / seconds_per_frame).otherwise(F.lit(1000.0))
    return px_per_frame * F.coalesce(um_per_px, F.lit(1.0)) * per


def seconds_per_frame(duration_s: Column, n_frames: Column) -> Column:
    return F.when((duration_s > 0) & (n_frames > 0), duration_s / n_frames)


def duration_seconds(hours: Column, mins: Column, secs: Column) -> Column:
    """Sum of the parts; a missing part counts 0, a sum of 0 gives null, a negative part is an error."""
    zero = F.lit(0.0)
    parts = [(F.coalesce(part.cast("double"), zero), scale) for part, scale in ((hours, 3600), (mins, 60), (secs, 1))]
    bad = F.least(*[x for x, _ in parts]) < 0
    total = parts[0][0] * parts[0][1] + parts[1][0] * parts[1][1] + parts[2][0]
    return F.when(bad, F.raise_error(F.lit("a duration cannot be negative")).cast("double")).otherwise(F.nullif(total, zero))


def format_minutes(mins: Column) -> Column:
    """``143 min (2 h 23 min)``; below an hour without brackets, below ten with one decimal, ``-`` for null."""
    exact = mins.cast("decimal(30,6)")
    whole, size = F.bround(exact, 0).cast("long"), F.abs(exact)
    plain = F.concat(whole.cast("string"), F.lit(" min"))
    hours = F.format_string(" (%d h %02d min)", F.floor(whole / 60), F.pmod(whole, F.lit(60)))
    short = F.concat(F.bround(exact, 1).cast("decimal(20,1)").cast("string"), F.lit(" min"))
    return F.when(mins.isNull(), "-").when(size < 10, short).when(size < 60, plain).otherwise(F.concat(plain, hours))


def format_duration(seconds: Column) -> Column:
    """``7 h 18 min``, ``45 min 20 s`` or ``50 s``; ``-`` for null and 0."""
    whole = F.bround(seconds.cast("decimal(30,6)"), 0).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    minutes_words = F.concat(F.format_string("%d min", m), F.when(s > 0, F.format_string(" %d s", s)).otherwise(F.lit("")))
    words = F.when(h > 0, F.format_string("%d h %02d min", h, m)).when(m > 0, minutes_words).otherwise(F.format_string("%d s", s))
    return F.when(seconds.isNull() | (seconds == 0), F.lit("-")).otherwise(words)


def frame_time(frame: Column, mapped: Column, has_map: Column, cadence: Column) -> Column:
    """An explicit time map wins, frames missing there stay null; else frame times cadence; else null."""
    return F.when(has_map, mapped).otherwise(frame * cadence)


def time_range(after: Column, by: Column) -> Column:
    """``a-b``, or one number when both ends round to the same minute."""
    a, b = F.round(after).cast("long"), F.round(by).cast("long")
    return F.when(a == b, b.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))
