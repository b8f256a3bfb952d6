"""Sub-pixel shifts of patches against a reference, and their robust correction over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shift_of(reference: np.ndarray, patch: np.ndarray, upsample: int = 20) -> tuple[float, float]:
    """(dx, dy) by which the patch's content lies off the reference's: the peak of their cross-correlation, looked for on
    whole pixels over all shifts (wrapped round) and then on a grid of 1 / upsample pixels round the best one.

    The fine grid is a product of three small matrices (rows, spectrum, columns), so no enlarged spectrum is transformed.
    """
    spectrum = np.fft.fft2(patch) * np.conj(np.fft.fft2(reference))
    h, w = spectrum.shape
    coarse = np.fft.ifft2(spectrum).real
    peak = np.unravel_index(int(coarse.argmax()), coarse.shape)
    at = np.array([p - n if p > n // 2 else p for p, n in zip(peak, (h, w))], float)
    if upsample > 1:
        fine = np.arange(-upsample, upsample + 1) / upsample
        waves = [np.exp(2j * np.pi * np.outer(c + fine, np.fft.fftfreq(n))) for c, n in zip(at, (h, w))]
        value = (waves[0] @ spectrum @ waves[1].T).real
        best = np.unravel_index(int(np.round(value, 9).argmax()), value.shape)
        at = at + fine[list(best)]
    return float(at[1]), float(at[0])


def shifts(patches: DataFrame, keys: list[str], at: str, height: int, width: int, reference: int = 3, upsample: int = 20) -> DataFrame:
    """keys, at, dx, dy of each patch (array of height x width values, row by row) against the mean of its key's first patches.

    References are one row a key; a patch meets its own by a join and is registered alone, so no group is gathered.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    first = patches.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= reference)
    cells = first.select(*keys, F.posexplode("patch").alias("_p", "_v")).groupBy(*keys, "_p").agg(F.avg("_v").alias("_v"))
    means = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda c: c["_v"]).alias("_ref"))
    kinds = ", ".join(f"`{c}` {patches.schema[c].dataType.simpleString()}" for c in [*keys, at])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [shift_of(np.array(r, float).reshape(height, width), np.array(p, float).reshape(height, width), upsample) for r, p in zip(pdf["_ref"], pdf["patch"])]
            yield pdf[[*keys, at]].assign(dx=[x for x, _ in got], dy=[y for _, y in got])

    return patches.select(*keys, at, "patch").join(means, keys).mapInPandas(run, f"{kinds}, dx double, dy double")


def corrected(found: DataFrame, keys: list[str], at: str, most: float, window: int = 3) -> DataFrame:
    """found with outlier, and dx and dy of outliers set to the running median over ``window`` rows on both sides: an outlier
    lies more than ``most`` from it. A jump that lasts is kept."""
    near = Window.partitionBy(*keys).orderBy(at).rowsBetween(-window, window)
    out = found.withColumn("_mx", F.percentile("dx", F.lit(0.5)).over(near)).withColumn("_my", F.percentile("dy", F.lit(0.5)).over(near))
    dx, dy = F.col("dx") - F.col("_mx"), F.col("dy") - F.col("_my")
    out = out.withColumn("outlier", F.sqrt(dx * dx + dy * dy) > most)
    return out.select(*keys, at, *[F.when(F.col("outlier"), F.col(f"_m{c}")).otherwise(F.col(f"d{c}")).alias(f"d{c}") for c in "xy"], "outlier")
