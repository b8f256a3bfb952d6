"""Bundles, typed parameters and flat fields."""

from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import parameters
from panelforge.operators import panel
from panelforge.sources import exports


def test_a_bundle_tells_what_failed(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "movie long, x long")

    def broken():
        raise RuntimeError("no labels yet")

    got = exports.bundle(spark, {"grains": lambda: df, "review": broken}, str(tmp_path / "a"), "movie", optional=("review",))
    assert {(r["movie"], r["name"], r["n"], r["error"]) for r in got.collect()} == {(1, "grains", 2, None), (2, "grains", 1, None), (None, "review", 0, "no labels yet")}
    with pytest.raises(RuntimeError):
        exports.bundle(spark, {"review": broken}, str(tmp_path / "b"), "movie")


def test_units_that_are_not_known_are_blank(spark):
    curves, checks = spark.createDataFrame([("g", 2, 10.125)], "grain string, bin long, length double"), spark.createDataFrame([], "grain string, n long")
    row = exports.reviewed_growth(curves, checks, 300, None, None).first()
    assert tuple(row) == ("g", 2, 750, "", "10.13", "", 0)
    assert tuple(exports.reviewed_growth(curves, checks, 300, 0.5, 2.0).first())[3:6] == ("25.00", "10.13", "5.06")


@dataclass(frozen=True)
class Knobs:
    radius: float = 12.0
    bins: int = 3
    strict: bool = False
    reader: str = "hybrid"
    band: tuple = (1.0, 2.0)


def test_overrides_have_the_kinds_of_their_defaults(spark):
    assert parameters.applied(Knobs(), {"radius": "9", "bins": "4", "strict": "True", "reader": "flood", "band": "(3,4.5)"}) == Knobs(9.0, 4, True, "flood", (3.0, 4.5))
    for bad in ({"radii": "9"}, {"bins": "4.5"}, {"strict": "yes"}, {"radius": "wide"}):
        with pytest.raises(ValueError):
            parameters.applied(Knobs(), bad)
    lines = ["radius=9", "radius = wide", "bins=4.5", "bins", "bins=", "strict=true", "strict=1", "other=1", "band=(1,2)", "reader=3"]
    got = {r["line"]: r["problem"] for r in parameters.judged(spark.createDataFrame([(x,) for x in lines], "line string"), "line", Knobs()).collect()}
    assert got == {"radius=9": None, "radius = wide": "wrong kind", "bins=4.5": "wrong kind", "bins": "no value", "bins=": "no value", "strict=true": None, "strict=1": "wrong kind", "other=1": "unknown", "band=(1,2)": None, "reader=3": None}


def test_a_flat_field_takes_the_slope_and_keeps_the_level(spark):
    rows = spark.createDataFrame([(0, i, 170.0 - 0.6 * i) for i in range(200)], "e long, i long, v double")
    got = panel.flat_field(rows, ["e"], "i", "v", "flat", 6.0).orderBy("i").collect()
    flat, was = np.array([r["flat"] for r in got]), np.array([r["v"] for r in got])
    assert len(flat) == 200 and abs(np.median(flat) - np.median(was)) < 0.5 and flat[50:150].std() < 0.1 * was[50:150].std()
    assert panel.flat_field(rows.where(F.lit(False)), ["e"], "i", "v", "flat").count() == 0
