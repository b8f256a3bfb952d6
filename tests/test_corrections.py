"""Folded commands, answers over a model's, pre-filled answers and the choice of a reader."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import corrections

COMMANDS = "who long, n long, e long, action string, bin long, value double, reason string"


def commands(spark, rows):
    return spark.createDataFrame([(0, n, e, a, b, v, r) for n, (e, a, b, v, r) in enumerate(rows)], COMMANDS)


@pytest.mark.parametrize("depth", [3, 50])
def test_undo_takes_back_the_last_that_stands(spark, depth):
    rng = random.Random(depth)
    rows = [(who, n, 1, "undo" if rng.random() < 0.45 else "onset", n, None, None) for who in range(6) for n in range(60)]
    got = {(r["who"], r["n"]) for r in corrections.effective(spark.createDataFrame(rows, COMMANDS), "who", "n", depth=depth).collect()}
    want = set()
    for who in range(6):
        gone, stack = [], []
        for w, n, _, action, *_ in rows:
            if w == who and action == "undo":
                stack[-1:] = []
            elif w == who:
                stack.append(n)
                if len(stack) > depth:
                    gone.append(stack.pop(0))
        want |= {(who, n) for n in gone + stack}
    assert got == want


def test_answers_after_revert_confirm_and_exclusion(spark):
    said = corrections.since_revert(
        corrections.effective(
            commands(spark, [
                (1, "length", 10, 30.0, None), (1, "revert", None, None, None), (1, "onset", 5, None, None), (1, "length", 12, 9.0, None), (1, "length", 12, 1.0, None), (1, "confirm", None, None, None),
                (1, "burst", 20, None, None), (2, "no_onset", None, None, None), (2, "confirm", None, None, None), (3, "exclude", None, None, "debris"), (3, "include", None, None, None),
                (4, "exclude", None, None, "debris"), (4, "onset", 0, None, None), (5, "onset", 7, None, None), (5, "undo", None, None, None),
            ]), "who", "n"), "e", "n")
    model = spark.createDataFrame([(e, "emerged_within", 8) for e in range(1, 6)], "e long, verdict string, visible long")
    onsets = corrections.onset_answers(said, model, "e", "n")
    got = {r["e"]: tuple(r)[1:] for r in onsets.collect()}
    assert got == {
        1: ("emerged_within", 5, "human", False, None, True), 2: ("no_emergence_by_end", None, "human", False, None, True), 3: ("emerged_within", 8, "model", False, None, False),
        4: ("emerged_at_start", None, "human", True, "debris", False), 5: ("emerged_within", 8, "model", False, None, False),
    }
    planned = spark.createDataFrame([(e, b) for e in (1, 2) for b in (8, 12, 16)], "e long, bin long")
    shown = spark.createDataFrame([(1, 8, 1.5), (1, 12, 40.0), (1, 16, 44.0)], "e long, bin long, length double")
    traces = {(r["e"], r["bin"]): tuple(r)[2:] for r in corrections.trace_answers(said, onsets, planned, shown, "e", "n").collect()}
    assert traces == {(1, 8): ("no_tube", 0.0, "confirmed"), (1, 12): ("no_tube", 0.0, "human"), (1, 16): ("full", 44.0, "confirmed"), (1, 20): ("burst", 0.0, "human")}


def test_prefilled_answers_and_their_confidence(spark):
    lengths = [0, 0, 3, 6, 6, 6.1, 12]
    series = spark.createDataFrame([(e, 3 + i, float(v)) for e in (1, 2) for i, v in enumerate(lengths)], "e long, bin long, length double")
    onsets = spark.createDataFrame([(1, "emerged_within"), (2, "no_emergence_by_end")], "e long, verdict string")
    planned = spark.createDataFrame([(e, b) for e in (1, 2) for b in (4, 8, 9, 50)], "e long, bin long")
    got = {r["bin"]: r for r in corrections.prefilled(series, onsets, planned, "e").collect()}
    assert {b: (r["e"], r["state"], r["length"]) for b, r in got.items()} == {4: (1, "no_tube", 0.0), 8: (1, "full", 6.1), 9: (1, "full", 12.0)}
    for b, still, length in ((4, 1, 0.0), (8, 2, 6.1), (9, 0, 12.0)):
        assert abs(got[b]["confidence"] - 1 / (1 + math.exp(0.41 + 0.63 * math.log1p(still) - 0.5 * math.log1p(length)))) < 1e-12


@pytest.mark.parametrize("mode, onsets", [("change_unless_missed", {2: None, 3: 4, 4: 1, 5: 1}), ("flood", {2: None, 3: 4, 4: 1, 5: 1}), ("change", {2: None, 3: 4, 4: 1, 5: None})])
def test_the_flood_reads_crowds_and_noise(spark, mode, onsets):
    schema = "e long, status string, onset long, flags array<string>, lengths array<struct<bin: long, length: double>>"
    series = lambda top: [(b, top * b) for b in range(6)]
    within, never = "emerged_within", "no_emergence_by_end"
    change = [(1, within, 3, ["ok"], series(1.0), 1.0), (2, never, None, [], series(0.0), 9.0), (3, within, 4, [], series(1.0), 9.0), (4, within, 3, ["touches:7"], series(1.0), 1.0), (5, never, None, [], series(0.0), 9.0)]
    flood = [(e, within if e > 2 else never, 1 if e > 2 else None, ["reader:flood"], series(2.0 if e > 2 else 0.1)) for e in range(1, 6)]
    got = {r["e"]: r for r in corrections.dispatched(spark.createDataFrame(change, schema + ", threshold double"), spark.createDataFrame(flood, schema), "e", 5.0, 8.0, mode).collect()}
    assert got[1]["reader"] == "change" and got[1]["flags"] == ["ok"] and [p["length"] for p in got[1]["lengths"]] == [float(b) for b in range(6)]
    if mode == "flood":
        onsets = {**onsets, 3: 1}
    assert {e: got[e]["onset"] for e in onsets} == onsets and all(got[e]["reader"] == "flood" for e in onsets)
    if mode == "change_unless_missed":
        assert [p["length"] for p in got[3]["lengths"]] == [0, 0, 0, 0, 8, 10] and got[3]["flags"][-1] == "onset:change"
        assert got[5]["flags"][-1] == "onset:flood_over_change" and [p["length"] for p in got[5]["lengths"]] == [2.0 * b for b in range(6)]
        assert got[4]["flags"] == ["reader:flood"] and max(p["length"] for p in got[2]["lengths"]) == 0
