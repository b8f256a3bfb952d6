"""The whole score report on one movie of known answers."""

from panelforge.operators import report

KEY = "movie long, id long, "


def test_counts_onsets_lengths_absences_and_tips(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, KEY + schema)
    grains = frame([(0, 1, False, True), (0, 2, False, True), (0, 3, True, True), (0, 4, False, False), (1, 9, None, None)], "excluded boolean, isolated boolean")
    onsets = frame([(0, 1, "emerged_within", 1000, 2000), (0, 2, "emerged_within", 1000, 2000), (0, 3, "emerged_within", 0, 1), (1, 9, "no_emergence_by_end", 5, None)], "verdict string, last_absent long, first_visible long")
    predictions = frame([(0, 1, "emerged_within", 2500), (0, 2, "emerged_within", 300), (0, 3, "emerged_within", 9)], "status string, onset long")
    traces = frame(
        [
            (0, 1, 6150, "full", 10.0, None, 0.0, 0.0), (0, 1, 750, "no_tube", 0.0, False, None, None), (0, 1, 9150, "burst", 0.0, None, None, None),
            (0, 1, 6200, "full", 10.0, True, None, None), (0, 1, 6100, "partial", 13.0, None, None, None), (0, 1, 6100, "unsure", 1.0, None, None, None),
            (0, 2, 6150, "full", 10.0, None, None, None), (0, 3, 6150, "full", 10.0, None, None, None), (1, 9, 100, "full", 5.0, None, None, None), (1, 9, 100, "burst", 5.0, None, None, None),
        ],
        "frame long, state string, length double, contact boolean, x double, y double",
    )
    readings = frame([(0, 1, 750, 0.0, None, None), (0, 1, 6150, 11.5, 3.0, 4.0), (0, 2, 100, 20.0, 1.0, 1.0)], "frame long, length double, x double, y double")
    t = report.Tolerance()
    got = {r["movie"]: r.asDict() for r in report.report(report.facts(grains, onsets, predictions, traces, readings, "movie", "isolated", t), "movie", t).collect()}
    assert got[0] == {
        "movie": 0, "grains_scored": 2, "grains_matched": 2, "onsets_timed": 2, "onsets_emerged": 2, "onset_hits": 1, "onset_mean_error": -100.0, "onsets_early": 1, "onsets_late": 0,
        "lengths": 2, "lengths_within": 1, "length_mean_error": 5.75, "length_bias": 5.75, "partials": 1, "partials_consistent": 1, "absences": 1, "absences_correct": 1,
        "tips": 1, "tips_within": 1, "lengths_and_tips": 1, "contact_skipped": 1, "burst_skipped": 1, "onset_median_error": 600.0, "length_median_error": 5.75, "tip_median": 5.0,
    }
    assert got[1]["grains_scored"] == 1 and got[1]["grains_matched"] == got[1]["lengths"] == 0 and got[1]["burst_skipped"] == 1 and got[1]["tip_median"] is None
    whole = {r["movie"]: r["grains_scored"] for r in report.report(report.facts(grains, onsets, predictions, traces, readings, "movie", "all", t), "movie", t).collect()}
    assert whole == {0: 3, 1: 1}
