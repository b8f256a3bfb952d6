"""Live answers over several batches, banks of looks, verified copies, streams over folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.session import ship
from panelforge.sources import backup, writers
from panelforge.streaming import bank, live, streams

SCHEMA = "entity long, event_id long, ts timestamp, event_type string, value double"


def update(entity, event, minute, value=9.0, kind="view"):
    return entity, event, minute, kind, value


def frame(spark, rows):
    return spark.createDataFrame([(e, i, m, k, v) for e, i, m, k, v in rows], "entity long, event_id long, m long, event_type string, value double").select(
        "entity", "event_id", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "event_type", "value"
    )


def test_updates_are_checked_and_the_journal_replays(spark, tmp_path):
    ship(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    valid = F.col("value") >= 5
    batches = [
        [update(1, 1, 10), update(1, 2, 12, 1.0), update(1, 3, 11), update(2, 4, 50)],
        [update(1, 5, 9), update(1, 6, 20), update(2, 7, 40), update(3, 8, 1, None)],
        [update(1, 9, 15), update(3, 10, 2), update(2, 11, 50)],
    ]
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        live.run(stream, path, "entity", "ts", "event_id", valid)
    journal = live.journal(spark, path)
    assert sorted(r["event_id"] for r in journal.collect()) == [1, 3, 4, 6, 10, 11]
    rejected = {r["event_id"]: r["reason"] for r in spark.read.parquet(f"{path}/rejected").collect()}
    assert rejected == {2: "invalid", 5: "stale", 7: "stale", 8: "invalid", 9: "stale"}
    assert {r["entity"]: r["event_id"] for r in live.replayed(journal, "entity", "ts", "event_id").collect()} == {1: 6, 2: 11, 3: 10}
    # a repeated batch sees the batches before it alone and writes the same rows
    again = live.judged(frame(spark, batches[1]), live.journal(spark, path, 1), "entity", "ts", "event_id", valid)
    assert {r["event_id"] for r in again.where("reason IS NULL").collect()} == {6}


def looks(n=60, seed=0):
    """A look that turns slowly, and another one in its place from 40 on."""
    rng = np.random.default_rng(seed)
    a, b, other = rng.normal(size=(3, 32))
    return [(0, t, (other if t >= 40 else a * np.cos(t / 12) + b * np.sin(t / 12)).tolist()) for t in range(n)]


def test_the_bank_learns_a_turning_look_and_loses_another_one(spark):
    ship(spark)
    df = spark.createDataFrame(looks(), "k long, t long, v array<double>")
    rows = bank.batch(df, "k", "t", "v").orderBy("t").collect()
    assert [r["outcome"] for r in rows[:3]] == ["reference"] * 3
    assert all(r["outcome"] == "accepted" for r in rows[3:40])
    assert [r["outcome"] for r in rows[40:47]] == ["missed"] * 7 and all(r["outcome"] == "lost" for r in rows[47:])
    rigid = bank.batch(df, "k", "t", "v", bank.Rules(low=2.0, high=2.0)).orderBy("t").collect()
    assert any(r["outcome"] == "missed" for r in rigid[3:40])  # without learning the turning look is missed


def test_stream_and_batch_of_banks_agree(spark, tmp_path):
    ship(spark)
    source = str(tmp_path / "in")
    rows = looks() + [(1, t, v) for _, t, v in looks(30, 5)]
    schema = "k long, t long, v array<double>"
    for part in ([r for r in rows if r[1] < 17], [r for r in rows if 17 <= r[1] < 43], [r for r in rows if r[1] >= 43]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        got = streams.caught_up(bank.stream(spark.readStream.schema(schema).parquet(source), "k", "t", "v"), str(tmp_path / "out"), ["k"])
        got = {r["k"]: (r["seen"], r["accepted"], r["lost_from"]) for r in got.collect()}
    want = bank.summary(bank.batch(spark.createDataFrame(rows, schema), "k", "t", "v"), "k", "t")
    assert got == {r["k"]: (r["seen"], r["accepted"], r["lost_from"]) for r in want.collect()} and got[0][2] == 40


def test_a_damaged_copy_is_found(spark, tmp_path):
    path = str(tmp_path / "copy")
    df = spark.createDataFrame([(k % 3, k, None if k % 5 == 0 else f"v{k}") for k in range(60)], "g long, k long, v string")
    assert backup.verified(df, path, ["g"]).where("same").count() == 3
    spark.createDataFrame([(3, "other")], "k long, v string").write.mode("append").parquet(f"{path}/g=1")
    changed = df.where("g <> 2 OR k <> 2").unionByName(spark.createDataFrame([(2, 2, "")], df.schema)).unionByName(spark.createDataFrame([(9, 1, "x")], df.schema))
    got = {r["g"]: r for r in backup.compared(changed, path, ["g"]).collect()}
    assert {g: r["same"] for g, r in got.items()} == {0: True, 1: False, 2: False, 9: False}
    assert (got[1]["source_n"], got[1]["copy_n"], got[9]["copy_n"]) == (20, 21, 0) and got[2]["source_n"] == got[2]["copy_n"] == 20


def test_a_stream_reads_a_folder_of_part_files(spark, tmp_path):
    rows = [(k, k % 2, "view", 1.0, "{}") for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    df = df.select("event_id", F.timestamp_seconds(F.col("event_id") * 86_400).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    df.repartitionByRange(8, F.desc("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    got = streams.caught_up(streams.tumbling(streams.events(spark, str(tmp_path)), "1 day"), writers.scratch(ship(spark)), ["entity", "day"])
    assert got.agg(F.sum("n")).first()[0] == 40
