"""Streams over event files: windows with watermarks, sessions, latest-wins state, gap timeouts.

``caught_up`` runs a stream over all that is there now; every micro-batch lands in its own folder, so a batch that is
repeated after a failure overwrites itself, and the last state of each key is what remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The table ``name`` of a folder as a stream: one file, or a folder of part files. All files that are there make one
    batch, so none is late behind another."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    read = spark.readStream.schema(schema)
    return read.parquet(f"{folder}/{name}.parquet") if whole else read.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def events(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Event rows as a stream with event time and a watermark."""
    s = source(spark, folder, "events", EVENTS)
    return s.select(F.col("user_id").alias("entity"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", delay)


def tumbling(stream: DataFrame, width: str) -> DataFrame:
    """entity, day, n, v (mean) by tumbling window; rows later than the watermark are dropped."""
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    g = stream.groupBy("entity", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), (total / F.count("value")).alias("v"))
    return g.select("entity", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "v")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """entity, first, last (epoch seconds), n of runs of events without a gap."""
    g = stream.groupBy("entity", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("ts")).alias("first"), F.unix_seconds(F.max("ts")).alias("last"))
    return g.select("entity", "first", "last", "n")


def latest(stream: DataFrame) -> DataFrame:
    """entity, last_id, value: latest record of each entity."""
    return stream.groupBy("entity").agg(F.max("event_id").alias("last_id"), F.max_by("value", "event_id").alias("value"))


def follow(stream: DataFrame, low: float, most: int) -> DataFrame:
    """entity, seen, lost_at: number of readings, and the id of the first of more than ``most`` misses in succession."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, misses, first, lost = state.get if state.exists else (0, 0, -1, -1)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for event, value in zip(rows["event_id"], rows["value"]):
            seen += 1
            misses, first = (misses + 1, first if misses else int(event)) if value < low else (0, -1)
            if misses > most and lost < 0:
                lost = first
        state.update((seen, misses, first, lost))
        yield pd.DataFrame({"entity": [key[0]], "seen": [seen], "lost_at": [lost]})

    return stream.groupBy("entity").applyInPandasWithState(step, "entity long, seen long, lost_at long", "seen long, misses long, first long, lost long", "update", "NoTimeout")


def caught_up(result: DataFrame, path: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a streaming result over all available input and read back the last row of each key."""

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(land).start()
    query.awaitTermination()
    rows = result.sparkSession.read.parquet(f"{path}/out")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")
