"""Live answers: updates are checked against what has been accepted, accepted ones go to a journal, others are kept with a reason.

The journal is a folder for each batch. A batch reads the journal of the batches before it alone, and writes its own folder
anew, so a batch that is repeated after a failure gives the same rows; replaying the journal gives the live table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import review


def judged(updates: DataFrame, before: DataFrame | None, key: str, at: str, order: str, valid: Column) -> DataFrame:
    """updates with ``reason``: null if accepted, ``invalid``, or ``stale``: older (by ``at``) than an accepted one that came
    before it (by ``order``) or is in ``before`` (key, at)."""
    rows = updates.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(F.col("_ok"), F.col(at))).over(w)  # a stale row never is the newest, so only accepted ones count
    if before is not None:
        last = before.groupBy(key).agg(F.max(at).alias("_last"))
        rows = rows.join(last, key, "left")
        newest = F.greatest(newest, F.col("_last"))
    stale = F.coalesce(F.col(at) < newest, F.lit(False))
    reason = F.when(~F.col("_ok"), "invalid").when(stale, "stale")
    return rows.withColumn("reason", reason).drop("_ok", "_last")


def journal(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame | None:
    """Accepted updates of the batches before ``batch`` (all: None); None if there are none yet."""
    jvm, root = spark._jvm, f"{path}/journal"
    folder = jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(root)
    return rows if batch is None else rows.where(F.col("batch") < batch)


def run(stream: DataFrame, path: str, key: str, at: str, order: str, valid: Column) -> None:
    """Take in all that the stream has now: ``path``/journal and ``path``/rejected get a folder for each batch."""
    spark = stream.sparkSession

    def land(batch: DataFrame, number: int) -> None:
        rows = judged(batch, journal(spark, path, number), key, at, order, valid).persist()
        rows.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{path}/journal/batch={number}")
        rows.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        rows.unpersist()

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(land).start().awaitTermination()


def replayed(journal: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """The live table: the last accepted update of each key."""
    return review.latest(journal, [key], [F.desc(at), F.desc(order)])
