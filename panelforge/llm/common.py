"""Small shared helpers: table access, shared storage, input-sized partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the cluster's spark.checkpoint.dir, else one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="panelforge-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove what ``materialized`` wrote for df; nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A table of so few narrow rows, some tens of megabytes, may go to every executor.
FEW_ROWS = 500_000


def broadcast_if_small(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df (narrow rows, written out) to be broadcast if it has ``most`` rows at most, else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def input_buckets(df: DataFrame, per_partition: int = 2, least: int = 8) -> int:
    """Number of hash buckets in proportion to the input: a fixed number for each input split."""
    return max(least, per_partition * df.rdd.getNumPartitions())


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """A bounded sample: one row for each of the n smallest values of the hash column ``key``.

    A threshold from the number of distinct values leaves some 2 n of them, so what partitions sort and send does not
    grow with the input; copies of a row have one hash and meet in a partial aggregation.
    """
    values = df.agg(F.approx_count_distinct(key)).first()[0]
    if values > 4 * n:
        df = df.where(F.col(key) < int(2**65 * n / values) - 2**63)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).orderBy(key).limit(n).select(key, "row.*")


def with_rest(docs: DataFrame, id_col: str, text_col: str, rest: tuple[str, ...] | None) -> tuple[DataFrame, str]:
    """(doc_id, text and the columns of ``rest`` as a struct of that name; what follows in the schema of a result).

    With rest (even an empty one) results carry the text and the struct on; without, neither.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    if rest is None:
        return named, ""
    return named, ", text string" + (f", rest {named.schema['rest'].dataType.simpleString()}" if rest else "")
