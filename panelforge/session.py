"""Session set-up shared by all queries."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that Python tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="panelforge-")) / "panelforge.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("panelforge") / p.relative_to(root))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that a cluster names in spark.checkpoint.dir; without one, a local session (tests) gets its own, and a
    cluster is refused, for a folder of one machine would lose what others write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="panelforge-")


def written(df: DataFrame) -> DataFrame:
    """df written out as Parquet into the shared folder and read back. A checkpoint keeps the size that Spark had estimated, and
    a join's estimate is the product of its sides': over rounds of joins it squares again and again, up to numbers of millions
    of digits. Files have the size they have."""
    ship(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete what ``written`` wrote for df; nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
