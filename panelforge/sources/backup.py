"""Copies of tables, verified part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import review


def parts(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n, digest of each part's rows in whatever order; columns take part by name, nulls and empty texts differ."""
    cells = [F.concat(F.lit(c + "="), F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("{}"))) for c in sorted(df.columns)]
    return review.ordered_digest(df, by, cells)


def copy(df: DataFrame, path: str, by: list[str]) -> None:
    """Write df as a table partitioned by ``by``; an existing copy is replaced as a whole."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def compared(source: DataFrame, path: str, by: list[str]) -> DataFrame:
    """by, source_n, copy_n, source_digest, copy_digest, same: every part of either side, read back from the copy's files.

    Digests are sums of row hashes, so each side is one partial aggregation and only a line a part is joined.
    """
    other = source.sparkSession.read.schema(source.schema).parquet(path)
    left, right = (parts(df, by).select(*by, F.col("n").alias(f"{side}_n"), F.col("digest").alias(f"{side}_digest")) for df, side in ((source, "source"), (other, "copy")))
    both = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    on = both[0]
    for x in both[1:]:
        on = on & x
    met = left.alias("l").join(right.alias("r"), on, "full")
    same = F.col("source_digest").eqNullSafe(F.col("copy_digest")) & F.col("source_n").eqNullSafe(F.col("copy_n"))
    return met.select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in by], F.coalesce("source_n", F.lit(0)).alias("source_n"), F.coalesce("copy_n", F.lit(0)).alias("copy_n"), "source_digest", "copy_digest", same.alias("same"))


def verified(source: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Copy source and compare; a part that differs is an error that names it."""
    copy(source, path, by)
    got = compared(source, path, by).checkpoint()
    bad = got.where("NOT same").limit(5).collect()
    if bad:
        raise ValueError(f"the copy differs in {[tuple(r[c] for c in by) for r in bad]}")
    return got
