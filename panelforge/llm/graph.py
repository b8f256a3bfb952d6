"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialized


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    # written out, so that the join reads two plain exchanges and Spark can split the edges of a node with very many
    least = materialized(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end of an edge has one edge only and is no smaller end."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not ends.where("down > 1 OR (down = 1 AND up = 1)").limit(1).count()


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label): the least node of each component, for every node but the least ones themselves.

    edges: two long columns; repeated edges, loops and an empty table are fine.
    Each round writes its edges to shared storage, so lineage stays short; the rounds end once all components are stars.
    """
    now = materialized(edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        now = materialized(_small(_large(now).distinct()).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
