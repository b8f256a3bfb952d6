"""Versioned records: latest revision, tombstones, closures, redirects, state rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def without_tombstones(current: DataFrame, deleted: Column) -> DataFrame:
    return current.where(~deleted)


def next_revision(entities: DataFrame, revisions: DataFrame, key: str, revision: str) -> DataFrame:
    """key, next: one more than the largest revision of either table."""
    both = entities.select(key, revision).unionByName(revisions.select(key, revision))
    return both.groupBy(key).agg((F.max(revision) + 1).alias("next"))


def revision_conflicts(writes: DataFrame, current: DataFrame, key: str, expected: str, revision: str) -> DataFrame:
    """Writes whose expected revision is not the current one."""
    ok = current.select(F.col(key), F.col(revision).alias(expected))
    return writes.join(ok, [key, expected], "left_anti")


def live_over_snapshot(snapshot: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows, and snapshot rows whose key is not live."""
    kept = snapshot.join(live.select(*keys).distinct(), keys, "left_anti")
    return live.withColumn("origin", F.lit("live")).unionByName(kept.withColumn("origin", F.lit("snapshot")))


def resolve_redirects(edges: DataFrame, most: int = 20) -> DataFrame:
    """(node, target) of each node under transitive redirects node -> next: pointer doubling, so steps grow as the
    logarithm of the longest chain; each round is checkpointed. A cycle is an error."""
    now = edges.select("node", F.col("next").alias("target"))
    for _ in range(most):
        t = now.select(F.col("node").alias("_n"), F.col("target").alias("_t"))
        joined = now.join(t, F.col("target") == F.col("_n"), "left")
        now = joined.select("node", F.coalesce("_t", "target").alias("target"), F.col("_t").isNotNull().alias("_more")).checkpoint()
        if not now.where("_more").limit(1).count():
            return now.select("node", "target")
        now = now.select("node", "target")
    raise ValueError("redirects have a cycle")


def save(entities: DataFrame, revisions: DataFrame, writes: DataFrame, key: str, expected: str | None = None, create_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, revisions) after one atomic save: all writes or none.

    The inputs are written out first, so what is checked is what is saved, whatever changes at their sources meanwhile; to
    put the results in place is the caller's part.
    A key is written once; with ``expected`` (null: no entity yet) it must be the entity's revision; create_only refuses
    keys that exist. The new revision is one more than the largest of either table, so revisions are never used again.
    """
    entities, revisions, writes = entities.checkpoint(), revisions.checkpoint(), writes.checkpoint()
    if writes.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("one write for each key")
    found = writes.join(entities.select(key, F.col("revision").alias("_now")), key, "left")
    if expected and found.where(~F.col(expected).eqNullSafe(F.col("_now"))).limit(1).count():
        raise ValueError("an entity changed before the save")
    if create_only and found.where("_now IS NOT NULL").limit(1).count():
        raise ValueError("an entity exists")
    last = entities.select(key, "revision").unionByName(revisions.select(key, "revision")).groupBy(key).agg(F.max("revision").alias("_last"))
    fresh = writes.join(last, key, "left").withColumn("revision", F.greatest(F.coalesce("_last", F.lit(0)), F.lit(0)) + 1)
    kept = entities.join(writes.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*entities.columns)), revisions.unionByName(fresh.select(*revisions.columns))


def delete(entities: DataFrame, revisions: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(entities, revisions) after deletes of keys (with their kind): a revision -1 keeps what the entity was, null if there was none."""
    prior = [c for c in revisions.columns if c not in (key, "kind", "revision")]
    dead = doomed.join(entities.select(key, *prior), key, "left").withColumn("revision", F.lit(-1))
    return entities.join(doomed.select(key), key, "left_anti"), revisions.unionByName(dead.select(*revisions.columns))


def excluded_closure(records: DataFrame, id_: str, parent: str, excluded: Column, most: int = 40) -> DataFrame:
    """records with ``out``: excluded themselves or under an excluded parent, transitively.

    Ancestors are reached by doubling, so rounds grow as the logarithm of the depth; parents in a circle take all of
    ``most`` rounds, which reach 2 ** most levels.
    """
    now = records.select(F.col(id_).alias("_id"), F.coalesce(excluded, F.lit(False)).alias("out"), F.when(F.col(parent) != F.col(id_), F.col(parent)).alias("_up")).checkpoint()
    for _ in range(most):
        if not now.where("_up IS NOT NULL").limit(1).count():
            break
        above = now.select(F.col("_id").alias("_p"), F.col("out").alias("_o"), F.col("_up").alias("_next"))
        both = now.join(above, F.col("_up") == F.col("_p"), "left")
        now = both.select("_id", (F.col("out") | F.coalesce("_o", F.lit(False))).alias("out"), F.col("_next").alias("_up")).checkpoint()
    return records.join(now.select(F.col("_id").alias(id_), "out"), id_)


def review_state(excluded: Column, onset: Column, changed: Column, checked: Column, still_open: Column) -> Column:
    """State of a reviewed entity out of its onset (``model``, ``checked`` or ``changed``) and its numbers of traces that
    a person changed, saw at all, or left open."""
    return (
        F.when(excluded, "excluded")
        .when((onset == "changed") | (changed > 0), "corrected")
        .when((onset == "checked") & (still_open == 0), "checked")
        .when((onset != "model") | (checked > 0), "partly checked")
        .otherwise("model")
    )


def violations(**rules: Column) -> Column:
    """Names of the violated rules, in the order given."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def ordered_digest(rows: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """keys, n, digest that does not depend on row order: a sum of row hashes, so no group is collected."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("\t", *parts), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("digest"))
