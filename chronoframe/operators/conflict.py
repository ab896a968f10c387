"""Vector clocks (MAP<STRING, BIGINT>), conflict resolution and tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _clock(c: Column) -> Column:
    return F.coalesce(c, F.create_map().cast("map<string,bigint>"))


def tick(clock: Column, node: str) -> Column:
    """The clock with one more event at ``node``."""
    one = F.create_map(F.lit(node), F.lit(1).cast("bigint"))
    return F.map_zip_with(_clock(clock), one, lambda k, a, b: _count(a) + _count(b))


def merge(a: Column, b: Column) -> Column:
    """The larger count of each node."""
    return F.map_zip_with(_clock(a), _clock(b), lambda k, x, y: F.greatest(_count(x), _count(y)))


def compare(a: Column, b: Column) -> Column:
    """'less', 'greater', 'equal' or 'concurrent'; a node that a clock lacks counts as 0."""
    gaps = F.map_values(
        F.map_zip_with(_clock(a), _clock(b), lambda k, x, y: _count(x) - _count(y))
    )
    under, over = F.exists(gaps, lambda d: d < 0), F.exists(gaps, lambda d: d > 0)
    return (
        F.when(under & over, "concurrent").when(under, "less").when(over, "greater").otherwise("equal")
    )


def dominates(a: Column, b: Column) -> Column:
    return compare(a, b).isin("greater", "equal")


def apply_writes(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Each incoming write with ``outcome``: applied, rejected, duplicate or conflict.

    Both have the keys and ``clock``; a key without a current version is applied."""
    now = current.select(*keys, F.col("clock").alias("__now"))
    order = compare(F.col("clock"), F.col("__now"))
    outcome = (
        F.when(F.col("__now").isNull(), "applied")
        .when(order == "greater", "applied")
        .when(order == "less", "rejected")
        .when(order == "equal", "duplicate")
        .otherwise("conflict")
    )
    return incoming.join(now, keys, "left").withColumn("outcome", outcome).drop("__now")


def resolve(writes: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Last writer wins: the newest of each key's writes, under the merged clock with one
    more event at ``node``.  The merge is a max per (key, node), combined before the shuffle."""
    rest = [c for c in writes.columns if c not in (*keys, "clock")]
    newest = writes.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("__v")
    )
    counts = (
        writes.select(*keys, F.explode("clock").alias("node", "n"))
        .groupBy(*keys, "node")
        .agg(F.max("n").alias("n"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("clock"))
    )
    out = newest.join(counts, keys, "left").withColumn("clock", tick(F.col("clock"), node))
    return out.select(*keys, *(F.col("__v")[c].alias(c) for c in rest), "clock")


def without_deleted(values: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Values that no tombstone dominates.  Of several tombstones any dominating one counts."""
    graves = tombstones.select(*keys, F.col("clock").alias("__t"))
    return values.join(
        graves, [values[k] == graves[k] for k in keys] + [dominates(F.col("__t"), values["clock"])], "left_anti"
    )


def missing_versions(local: DataFrame, peer: DataFrame, keys: list[str]) -> DataFrame:
    """What a peer lacks: local rows whose key it has not, or has in a version before."""
    theirs = peer.select(*keys, F.col("clock").alias("__c"))
    both = local.join(theirs, keys, "left")
    newer = F.col("__c").isNull() | compare(F.col("clock"), F.col("__c")).isin("greater", "concurrent")
    return both.where(newer).drop("__c")
