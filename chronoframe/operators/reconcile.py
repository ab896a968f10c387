"""Reconciliation of sets of ids: differences, Merkle trees, Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Remote ids that are not local; repeats stay."""
    return remote.join(local.select(key).distinct(), key, "left_anti")


def common(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    return local.select(key).intersect(remote.select(key))


def efficiency(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """1 - missing / total of the remote ids; 1 if there are none."""
    mine = local.select(key).distinct().withColumn("__l", F.lit(1))
    theirs = remote.select(key).join(mine, key, "left")
    gone = F.count_if(F.col("__l").isNull())
    total = F.count(F.lit(1))
    return theirs.agg(
        total.alias("total"),
        gone.alias("missing"),
        F.when(total == 0, 1.0).otherwise(1 - gone / total).alias("efficiency"),
    )


def merge_graphs(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Union of nodes with ``side``: local, remote or both."""
    both = local.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(
        remote.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    side = F.when((F.max("l") == 1) & (F.max("r") == 1), "both").when(F.max("l") == 1, "local")
    return both.groupBy(key).agg(side.otherwise("remote").alias("side"))


def _leaf(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 64 - depth).alias("node")


def merkle_leaves(ids: DataFrame, key: str, depth: int) -> DataFrame:
    """(node, hash) of each range of id hashes that holds an id."""
    text = F.col(key).cast("string")
    each = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = ids.select(key).distinct().groupBy(_leaf(key, depth)).agg(
        F.sum(each).alias("sum"), F.count(F.lit(1)).alias("n")
    )
    return sums.select("node", F.sha2(F.concat_ws(":", "n", "sum"), 256).alias("hash"))


def merkle_levels(ids: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """A Merkle tree over ids: (level, node, hash), leaves at level 0, one root on top.

    Leaves are hash ranges of the id space, so an id changes one leaf and its ancestors
    only, wherever it is inserted.  A leaf hashes its ids by an order-free sum, which
    combines before the shuffle; upper levels have at most ``buckets`` nodes.
    """
    depth = max(1, math.ceil(math.log2(buckets)))
    level = merkle_leaves(ids, key, depth)
    out = level.select(F.lit(0).alias("level"), "node", "hash")
    for i in range(1, depth + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        told = F.transform(children, lambda c: F.concat_ws(":", c["node"], c["hash"]))
        level = level.groupBy(F.shiftright("node", 1).alias("node")).agg(
            F.sha2(F.array_join(told, "|"), 256).alias("hash")
        )
        out = out.union(level.select(F.lit(i).alias("level"), "node", "hash"))
    return out


def merkle_root(ids: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    depth = max(1, math.ceil(math.log2(buckets)))
    return merkle_levels(ids, key, buckets).where(F.col("level") == depth).select("hash")


def merkle_diff(a: DataFrame, b: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """Ids that only one side has: leaves are compared first, ids of unequal leaves then."""
    depth = max(1, math.ceil(math.log2(buckets)))
    leaf = _leaf(key, depth)
    x, y = (merkle_leaves(d, key, depth) for d in (a, b))
    differ = (
        x.select("node", F.col("hash").alias("x"))
        .join(y.select("node", F.col("hash").alias("y")), "node", "full")
        .where(~F.col("x").eqNullSafe(F.col("y")))
        .select("node")
    )

    def ids(d: DataFrame, side: str) -> DataFrame:
        return d.select(key).distinct().select(key, leaf).join(differ, "node", "left_semi").select(key, F.lit(side).alias("side"))

    both = ids(a, "a").union(ids(b, "b"))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("side")).where("n = 1").drop("n")


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for so many items at a false-positive rate."""
    bits = max(64, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / max(1, items) * math.log(2)))


def _places(key: Column, bits: int, hashes: int) -> list[Column]:
    # reduced first: sums of full hashes would overflow
    a, b = (F.pmod(F.xxhash64(key, F.lit(s)), F.lit(bits)) for s in (1, 2))
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)]


def bloom_filter(ids: DataFrame, key: str, items: int, rate: float = 0.01) -> DataFrame:
    """The filter as rows (word, mask): 64 bits each, or-ed together before the shuffle."""
    bits, hashes = bloom_size(items, rate)
    at = ids.select(F.explode(F.array(*_places(F.col(key), bits, hashes))).alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")
    )


def maybe_missing(local: DataFrame, remote: DataFrame, key: str, items: int | None = None, rate: float = 0.01) -> DataFrame:
    """Remote ids that the filter of local ids rules out: certainly missing ones.

    Without ``items`` the filter is made for as many ids as there are."""
    if items is None:
        items = local.select(key).distinct().count()
    bits, hashes = bloom_size(items, rate)
    bloom = bloom_filter(local, key, items, rate)
    asked = remote.select(key).distinct()
    each = asked.select(key, F.explode(F.array(*_places(F.col(key), bits, hashes))).alias("at"))
    seen = each.select(key, "at", F.shiftright("at", 6).alias("word")).join(bloom, "word", "left")
    hit = F.coalesce(F.expr("(mask & shiftleft(1L, cast(at & 63 as int))) <> 0"), F.lit(False))
    return seen.groupBy(key).agg(F.bool_and(hit).alias("held")).where("NOT held").select(key)


def divergence(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Where two histories part: nodes that both edge tables (parent, child) hold and below
    which at least one of them has a child that the other lacks."""
    mine, theirs = (d.select("parent", "child").distinct() for d in (local, remote))
    only = mine.join(theirs, ["parent", "child"], "left_anti").union(theirs.join(mine, ["parent", "child"], "left_anti"))

    def nodes(d: DataFrame) -> DataFrame:
        return d.select(F.explode(F.array("parent", "child")).alias("node")).distinct()

    both = nodes(mine).intersect(nodes(theirs))
    return only.select(F.col("parent").alias("node")).distinct().join(both, "node", "left_semi")


def frontier_exchange(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Frontier nodes (no children) of each side that the other doesn't know: what each asks
    the other to send from."""

    def frontier(d: DataFrame) -> DataFrame:
        return d.select(F.col("child").alias("node")).distinct().join(d.select(F.col("parent").alias("node")), "node", "left_anti")

    def unknown(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        known = b.select(F.explode(F.array("parent", "child")).alias("node"))
        return frontier(a).join(known, "node", "left_anti").select("node", F.lit(side).alias("side"))

    return unknown(local, remote, "local").union(unknown(remote, local, "remote"))
