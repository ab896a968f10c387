"""Versions of keys in an append-only log: (ns, key, seq, ts, op, ...).

``seq`` orders versions of one instant.  A version whose ``op`` is 'D' deletes its key.
The newest version comes from ``max_by`` over a struct: a hash aggregate that combines
before the shuffle, where a window would sort every version.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("ns", "key")


def latest(log: DataFrame, keys: Sequence[str] = KEYS, deleted: bool = False) -> DataFrame:
    """The newest version of each key; deleted keys only if asked for."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("__v")
    )
    out = newest.select(*keys, *(F.col("__v")[c].alias(c) for c in rest))
    if "op" in rest and not deleted:
        out = out.where(F.coalesce(F.col("op") != "D", F.lit(True)))
    return out.select(*log.columns)


def as_of(log: DataFrame, t: Any, keys: Sequence[str] = KEYS, deleted: bool = False) -> DataFrame:
    """The state at ``t``: for each key, its newest version not after it."""
    return latest(log.where(F.col("ts") <= t), keys, deleted)


def as_of_join(
    left: DataFrame, log: DataFrame, keys: Sequence[str] = KEYS, at: str = "at"
) -> DataFrame:
    """Each row of ``left`` with the version (struct ``version``) its key had at ``at``.

    One sort over both inputs together: versions and questions of a key in order of time,
    and the last version seen carried forward.  No pair of question and version is made.
    """
    rest = [c for c in log.columns if c not in keys]
    row = [c for c in left.columns if c not in keys]
    versions = log.select(
        *keys,
        F.struct(F.col("ts").alias("t"), F.lit(0).alias("k"), F.col("seq").alias("s")).alias("__o"),
        F.struct(*rest).alias("version"),
        F.lit(None).cast(left.select(F.struct(*row)).schema[0].dataType).alias("__row"),
    )
    asked = left.select(
        *keys,
        F.struct(
            F.col(at).cast(log.schema["ts"].dataType).alias("t"),
            F.lit(1).alias("k"),
            F.lit(0).cast(log.schema["seq"].dataType).alias("s"),
        ).alias("__o"),
        F.lit(None).cast(log.select(F.struct(*rest)).schema[0].dataType).alias("version"),
        F.struct(*row).alias("__row"),
    )
    w = Window.partitionBy(*keys).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    both = versions.unionByName(asked).withColumn(
        "version", F.last("version", ignorenulls=True).over(w)
    )
    return both.where(F.col("__o.k") == 1).select(
        *keys, *(F.col("__row")[c].alias(c) for c in row), "version"
    )


def history(log: DataFrame, **key: Any) -> DataFrame:
    """All versions of a key, oldest first."""
    for name, value in key.items():
        log = log.where(F.col(name) == value)
    return log.orderBy("ts", "seq")


def newest_versions(log: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def between(log: DataFrame, start: Any, end: Any) -> DataFrame:
    return log.where(F.col("ts").between(start, end))


def namespaces(log: DataFrame) -> DataFrame:
    return log.select("ns").distinct().orderBy("ns")


def keys(log: DataFrame, ns: str) -> DataFrame:
    return log.where(F.col("ns") == ns).select("key").distinct().orderBy("key")


def contains(log: DataFrame, wanted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows of ``wanted`` whose key exists and is not deleted."""
    return wanted.join(latest(log, keys).select(*keys), list(keys), "left_semi")


def stats(log: DataFrame) -> DataFrame:
    """Keys, versions and namespaces.  Two plain aggregates instead of distinct counts
    over all versions in one."""
    by_key = log.groupBy("ns", "key").agg(F.count(F.lit(1)).alias("n"))
    by_ns = by_key.groupBy("ns").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))
    return by_ns.agg(
        F.coalesce(F.sum("keys"), F.lit(0)).alias("key_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_versions"),
        F.count(F.lit(1)).alias("namespace_count"),
    )


def _by_version(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def with_previous(
    log: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Each version with ``prev_<column>`` of the one before it, and its number from 1."""
    w = _by_version(keys)
    return log.withColumns(
        {f"prev_{c}": F.lag(c).over(w) for c in columns} | {"version": F.row_number().over(w)}
    )


def write_id(content: Column, seq: Column) -> Column:
    return F.concat_ws("_", content, seq.cast("string"))


def diff(
    log: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, newer: int | None = None, older: int | None = None
) -> DataFrame:
    """Fields that differ between two versions of each key: by number from 1, or the last two."""
    w = _by_version(keys)
    back = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq"))
    log = log.withColumns({"__v": F.row_number().over(w), "__b": F.row_number().over(back)})
    new = F.col("__b") == 1 if newer is None else F.col("__v") == newer
    old = F.col("__b") == 2 if older is None else F.col("__v") == older
    sides = log.where(new | old).groupBy(*keys).agg(
        *(F.max(F.when(new, F.col(c).cast("string"))).alias(f"new_{c}") for c in columns),
        *(F.max(F.when(old, F.col(c).cast("string"))).alias(f"old_{c}") for c in columns),
        F.count(F.lit(1)).alias("__n"),
    )
    each = F.array(
        *(F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new")) for c in columns)
    )
    changed = F.filter(each, lambda f: ~f["old"].eqNullSafe(f["new"]))
    return sides.where("__n = 2").select(*keys, F.explode(changed).alias("f")).select(*keys, "f.*")


def changes(log: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The change feed of a log: each version as insert, update or delete, with what was
    there before.  What follows a delete is an insert."""
    w = _by_version(keys)
    op = F.col("op") if "op" in log.columns else F.lit("P")
    gone = F.coalesce(F.lag(op).over(w) == "D", F.lit(True))
    kind = F.when(op == "D", "delete").when(gone, "insert").otherwise("update")
    out = log.withColumns(
        {f"prev_{c}": F.when(~gone, F.lag(c).over(w)) for c in columns} | {"change": kind}
    )
    return out
