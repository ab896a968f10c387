"""Version logs on disk: Parquet by namespace, JSON-lines write-ahead logs, snapshots."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.values import content_id
from chronoframe.operators import conflict, temporal

SCHEMA = "ns string, key string, seq bigint, ts timestamp, op string, value string, content_id string"


def append(log: DataFrame, path: str) -> None:
    """Appends versions; files are laid out by namespace, so a read of one prunes the rest."""
    log.write.mode("append").partitionBy("ns").parquet(path)


def read(spark: SparkSession, path: str, ns: str | None = None) -> DataFrame:
    log = spark.read.schema(SCHEMA).parquet(path)
    return log if ns is None else log.where(F.col("ns") == ns)


def next_seq(log: DataFrame) -> int:
    """The least number that no version of ``log`` has reached."""
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def put(spark: SparkSession, path: str, items: DataFrame, seq: int) -> None:
    """Writes (ns, key, ts, value) as versions numbered from ``seq`` on, in the order of their
    rows.  Numbers grow but may leave gaps: no row waits for how many others there are."""
    rows = items.select(
        "ns", "key", (F.monotonically_increasing_id() + seq).alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit("P").alias("op"), "value", content_id(F.col("value")).alias("content_id"),
    )
    append(rows, path)


def put_with_parents(
    spark: SparkSession, path: str, edges_path: str, items: DataFrame, seq: int
) -> None:
    """``put`` of (ns, key, ts, value, parents): an edge (parent, child) for each of ``parents``,
    the child named 'ns:key'."""
    put(spark, path, items, seq)
    child = F.concat_ws(":", "ns", "key").alias("child")
    items.select(F.explode("parents").alias("parent"), child).write.mode("append").parquet(edges_path)


def delete_causal(
    spark: SparkSession, path: str, graves_path: str, keys: DataFrame, ts: Any, seq: int, node: str
) -> None:
    """Deletes (ns, key, clock) and leaves a tombstone of each under its clock, ticked at
    ``node``; the versions stay readable."""
    delete(spark, path, keys, ts, seq)
    graves = keys.select("ns", "key", conflict.tick(F.col("clock"), node).alias("clock"), F.lit(ts).cast("timestamp").alias("ts"))
    graves.write.mode("append").parquet(graves_path)


def linked(log: DataFrame) -> DataFrame:
    """Versions with ``write_id`` and ``previous``, the write before under the same key."""
    named = log.withColumn("write_id", temporal.write_id(F.col("content_id"), F.col("seq")))
    return temporal.with_previous(named, ["write_id"]).withColumnRenamed("prev_write_id", "previous").drop("version")


def split_values(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions without their values, and each distinct value once under its content id."""
    values = log.where(F.col("content_id").isNotNull()).groupBy("content_id").agg(F.min("value").alias("value"))
    return log.drop("value"), values


def with_values(versions: DataFrame, values: DataFrame) -> DataFrame:
    return versions.join(values, "content_id", "left").select("ns", "key", "seq", "ts", "op", "value", "content_id")


def get(log: DataFrame, ns: str, key: Any) -> DataFrame:
    """The current version of one key; no row if there is none or it is deleted."""
    return temporal.latest(log.where((F.col("ns") == ns) & (F.col("key") == key)))


def delete(spark: SparkSession, path: str, keys: DataFrame, ts: Any, seq: int) -> None:
    rows = keys.select(
        "ns", "key", (F.monotonically_increasing_id() + seq).alias("seq"), F.lit(ts).cast("timestamp").alias("ts"),
        F.lit("D").alias("op"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("content_id"),
    )
    append(rows, path)


WAL = "ns string, key string, seq bigint, ts timestamp, op string, value string, checksum bigint"


def checksum() -> Any:
    at = F.unix_micros("ts").cast("string")
    return F.crc32(F.concat_ws("|", "ns", "key", F.col("seq").cast("string"), at, "op", "value"))


def write_wal(log: DataFrame, path: str) -> None:
    """Versions as JSON lines with a CRC-32 of each."""
    log.select("ns", "key", "seq", "ts", "op", "value", checksum().alias("checksum")).write.mode(
        "append"
    ).json(path)


def replay_wal(spark: SparkSession, path: str) -> DataFrame:
    """Versions of a write-ahead log; lines that can't be read or fail their checksum are left out."""
    lines = spark.read.schema(WAL).option("mode", "PERMISSIVE").json(path)
    good = lines.where(F.col("checksum").isNotNull() & (F.col("checksum") == checksum()))
    return good.withColumn("content_id", content_id(F.col("value"))).select(
        "ns", "key", "seq", "ts", "op", "value", "content_id"
    )


def snapshot(log: DataFrame, path: str, history: bool = True) -> None:
    """All versions, or the current ones only, by namespace."""
    kept = log if history else temporal.latest(log)
    kept.write.mode("overwrite").partitionBy("ns").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The log that ``snapshot`` wrote."""
    return read(spark, path)


def conflicts(log: DataFrame) -> DataFrame:
    """(ns, key, seq, ts, contents): writes under one number that don't hold the same."""
    by = log.groupBy("ns", "key", "seq", "ts").agg(F.sort_array(F.collect_set(F.coalesce("content_id", "op"))).alias("contents"))
    return by.where(F.size("contents") > 1)


def merge(*logs: DataFrame) -> DataFrame:
    """One log of several: versions that two of them hold are kept once.  Different values
    under one number are all kept; ``conflicts`` finds them."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates(["ns", "key", "seq", "ts", "op", "value"])
