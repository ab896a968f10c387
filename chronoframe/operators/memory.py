"""Workspace and agent memory: keyword search, recall, relevance."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword(df: DataFrame, words: str, n: int, text: Column, key: str = "key") -> DataFrame:
    """Rows whose text or key holds ``words`` in any case."""
    asked = F.lower(F.lit(words))
    hit = F.contains(F.lower(text), asked) | F.contains(F.lower(F.col(key).cast("string")), asked)
    return df.where(F.coalesce(hit, F.lit(False))).withColumn("relevance", F.lit(0.5)).orderBy(key).limit(n)


def recall(df: DataFrame, words: str, n: int, least: float = 0.0, kind: str | None = None, text: str = "text", key: str = "key") -> DataFrame:
    """Memories by half of whether they match plus half of their importance; those that
    don't match stay, on importance alone."""
    rows = df if kind is None else df.where(F.col("type") == kind)
    hit = F.coalesce(F.contains(F.lower(text), F.lower(F.lit(words))), F.lit(False))
    score = 0.5 * F.when(hit, 0.5).otherwise(0.0) + 0.5 * F.col("importance")
    return rows.withColumn("relevance", score).where(F.col("relevance") >= least).orderBy(F.desc("relevance"), key).limit(n)


def relevance(cosine: Column, importance: Column, age_days: Column, accesses: Column) -> Column:
    return (
        0.4 * (cosine + 1) / 2
        + 0.3 * importance
        + 0.2 * F.exp(-age_days / 30)
        + 0.1 * F.least(accesses / 10, F.lit(1.0))
    )


def should_consolidate(age_days: Column, importance: Column, accesses: Column, days: int = 30) -> Column:
    """Old items, but for important and often used ones."""
    return (F.floor(age_days) >= days) & (importance <= 0.8) & (accesses <= 5)


def stats(df: DataFrame, kind: str = "type") -> DataFrame:
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("items"))


def item_id(*parts: Any) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
