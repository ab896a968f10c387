"""Time to live in ticks: rows carry ``expires_at``; the tick is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_ttl(df: DataFrame, now: int, ticks: Column | int) -> DataFrame:
    ticks = F.lit(ticks) if isinstance(ticks, int) else ticks
    return df.withColumn("expires_at", F.lit(now) + ticks)


def expired(df: DataFrame, tick: int) -> DataFrame:
    return df.where(F.col("expires_at") <= tick)


def live(df: DataFrame, tick: int) -> DataFrame:
    """What a clean-up leaves: rows without a time to live stay."""
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > tick))


def expiring_soon(df: DataFrame, tick: int, within: int) -> DataFrame:
    """Rows that expire within so many ticks, also those that have, with what remains."""
    return df.where(F.col("expires_at") <= tick + within).withColumn("remaining", remaining(tick))


def remaining(tick: int) -> Column:
    return F.greatest(F.col("expires_at") - tick, F.lit(0))


def expired_predictions(df: DataFrame, tick: int, source: str = "source") -> DataFrame:
    return expired(df, tick).where(F.col(source) == "prediction")
