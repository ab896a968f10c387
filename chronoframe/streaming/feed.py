"""Change feeds as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoframe.operators.views import Views
from chronoframe.plans.filters import And, Filter
from chronoframe.plans.query import Query


@dataclass(frozen=True)
class Subscription:
    """What a subscriber wants: a namespace, a key, kinds of change, a filter."""

    ns: str | None = None
    key: str | None = None
    kinds: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()

    def matches(self, df: DataFrame, value: str = "value", prev: str = "prev_value") -> DataFrame:
        """The changes that match; a filter looks at the new value, or the old of a delete."""
        out = df
        if self.kinds:
            out = out.where(F.col("change").isin(*self.kinds))
        if self.ns is not None:
            out = out.where(F.col("ns") == self.ns)
        if self.key is not None:
            out = out.where(F.col("key") == self.key)
        if self.filters:
            seen = out.withColumn("__seen", F.coalesce(value, prev))
            q = Query(value="__seen")
            test: Column = And(list(self.filters)).compile(lambda n: q._field(seen, n))
            out = seen.where(test).drop("__seen")
        return out


CHANGE = "ns string, key string, seq bigint, ts timestamp, change string, value string, prev_value string"


def changes(log: DataFrame) -> DataFrame:
    """Inserts, updates and deletes of a streaming log, with the value before each.

    The state of a key is its last value; only keys seen in a batch are touched."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, alive = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for r in rows.itertuples():
            kind = "delete" if r.op == "D" else "update" if alive else "insert"
            value = None if r.op == "D" else r.value
            out.append((key[0], key[1], r.seq, r.ts, kind, value, last if alive else None))
            last, alive = value, r.op != "D"
        state.update((last, alive))
        yield pd.DataFrame(out, columns=["ns", "key", "seq", "ts", "change", "value", "prev_value"])

    return log.groupBy("ns", "key").applyInPandasWithState(
        run, CHANGE, "last string, alive boolean", "append", GroupStateTimeout.NoTimeout
    )


def subscribe(
    spark: SparkSession, path: str, schema: str, subscription: Subscription, deliver: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Delivers matching changes of the log below ``path``, batch by batch."""
    log = spark.readStream.schema(schema).parquet(path)
    found = subscription.matches(changes(log))
    writer = found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return (writer.trigger(availableNow=True) if once else writer).start()


def refresh_on_write(spark: SparkSession, path: str, schema: str, views: Views, source: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Refreshes the views that follow ``source`` whenever its log grows."""

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            views.refresh_source(source)

    writer = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(log: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    """Changes by window of event time; what comes later than ``late`` is dropped."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("changes"))
