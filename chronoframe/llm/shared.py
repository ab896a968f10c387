"""What several operators need: lineage cut in the shared folder, joins that stand hot keys,
and Python workers that hold little."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.lineage import cut, make_dir, new_dir, shared_dir

__all__ = ["bounded_batches", "cut", "join_facts", "lean", "make_dir", "new_dir", "release", "shared_dir"]

#: Rows and bytes of the Arrow batches that go to Python, at most.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
#: The same and the rows that a scan decodes at once, for steps whose JVM has to stay small: each
#: file that a task writes has the JVM start ``chmod``, and until that is executed the new process
#: counts with all of the JVM's memory once more.
SMALL = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
#: Keys that are joined by broadcast, at most, and rows below which a key never is.
HOT, LEAST = 1_000, 32


def bounded_batches(spark: SparkSession, bounds: dict[str, str] = BATCH) -> None:
    """Bounds the batches of this session, where it has no setting of its own: texts
    are long, and a batch is held several times over by both sides."""
    own = spark.conf.getAll
    for name, value in bounds.items():
        if name not in own:
            spark.conf.set(name, value)


def release() -> None:
    """Gives memory that this worker no longer uses back to the machine: workers serve many
    tasks, and what a task leaves behind counts against the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, then ``release``."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return whole


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` inner-joined with their one row of ``facts`` by ``keys``; ``weight`` counts the
    rows of each key and goes.  ``facts`` is read several times: it should be cut before.

    Fewer than HOT keys can have more than one in HOT of all rows.  Their facts are broadcast,
    so that their rows stay in the tasks that have them; all others are joined by a shuffle
    that no key can unbalance.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    bar = max(LEAST, total // HOT)
    hot = F.broadcast(facts.where(F.col(weight) > bar).drop(weight))
    cold = facts.where(F.col(weight) <= bar).drop(weight)
    if not total:
        return rows.join(cold, keys)
    rest = rows.join(F.broadcast(facts.where(F.col(weight) > bar).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))
