"""Similarity search over vectors kept as ARRAY columns.

Searches for one vector score every row once and keep the best k by a top-k operator, so
nothing but k rows for each task is moved.  ``pairs`` compares all vectors, block by block,
as products of matrices, and scores exactly what comes near the threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import vectors as V
from chronoframe.lineage import cut, make_dir, new_dir
from chronoframe.operators import temporal

#: Rows of a block, at least; its numbers, at most; blocks below which it isn't larger.
LEAST_ROWS, MOST_NUMBERS, BLOCKS = 1024, 1 << 20, 32
#: Tasks that compare blocks, at most; pairs of blocks that a task compares where that gives
#: fewer; cosines at once; pairs in a batch of results.
TASKS, EACH, COSINES, BATCH = 1000, 4, 1 << 20, 1 << 16


def search(
    df: DataFrame,
    query: list[float],
    k: int | None = 10,
    threshold: float = 0.0,
    vector: str = "embedding",
    key: str = "key",
    where: Column | None = None,
    score: str = "score",
) -> DataFrame:
    """The k rows most like ``query`` by cosine, at least ``threshold``; ties by key.
    With ``k`` None all of them, in no order.

    Vectors of another length take no part.  Conditions hold before the k are taken."""
    rows = df if where is None else df.where(where)
    scored = rows.withColumn(score, V.cosine(F.col(vector), V.literal(query)))
    found = scored.where(F.col(score) >= threshold)
    return found if k is None else found.orderBy(F.desc(score), key).limit(k)


def search_as_of(
    log: DataFrame, query: list[float], t: Any, k: int = 10, threshold: float = 0.0, keys=temporal.KEYS, **options: Any
) -> DataFrame:
    """Search among the vectors that keys had at ``t``."""
    return search(temporal.as_of(log, t, keys), query, k, threshold, **options)


def navigate(
    df: DataFrame, start: list[float], steps: list[tuple[str, list[float]]], k: int = 10, **options: Any
) -> DataFrame:
    """Moves from ``start`` by adding, subtracting or going half way, then searches there."""
    at = start
    for move, v in steps:
        pairs = list(zip(at, v, strict=True))
        if move == "add":
            at = [a + b for a, b in pairs]
        elif move == "subtract":
            at = [a - b for a, b in pairs]
        else:
            at = [(a + b) / 2 for a, b in pairs]
        at = [max(-1.0, min(1.0, a)) for a in at]
    return search(df, at, k, **options)


class Block:
    """Keys, what they are ``apart`` by, and vectors of one length (``columns``: one array for
    each dimension), from rows (key, vec, apart)."""

    def __init__(self, rows: pa.Table, length: int):
        self.keys, self.apart = rows.column(0).combine_chunks(), rows.column(2).to_pandas(integer_object_nulls=True).to_numpy()
        flat = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        self.columns = np.ascontiguousarray(flat.reshape(rows.num_rows, length).T)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(self._sum(self.columns, self.columns, slice(None), slice(None)))
            unit = self.columns / np.where(self.norm > 0, self.norm, 1)
        # not a number, so that no comparison rules them out
        unit[:, ~np.isfinite(self.norm)] = np.nan
        self.unit = np.ascontiguousarray(unit.T, np.float32)

    @classmethod
    def all(cls, rows: pa.Table) -> dict[int, Block]:
        lengths = rows.column(1).combine_chunks().value_lengths().to_numpy()
        return {n: cls(rows.take(np.flatnonzero(lengths == n)), n) for n in np.unique(lengths).tolist()}

    @staticmethod
    def _sum(a: np.ndarray, b: np.ndarray, i, j) -> np.ndarray:
        """Sums of products, added in the order in which ``V.cosine`` adds them."""
        total = np.zeros(a.shape[1])[i]
        for x, y in zip(a, b, strict=True):
            total += x[i] * y[j]
        return total

    def scores(self, other: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``V.cosine`` of rows ``i`` with rows ``j`` of ``other``, to the last bit."""
        with np.errstate(all="ignore"):
            size = self.norm[i] * other.norm[j]
            return np.where(size == 0, 0.0, self._sum(self.columns, other.columns, i, j) / size)

    def close(self, other: Block, threshold: float) -> Iterator[tuple]:
        """(rows, rows of ``other``) that may reach the threshold; of a block with itself each
        pair once, and each row with itself."""
        # cosines of rounded vectors are off by less than this
        least = np.float32(threshold - (len(self.columns) + 8) * 2.0**-23)
        step = max(1, COSINES // max(1, len(other.norm)))
        held = np.empty((min(step, len(self.norm)), len(other.norm)), np.float32)
        for at in range(0, len(self.norm), step):
            own = self.unit[at : at + step]
            with np.errstate(all="ignore"):
                cosine = np.matmul(own, other.unit.T, out=held[: len(own)])
            # a maximum is found faster than places; most rows have none
            some = np.flatnonzero(~(cosine.max(axis=1, initial=-2) < least))
            i, j = np.nonzero(~(cosine[some] < least))
            i = some[i] + at
            if other is self:
                i, j = i[i <= j], j[i <= j]
            yield i, j

    def near(self, other: Block, threshold: float, differ: bool) -> Iterator[tuple]:
        """(rows, rows of ``other``, scores) that reach the threshold, in batches; of a block
        with itself each pair once.  ``differ``: those alone that ``apart`` parts."""
        for i, j in self.close(other, threshold):
            if other is self:
                i, j = i[i < j], j[i < j]
            if differ:
                mine, its = self.apart[i], other.apart[j]
                parted = (mine != its) & ~pd.isna(mine) & ~pd.isna(its)
                i, j = i[parted], j[parted]
            for k in range(0, len(i), BATCH):
                x, y = i[k : k + BATCH], j[k : k + BATCH]
                score = self.scores(other, x, y)
                kept = ~(score < threshold)
                yield x[kept], y[kept], score[kept]

    def tally(self, other: Block, threshold: float, bars: list[float], differ: bool) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the scores that reach the threshold, by how many of ``bars`` they
        are over.  A row stands for as many rows as its key says, with one vector; with
        ``differ`` rows whose ``apart`` is the same make no pair."""
        n, total = np.zeros(len(bars) + 1, np.int64), np.zeros(len(bars) + 1)
        mine, its = self.keys.to_numpy(), other.keys.to_numpy()
        for all_i, all_j in self.close(other, threshold):
            for k in range(0, len(all_i), BATCH):
                i, j = all_i[k : k + BATCH], all_j[k : k + BATCH]
                weight = mine[i] * its[j]
                if other is self:
                    weight = np.where(i == j, mine[i] * (mine[i] - 1) // 2, weight)
                if differ:
                    a, b = self.apart[i], other.apart[j]
                    weight[(a == b) & ~pd.isna(a) & ~pd.isna(b)] = 0
                i, j, weight = i[weight > 0], j[weight > 0], weight[weight > 0]
                score = self.scores(other, i, j)
                kept = ~(score < threshold)
                score, weight = score[kept], weight[kept]
                # what isn't a number is over all bars, as in SQL
                band = sum((~(score <= bar) for bar in bars), np.zeros(len(score), np.int64))
                np.add.at(n, band, weight)
                np.add.at(total, band, weight * score)
        return n, total


def _ordered(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a < b")


def _comparable(df: DataFrame, key: str, vector: str, apart: str | None = None) -> DataFrame:
    vec = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else V.doubles(F.col(vector))
    rows = df.select(F.col(key).alias("key"), vec.alias("vec"), (F.col(apart) if apart else F.lit(0)).alias("apart"))
    return rows.where("key IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)")


def pairs(
    df: DataFrame, threshold: float, key: str = "key", vector: str = "embedding", apart: str | None = None
) -> DataFrame:
    """(a, b, score) of all pairs of rows whose cosine is ``threshold`` or more, a < b; with
    ``apart`` those alone that differ in that column, where neither lacks it.

    Rows are dealt to blocks, which are written to the shared folder once; each task reads
    the blocks that it compares.  So only the pairs found are moved, and a common vector
    makes no task larger.  Vectors that are null or hold a null, and null keys, take no
    part; as in SQL, a cosine that isn't a number (of an infinite vector) reaches any
    threshold."""
    rows = _comparable(df, key, vector, apart)
    kind = rows.schema["key"].dataType.simpleString()
    size, blocks = _size(rows)

    def compare(x: Block, y: Block) -> Iterator[pa.RecordBatch]:
        for i, j, score in x.near(y, threshold, apart is not None):
            yield pa.RecordBatch.from_arrays([x.keys.take(i), y.keys.take(j), pa.array(score)], names=["a", "b", "score"])

    return _ordered(_compared(rows.repartition(blocks), size, compare, f"a {kind}, b {kind}, score double"))


def pair_counts(
    df: DataFrame, threshold: float, bars: list[float], key: str = "key", vector: str = "embedding"
) -> DataFrame:
    """(band, n, total): of ``pairs``, how many have a score over so many of ``bars``, and the
    sum of their scores.

    Equal vectors are compared once, each with how many rows have it, and tasks count what
    they find, so copies are not expanded into pairs and no pair is moved.  Rows that share
    a key make no pair: only where keys repeat are vectors grouped by such a key too."""
    rows = _comparable(df, key, vector).select("key", "vec")
    size, _ = _size(rows)
    again = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("key").alias("shared")))
    repeat = not again.isEmpty()
    marked = rows.join(again, "key", "left") if repeat else rows.withColumn("shared", F.lit(0))
    groups = marked.groupBy("vec", "shared").agg(F.count(F.lit(1)).alias("n")).select("n", "vec", "shared")

    def compare(x: Block, y: Block) -> Iterator[pa.RecordBatch]:
        n, total = x.tally(y, threshold, bars, repeat)
        band = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), pa.array(n[band]), pa.array(total[band])], names=["band", "n", "total"])

    found = _compared(groups, size, compare, "band int, n long, total double")
    return found.groupBy("band").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _size(rows: DataFrame) -> tuple[int, int]:
    """Rows of a block, and the number of blocks that it takes for all."""
    count, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    most = max(1, MOST_NUMBERS // max(1, longest or 1))
    size = min(most, max(LEAST_ROWS, -(-count // BLOCKS)))
    return size, max(1, -(-count // size))


def _compared(rows: DataFrame, size: int, compare: Callable[[Block, Block], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
    """What ``compare`` yields for every two blocks with vectors of one length, and for every
    block with itself.  Blocks have at most about ``size`` of a partition's rows each."""
    folder = new_dir(rows.sparkSession, "vectors")
    make_dir(rows.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def save(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            where, path = fs.FileSystem.from_uri(folder)
            name = uuid.uuid4().hex
            with where.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, held[0].schema) as file:
                for b in held:
                    file.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                # repartition deals rows evenly, but not to the last row
                part = batch.slice(0, size + BLOCKS - count)
                held, count, batch = [*held, part], count + part.num_rows, batch.slice(part.num_rows)
                if count == size + BLOCKS:
                    yield save(held)
                    held, count = [], 0
        if held:
            yield save(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)

        def read(name: str) -> dict[int, Block]:
            with where.open_input_file(f"{path}/{name}") as file:
                return Block.all(pa.ipc.open_file(file).read_all())

        last, first = None, {}
        for batch in batches:
            for one, two in zip(*batch.to_pydict().values(), strict=True):
                if one != last:
                    last, first = one, read(one)
                second = first if one == two else read(two)
                for n in first.keys() & second.keys():
                    yield from compare(first[n], second[n])

    # the files are there once this has run
    names = cut(rows.mapInArrow(write, "name string"))
    count = names.count()
    items = names.toDF("one").crossJoin(F.broadcast(names.toDF("two"))).where("one <= two")
    # a task's pairs of blocks have their first one in common, mostly
    tasks = max(1, min(TASKS, -(-count * (count + 1) // 2 // EACH)))
    dealt = items.repartitionByRange(tasks, "one", "two").sortWithinPartitions("one", "two")
    return dealt.mapInArrow(run, fields)


def pairs_of(
    df: DataFrame, few: DataFrame, threshold: float, key: str = "key", vector: str = "embedding"
) -> DataFrame:
    """Those of ``pairs`` that have an end in ``few`` (key, vector), each once.  They are as
    few as the hits of a search: all tasks get them, and the rows are read once."""
    rows, ends = _comparable(df, key, vector), _comparable(few, key, vector).toArrow()
    kind = rows.schema["key"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Block.all(ends)
        for batch in batches:
            own = Block.all(pa.Table.from_batches([batch]))
            for n in own.keys() & asked.keys():
                x, y = own[n], asked[n]
                for i, j, score in x.near(y, threshold, False):
                    yield pa.RecordBatch.from_arrays([x.keys.take(i), y.keys.take(j), pa.array(score)], names=["a", "b", "score"])

    return _ordered(rows.mapInArrow(compare, f"a {kind}, b {kind}, score double")).distinct()


def unconnected(found: DataFrame, connected: DataFrame, k: int | None) -> DataFrame:
    """The k best of ``pairs`` that ``connected`` (a, b in either order) does not hold; with
    ``k`` None all of them, in no order."""
    both = connected.select("a", "b").union(connected.select("b", "a"))
    rest = found.join(both, ["a", "b"], "left_anti")
    return rest if k is None else rest.orderBy(F.desc("score"), "a", "b").limit(k)


#: Scores over which an edge is a composition, and an abstraction.
EDGE_BARS = [0.85, 0.95]
EDGE_KINDS = {0: ("proximity", 0.0), 1: ("composition", 0.7), 2: ("abstraction", 0.9)}


def typed_edges(found: DataFrame) -> DataFrame:
    """Kind and strength of the edges of a similarity graph."""
    kind = (
        F.when(F.col("score") > 0.95, "abstraction")
        .when(F.col("score") > 0.85, "composition")
        .otherwise("proximity")
    )
    semantic = F.when(kind == "abstraction", 0.9).when(kind == "composition", 0.7).otherwise(0.0)
    return found.withColumns(
        {"kind": kind, "strength": 0.4 * F.col("score") + 0.6 * semantic}
    )


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(
        F.count(F.lit(1)).alias("edges"), F.avg("strength").alias("mean_strength")
    )


def counted_edge_stats(df: DataFrame, threshold: float, key: str = "key", vector: str = "embedding") -> DataFrame:
    """``edge_stats`` of the ``typed_edges`` of ``pairs``, from counts alone."""
    by = pair_counts(df, threshold, EDGE_BARS, key, vector)
    kind, semantic = F.lit(None).cast("string"), F.lit(None).cast("double")
    for band, (name, strength) in EDGE_KINDS.items():
        kind = F.when(F.col("band") == band, name).otherwise(kind)
        semantic = F.when(F.col("band") == band, strength).otherwise(semantic)
    mean = 0.4 * F.col("total") / F.col("n") + 0.6 * semantic
    return by.select(kind.alias("kind"), F.col("n").alias("edges"), mean.alias("mean_strength"))


def abstraction_levels(edges: DataFrame) -> DataFrame:
    """2 for nodes with three kinds of edges and a mean strength under 0.8, 1 for two kinds."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "kind", "strength")
    by = ends.groupBy("node").agg(F.count_distinct("kind").alias("kinds"), F.avg("strength").alias("mean"))
    rank = F.when((F.col("kinds") >= 3) & (F.col("mean") < 0.8), 2).when(F.col("kinds") >= 2, 1)
    return by.withColumn("level", rank.otherwise(0))


def proximity(geometric: Column, semantic: Column, causal: Column) -> Column:
    mixed = 0.5 * geometric + 0.35 * semantic + 0.15 * causal
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))


def causal_score(
    versions: Column, earliest: Column, latest: Column, after: Any = None, before: Any = None,
    least_versions: int | None = None, custom: Column | None = None,
) -> Column:
    """How well a history fits what is asked for: the mean of one part for each condition, 0 if
    one fails, 0.5 if there is none.  Conditions: written after and before given times, at
    least so many versions (a tenth for each, up to 1), any column of truth values."""
    tests: list[tuple[Column, Column]] = []
    if after is not None:
        tests.append((latest >= F.lit(after), F.lit(1.0)))
    if before is not None:
        tests.append((earliest <= F.lit(before), F.lit(1.0)))
    if least_versions is not None:
        tests.append((versions >= least_versions, F.least(versions / 10, F.lit(1.0))))
    if custom is not None:
        tests.append((F.coalesce(custom, F.lit(False)), F.lit(1.0)))
    if not tests:
        return F.lit(0.5)
    holds, parts = tests[0][0], tests[0][1]
    for test, part in tests[1:]:
        holds, parts = holds & test, parts + part
    return F.when(F.coalesce(holds, F.lit(False)), parts / len(tests)).otherwise(0.0)


def history_scores(log: DataFrame, key: str = "key", **criteria: Any) -> DataFrame:
    """(key, causal): ``causal_score`` of each key's history (ts)."""
    by = log.groupBy(key).agg(F.count(F.lit(1)).alias("versions"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    score = causal_score(F.col("versions"), F.col("earliest"), F.col("latest"), **criteria)
    return by.select(key, score.alias("causal"))


def hybrid(
    hits: DataFrame, causal: DataFrame, key: str, k: int, vector_weight: float = 0.7, causal_weight: float = 0.3
) -> DataFrame:
    """Hits (key, score) ranked anew with ``causal`` (key, causal); others' causal is 0 and
    drops them."""
    if abs(vector_weight + causal_weight - 1) > 0.01:
        raise ValueError("weights must add up to 1")
    both = hits.join(causal, key).where("causal > 0")
    mixed = vector_weight * F.col("score") + causal_weight * F.col("causal")
    return both.withColumn("combined", mixed).orderBy(F.desc("combined"), key).limit(k)


def decayed(hits: DataFrame, age_days: Column, half_life: float, k: int, key: str) -> DataFrame:
    aged = F.col("score") * F.exp(-0.693 * age_days / half_life)
    return hits.withColumn("decayed", aged).orderBy(F.desc("decayed"), key).limit(k)


def mmr(hits: DataFrame, k: int, balance: float = 0.5, group: str = "query", key: str = "key", vector: str = "embedding", score: str = "score") -> DataFrame:
    """Maximal marginal relevance within each group of at most a few hundred hits: greedy
    choice of what is relevant and unlike what was chosen."""
    import numpy as np

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key).reset_index(drop=True)
        x = np.array(rows[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        relevance, chosen = rows[score].to_numpy(float), []
        likeness = np.zeros(len(rows))
        while len(chosen) < min(k, len(rows)):
            value = balance * relevance - (1 - balance) * likeness
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
            likeness = np.maximum(likeness, x @ x[chosen[-1]]) if len(chosen) > 1 else x @ x[chosen[-1]]
        return rows.loc[chosen].assign(rank=range(1, len(chosen) + 1))

    return hits.groupBy(group).applyInPandas(choose, f"{fields}, rank int")


def recall(approximate: DataFrame, exact: DataFrame, query: str, key: str) -> DataFrame:
    """Share of the exact answers that the approximate ones hold, by query."""
    got = approximate.select(query, key).distinct().withColumn("__got", F.lit(1))
    both = exact.select(query, key).join(got, [query, key], "left")
    return both.groupBy(query).agg(F.avg(F.coalesce("__got", F.lit(0)).cast("double")).alias("recall"))


def explain(hits: DataFrame, edges: DataFrame, shared: int = 5, kinds: int = 3) -> DataFrame:
    """Hits (key) with up to ``shared`` neighbours that other hits have too, and up to
    ``kinds`` kinds of edges that lead to them.  Hits are few: their edges alone are read."""
    ends = edges.select(F.col("a").alias("key"), F.col("b").alias("near"), "kind").union(
        edges.select("b", "a", "kind")
    )
    own = ends.join(hits.select("key"), "key", "left_semi")
    common = own.groupBy("near").agg(F.count_distinct("key").alias("n")).where("n > 1")
    why = own.join(common.select("near"), "near").groupBy("key").agg(
        F.slice(F.sort_array(F.collect_set("near")), 1, shared).alias("shared"),
        F.slice(F.sort_array(F.collect_set("kind")), 1, kinds).alias("relations"),
    )
    out = hits.join(why, "key", "left")
    told = F.when(F.col("shared").isNull(), "no shared neighbours").otherwise(
        F.concat_ws(" ", F.lit("shares"), F.size("shared"), F.lit("neighbours by"), F.concat_ws(", ", "relations"))
    )
    return out.withColumn("explanation", told)


def rank_in(groups: str, score: str, key: str) -> Column:
    return F.row_number().over(Window.partitionBy(groups).orderBy(F.desc(score), key))
