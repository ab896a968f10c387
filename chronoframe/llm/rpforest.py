"""Nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample: a node parts its rows at the median of their
projections on the difference of two of them.  Every row is then routed to one leaf of
each tree.  A query walks all trees through one priority queue, keyed by how far the
query lies on the wrong side of the splits above a branch, and takes leaves until they
hold enough places.  What the leaves hold is ranked by exact distance.

How many places are enough is measured: ASKED vectors are compared with all others, and the
least number is taken at which RECALL of their true neighbours lie in visited leaves.  It
follows the vectors: few places where neighbours are near, many where they are hardly nearer
than the rest.

Rows are dealt to tasks by groups of leaves; a group with many rows is parted by vector, and
every part gets the queries that visit one of its leaves.  A part's rows come first in its
sorted stream and are held, its queries follow and are answered batch by batch.  A task keeps
each query's nearest only, so no pair of query and candidate ever leaves it.  Equal vectors
become one entry first, with the K + 1 smallest ids: no more of them can be in an answer.

Defined results: rows whose vector is null, empty, all zero, of another length than most
rows have, or with a null or non-finite component take no part, neither as query nor as
candidate, and neither do rows with a null id; rows that repeat an id count once, with
the vector that sorts first; ties go to the smaller id; an empty table gives no rows.
Input
columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.shared import bounded_batches, cut, lean

K = 10
TREES = 8
#: Rows that the trees are grown on, at most, and rows of them in a leaf, at most.
SAMPLE, LEAF = 20_000, 64
#: Vectors that the number of visited places is measured with, and the share of their true
#: neighbours that must be found.
ASKED, RECALL = 100, 0.97
#: Leaves that a task takes together, and entries of them that it holds at once.
LEAVES_TOGETHER, PART = 16, 16_384


@dataclass
class Forest:
    """Nodes of all trees; ``left`` and ``right`` are -1 at a leaf."""

    roots: list[int]
    normals: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while True:
                go = np.flatnonzero(self.left[node] >= 0)
                if not len(go):
                    break
                at = node[go]
                side = np.einsum("ij,ij->i", x[go], self.normals[at]) >= self.offsets[at]
                node[go] = np.where(side, self.right[at], self.left[at])
            out[:, t] = node
        return out

    def visit(self, query: np.ndarray, sizes: dict[int, int], enough: float) -> Iterator[int]:
        """Leaves for a query, best first, until they hold ``enough`` places."""
        margins = (self.normals @ query - self.offsets).tolist()
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        held = 0
        while queue and held < enough:
            far, node = heapq.heappop(queue)
            while self.left[node] >= 0:
                m = margins[node]
                near, other = (self.right, self.left) if m >= 0 else (self.left, self.right)
                heapq.heappush(queue, (max(far, abs(m)), int(other[node])))
                node = int(near[node])
            yield int(node)
            held += sizes.get(int(node), 0)


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    normals, offsets, left, right, roots = [], [], [], [], []

    def node(rows: np.ndarray) -> int:
        me = len(left)
        normals.append(np.zeros(sample.shape[1]))
        offsets.append(0.0)
        left.append(-1)
        right.append(-1)
        if len(rows) <= leaf:
            return me
        for _ in range(4):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            size = np.linalg.norm(normal)
            if size:
                normal /= size
                side = sample[rows] @ normal
                middle = float(np.median(side))
                upper = side >= middle
                if 0 < upper.sum() < len(rows):
                    normals[me], offsets[me] = normal, middle
                    low, high = node(rows[~upper]), node(rows[upper])
                    left[me], right[me] = low, high
                    break
        return me

    for _ in range(trees):
        roots.append(node(np.arange(len(sample))))
    return Forest(roots, np.array(normals), np.array(offsets), np.array(left), np.array(right))


def distinct_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec, ids, rep) of each distinct usable vector: its K + 1 smallest ids, and the least."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
    usable = (
        F.col("id").isNotNull()
        & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists("vec", lambda v: v != 0)
    )
    rows = rows.where(F.coalesce(usable, F.lit(False)))
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    rows = rows.where(F.size("vec") == F.coalesce(F.lit((most.collect() or [(0,)])[0][0]), F.lit(0)))
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("n", first).where(F.col("n") <= K + 1)
    return few.groupBy("vec").agg(
        F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("rep")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _fit(entries: DataFrame, trees: int) -> Forest:
    """Trees on the vectors whose ids hash lowest."""
    rows = entries.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toArrow()
    return grow(_matrix(rows.column(0).combine_chunks()), trees)


def _enough(forest: Forest, placed: DataFrame, sizes: dict[int, int]) -> int:
    """Places to visit, so that RECALL of the true neighbours of ASKED vectors are found."""
    asked = placed.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(ASKED).select("rep", "vec").toArrow()
    reps, q = asked.column(0).to_numpy(), _matrix(asked.column(1).combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, list[int]]]] = [[] for _ in reps]
        for batch in batches:
            x, own = _matrix(batch.column(1)), batch.column(0).to_numpy()
            far = (x**2).sum(1)[None, :] - 2 * q @ x.T  # less the asked vector's own square
            far[reps[:, None] == own[None, :]] = np.inf
            for j in range(len(reps)):
                for i in np.argpartition(far[j], min(K, len(own) - 1))[:K].tolist():
                    if far[j, i] < np.inf:
                        best[j].append((float(far[j, i]), int(own[i]), batch.column(2)[i].as_py()))
                best[j] = sorted(best[j])[:K]
        rows = [(j, *b) for j, some in enumerate(best) for b in some]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["asked", "far", "rep", "leaves"]
        )

    near = placed.select("rep", "vec", "leaves").mapInArrow(run, "asked long, far double, rep long, leaves array<long>")
    first = F.row_number().over(Window.partitionBy("asked").orderBy("far", "rep"))
    # no more than ASKED * K rows
    true: dict[int, list[set[int]]] = defaultdict(list)
    for r in near.withColumn("n", first).where(F.col("n") <= K).collect():
        true[r.asked].append(set(r.leaves))
    needed: list[int] = []
    for j, wanted in true.items():
        held = 0
        for leaf in forest.visit(q[j], sizes, math.inf):
            held += sizes.get(leaf, 0)
            met = [w for w in wanted if leaf in w]
            needed += [held] * len(met)
            wanted = [w for w in wanted if leaf not in w]
            if not wanted:
                break
    needed.sort()
    return needed[math.ceil(RECALL * len(needed)) - 1] if needed else 1


def nearest(df: DataFrame, key: str, vector: str, chosen, trees: int = TREES) -> DataFrame:
    """(query, rank, id, score): the K nearest found for every row that ``chosen`` holds for.

    ``chosen`` is a condition on ``id``.
    """
    spark = df.sparkSession
    shape = "query long, rank int, id long, score double"
    entries = cut(distinct_vectors(df, key, vector))
    total = entries.count()
    if not total:
        return spark.createDataFrame([], shape)
    forest = _fit(entries, trees)
    # a query's vector is one of the entries, also if its id is not among the first there
    asked = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).where(chosen)
    asked = asked.groupBy("id").agg(F.min("vec").alias("vec"))
    asked = cut(asked.join(entries.select("vec", "rep"), "vec").select("id", "rep"))
    queries = asked.select("rep").distinct().join(entries.select("rep", "vec"), "rep")
    queries = cut(queries)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.route(_matrix(batch.column(1)))
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * trees), pa.array(leaves.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["rep", "vec", "leaves"])

    kind = entries.schema["vec"].dataType.simpleString()
    routed = entries.select("rep", "vec").mapInArrow(
        route, f"rep long, vec {kind}, leaves array<long>"
    )
    placed = cut(routed)
    # no more leaves than the bounded sample gives
    counted = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()
    sizes = {leaf: n for leaf, n in counted}
    group = {leaf: i // LEAVES_TOGETHER for i, leaf in enumerate(sorted(sizes))}
    held: dict[int, int] = defaultdict(int)
    for leaf, n in sizes.items():
        held[group[leaf]] += n
    parts = {g: -(-n // PART) for g, n in held.items()}
    enough = _enough(forest, placed, sizes)

    def cell(rep: int, g: int) -> int:
        return (rep * 2654435761 >> 7) % parts[g]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry to its leaves' groups, in one part of each."""
        for batch in batches:
            rep, leaves = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows: list[tuple[int, int, int, list[int]]] = []
            for i, own in enumerate(leaves):
                by_group: dict[int, list[int]] = defaultdict(list)
                for leaf in own:
                    by_group[group[leaf]].append(leaf)
                rows += [(i, g, cell(rep[i], g), some) for g, some in by_group.items()]
            if rows:
                yield _dealt(batch, rows, 0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for low in range(0, len(x), 200):
                rows = []
                for i in range(low, min(low + 200, len(x))):
                    by_group: dict[int, list[int]] = defaultdict(list)
                    for leaf in forest.visit(x[i], sizes, enough):
                        if leaf in group:
                            by_group[group[leaf]].append(leaf)
                    rows += [(i, g, p, some) for g, some in by_group.items() for p in range(parts[g])]
                if rows:
                    yield _dealt(batch, rows, 1)

    shape_dealt = f"rep long, vec {kind}, grp long, part long, asks int, leaves array<long>"
    items = placed.mapInArrow(lean(deal), shape_dealt)
    asking = queries.select("rep", "vec").mapInArrow(lean(ask), shape_dealt)
    streams = items.unionByName(asking).repartition("grp", "part").sortWithinPartitions("grp", "part", "asks")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        x, reps, rows_of = np.zeros((0, 0)), np.zeros(0, np.int64), {}
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4)], 1)
            turns = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(1)])[: len(place)])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for low, high in zip(turns.tolist(), [*turns[1:].tolist(), len(place)], strict=True):
                grp, part, asks = place[low].tolist()
                some = batch.slice(low, high - low)
                if now != (grp, part):
                    now, held, rows_of = (grp, part), [], None
                if not asks:
                    held.append(some)
                    continue
                if rows_of is None:  # the part's entries are all there
                    rows_of = defaultdict(list)
                    x = np.concatenate([_matrix(b.column(1)) for b in held]) if held else np.zeros((0, 0))
                    reps = np.concatenate([b.column(0).to_numpy() for b in held] or [np.zeros(0, np.int64)])
                    owns = (own for b in held for own in b.column(5).to_pylist())
                    for i, own in enumerate(owns):
                        for leaf in own:
                            rows_of[leaf].append(i)
                    rows_of = {leaf: np.array(r) for leaf, r in rows_of.items()}
                    held = []
                q, askers = _matrix(some.column(1)), some.column(0).to_pylist()
                for j, own in enumerate(some.column(5).to_pylist()):
                    rows = [rows_of[f] for f in own if f in rows_of]
                    if not rows:
                        continue
                    rows = np.unique(np.concatenate(rows))
                    d = np.sqrt(((x[rows] - q[j]) ** 2).sum(1))
                    best = np.lexsort((reps[rows], d))[: K + 1]
                    out.append((np.full(len(best), askers[j]), reps[rows][best], d[best]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["asker", "rep", "score"]
            )

    dealt = streams.select("rep", "vec", "grp", "part", "asks", "leaves")
    found = dealt.mapInArrow(lean(rank), "asker long, rep long, score double")
    # the same entry comes from several trees, with the same score
    found = found.groupBy("asker", "rep").agg(F.min("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("asker").orderBy("score", "rep"))
    found = found.withColumn("n", order).where(F.col("n") <= K + 1)
    near = (
        found.join(entries.select("rep", "ids"), "rep")
        .select("asker", "score", F.explode("ids").alias("id"))
        .groupBy("asker")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, K + 1).alias("near"))
    )
    each = asked.join(near.withColumnRenamed("asker", "rep"), "rep").select(
        F.col("id").alias("query"),
        F.posexplode(F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, K)).alias("at", "hit"),
    )
    return each.select("query", (F.col("at") + 1).alias("rank"), "hit.id", "hit.score")


def _dealt(batch: pa.RecordBatch, rows: list[tuple[int, int, int, list[int]]], asks: int) -> pa.RecordBatch:
    at, groups, part, leaves = zip(*rows, strict=True)
    taken = batch.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            taken.column(0),
            taken.column(1),
            pa.array(groups, pa.int64()),
            pa.array(part, pa.int64()),
            pa.array([asks] * len(at), pa.int32()),
            pa.array(leaves, pa.list_(pa.int64())),
        ],
        names=["rep", "vec", "grp", "part", "asks", "leaves"],
    )


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = nearest(rows, "vec_id", "embedding", F.col("id") % 100 == 0)
    return out.select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"
    )
