"""Hierarchical best-fit packing of token pieces into sequences.

Each partition of pieces is packed by itself, longest piece first, into the bin that it
fits best.  Bins that are nearly full are done.  All pieces in the others, however many,
are packed anew over all partitions.  Best fit sees nothing of a piece but its length, and
there are no more than ``capacity`` lengths: how many pieces have each is all that is sent
up, and bins that are filled alike are planned as one range.  So what the root holds stays
bounded and gives the bins that best fit gives to all these pieces at once.

A piece is known by its length and its place among those of that length: its place in its
partition and the number in the partitions before.  That gives its bin in the plan; no
piece is moved but for the join on that number.

Defined results: a null or empty text is the end id alone, one piece of length 1; a null
``doc_id`` is kept; repeated rows are packed each by itself; an empty table gives no
rows.  Input columns beyond those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.shared import SMALL, bounded_batches, cut, lean
from chronoframe.llm.vocab import vocabulary

CAPACITY = 2048
END_ID = 0
#: Share of a bin that may stay empty when its partition is done with it.
SLACK = 0.002
#: Pieces of a leaf of the tree: a partition's pieces are packed in runs of so many, which
#: bounds what a task holds.  Underfull bins of all leaves meet above, so that the place of a
#: run's end costs nothing but the order in which nearly full bins are found.
LEAF = 500_000
#: Bytes of words that a worker remembers the ids of, in each generation: beside what other
#: steps have left in the JVM and the workers, and in a session that does nothing else.
REMEMBERED, ALONE = 32 << 20, 112 << 20


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin: longest first, best fit.

    The rest of every open bin is a bit of one integer, so the smallest rest that is large
    enough is its lowest set bit from that length on.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_rest: dict[int, list[int]] = {}
    rests = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rests >> n
        if fit:
            rest = (fit & -fit).bit_length() - 1 + n
            same = by_rest[rest]
            b = same.pop()
            if not same:
                rests ^= 1 << rest
        else:
            b, rest = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if rest > n:
            same = by_rest.setdefault(rest - n, [])
            if not same:
                rests |= 1 << (rest - n)
            same.append(b)
    return bins, offsets, np.array(fills, np.int64)


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit of so many pieces of each length: rows (length, first piece, first bin, pieces
    for each bin, offset), by length and piece, and the number of bins.

    The pieces of a length from a row's first one on fill its bins in turn.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    by_rest: dict[int, list[tuple[int, int]]] = {}
    rests = used = 0

    def put(rest: int, first: int, bins: int) -> None:
        nonlocal rests
        if rest and bins:
            rests |= 1 << rest
            by_rest.setdefault(rest, []).append((first, bins))

    for n in sorted(counts, reverse=True):
        piece, left = 0, counts[n]
        while left:
            fit = rests >> n
            if fit:
                rest = (fit & -fit).bit_length() - 1 + n
                same = by_rest[rest]
                first, bins = same.pop()
                if not same:
                    rests ^= 1 << rest
            else:
                rest, first, bins = capacity, used, -(-left // (capacity // n))
                used += bins
            each = min(rest // n, left)
            full = min(bins, left // each)
            plan.append((n, piece, first, each, capacity - rest))
            put(rest - each * n, first, full)
            put(rest, first + full, bins - full)
            piece, left = piece + full * each, left - full * each
    return np.array(sorted(plan), np.int64).reshape(-1, 5), used


Batches = Iterator[pa.RecordBatch]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [f.split()[0] for f in PIECES.split(", ")]
#: A piece's bin and place in it, its partition, whether the bin is underfull, and if so the
#: piece's place among those of its partition and length.
LOCAL = "bin long, offset long, node long, open boolean, place long"


def _cutter(path: str, capacity: int, remembered: int) -> Callable[[Batches], Batches]:
    """What a task does to (doc_id, text) for the columns PIECES."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Batches) -> Batches:
        encode = vocabulary(path, remembered).encode
        for batch in batches:
            rows = []
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(words.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=NAMES,
                )

    return run


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", remembered: int = REMEMBERED
) -> DataFrame:
    """Token pieces of whole texts, each with the end id after it; only longer ones are cut.

    ``remembered`` bounds the words that a worker holds, not the result."""
    run = _cutter(path, capacity, remembered)
    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(lean(run), PIECES)


def _packer(names: list[str], capacity: int) -> Callable[[Batches], Batches]:
    """What a task does to pack its pieces (with the columns ``names``) by themselves, for
    the columns LOCAL beside those."""
    most = LEAF

    def run(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        used = 0
        seen = np.zeros(capacity + 1, np.int64)

        def packed(table: pa.Table) -> Batches:
            nonlocal used, seen
            lengths = table.column("length").to_numpy()
            bins, offsets, fills = best_fit(lengths, capacity)
            left = (fills < capacity - int(capacity * SLACK))[bins]
            at = np.flatnonzero(left)
            at = at[np.argsort(lengths[at], kind="stable")]
            here = np.bincount(lengths[at], minlength=capacity + 1)
            place = np.zeros(len(bins), np.int64)
            place[at] = np.arange(len(at)) + (seen - np.cumsum(here) + here)[lengths[at]]
            seen += here
            ids = (np.int64(part) << 32) + used + bins
            used += len(fills)
            node = pa.array(np.full(len(bins), part, np.int64))
            out = pa.Table.from_arrays(
                [*table.columns, pa.array(ids), pa.array(offsets), node, pa.array(left), pa.array(place)],
                names=[*names, "bin", "offset", "node", "open", "place"],
            )
            yield from out.to_batches(max_chunksize=10_000)

        block: list[pa.RecordBatch] = []
        for batch in batches:
            block.append(batch)
            if sum(b.num_rows for b in block) >= most:
                yield from packed(pa.Table.from_batches(block))
                block = []
        if block:
            yield from packed(pa.Table.from_batches(block))

    return run


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _planned(rows: DataFrame, plan: np.ndarray, names: list[str]) -> DataFrame:
    """``rows`` (with ``length`` and ``place`` among all of that length) with ``bin`` and
    ``offset`` of ``plan``."""
    keys = plan[:, 0] << 48 | plan[:, 1]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            length, place = (batch.column(c).to_numpy() for c in ("length", "place"))
            length = length.astype(np.int64)
            row = np.searchsorted(keys, length << 48 | place, side="right") - 1
            _, piece, first, each, offset = plan[row].T
            nth = place - piece
            ids = (1 << 62) + first + nth // each
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(ids), pa.array(offset + nth % each * length)],
                names=[*names, "bin", "offset"],
            )

    return rows.mapInArrow(lean(run), f"{_fields(rows.select(*names))}, bin long, offset long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    names = items.columns
    run = _packer(names, capacity)
    return _repacked(items.mapInArrow(lean(run), f"{_fields(items)}, {LOCAL}"), names, capacity)


def pack_texts(
    docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", remembered: int = REMEMBERED
) -> DataFrame:
    """``pack`` of ``pieces``, by one Python worker of a task: two in a row take turns, and each
    would come to remember the words."""
    cutter, packer = _cutter(path, capacity, remembered), _packer(NAMES, capacity)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), text)
    return _repacked(texts.mapInArrow(lean(lambda batches: packer(cutter(batches))), f"{PIECES}, {LOCAL}"), NAMES, capacity)


def _repacked(local: DataFrame, names: list[str], capacity: int) -> DataFrame:
    """``local``, packed within each partition, with the pieces of underfull bins packed anew."""
    placed = cut(local)
    left = placed.where("open").select(*names, "node", "place")
    counts = cut(left.groupBy("node", "length").agg(F.count(F.lit(1)).alias("n")))
    # at most ``capacity`` rows
    total = {n: k for n, k in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan, _ = best_fit_counts(total, capacity)
    before = Window.partitionBy("length").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("node", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    left = left.join(before, ["node", "length"]).withColumn("place", F.col("place") + F.col("before"))
    out = placed.where("NOT open").select(*names, "bin", "offset").union(_planned(left, plan, names))
    return out.select(*names, F.col("bin").alias("sequence_id"), "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark, SMALL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=ALONE)
