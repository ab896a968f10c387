"""Near-duplicate documents by DartMinHash signatures, banded joins and exact checks.

A document is its set of five-word shingles, each of weight 1 however often it occurs, so
that signatures estimate the very similarity that decides the link.  Darts fall on every
shingle as a Poisson process over (weight, rank), fixed by the shingle's hash alone: the
k-th dart's rank follows the one before by an exponential gap.  A dart within the
shingle's weight counts for the coordinate that its hash names, and each coordinate keeps
its earliest.  Ranks are followed only as far as the document's total weight needs
for every coordinate to be hit, so the work grows with shingles plus coordinates, not
with their product.  Equal coordinates estimate the Jaccard similarity.

Documents that agree on every coordinate of a band are candidates.  The link itself is
exact: the Jaccard similarity of the two shingle sets is SIMILARITY or more.

Groups of any size:

1. Documents with the same shingle set become one representative first.
2. In a band's bucket every member is compared with the bucket's least one only.  Links
   that hold merge their documents into classes.
3. Buckets whose members are of more than one class are gone through again, for pairs of
   different classes only.  A bucket of up to LARGE members gives these pairs as rows.  In
   a larger one the members outside its main class (strays) are compared with all members
   of all buckets that have this main class: in blocks of BLOCK by BLOCK documents inside a
   task, which gives only the links that hold.

So the members of a large group of near copies meet their least one and the strays, not
each other, no pair of them becomes a row, and no link that the bands propose is lost.  The
facts of buckets with a large share of all rows are broadcast, so that their members stay in
the tasks that have them; the text of a document that many are compared with goes to several
tasks.  Classes are the connected components, found by joins with the lineage cut between
rounds.

Defined results: a null or empty text, or one without a word, is its own class; so is
every row with a null ``doc_id`` in ``classes``, and ``dedup`` keeps it; a text of fewer
than five words is one shingle; rows that repeat an id count once in ``classes``, and
``dedup`` keeps the one with the least text that isn't null, then the one
whose other columns hash lowest; an empty table gives no rows; a very long text is read whole.  Other columns of the
input are ignored by ``classes`` and passed through by ``dedup``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.shared import bounded_batches, cut, join_facts, lean
from chronoframe.llm.vocab import Memory

WORDS = 5
SIMILARITY = 0.8
#: A pair at the similarity misses every band with probability (1 - 0.8^5)^24 < 0.0001.
BANDS, ROWS = 24, 5
#: Bytes of words that a worker remembers the hashes of, in each generation.
REMEMBERED = 16 << 20
#: Shingles that are signed together.
AT_ONCE = 100_000
#: Buckets with more representatives are compared in blocks of so many documents.
LARGE, BLOCK = 32, 256

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _word(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Shingler:
    """Hashes of the shingles of a text."""

    def __init__(self, words: int = WORDS):
        self.size = words
        self.hashes = Memory(_word, REMEMBERED, 0)

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes in order."""
        tokens = (text or "").lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, tokens), np.uint64, len(tokens))
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, len(h) if len(h) < self.size else self.size, np.uint64)
        for k in range(min(self.size, len(h))):
            out = mix(out * STEP + h[k : k + n])
        return np.unique(out)


def darts(sets: list[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
    """For each weighted set (elements, weights), the element whose dart comes first in each
    of ``count`` coordinates.

    Weight is cut into cells [0, 1), [1, 2), [2, 4), ...; each (element, cell) has its own
    Poisson process of darts, so an element's darts don't depend on the rest of the set.
    Ranks are compared as 32-bit floats; of equal ones the smaller element counts.
    """
    out = np.zeros((len(sets), count), np.uint64)
    todo = np.arange(len(sets))
    totals = np.array([w.sum() for _, w in sets])
    reach = count * (math.log(count) + 2) / totals
    while len(todo):
        sizes = [len(sets[i][0]) for i in todo.tolist()]
        owner = np.repeat(np.arange(len(todo)), sizes)
        element = np.concatenate([sets[i][0] for i in todo.tolist()])
        weight = np.concatenate([sets[i][1] for i in todo.tolist()])
        far = reach[todo][owner]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low, high, cell = 0.0, 1.0, 1
        while True:
            inside = weight > low
            if not inside.any():
                break
            if inside.all():
                e, w, o, f = element, weight, owner, far
            else:
                e, w, o, f = element[inside], weight[inside], owner[inside], far[inside]
            width = high - low
            seed = mix(e + np.uint64(cell * int(STEP) % 2**64))
            at = np.zeros(len(e))
            while len(e):
                seed = mix(seed + STEP)
                at = at - np.log(((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
                go = np.flatnonzero(at <= f)
                e, w, o, f, seed, at = e[go], w[go], o[go], f[go], seed[go], at[go]
                place = mix(seed ^ MIX2)
                height = low + width * ((place >> np.uint64(40)).astype(float) + 0.5) * 2.0**-24
                hit = np.flatnonzero(height < w)
                coord = (place[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(count)
                key = o[hit].astype(np.uint64) * np.uint64(count) + coord
                rank = at[hit].astype(np.float32).view(np.uint32).astype(np.uint64)
                found.append((key << np.uint64(32) | rank, e[hit]))
            low, high, cell = high, high * 2, cell + 1
        placed, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(placed, kind="stable")
        placed, ids = placed[order], ids[order]
        key = placed >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for i in np.flatnonzero(placed[1:] == placed[:-1]).tolist():  # hardly ever
            ids[i] = ids[i + 1] = min(ids[i], ids[i + 1])
        full = np.bincount((key[first] // np.uint64(count)).astype(np.int64), minlength=len(todo)) == count
        keep = full[(key[first] // np.uint64(count)).astype(np.int64)]
        out[todo[full]] = ids[first[keep]].reshape(-1, count)
        todo = todo[~full]
        reach[todo] *= 2
    return out


def signature(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each set."""
    coords = darts([(e, np.ones(len(e))) for e in sets], bands * rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands))
    for row in np.moveaxis(coords.reshape(-1, bands, rows), 2, 0):
        out = mix(out * STEP + row)
    return np.ascontiguousarray(out).view(np.int64)


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, same, bands) of each document with words; ``same`` names its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            held: list[tuple[int, bytes]] = []
            sets: list[np.ndarray] = []
            seen: dict[bytes, int] = {}
            size = 0
            for i, (doc, words) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1
            ):
                elements = shingler.shingles(words.as_py())
                if len(elements):
                    same = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
                    held.append((doc, same))
                    if same not in seen:
                        seen[same] = len(sets)
                        sets.append(elements)
                        size += len(elements)
                if held and (size >= AT_ONCE or i == batch.num_rows):
                    bands = signature(sets)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d for d, _ in held], pa.int64()),
                            pa.array([n for _, n in held], pa.binary()),
                            pa.array([bands[seen[n]] for _, n in held], pa.list_(pa.int64())),
                        ],
                        names=["doc", "same", "bands"],
                    )
                    held, sets, seen, size = [], [], {}, 0

    rows = docs.select(F.col(key).cast("long").alias("doc"), text).where(F.col("doc").isNotNull())
    return rows.mapInArrow(lean(run), "doc long, same binary, bands array<long>")


def _texts(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, text) of the ids ``doc`` of ``wanted``; an id that repeats stands for one text,
    the least of them."""
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    # ids are hashed, so that texts need no sorting
    texts = texts.join(wanted.hint("shuffle_hash"), "doc", "left_semi")
    return cut(texts.groupBy("doc").agg(F.min("text").alias("text")))


def verify(pairs: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets are similar enough.

    The texts of all b of an a follow a's own in one sorted stream; where there are many, a's
    text heads several streams."""
    pairs = cut(pairs.select("a", "b"))
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), text, key)
    heads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    heads = cut(heads)
    members = join_facts(pairs, heads, ["a"], "n")
    members = members.select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    members = members.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "part", "b", "text")
    own = heads.join(texts.withColumnRenamed("doc", "a"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        x = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                y = shingler.shingles(words.as_py())
                if b is None:  # the head of a stream
                    x = y
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9:
                    found.append((a, b))
            columns = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    streams = members.unionByName(own).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return streams.select("a", "b", "text").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc, root) for every document of ``edges`` (a, b): the least of its component.

    Large and small stars by turns: each vertex links its larger neighbours, then all its
    smaller ones, to the least it knows, until nothing changes.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("m").alias("a"), "b")
            .where("a < b")
            .distinct()
        )
        # small star: b's smaller neighbours and b itself go to the least of them
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(small_least, "b")
            .select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
            .where("a < b")
            .distinct()
        )
        new = cut(small.select("a", "b"))
        # both sets are distinct: equal sizes and no row of one outside the other
        if new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty():
            roots = new.select(F.col("b").alias("doc"), F.col("a").alias("root"))
            return roots.union(new.select(F.col("a").alias("doc"), F.col("a").alias("root")).distinct())
        now = new


def _with_roots(df: DataFrame, roots: DataFrame, doc: str, root: str) -> DataFrame:
    named = roots.select(F.col("doc").alias(doc), F.col("root").alias("__root"))
    return df.join(named, doc, "left").withColumn(root, F.coalesce("__root", doc)).drop("__root")


def _mixed(buckets: DataFrame, roots: DataFrame, *by: str) -> DataFrame:
    """Members, with roots, of the buckets that hold more than one class, and ``n`` of each."""
    rooted = cut(_with_roots(buckets, roots, "rep", "root"))
    several = rooted.groupBy(*by).agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    several = cut(several.where("lo < hi").select(*by, "n", F.col("n").alias("weight")))
    return join_facts(rooted, several, list(by), "weight")


def _across(members: DataFrame, *by: str) -> DataFrame:
    """Pairs of members of one bucket that are of different classes."""
    other = members.select(*by, F.col("rep").alias("b"), F.col("root").alias("root_b"))
    pairs = members.select(*by, F.col("rep").alias("a"), "root").join(other, list(by))
    return pairs.where("a < b AND root <> root_b").select("a", "b").distinct()


def _overlap(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``x`` with each of ``y``."""

    def table(sets: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(shared)), np.float32)
        for row, s in zip(out, sets, strict=True):
            at = np.searchsorted(shared, s)
            at[at == len(shared)] = 0
            row[at[shared[at] == s]] = 1
        return out

    shared = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    if not len(shared):
        return np.zeros((len(x), len(y)), np.float32)
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(shared), 1 << 14):
        part = shared[low : low + (1 << 14)]
        out += table(x, part) @ table(y, part).T
    return out


def _links_of_strays(large: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """The links (a, b) between documents of different classes that share one of ``large``
    buckets (band, hash, rep, root)."""
    sizes = large.groupBy("band", "hash", "root").agg(F.count(F.lit(1)).alias("n"))
    main = cut(sizes.groupBy("band", "hash").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n")))
    rows = join_facts(large, main, ["band", "hash"], "n").select("main", "rep", "root").distinct()
    rows = cut(rows.withColumn("stray", F.col("main") != F.col("root")))
    counts = rows.groupBy("main").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"),
        F.ceil(F.count_if("stray") / BLOCK).alias("stray_blocks"),
    )
    texts = _texts(docs, rows.select(F.col("rep").alias("doc")).distinct(), text, key)
    rows = rows.join(counts, "main").join(texts.withColumnRenamed("doc", "rep"), "rep")
    shape = "main long, stray_block int, block int, rep long, root long, shingles binary"

    def deal(strays: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler()
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    place = int(mix(np.array([r["rep"]], np.int64).view(np.uint64))[0])
                    own = shingler.shingles(r["text"]).tobytes()
                    n, m = r["stray_blocks"], r["blocks"]
                    cells = [(place % n, b) for b in range(m)] if strays else [(b, place % m) for b in range(n)]
                    out += [(r["main"], s, b, r["rep"], r["root"], own) for s, b in cells]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=["main", "stray_block", "block", "rep", "root", "shingles"],
                    )

        return run

    cell = ["main", "stray_block", "block"]
    columns = ["main", "rep", "root", "blocks", "stray_blocks", "text"]
    strays = rows.where("stray").select(*columns).mapInArrow(lean(deal(True)), shape)
    every = rows.select(*columns).mapInArrow(lean(deal(False)), shape)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t.column("rep").to_numpy() for t in (left, right))
        found: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(a) and len(b):
            x, y = ([np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()] for t in (left, right))
            both = _overlap(x, y)
            total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y]) - both
            apart = left.column("root").to_numpy()[:, None] != right.column("root").to_numpy()
            i, j = np.nonzero(apart & (both >= SIMILARITY * total - 1e-6))
            found = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
        return pa.table({"a": found[0], "b": found[1]})

    links = strays.groupBy(*cell).cogroup(every.groupBy(*cell)).applyInArrow(compare, "a long, b long")
    return links.distinct()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, class) of every distinct non-null id; a class is named by its least id."""
    sigs = cut(signatures(docs, text, key))
    reps = cut(
        sigs.groupBy("same").agg(F.min("doc").alias("rep"), F.min_by("bands", "doc").alias("bands"))
    )
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = buckets.groupBy("band", "hash").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.where("n > 1"))
    buckets = cut(join_facts(buckets, shared, ["band", "hash"], "n"))

    # every member of a bucket with the least one
    tried = cut(buckets.where("a < rep").select("a", F.col("rep").alias("b")).distinct())
    buckets = buckets.drop("a")
    links = cut(verify(tried, docs, text, key))
    roots = cut(components(links))

    mixed = cut(_mixed(buckets, roots, "band", "hash"))
    more = _across(mixed.where(F.col("n") <= LARGE), "band", "hash")
    more = cut(more.join(tried, ["a", "b"], "left_anti"))
    found = links.limit(0) if more.isEmpty() else verify(more, docs, text, key)
    large = mixed.where(F.col("n") > LARGE)
    if not large.isEmpty():
        found = found.union(_links_of_strays(large.drop("n"), docs, text, key))
    found = cut(found)
    if not found.isEmpty():
        roots = cut(components(links.union(found)))

    # copies of a set follow their representative
    copies = sigs.select("doc", "same").distinct().join(reps.select("same", "rep"), "same")
    named = _with_roots(copies, roots, "rep", "root")
    # an id with several texts takes the least class of them
    named = named.groupBy("doc").agg(F.min("root").alias("class"))
    ids = docs.select(F.col(key).cast("long").alias("doc")).where("doc IS NOT NULL").distinct()
    return ids.join(named, "doc", "left").select("doc", F.coalesce("class", "doc").alias("class"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: the least id's; of its rows, the one with the least
    text, and of those the one whose other columns hash lowest."""
    kept = classes(docs, text, key).where("doc = class").select(F.col("doc").alias(key))
    found = docs.where(F.col(key).isNotNull()).join(kept.hint("shuffle_hash"), key, "left_semi").select(*docs.columns)
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = cut(repeated.select(key))
    if not repeated.isEmpty():
        rest = [c for c in docs.columns if c not in (key, text)]
        order = F.struct(F.col(text).isNull(), F.col(text), F.xxhash64(*rest) if rest else F.lit(0))
        least = found.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
        found = found.join(repeated, key, "left_anti").select(*docs.columns).union(least.select("row.*"))
    return found.union(docs.where(F.col(key).isNull()))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = classes(docs)
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("class").alias("class_id"),
        (F.col("doc") == F.col("class")).alias("kept"),
    )
