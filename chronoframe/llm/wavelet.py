"""Token ids in wavelet matrices: one compressed file for each shard of documents.

Documents are range-partitioned by id and sorted, so shards follow each other in
ascending order.  A shard's file holds the number of ids that each document has and the
ids themselves as a wavelet matrix: bit-planes from the highest bit down, the ids of each
plane stably parted by that bit.  Planes are compressed in chunks of CHUNK bits, and the
file's directory has the place and the ones of every chunk.  So a reader of a few ids reads
the directory and one chunk of each plane.  From the file alone it answers: the id at a
place, how often an id occurs before a place, and where its n-th occurrence is.

Files go to the folder that the cluster shares, each under a name of its own; the rows of
``write`` name those that count.  A task that runs again writes new files, and nothing reads
those of the one that was lost.

Defined results: a null or empty text is the end id alone; a null id sorts first; rows that
repeat an id are written each, in order of their texts' hashes, then texts; an empty table
gives no shard and no rows; a very long text is one document, in a shard as long as that
needs.  Input columns beyond those named are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.shared import bounded_batches, cut, lean, make_dir, new_dir, release
from chronoframe.llm.vocab import vocabulary

MAGIC = b"WVM2"
HEAD = "<4sQQBI"
END_ID = 0
#: Ids after which a shard ends, at the next document: about 2 MB of compressed planes.
SHARD_IDS = 2_000_000
WORD = 64
#: Bits of a plane that are compressed together.
CHUNK = 1 << 17
#: Rows that a scan decodes at once: texts are long, and their buffers are doubled as they grow.
SCAN = "spark.sql.parquet.columnarReaderBatchSize", "512"
#: Values that are parted at once: their places stay in the processor's cache.
STEP = 1 << 16
#: Writing tasks for each that takes up their rows; files that a reading task takes where
#: there are more than LEAST_TASKS.
PARTS, FILES, LEAST_TASKS = 16, 16, 12
#: Bytes of words that a worker remembers the ids of, in each generation.
REMEMBERED = 112 << 20


class Plane:
    """A bit-plane in chunks, with the ones before each; chunks are fetched when needed."""

    def __init__(self, ones: np.ndarray, fetch: Callable[[int], np.ndarray]):
        self.before = np.zeros(len(ones) + 1, np.int64)
        np.cumsum(ones, out=self.before[1:])
        self.fetch = fetch
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.all: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, words: np.ndarray) -> Plane:
        step = CHUNK // WORD
        parts = [words[i : i + step] for i in range(0, len(words), step)]
        ones = np.array([int(np.bitwise_count(p).sum()) for p in parts], np.int64)
        return cls(ones, parts.__getitem__)

    @property
    def chunks(self) -> int:
        return len(self.before) - 1

    def words(self) -> np.ndarray:
        """All words, which later ranks are taken from."""
        if self.all is None:
            words = np.concatenate([self.fetch(i) for i in range(self.chunks)] or [np.zeros(0, np.uint64)])
            ranks = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ranks[1:])
            self.all = words, ranks
        return self.all[0]

    def chunk(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of a chunk, and the ones in it before each word."""
        if i not in self.held:
            words = self.fetch(i)
            ranks = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ranks[1:])
            self.held[i] = words, ranks
        return self.held[i]

    def rank1(self, at) -> np.ndarray:
        """Ones before each place."""
        at = np.asarray(at, np.int64)
        flat = at.ravel()
        if self.all is not None:
            return self._ranks(*self.all, flat).reshape(at.shape)
        which = flat // CHUNK
        out = self.before[np.minimum(which, self.chunks)].copy()
        for i in np.unique(which[which < self.chunks]).tolist():
            own = np.flatnonzero(which == i)
            out[own] += self._ranks(*self.chunk(i), flat[own] - i * CHUNK)
        return out.reshape(at.shape)

    @staticmethod
    def _ranks(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(len(at), np.int64)
        word, bit = at >> 6, at & 63
        mask = (np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1)
        return ranks[word] + np.bitwise_count(words[np.minimum(word, len(words) - 1)] & mask)

    def select(self, one: int, n: int) -> int:
        """Place of the ``n``-th (from 0) bit that equals ``one``."""
        counts = self.before if one else np.arange(len(self.before)) * CHUNK - self.before
        i = min(int(np.searchsorted(counts, n, side="right")) - 1, self.chunks - 1)
        words, ranks = self.chunk(i)
        inner = ranks if one else np.arange(len(ranks)) * WORD - ranks
        left = n - int(counts[i])
        word = int(np.searchsorted(inner, left, side="right")) - 1
        bits = np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little")
        return i * CHUNK + word * WORD + int(np.flatnonzero(bits == one)[left - int(inner[word])])


class WaveletMatrix:
    """Bit-planes of a sequence of unsigned integers below ``2 ** bits``."""

    def __init__(self, size: int, planes: list[Plane]):
        self.size, self.planes, self.bits = size, planes, len(planes)
        self.zeros = [size - int(p.before[-1]) for p in planes]

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        now = values.astype(np.uint16 if bits <= 16 else np.uint32)
        next_ = np.empty_like(now)
        planes = []
        for level in range(bits - 1, -1, -1):
            bit = (now & (1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros(-(-len(packed) // 8) * 8, np.uint8)
            padded[: len(packed)] = packed
            planes.append(Plane.of(padded.view("<u8")))
            zero, one = 0, len(values) - int(planes[-1].before[-1])
            for at in range(0, len(values), STEP):
                on, own = bit[at : at + STEP], now[at : at + STEP]
                ones, zeros = np.flatnonzero(on), np.flatnonzero(~on)
                np.take(own, zeros, out=next_[zero : zero + len(zeros)], mode="clip")
                np.take(own, ones, out=next_[one : one + len(ones)], mode="clip")
                zero, one = zero + len(zeros), one + len(ones)
            now, next_ = next_, now
        return cls(len(values), planes)

    def rank1(self, level: int, at):
        return self.planes[level].rank1(at)

    def select(self, level: int, one: int, n: int) -> int:
        return self.planes[level].select(one, n)

    def access(self, at) -> np.ndarray:
        """The value at each place."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.int64)
        for level in range(self.bits):
            ones = self.rank1(level, at)
            bit = self.rank1(level, at + 1) - ones
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, value, end) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences before ``end`` stand below the last plane."""
        value, high = np.broadcast_arrays(np.asarray(value, np.int64), np.asarray(end, np.int64))
        high = np.where(value >> self.bits, 0, high)
        low = np.zeros_like(high)
        for level in range(self.bits):
            a, b = self.rank1(level, low), self.rank1(level, high)
            one = (value >> (self.bits - 1 - level) & 1) == 1
            zeros = self.zeros[level]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return low, high

    def count(self, value, end=None) -> np.ndarray:
        """How often each ``value`` occurs before ``end``."""
        low, high = self._range(value, self.size if end is None else end)
        return high - low

    def find(self, value: int, n: int) -> int:
        """Place of the ``n``-th occurrence, from 0; -1 if there are fewer."""
        low, high = map(int, self._range(value, self.size))
        if value >> self.bits or n >= high - low:
            return -1
        at = low + n
        for level in range(self.bits - 1, -1, -1):
            if value >> (self.bits - 1 - level) & 1:
                at = self.select(level, 1, at - self.zeros[level])
            else:
                at = self.select(level, 0, at)
        return at

    def values(self) -> np.ndarray:
        """All values in order: each plane undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now, before = np.zeros(self.size, kind), np.empty(self.size, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(
                self.planes[level].words().view(np.uint8), count=self.size, bitorder="little"
            ).view(bool)
            zero, one = 0, self.zeros[level]
            now[one:] |= kind(1 << (self.bits - 1 - level))
            for at in range(0, self.size, STEP):
                on, own = bit[at : at + STEP], before[at : at + STEP]
                # places by number: several times as fast as by mask
                ones, zeros = np.flatnonzero(on), np.flatnonzero(~on)
                own[zeros], own[ones] = now[zero : zero + len(zeros)], now[one : one + len(ones)]
                zero, one = zero + len(zeros), one + len(ones)
            now, before = before, now
        return now


def dump(values: np.ndarray, lengths: np.ndarray, keys: list[int | None]) -> bytes:
    """A shard's file: header, directory of chunks, compressed document table and chunks."""
    matrix = WaveletMatrix.build(values)
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([k is not None for k in keys], np.uint8)
    table = np.array([k or 0 for k in keys], "<i8").tobytes() + known.tobytes()
    table = pack(table + lengths.astype("<u8").tobytes())
    chunks = [pack(p.fetch(i).tobytes()) for p in matrix.planes for i in range(p.chunks)]
    ones = np.concatenate([np.diff(p.before) for p in matrix.planes])
    places = np.array([np.array([len(c) for c in chunks], np.int64), ones]).T.astype("<u4").tobytes()
    return b"".join([struct.pack(HEAD, MAGIC, len(keys), len(values), matrix.bits, len(table)), places, table, *chunks])


class Shard:
    """A shard's file, read by ``read(offset, bytes)``: what is asked for and no more."""

    def __init__(self, read: Callable[[int, int], bytes]):
        at = struct.calcsize(HEAD)
        magic, self.docs, size, bits, self._table = struct.unpack(HEAD, read(0, at))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        each = -(-size // CHUNK)
        places = np.frombuffer(read(at, 8 * each * bits), "<u4").reshape(bits, each, 2)
        self._at = at + 8 * each * bits
        ends = self._at + self._table + np.cumsum(places[:, :, 0], dtype=np.int64).reshape(bits, each)
        self.read = read
        unpack = zstandard.ZstdDecompressor().decompress

        def plane(level: int) -> Plane:
            def fetch(i: int) -> np.ndarray:
                length = int(places[level, i, 0])
                return np.frombuffer(unpack(read(int(ends[level, i]) - length, length)), "<u8")

            return Plane(places[level, :, 1], fetch)

        self.matrix = WaveletMatrix(size, [plane(level) for level in range(bits)])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and lengths of the documents, in order."""
        raw = zstandard.ZstdDecompressor().decompress(self.read(self._at, self._table))
        keys = np.frombuffer(raw, "<i8", self.docs).tolist()
        known = np.frombuffer(raw, np.uint8, self.docs, 8 * self.docs)
        lengths = np.frombuffer(raw, "<u8", self.docs, 9 * self.docs).astype(np.int64)
        return [k if ok else None for k, ok in zip(keys, known, strict=True)], lengths


def load(data: bytes) -> Shard:
    return Shard(lambda at, n: data[at : at + n])


def opened(folder: str, name: str) -> Shard:
    """A shard's file in ``folder``, of which only what is asked for is read."""
    where, path = fs.FileSystem.from_uri(folder)
    file = where.open_input_file(f"{path}/{name}.wvm")

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return Shard(read)


def _save(folder: str, name: str, data: bytes) -> None:
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{name}.wvm") as out:
        out.write(data)


def write(
    docs: DataFrame,
    path: str,
    folder: str,
    text: str = "text",
    key: str = "doc_id",
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Writes the shards; returns (part, shard, name, docs, ids) of each.

    ``path`` names the vocabulary file, ``folder`` a URL that all machines reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path, REMEMBERED).encode_all
        end = np.array([END_ID], "<u4").tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            values = np.frombuffer(b"".join(ids), "<u4")
            name = f"{part:08d}-{shard:08d}-{uuid.uuid4().hex}"
            _save(folder, name, dump(values, lengths, keys))
            row = ([part], [shard], [name], [len(keys)], [len(values)])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "shard", "name", "docs", "ids"]
            )

        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                keys.append(k)
                ids.append(own + end)
                held += len(ids[-1]) // 4
                if held >= shard_ids:
                    yield flush()
                    keys, ids, held, shard = [], [], 0, shard + 1
        if keys:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())
    # rows that repeat an id are parted too, in an order that their texts define
    by = ["key", "h", "n"]
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions("key", "h", "text").select("key", "text")
    found = ordered.mapInArrow(lean(run), "part long, shard long, name string, docs long, ids long")
    # a few rows of each of many tasks: what is done with them takes fewer, after these are over.
    # By part, so that a task that runs again puts other names in no other place
    return found.repartition(max(1, parts // PARTS), "part")


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_first long"


def _dealt(shards: DataFrame) -> DataFrame:
    """``shards`` dealt to tasks, FILES to each where there are many: a file takes a tenth of a
    second, and so does what a task costs besides."""
    count = shards.count()
    return shards.repartition(max(1, min(count, max(count // FILES, LEAST_TASKS))))


def read(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that ``shards``
    (name, base: the ids in all shards before) names; ``first_id`` is a document's first id
    and ``n_first`` how often the document has it, both by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the words that this worker remembered when it wrote are of no more use
        vocabulary.cache_clear()
        release()
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = opened(folder, name)
                keys, lengths = shard.documents()
                matrix = shard.matrix
                values = matrix.values().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [
                    zlib.crc32(values[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)
                ]
                first = matrix.access(starts)
                columns = (keys, starts + base, lengths, sums, first, matrix.count(first, ends) - matrix.count(first, starts))
                names = [f.split()[0] for f in ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return _dealt(shards.select("name", "base")).mapInArrow(lean(run), ROWS)


def tokens(shards: DataFrame, folder: str, asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """``asked`` (key, ``at``: places in the document) with ``id``, the token there; places that
    a document doesn't have are left out.  Of each file only the document table and the
    chunks on the way to the places are read."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                keys, lengths = opened(folder, name).documents()
                columns = ([name] * len(keys), keys, np.cumsum(lengths) - lengths, lengths)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", key, "inside", "n"]
                )

    index = _dealt(shards.select("name")).mapInArrow(places, f"name string, `{key}` long, inside long, n long")
    found = asked.select(F.col(key).cast("long").alias(key), F.col("at").cast("long").alias("at")).join(index, key)
    found = found.where("at >= 0 AND at < n").select("name", key, "at", "inside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for batch in batches:
            names, at = np.array(batch.column(0).to_pylist()), batch.column(2).to_numpy()
            place, out = batch.column(3).to_numpy() + at, np.zeros(len(at), np.int64)
            for name in dict.fromkeys(names.tolist()):
                if name != last:
                    last, shard = name, opened(folder, name)
                own = names == name
                out[own] = shard.matrix.access(place[own])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out)], names=[key, "at", "id"])

    # a file's questions are parted too: any task can open it
    dealt = found.repartition("name", F.floor(F.col("inside") / CHUNK)).sortWithinPartitions("name", "inside", "at")
    return dealt.mapInArrow(run, f"`{key}` long, at long, id long")


def occurrences(shards: DataFrame, folder: str, ids: list[int]) -> DataFrame:
    """(id, n): how often each of a few ids occurs in all files, by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                total += opened(folder, name).matrix.count(np.array(ids, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], names=["id", "n"])

    parts = _dealt(shards.select("name")).mapInArrow(run, "id long, n long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


def bases(shards: DataFrame) -> DataFrame:
    """``name`` and ``base`` of each shard: the ids before it.  In two steps, first within
    each part, then over the parts, of which there are as many as partitions."""
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("ids").alias("all"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    return shards.join(parts, "part").select(
        "name", (F.coalesce(F.sum("ids").over(inside), F.lit(0)) + F.col("before")).alias("base")
    )


def op10_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    if SCAN[0] not in spark.conf.getAll:
        spark.conf.set(*SCAN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_dir(spark, "wavelet")
    make_dir(spark, folder)
    # the files are there once this has run
    shards = cut(write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder))
    return read(bases(shards), folder)
