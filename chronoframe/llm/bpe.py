"""Byte-pair encoding by backtracking, and decoding from an offset table.

An Aho-Corasick automaton over the reversed tokens reads a word once and gives, for each
place in it, the tokens that start there.  The encoder takes the longest, then the next
longest, wherever the pair with the token before is one that merging would leave as it
is; a place from which no token goes on is marked and never tried again, so the work is
linear in the word.  A row of tokens is the result of merging exactly if each of its
neighbouring pairs is (the merges are applied in order of rank, leftmost first), so the
pair-compatibility table makes the result exact.  The table is filled as pairs come up,
each entry by merging the two tokens' letters.

Decoding gathers from one string of all tokens by an offset table, all ids of a batch at
once.  The vocabulary has no decoder: its tokens are joined by a space.

Defined results: a null or empty text has no ids and decodes to an empty text; a null
``doc_id`` is kept; repeated rows give repeated results; columns that are not asked for
are not carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import vocab as V
from chronoframe.llm.shared import bounded_batches, lean

#: What marks a letter at a word's end in the automaton: its code is moved up by so much.
AT_END = 0x1000
#: Bytes of each generation of pairs that the compatibility table keeps.
PAIRS = 32 << 20


class OffsetTable:
    """Texts by number, each after one space, in one string of bytes with offsets."""

    def __init__(self, texts: list[str]):
        spaced = [f" {t}".encode() for t in texts]
        self.data = np.frombuffer(b"".join(spaced), np.uint8)
        self.offsets = np.zeros(len(spaced) + 1, np.int64)
        np.cumsum([len(t) for t in spaced], out=self.offsets[1:])

    def gather(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The joined texts of each run of ``ids``; ``ends`` are the runs' ends."""
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        to = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=to[1:])
        at = np.repeat(starts - to[:-1], lengths)
        at += np.arange(to[-1])
        whole = self.data[at].tobytes()
        out, low = [], 0
        for high in to[ends].tolist():
            out.append(whole[low + 1 : high])
            low = high
        return out


class BacktrackingBpe:
    """Encoder of the ``word`` vocabulary: its tokens at a word's end carry a suffix."""

    def __init__(self, path: str):
        base = V.vocabulary(path)
        if base.style != "word":
            raise ValueError(f"{path}: not a vocabulary with word ends")
        self.base = base
        spec = V.read_spec(path)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[self.marked(a), self.marked(b)] = rank
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        names = [""] * size
        for name, i in model["vocab"].items():
            names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            names[i] = name
        self.letters = [self.marked(n) for n in names]
        self.tokens = OffsetTable(names)
        self.decimals = OffsetTable([str(i) for i in range(size)])
        self.automaton = ahocorasick.Automaton()
        for name, i in model["vocab"].items():
            if letters := self.marked(name):
                self.automaton.add_word(letters[::-1], (i, len(letters)))
        self.automaton.make_automaton()
        # one entry for each token: never full
        self.whole = V.Memory(self._whole, 2 * size * V.Memory.FIXED, 0, plain=True)
        self.pairs = V.Memory(self._compatible, PAIRS, 0, plain=True)
        self.pieces = V.Memory(self.word, V.REMEMBERED // 2)
        self.chunks = V.Memory(self._chunk, V.REMEMBERED)
        self.between = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def marked(self, token: str) -> str:
        """A token as one letter for each symbol that merging starts from."""
        if self.suffix and token.endswith(self.suffix):
            token = token.removesuffix(self.suffix)
            return token[:-1] + chr(ord(token[-1]) + AT_END) if token else ""
        return token

    def merged(self, letters: str) -> list[str]:
        """The letters merged pair by pair, lowest rank first, leftmost first."""
        parts = list(letters)
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min(
                (ranks.get((a, b), 1 << 30), i)
                for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
            )
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, token: int) -> bool:
        """True if merging a token's letters gives that token."""
        return len(self.merged(self.letters[token])) == 1

    def _compatible(self, pair: tuple[int, int]) -> bool:
        a, b = self.letters[pair[0]], self.letters[pair[1]]
        return self.merged(a + b) == [a, b]

    def word(self, piece: str) -> bytes:
        """Ids of one piece."""
        letters = V.lettered(piece)
        letters = letters[:-1] + chr(ord(letters[-1]) + AT_END)
        n = len(letters)
        fits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (token, size) in self.automaton.iter(letters[::-1]):
            fits[n - 1 - end].append((token, size))
        for here in fits:
            here.sort(key=lambda t: -t[1])
        dead = bytearray(n + 1)
        stack: list[tuple[int, int]] = []  # token and which of its place's it is
        at = k = 0
        whole, pairs = self.whole, self.pairs
        while at < n:
            here = fits[at]
            while k < len(here):
                token, size = here[k]
                if (
                    not dead[at + size]
                    and whole[token]
                    and (not stack or pairs[stack[-1][0], token])
                ):
                    break
                k += 1
            if k < len(here):
                stack.append((token, k))
                at, k = at + size, 0
                continue
            dead[at] = 1
            if not stack:
                raise ValueError(f"no tokens for {piece!r}")
            token, k = stack.pop()
            at, k = at - len(self.letters[token]), k + 1
        return np.array([t for t, _ in stack], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if V.known(chunk):
            pieces = V.word_pieces(chunk)
        else:
            library = self.base.library
            plain = library.normalizer.normalize_str(chunk)
            letters = {v: k for k, v in V.LETTERS.items()}
            pieces = [
                bytes(letters[c] for c in p).decode("utf-8", "surrogatepass")
                for p, _ in library.pre_tokenizer.pre_tokenize_str(plain)
            ]
        return b"".join([self.pieces[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return b"".join(map(self.chunks.__getitem__, V.word_chunks(text)))
        out = []
        for part in self.between.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += map(self.chunks.__getitem__, V.word_chunks(part))
        return b"".join(out)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The decoded text of each array of ids, in UTF-8."""
        return self.tokens.gather(*joined(ids))


def joined(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(i) for i in ids], dtype=np.int64)
    return np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64), ends


@lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def _groups(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about ``size`` bytes of text in each."""
    low, held = 0, 0
    for i, text in enumerate(batch.column(1)):
        held += len(text.as_buffer()) if text.is_valid else 0
        if held >= size:
            yield low, i + 1
            low, held = i + 1, 0
    if low < batch.num_rows:
        yield low, batch.num_rows


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids``, the token ids of each whole text as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            ids = [bpe.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary())], names=["key", "ids"]
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), text)
    return rows.mapInArrow(lean(run), "key long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of what ``encode`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = bpe.decode([np.frombuffer(x.as_py() or b"", "<u4") for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["key", "text"],
            )

    rows = encoded.select(F.col(key).cast("long").alias("key"), "ids")
    return rows.mapInArrow(lean(run), "key long, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts and digests of ids and decoded texts, in one pass that keeps neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for low, high in _groups(batch):
                part = batch.slice(low, high - low)
                ids = [np.frombuffer(bpe.encode(t.as_py()), "<u4") for t in part.column(1)]
                flat, ends = joined(ids)
                told = [
                    [hashlib.sha256(x).hexdigest() for x in table.gather(flat, ends)]
                    for table in (bpe.decimals, bpe.tokens)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(i) for i in ids], pa.int64()),
                        *(pa.array(x, pa.string()) for x in told),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text)
    return rows.mapInArrow(
        lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("word_bpe_49k.json"))
