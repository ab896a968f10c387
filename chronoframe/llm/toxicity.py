"""Toxicity of texts that may hide their words.

A noisy-channel decoder restores disguised words first.  Each character opens to the letters
it can stand for (leetspeak), separators, repeated letters and spaces may drop out, and
Viterbi picks the path that is likeliest under a trigram model of letters times the channel.
The letter model is counted over all documents.  A linear model over restored words and word
beginnings then scores the text.

The lattice is that of the whole text, decoded where it can differ from the text:

* tokens with marks, digits or doubled letters by themselves, as a letter model of order
  three doesn't see past the two spaces around them;
* runs of tokens of one character, spaces included, so that a run falls into words;
* a space between tokens of two letters or more by a table: whether it stays depends on the
  two letters on each side alone, not on what becomes of other spaces.

The score's words are learned from labelled rows outside the held-out fold: at most
TOXIC_ROWS and CLEAN_ROWS of them, those whose ids hash lowest.  Of the words and beginnings
in them all that are tied closely enough to the label are kept and weighted by logistic
regression with balanced classes.

Defined results: null and empty texts get the score of a text without any known word;
without a labelled toxic row every score is 0; a null ``doc_id`` is not held out; repeated
rows give repeated results; an empty table gives no rows; a very long text is read whole, in
time that grows with it alone.  To learn from, an id counts once, with the greatest of its
labels and the least of its texts; null labels don't count.  Input columns beyond those named
are ignored or, in ``filter_toxic``, passed through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.shared import bounded_batches, cut, lean, release
from chronoframe.llm.vocab import Memory

#: Labelled rows to learn from, at most.
TOXIC_ROWS, CLEAN_ROWS = 3_000, 5_000
#: Least number of toxic texts with a feature.
SEEN = 3
#: Least log-likelihood ratio between a feature and the label.
TIE = 20.0
#: Least share of toxic texts among those with a feature.
SHARE = 0.8
PREFIXES = range(3, 9)
#: Bytes of tokens that a worker remembers the features of, in each generation.
REMEMBERED = 20 << 20
#: Counts that a worker holds before it sends them on.
HELD = 100_000
THRESHOLD = 0.7

#: Letters that a character can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
    "£": "l", "¥": "y", "µ": "u",
}
SEPARATORS = "._-*~'`^"
#: Logarithms of what the channel makes of a letter.
KEPT, SWAPPED, SEPARATED, REPEATED, STRAY = 0.0, -1.0, -0.5, -0.7, -12.0
#: The same for a space that drops out, in a run of single characters and between words.
SPELLED, SPACED = -0.5, -2.0
#: Single characters in a row that count as spelled.
RUN = 3
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&$|~`^_-+=/\\@…»«“”„’‘"

LETTERS = 28  # none, a to z, any other letter


def _codes() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        if chr(cp).isalpha():
            low = chr(cp).lower()[0]
            table[cp] = ord(low) - 96 if "a" <= low <= "z" else 27
    return table


CODES = _codes()


def code(letter: str) -> int:
    return int(CODES[min(ord(letter), 0xFFFF)])


def trigrams(texts: Iterable[str]) -> np.ndarray:
    """Counts of three letters in a row; what is no letter ends a word."""
    counts = np.zeros(LETTERS**3, np.int64)

    def add(text: str) -> None:
        cps = np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), "<u4")
        c = CODES[np.minimum(cps, 0xFFFF)].astype(np.int32)
        tri = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
        np.add(counts, np.bincount(tri, minlength=LETTERS**3), out=counts)

    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= 1 << 17:  # what holds for two spaces holds for texts: neither sees the other
            add("  ".join(held))
            held, size = [], 0
    if held:
        add("  ".join(held))
    return counts


class LetterModel:
    """Log-probability of a letter after two, each order smoothed by the one below."""

    def __init__(self, counts: np.ndarray, strength: float = 5.0):
        n3 = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        n3[0, 0, 0] = 0
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + LETTERS)
        p2 = (n2 + strength * p1) / (n2.sum(1, keepdims=True) + strength)
        p3 = (n3 + strength * p2) / (n3.sum(2, keepdims=True) + strength)
        log = np.log(p3)
        self.log = log.tolist()
        # [a, b, c, d]: whether "ab cd" is likelier as one word
        one = log[:, :, :, None] + log[None, :, :, :] + SPACED
        two = log[:, :, 0, None, None] + log[None, :, 0, :, None] + log[0][None, None, :, :]
        self.joins = (one > two).ravel()


def options(ch: str, before: str) -> list[tuple[str, float]]:
    """What a character can stand for, with the channel's price."""
    if ch == " ":
        return [(" ", KEPT), ("", SPELLED)]
    out: list[tuple[str, float]] = []
    if ch.isalpha():
        out.append((ch, KEPT))
        if ch == before:
            out.append(("", REPEATED))
    out += [(to, SWAPPED) for to in LEET.get(ch, "")]
    if not ch.isalpha():
        out.append(("", SEPARATED if ch in SEPARATORS else STRAY))
    return out


def restore(observed: str, model: LetterModel) -> str:
    """The likeliest letters and spaces behind ``observed``, by Viterbi over its lattice."""
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    before = ""
    for ch in observed:
        step: dict[tuple[int, int], tuple[float, tuple]] = {}
        open_to = options(ch, before)
        for (a, b), (score, path) in paths.items():
            for to, channel in open_to:
                if to:
                    c = 0 if to == " " else code(to)
                    key, new = (b, c), (score + channel + model.log[a][b][c], (path, to))
                else:
                    key, new = (a, b), (score + channel, path)
                if key not in step or new[0] > step[key][0]:
                    step[key] = new
        paths, before = step, ch
    path = max(
        ((score + model.log[a][b][0], path) for (a, b), (score, path) in paths.items()),
        key=lambda p: p[0],
        default=(0.0, ()),
    )[1]
    letters = []
    while path:
        path, last = path
        letters.append(last)
    return "".join(reversed(letters))


_ODD = str.maketrans("", "", "".join(LEET) + SEPARATORS)
_DOUBLED = re.compile(r"(.)\1")


def _suspicious(core: str) -> bool:
    """Letters with one doubled, or with marks that stand for or part letters."""
    if core.isalpha():
        return _DOUBLED.search(core) is not None
    rest = core.translate(_ODD)
    return rest.isalpha() and len(rest) < len(core)


_REPEATED = re.compile(r"(.)\1+")
_WORD_BEFORE = re.compile(r"[^\W\d_]{1,24}\Z")
_WORD_AFTER = re.compile(r"[^\W\d_]{1,24}")


class Reader:
    """Features of a text: its restored words, and how they begin."""

    def __init__(self, model: LetterModel, known: dict[str, int] | None = None):
        self.model, self.known = model, known
        # features are numbers once they are known, strings before
        self.words = Memory(self._word, REMEMBERED, 500 if known is None else 8)
        stems = [f.rstrip("*") for f in known or ()]
        self.longest = max(map(len, stems), default=0)
        # what a word that a feature fits can begin with: without repeats, and as codes
        self.heads = {f[:3] for f in stems}
        self.single = {_REPEATED.sub(r"\1", f) for f in stems}
        self.begins = np.zeros(LETTERS**3, bool)
        for f in stems:
            if len(f) >= PREFIXES[0]:
                a, b, c = map(code, f[:3])
                self.begins[(a * LETTERS + b) * LETTERS + c] = True

    def _features(self, word: str) -> tuple:
        if self.known is not None and word[:3] not in self.heads:
            return ()
        found = [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]
        if self.known is None:
            return tuple(found)
        return tuple(self.known[f] for f in found if f in self.known)

    def _word(self, token: str) -> tuple:
        core = token.strip(PUNCTUATION)
        if core.isalpha():
            if self.known is not None and core[:3] not in self.heads and not _DOUBLED.search(core):
                return ()
            found = set(self._features(core))
        else:
            found = set()
            part = "".join(c if c.isalpha() else " " for c in core).split()
            for word in part:
                found.update(self._features(word))
        for hidden in {core, token.strip(".,;:?\"'")}:
            if hidden and _suspicious(hidden) and self._can_fit(hidden):
                found.update(self._features(restore(hidden, self.model)))
        return tuple(found)

    def _can_fit(self, hidden: str) -> bool:
        """False if decoding ``hidden`` can't give a known feature: dropping repeats from a
        word of letters leaves the word without repeats as it is."""
        if self.known is None or not hidden.isalpha():
            return True
        single = _REPEATED.sub(r"\1", hidden)
        return any(single[:n] in self.single for n in range(1, min(self.longest, len(single)) + 1))

    def _spelled(self, tokens: list[str]) -> Iterator[str]:
        """Features of the runs of single characters."""
        ones = [
            i
            for i, t in enumerate(tokens)
            if len(t) == 1 or len(t) <= 3 and not t.isalpha() and len(t.strip(".,;:?!\"'()")) == 1
        ]
        low = 0
        for k in range(1, len(ones) + 1):
            if k == len(ones) or ones[k] != ones[k - 1] + 1:
                if k - low >= RUN:
                    run = [tokens[i].strip(".,;:?\"'()") or tokens[i] for i in ones[low:k]]
                    word = restore(" ".join(run), self.model)
                    for part in word.split():
                        yield from self._features(part)
                    if self.known is not None:  # a word's end may be taken for another's beginning
                        word = word.replace(" ", "")
                        for at in range(len(word) - PREFIXES[0]):
                            for n in range(PREFIXES[0], self.longest + 1):
                                for f in (word[at : at + n], word[at : at + n] + "*"):
                                    if f in self.known:
                                        yield self.known[f]
                low = k

    def _joined(self, text: str) -> Iterator[tuple[str, int]]:
        """Words that a space parts although one word is likelier, and how long the part
        before the space is; only those that begin as a known feature of three letters or
        more does."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.flatnonzero(cps[2:-2] == 32) + 2
        c = CODES[np.minimum(cps, 0xFFFF)].astype(np.int32)
        a, b, d, e = c[at - 2], c[at - 1], c[at + 1], c[at + 2]
        go = (b > 0) & (d > 0)
        go &= self.model.joins[((a * LETTERS + b) * LETTERS + d) * LETTERS + e]
        at = at[go]
        if not len(at):
            return
        # the first three letters of what a join gives
        start = np.maximum.accumulate(np.where(c == 0, np.arange(1, len(c) + 1), 0))[at - 1]
        three = [c[p + (p >= at)] for p in (start, start + 1, start + 2)]
        fits = self.begins[(three[0] * LETTERS + three[1]) * LETTERS + three[2]]
        at = at.tolist()
        for i in np.flatnonzero(fits).tolist():
            left = _WORD_BEFORE.search(text, max(0, at[i] - 24), at[i])
            if not left:
                continue
            word, end = left[0], at[i]
            while i < len(at) and at[i] == end and (right := _WORD_AFTER.match(text, end + 1)):
                word += right[0]
                yield word, len(left[0])
                i, end = i + 1, right.end()

    def read(self, text: str | None) -> set:
        low = (text or "").lower()
        tokens = low.split()
        found: set = set()
        found.update(*filter(None, map(self.words.__getitem__, set(tokens))))
        found.update(self._spelled(tokens))
        # what is learned from are words as they stand
        if self.known and len(low) > 4:
            for word, left in self._joined(low):
                # only what the parts don't have: features that reach over the space
                for f in (word, *(word[:n] + "*" for n in PREFIXES if left < n < len(word))):
                    if f in self.known:
                        found.add(self.known[f])
        return found


@dataclass
class Model:
    """What scoring needs: the letter model's counts, features and their weights."""

    counts: np.ndarray
    features: list[str]
    weights: np.ndarray
    bias: float

    def reader(self) -> Reader:
        return Reader(LetterModel(self.counts), {f: i for i, f in enumerate(self.features)})

    def score(self, found: set) -> float:
        if math.isinf(self.bias):
            return 0.0
        z = self.bias + sum(self.weights[i] for i in found)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def count_letters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            total += trigrams(t.as_py() for t in batch.column(0) if t.is_valid)
        release()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counts = np.zeros(LETTERS**3, np.int64)
    parts = docs.select(text).mapInArrow(run, "at long, n long")
    # at most LETTERS ** 3 rows
    for at, n in parts.groupBy("at").agg(F.sum("n")).collect():
        counts[at] = n
    return counts


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, key: str) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from."""
    open_rows = labels.select(key, "toxic").where(F.col("toxic").isin(0, 1) & (fold(key) != 1))
    open_rows = open_rows.groupBy(key).agg(F.max("toxic").alias("toxic"))
    lowest = [F.xxhash64(key), F.col(key)]
    picked = [
        open_rows.where(F.col("toxic") == y).orderBy(*lowest).limit(n)
        for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    ]
    # no more rows than the two bounds allow
    few = F.broadcast(picked[0].union(picked[1]))
    found = docs.select(F.col(key).alias("__id"), F.col(text).alias("text"))
    found = found.join(few, F.col("__id") == few[key])
    # an id that many rows repeat is one row of the sample
    return found.groupBy("__id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("__id")


def _tied(sample: DataFrame, counts: np.ndarray, toxic: int, rows: int) -> list[tuple[str, int, int]]:
    """(feature, texts, toxic texts) of all features closely tied to the label, closest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(LetterModel(counts)), Counter()

        def told() -> pa.RecordBatch:
            features, labels = zip(*seen, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(features), pa.array(labels, pa.int32()), pa.array(list(seen.values()), pa.int64())],
                names=["feature", "toxic", "n"],
            )

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen.update((f, label) for f in reader.read(text.as_py()))
                if len(seen) >= HELD:
                    yield told()
                    seen.clear()
        if seen:
            yield told()

    parts = sample.select("text", "toxic").mapInArrow(lean(run), "feature string, toxic int, n long")
    by = parts.groupBy("feature").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).cast("double").alias("a")
    )
    a, n, share = F.col("a"), F.col("n"), toxic / rows

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    tie = 2 * (
        part(a, n * share)
        + part(n - a, n * (1 - share))
        + part(toxic - a, (rows - n) * share)
        + part(rows - toxic - (n - a), (rows - n) * (1 - share))
    )
    close = by.where((a >= SEEN) & (a > n * share) & (a >= SHARE * n)).withColumn("tie", F.round(tie, 6)).where(F.col("tie") >= TIE)
    # what a bounded sample has
    # of beginnings that say the same the longest is taken, and any before the whole word
    order = [F.desc("tie"), F.desc(F.endswith("feature", F.lit("*"))), F.desc(F.length("feature")), F.col("feature")]
    return [(f, int(k), int(t)) for f, k, t in close.orderBy(*order).select("feature", "n", "a").collect()]


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id"
) -> Model:
    """The model for ``docs``, learned from ``labels`` (``key``, ``toxic``) outside the fold."""
    counts = count_letters(docs, text)
    sample = cut(labelled_sample(docs, labels, text, key))
    rows, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    names = _distinct(_tied(sample, counts, toxic, rows)) if toxic else []
    if not names:
        return Model(counts, [], np.zeros(0), -math.inf)
    known = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(LetterModel(counts), known)
        for batch in batches:
            found = [sorted(reader.read(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))],
                names=["toxic", "found"],
            )

    # texts with the same features are one row with their number
    each = sample.select("text", "toxic").mapInArrow(lean(run), "toxic int, found array<int>")
    each = each.groupBy("toxic", "found").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "found").collect()
    weights, bias = _regress([r[1] for r in each], np.array([r[0] for r in each], float), np.array([r[2] for r in each], float), len(names))
    return Model(counts, names, weights, bias)


def _distinct(tied: list[tuple[str, int, int]]) -> list[str]:
    """Features in order, leaving out a beginning or word that says the same as one already
    taken: one begins the other, and as many texts have both."""
    kept: list[str] = []
    taken: set[tuple[str, int, int]] = set()
    for name, n, a in tied:
        stem = name.rstrip("*")
        says = {(stem[:k], n, a) for k in range(PREFIXES[0], len(stem) + 1)}
        if not says & taken:
            kept.append(name)
        taken |= says
    return kept


def _regress(found: list[list[int]], y: np.ndarray, n: np.ndarray, size: int, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression of ``y``, rows counting ``n`` times, classes balanced, by accelerated
    gradient descent.  Rows hold the numbers of their features, which are few."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    column = np.array([f for r in found for f in r], np.int64)
    share = float((n * y).sum() / n.sum())
    w8 = n * np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / n.sum()
    w, b, l2 = np.zeros(size), 0.0, 1e-4
    rate = 1.0 / (0.25 * (max((len(f) for f in found), default=0) + 1) + l2)
    vw, vb = w.copy(), b
    for t in range(steps):
        z = np.bincount(row, weights=vw[column], minlength=len(y)) + vb
        e = w8 * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        nw = vw - rate * (np.bincount(column, weights=e[row], minlength=size) + l2 * vw)
        nb = vb - rate * e.sum()
        m = t / (t + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, float(b)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; an input column of that name is replaced.

    Only texts go to Python and only scores come back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = model.reader()
        for texts in batches:
            yield pa.array([model.score(reader.read(t.as_py())) for t in texts], pa.float64())
        del reader
        release()

    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col(text)))


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score THRESHOLD or more."""
    out = scored(docs, fit(docs, labels))
    return out.where(F.col("score") < THRESHOLD).select(*docs.columns)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, fit(docs, labels))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
