"""Token ids of whole texts by the tokenizers library, with a memory of words seen.

The library takes about a second for each megabyte here, and most of that repeats: a
text is cut where no token can cross, and what lies between is looked up.  Only words
not seen lately reach the library's model.  The cut depends on the vocabulary file:

* ``word``: white space is dropped, so any white space cuts;
* ``byte``: a space belongs to the word after it, so a single space between two
  characters that aren't white space cuts, and so does a newline that stands alone;
* any other file: the library encodes whole texts.

``encode_all`` takes many texts at once: all their bytes are cut together, equal words are
found by hash, and each is looked up once.

Texts that hold a special token's string go to the library whole, and so do texts with
characters that this Python's Unicode tables don't know.  Ids come as little-endian
unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Bytes of each generation of a memory; bounds a worker's memory, not its results.
REMEMBERED = 48 << 20
#: Marks that often end a word; none is a letter, number or white space.
MARKS = ".,;:!?)\"%&#$*]"

#: The split patterns that the two vocabulary files name.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = regex.compile(WORD)
_BYTE = regex.compile(BYTE)
_ASCII_WORD = re.compile(WORD.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
_ASCII_BYTE = re.compile(
    BYTE.replace(r"[^\s\p{L}\p{N}]", "[^\\sa-zA-Z0-9]")
    .replace(r"\p{L}", "[a-zA-Z]")
    .replace(r"\p{N}", "[0-9]"),
    re.ASCII,
)
#: White space of the library; str.split() also takes the four separators 1C to 1F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: No character up to here is unassigned.
_LATE = re.compile("[^\x00-\u0377]")
_ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile("(?<=[^\\s]) (?=[^\\s])")

#: What a byte is for the cuts of many texts: digits, controls and all beyond ASCII are 0.
SPACE, LETTER, MARK = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_ASCII_SPACE = "\t\n\x0b\x0c\r "
_KINDS[list(_ASCII_SPACE.encode())] = SPACE
_KINDS[[b for b in range(33, 127) if chr(b).isalpha()]] = LETTER
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum()]] = MARK
#: Other white space, or what only some libraries count as such.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: In place of ids: the text of this word goes through ``encode``.
ODD = b"?"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


class _Lettered(dict):
    """The letters of each character's bytes, by code point."""

    def __missing__(self, point: int) -> str:
        self[point] = letters = "".join(LETTERS[b] for b in chr(point).encode("utf-8", "surrogatepass"))
        return letters


_LETTERED = _Lettered()


def lettered(piece: str) -> str:
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", LETTERS[32])
    return piece.translate(_LETTERED)


def known(text: str) -> bool:
    """True if this Python's Unicode tables know every character of ``text``."""
    if text.isascii() or not _LATE.search(text):
        return True
    return all(unicodedata.category(c) not in ("Cn", "Cs") for c in set(text))


class Memory(dict):
    """The last entries used, in two generations: the older goes when the newer is full.

    ``room`` bounds the bytes of a generation: about FIXED for each entry, two for each
    character of its key and ``each`` for each item of its value.  Keys of over LONG
    characters hardly come again and are not kept.  Keys that aren't strings (``plain``)
    are of one size.
    """

    FIXED, LONG = 160, 48

    def __init__(self, make, room: int, each: int = 1, plain: bool = False):
        super().__init__()
        self.make, self.room, self.each, self.plain = make, room, each, plain
        self.left, self.old = room, {}

    def __missing__(self, key):
        value = self.old.get(key)
        size = 0 if self.plain else len(key)
        if value is None:
            value = self.make(key)
            if size > self.LONG:
                return value
        size = self.FIXED + 2 * size
        if self.each:
            size += self.each * len(value)
        # making the value may have taken room
        self.left = left = self.left - size
        if left < 0:
            self.old = dict(self)
            self.clear()
            self.left = self.room
        self[key] = value
        return value


def fold(chunk: str) -> str:
    """A chunk without white space as the word vocabulary's normalizer has it."""
    if chunk.isascii():
        return chunk.lower()
    return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()


def word_chunks(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


def word_pieces(chunk: str) -> list[str]:
    chunk = fold(chunk)
    if chunk.isascii():
        return [chunk] if chunk.isalpha() else _ASCII_WORD.findall(chunk)
    return _WORD.findall(chunk)


def byte_chunks(text: str) -> list[str]:
    """Chunks; each but the first follows one space that belongs to it, or starts with a
    newline, which stands alone and is a piece of its own."""
    if "  " in text or "\n " in text or " \n" in text or _ODD_SPACE.search(text):
        return _CUT.split(text)
    if "\n" in text and "\n\n" not in text:
        return text.replace("\n", " \n").split(" ")
    return text.split(" ")


def byte_pieces(chunk: str) -> list[str]:
    return (_ASCII_BYTE if chunk.isascii() else _BYTE).findall(chunk)


def byte_cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in the texts' bytes before which no token crosses, where ASCII's is the only white
    space.  ``starts`` and ``ends`` are those of all texts that aren't empty.

    Only tokens of white space alone have any after their first place, and they leave the last
    place of a run that something follows: so it cuts before a run, before its last place, and
    after that if it is no space.  Letters end before a mark.
    """
    kind = _KINDS[data]
    space = kind == SPACE
    alone, cut = np.ones(len(data), bool), np.zeros(len(data), bool)
    np.logical_not(space[1:], out=alone[:-1])
    alone[ends - 1] = False
    alone[1:] |= ~space[:-1]
    np.logical_and(space, alone, out=cut)
    cut[1:] |= (kind[1:] == MARK) & (kind[:-1] == LETTER)
    cut[1:] |= space[:-1] & (data[:-1] != 32) & ~space[1:]
    cut[starts] = True
    return np.flatnonzero(cut)


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Vocabulary:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = read_spec(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        text = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        if json.dumps(WORD)[1:-1] in text and '"Lowercase"' in text:
            self.style = "word"
        elif spec["normalizer"] is None and '"use_regex": true' in text:
            self.style = "byte"
        else:
            self.style = "other"
        self.tokenize = self.library.model.tokenize
        # pieces are few: marks, numbers, parts of odd chunks
        self.pieces = Memory(self.piece, remembered // 8)
        if self.style == "word":
            self.chunks = Memory(self.word_chunk, remembered)
        else:  # most texts come many at once, and their words are in a memory of its own
            self.chunks = Memory(self.byte_chunk, remembered // 4)
            self.words = Memory(self.byte_word, remembered)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece that the pre-tokenizer leaves whole."""
        return self.token_ids(lettered(piece))

    def token_ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def word_chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        # letters that stay letters when folded are one piece
        if core.isalpha() and (folded := fold(core)).isalpha():
            if len(core) == len(chunk):
                return self.token_ids(folded if folded.isascii() else lettered(folded))
            return self.chunks[core] + self.pieces[chunk[len(core) :]]
        return b"".join([self.pieces[p] for p in word_pieces(chunk)])

    def byte_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.token_ids(LETTERS[32] + chunk if chunk.isascii() else lettered(" " + chunk))
        core = chunk.rstrip(MARKS)
        if core.isalpha():
            return self.chunks[core] + self.pieces[chunk[len(core) :]]
        if chunk[:1] == "\n":
            return self.pieces["\n"] + self.head(chunk[1:])
        return b"".join([self.pieces[p] for p in byte_pieces(" " + chunk)])

    def head(self, chunk: str) -> bytes:
        """Ids of a chunk that follows no space."""
        if chunk.isalpha():
            return self.token_ids(chunk if chunk.isascii() else lettered(chunk))
        core = chunk.rstrip(MARKS)
        if core.isalpha():
            return self.head(core) + self.pieces[chunk[len(core) :]]
        return b"".join([self.pieces[p] for p in byte_pieces(chunk)])

    def byte_word(self, word: str) -> bytes:
        """Ids of what lies between two cuts of ``byte_cuts``, with the space that it begins
        with; ODD if it has characters that aren't known, or rare white space at an end, where
        more may follow beyond the cut."""
        if word.isalpha() or word[0] == " " and word[1:].isalpha():
            return self.token_ids(lettered(word))
        inner = word.strip(_ASCII_SPACE)
        if not known(word) or _RARE_SPACE.match(inner) or _RARE_SPACE.match(inner[-1:]):
            return ODD
        core = word.rstrip(MARKS)
        if core != word and core.lstrip(" ").isalpha():
            return self.words[core] + self.pieces[word[len(core) :]]
        return b"".join([self.pieces[p] for p in byte_pieces(word)])

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return b""
        if self.style == "other" or any(s in text for s in self.specials) or not known(text):
            return self.whole(text)
        if self.style == "word":
            return b"".join(map(self.chunks.__getitem__, word_chunks(text)))
        first, *rest = byte_chunks(text)
        return self.head(first) + b"".join(map(self.chunks.__getitem__, rest))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of each text."""
        if self.style != "byte":
            return [self.encode(t.as_py()) for t in texts]
        out, again = self.by_words(texts.cast(pa.large_string()).fill_null(""))
        # what the words took is free by now: texts may be long
        for i in again:
            out[i] = self.encode(texts[i].as_py())
        return out

    def by_words(self, texts: pa.Array) -> tuple[list[bytes], set[int]]:
        """Ids of each text from those of its words, and the texts for which they aren't right."""
        _, places, data = texts.buffers()
        bounds = np.frombuffer(places or bytes(8), np.int64)[texts.offset :][: len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            return [b""] * len(texts), set()
        cuts = byte_cuts(data, bounds[full], bounds[full + 1])
        parts = pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(data)
        words = pa.LargeStringArray.from_buffers(len(cuts), *parts).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        ids = pa.array([self.words[w] for w in distinct], pa.large_binary()).take(words.indices)
        _, places, found = ids.buffers()
        ends, every = np.frombuffer(places, np.int64)[: len(cuts) + 1], memoryview(found)
        # the first word of each text, and where its ids begin
        first = np.searchsorted(cuts, bounds)
        at = ends[first].tolist()
        out = [bytes(every[a:b]) for a, b in zip(at, at[1:], strict=False)]
        odd = np.flatnonzero(np.diff(ends) == len(ODD))
        again = set((np.searchsorted(first, odd, side="right") - 1).tolist())
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.specials):
            again |= {i for i, t in enumerate(texts) if any(s in t.as_py() for s in self.specials)}
        return out, again


@lru_cache(maxsize=4)
def vocabulary(path: str, remembered: int = REMEMBERED) -> Vocabulary:
    return Vocabulary(path, remembered)
