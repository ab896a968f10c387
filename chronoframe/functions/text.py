"""Text: chunks for retrieval, token estimates, word similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def tokens(c: Column) -> Column:
    """About how many tokens a text has: one for four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.split(F.lower(c), r"\s+")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """``text`` in pieces of at most ``size``, cut at the first separator that it holds."""
    if len(text) <= size:
        return [text] if text else []
    mark = next((s for s in separators if s and s in text), "")
    if not mark:
        return [text[i : i + size] for i in range(0, len(text), size)]
    later = separators[separators.index(mark) + 1 :]
    parts = text.split(mark)
    kept = [p + mark for p in parts[:-1]] + [parts[-1]]
    return [piece for part in kept for piece in _pieces(part, size, later)]


def chunks(text: str | None, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters; each repeats up to ``overlap`` characters of
    whole pieces from the end of the one before."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than it")
    out: list[str] = []
    now: list[str] = []
    length = 0
    for piece in _pieces(text or "", size, separators):
        if now and length + len(piece) > size:
            out.append("".join(now))
            while now and (length > overlap or length + len(piece) > size):
                length -= len(now.pop(0))
        now.append(piece)
        length += len(piece)
    return out + (["".join(now)] if now else [])


def chunked(df: DataFrame, text: str, size: int, overlap: int = 0, by_tokens: bool = False) -> DataFrame:
    """One row for each chunk: the other columns, ``chunk`` number from 0 and ``content``."""
    limit, again = (4 * size, 4 * overlap) if by_tokens else (size, overlap)
    chunks("", limit, again)  # the sizes are checked here, not on the workers
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = rows[text].map(lambda t: list(enumerate(chunks(t, limit, again))))
            out = rows[rest].assign(__c=made).explode("__c").dropna(subset=["__c"])
            out["chunk"] = [c[0] for c in out["__c"]]
            out["content"] = [c[1] for c in out["__c"]]
            yield out.drop(columns="__c")

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*rest).schema)
    return df.select(*rest, text).mapInPandas(run, f"{fields}chunk int, content string")


def line_diff(old: str | None, new: str | None) -> list[str]:
    import difflib

    return [d for d in difflib.ndiff((old or "").splitlines(), (new or "").splitlines()) if d[:1] in "+-"]


def duration_seconds(text: str) -> int:
    """``2h``, ``3d``, ``15m`` or a number of seconds."""
    unit = {"h": 3600, "d": 86_400, "m": 60, "s": 1}.get(text[-1:])
    return int(text[:-1]) * unit if unit else int(text)
