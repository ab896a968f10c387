"""Filters of documents, compiled to one boolean column.

Every test is true or false, never null: a missing field fails each test but ``Ne``, and
``Not`` is the exact complement.  So each compiled test is closed with ``coalesce`` before
anything negates it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.values import Typed, Variant

Field = Typed | Variant
Lookup = Callable[[str], Field]


class Filter:
    def compile(self, field: Lookup) -> Column:
        raise NotImplementedError

    def __and__(self, other: Filter) -> Filter:
        return And([self, other])

    def __or__(self, other: Filter) -> Filter:
        return Or([self, other])

    def __invert__(self) -> Filter:
        return Not(self)


def closed(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Eq(Filter):
    field: str
    value: Any

    def compile(self, field: Lookup) -> Column:
        return closed(field(self.field).equals(self.value))


@dataclass(frozen=True)
class Ne(Filter):
    field: str
    value: Any

    def compile(self, field: Lookup) -> Column:
        return ~closed(field(self.field).equals(self.value))


@dataclass(frozen=True)
class Gt(Filter):
    field: str
    value: Any

    def compile(self, field: Lookup) -> Column:
        return closed(field(self.field).compares(self.value)[1])


@dataclass(frozen=True)
class Gte(Filter):
    field: str
    value: Any

    def compile(self, field: Lookup) -> Column:
        f = field(self.field)
        return closed(f.compares(self.value)[1]) | closed(f.equals(self.value))


@dataclass(frozen=True)
class Lt(Filter):
    field: str
    value: Any

    def compile(self, field: Lookup) -> Column:
        return closed(field(self.field).compares(self.value)[0])


@dataclass(frozen=True)
class Lte(Filter):
    field: str
    value: Any

    def compile(self, field: Lookup) -> Column:
        f = field(self.field)
        return closed(f.compares(self.value)[0]) | closed(f.equals(self.value))


@dataclass(frozen=True)
class Contains(Filter):
    """Part of a string, member of an array, key of an object."""

    field: str
    value: Any

    def compile(self, field: Lookup) -> Column:
        return closed(field(self.field).contains(self.value))


@dataclass(frozen=True)
class Exists(Filter):
    field: str

    def compile(self, field: Lookup) -> Column:
        return closed(field(self.field).present())


@dataclass(frozen=True)
class Matches(Filter):
    """A regular expression found anywhere in a string.  One that can't be compiled, or
    needs look-around or back-references, matches nothing."""

    field: str
    pattern: str

    def compile(self, field: Lookup) -> Column:
        if re.search(r"\(\?<?[=!]|\\[1-9]", self.pattern):
            return F.lit(False)
        try:
            re.compile(self.pattern)
        except re.error:
            return F.lit(False)
        return closed(field(self.field).text().rlike(self.pattern))


@dataclass(frozen=True)
class And(Filter):
    parts: list[Filter]

    def compile(self, field: Lookup) -> Column:
        return reduce(Column.__and__, (p.compile(field) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Or(Filter):
    parts: list[Filter]

    def compile(self, field: Lookup) -> Column:
        return reduce(Column.__or__, (p.compile(field) for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def compile(self, field: Lookup) -> Column:
        return ~self.part.compile(field)


BY_NAME = {"eq": Eq, "ne": Ne, "gt": Gt, "gte": Gte, "lt": Lt, "lte": Lte, "contains": Contains}


def from_dict(spec: Mapping[str, Any]) -> Filter:
    """``{"field": ..., "op": ..., "value": ...}``; any other mapping is equalities."""
    if set(spec) >= {"field", "op"}:
        op = str(spec["op"]).lower()
        if op == "exists":
            return Exists(spec["field"])
        if op == "matches":
            return Matches(spec["field"], spec["value"])
        if op not in BY_NAME:
            raise ValueError(f"unknown operator {op!r}")
        return BY_NAME[op](spec["field"], spec.get("value"))
    return And([Eq(k, v) for k, v in spec.items()])


SIGNS = ((">=", Gte), ("<=", Lte), ("!=", Ne), ("=", Eq), (">", Gt), ("<", Lt))


def literal(text: str) -> Any:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def from_text(text: str) -> Filter:
    """``field op literal``, the operators tried in the order of SIGNS."""
    for sign, kind in SIGNS:
        name, found, value = text.partition(sign)
        if found:
            return kind(name.strip(), literal(value))
    raise ValueError(f"no operator in {text!r}")
