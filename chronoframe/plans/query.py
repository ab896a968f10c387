"""Queries: filter, project, sort, offset, limit, aggregate, in that order.

Sorting and aggregation see only what projection leaves, and aggregation only the rows
that offset and limit leave; ``total`` counts before them.  Everything is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.functions.values import Typed, Variant, typed_field, variant_path
from chronoframe.plans.filters import And, Filter, from_dict, from_text


@dataclass(frozen=True)
class Aggregate:
    """``count``, ``sum``, ``avg``, ``min``, ``max``, ``distinct`` or ``group`` (with ``by``
    and, for each group, ``parts`` by name)."""

    kind: str
    field: str | None = None
    parts: tuple[tuple[str, Aggregate], ...] = ()


def count() -> Aggregate:
    return Aggregate("count")


def sum_of(name: str) -> Aggregate:
    return Aggregate("sum", name)


def avg_of(name: str) -> Aggregate:
    return Aggregate("avg", name)


def min_of(name: str) -> Aggregate:
    return Aggregate("min", name)


def max_of(name: str) -> Aggregate:
    return Aggregate("max", name)


def distinct(name: str) -> Aggregate:
    return Aggregate("distinct", name)


def group_by(name: str, **parts: Aggregate) -> Aggregate:
    return Aggregate("group", name, tuple(parts.items()))


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...] = ()
    fields: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    skip: int = 0
    most: int | None = None
    aggregate: Aggregate | None = None
    key: str = "key"
    value: str | None = None

    def where(self, *filters: Filter | dict | str) -> Query:
        made = tuple(
            f if isinstance(f, Filter) else from_text(f) if isinstance(f, str) else from_dict(f)
            for f in filters
        )
        return replace(self, filters=self.filters + made)

    def project(self, *fields: str) -> Query:
        return replace(self, fields=self.fields + fields)

    def sort(self, name: str, ascending: bool = True) -> Query:
        return replace(self, order=(*self.order, (name, ascending)))

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def agg(self, aggregate: Aggregate) -> Query:
        return replace(self, aggregate=aggregate)

    def _field(self, df: DataFrame, name: str) -> Typed | Variant:
        if self.value is None or self.value not in df.columns:
            # a projected dotted path is a column of that literal name
            if name in df.columns:
                kind = df.schema[name].dataType
                return Variant(F.col(f"`{name}`"), "$") if isinstance(kind, T.VariantType) else Typed(F.col(f"`{name}`"), kind)
            return typed_field(df.schema, name)
        kind = df.schema[self.value].dataType
        if isinstance(kind, T.VariantType):
            return Variant(F.col(self.value), variant_path(name))
        return typed_field(kind, name, F.col(self.value))

    def matching(self, df: DataFrame) -> DataFrame:
        return df.where(And(list(self.filters)).compile(lambda n: self._field(df, n)))

    def total(self, df: DataFrame) -> int:
        """Rows that match, before offset and limit."""
        return self.matching(df).count()

    def page(self, df: DataFrame) -> DataFrame:
        """Everything but aggregation."""
        out = self.matching(df)
        if self.fields:
            # what a document lacks is null, and so are all fields that none has
            chosen = {n: self._field(out, n) for n in self.fields}
            chosen = {n: Typed(f._value(), T.VariantType()) if isinstance(f, Variant) else f for n, f in chosen.items()}
            keep = [self.key] if self.key in out.columns and self.key not in self.fields else []
            out = out.select(
                *keep, *(f.column.alias(n) for n, f in chosen.items() if f.kind is not None)
            )
        if self.order:
            by = []
            for name, ascending in self.order:
                f = self._field(out, name)
                c = f.sort_key() if isinstance(f, Variant) else f.column
                if isinstance(f, Typed) and f.kind is None:
                    continue
                by.append(c.asc_nulls_last() if ascending else c.desc_nulls_first())
            if self.key in out.columns:
                by.append(F.col(self.key))
            out = out.orderBy(*by)
        if self.skip:
            out = out.offset(self.skip)
        if self.most is not None:
            out = out.limit(self.most)
        return out

    def run(self, df: DataFrame) -> DataFrame:
        page = self.page(df)
        return page if self.aggregate is None else self._aggregated(page, self.aggregate)

    def _value(self, df: DataFrame, a: Aggregate) -> Column:
        f = self._field(df, a.field)
        if isinstance(f, Variant):
            return f._number() if a.kind in ("sum", "avg") else F.to_json(f._value())
        if f.kind is None:
            return F.lit(None).cast("double" if a.kind in ("sum", "avg") else "string")
        if a.kind in ("sum", "avg"):
            numeric = isinstance(f.kind, T.NumericType)
            return f.column.cast("double") if numeric else F.lit(None).cast("double")
        return f.column

    def _column(self, df: DataFrame, a: Aggregate) -> Column:
        if a.kind == "count":
            return F.count(F.lit(1))
        v = self._value(df, a)
        if a.kind == "sum":
            return F.coalesce(F.sum(v), F.lit(0.0))
        if a.kind == "distinct":
            return F.sort_array(F.collect_set(v))
        f = self._field(df, a.field)
        if isinstance(f, Variant) and a.kind in ("min", "max"):
            # as sorting orders them, not as texts
            return (F.min_by if a.kind == "min" else F.max_by)(v, f.sort_key())
        return {"avg": F.avg, "min": F.min, "max": F.max}[a.kind](v)

    def _aggregated(self, df: DataFrame, a: Aggregate, name: str = "value") -> DataFrame:
        if a.kind == "distinct":
            # rows, not one array: distinct values may be as many as the rows
            return df.select(self._value(df, a).alias(name)).where(F.col(name).isNotNull()).distinct()
        if a.kind != "group":
            return df.agg(self._column(df, a).alias(name))
        return self._grouped(df, a, [])

    def _grouped(self, df: DataFrame, a: Aggregate, outer: list[str]) -> DataFrame:
        """Groups within groups are more grouping columns; aggregates beside an inner group
        stand in each of its rows."""
        by = [*outer, a.field]
        if not outer or a.field not in df.columns or self.value in df.columns:
            df = df.withColumn(a.field, self._value(df, replace(a, kind="group")))
        own = [(n, p) for n, p in a.parts if p.kind != "group"]
        inner = [p for _, p in a.parts if p.kind == "group"]
        if len(inner) > 1:
            raise ValueError("a group holds one inner group at most")
        names = [f"`{c}`" for c in by]
        told = df.groupBy(*names).agg(*(self._column(df, p).alias(n) for n, p in own)) if own or not inner else None
        if not inner:
            return told
        below = self._grouped(df, inner[0], by)
        if told is None:
            return below
        same = [below[c].eqNullSafe(told[c]) for c in names]
        return below.join(told, same).select(*(below[c] for c in names), *(told[n] for n, _ in own), *(below[f"`{c}`"] for c in below.columns if c not in by))


@dataclass(frozen=True)
class HistoryQuery:
    """A query over all versions of keys, bounded in time, with the newest per key."""

    query: Query = field(default_factory=Query)
    start: Any = None
    end: Any = None
    newest: int | None = None
    keys: Sequence[str] = ("key",)
    ts: str = "ts"
    seq: str = "seq"

    def run(self, log: DataFrame) -> DataFrame:
        if self.start is not None:
            log = log.where(F.col(self.ts) >= self.start)
        if self.end is not None:
            log = log.where(F.col(self.ts) <= self.end)
        log = self.query.matching(log)
        if self.newest is not None:
            last = Window.partitionBy(*self.keys).orderBy(F.desc(self.ts), F.desc(self.seq))
            log = log.withColumn("__n", F.row_number().over(last))
            log = log.where(F.col("__n") <= self.newest).drop("__n")
        return replace(self.query, filters=()).run(log)
