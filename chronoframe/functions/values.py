"""Values of documents: dotted paths, equality, comparison, containment.

A document is either typed columns (a null column is a missing field) or one VARIANT
column, in which an explicit null and a missing field differ.  Both kinds of field answer
the same questions, so a filter compiles against either.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Typed:
    """A field of a typed document; ``kind`` is None where the path leads nowhere."""

    column: Column
    kind: T.DataType | None

    def present(self) -> Column:
        return self.column.isNotNull()

    def equals(self, x: Any) -> Column:
        if x is None or self.kind is None or not _comparable(self.kind, x):
            return F.lit(False)
        return self.column == F.lit(x)

    def compares(self, x: Any) -> tuple[Column, Column]:
        """(less, greater) than a literal of the same kind."""
        if x is None or self.kind is None or not _comparable(self.kind, x):
            return F.lit(False), F.lit(False)
        return self.column < F.lit(x), self.column > F.lit(x)

    def contains(self, x: Any) -> Column:
        if isinstance(self.kind, T.StringType):
            return F.contains(self.column, F.lit(x)) if isinstance(x, str) else F.lit(False)
        if isinstance(self.kind, T.ArrayType) and _comparable(self.kind.elementType, x):
            return F.array_contains(self.column, x)
        if isinstance(self.kind, T.MapType):
            return F.map_contains_key(self.column, x)
        if isinstance(self.kind, T.StructType):
            return self.column.isNotNull() & F.lit(x in self.kind.names)
        return F.lit(False)

    def text(self) -> Column:
        return self.column if isinstance(self.kind, T.StringType) else F.lit(None).cast("string")


def _comparable(kind: T.DataType, x: Any) -> bool:
    if isinstance(x, bool) or isinstance(kind, T.BooleanType):
        return isinstance(x, bool) and isinstance(kind, T.BooleanType)
    if isinstance(x, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(x, str):
        return isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return not isinstance(kind, T.NumericType)


@dataclass(frozen=True)
class Variant:
    """A field of a VARIANT document."""

    column: Column
    path: str

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self.column, self.path, kind)

    def _value(self) -> Column:
        return self._as("variant")

    def _is(self, *kinds: str) -> Column:
        return F.coalesce(F.schema_of_variant(self._value()).isin(*kinds), F.lit(False))

    def _number(self) -> Column:
        schema = F.schema_of_variant(self._value())
        numeric = schema.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")
        return F.when(numeric, self._as("double"))

    def _null(self) -> Column:
        return F.coalesce(F.is_variant_null(self._value()), F.lit(False))

    def present(self) -> Column:
        return self._value().isNotNull() & ~self._null()

    def equals(self, x: Any) -> Column:
        if x is None:
            return self._null()
        if isinstance(x, bool):
            return self._is("BOOLEAN") & (self._as("boolean") == x)
        if isinstance(x, (int, float)):
            return self._number() == float(x)
        if isinstance(x, str):
            return self.text() == x
        return F.to_json(self._value()) == F.to_json(F.parse_json(F.lit(json.dumps(x))))

    def compares(self, x: Any) -> tuple[Column, Column]:
        none = F.lit(False)
        if x is None:
            return none, self.present()
        if isinstance(x, bool):
            v = F.when(self._is("BOOLEAN"), self._as("boolean"))
        elif isinstance(x, (int, float)):
            v, x = self._number(), float(x)
        elif isinstance(x, str):
            v = self.text()
        else:
            return self._null(), none
        return self._null() | F.coalesce(v < F.lit(x), none), v > F.lit(x)

    def contains(self, x: Any) -> Column:
        found = F.lit(False)
        if isinstance(x, str):
            key = F.lit(x)
            keys = F.map_keys(F.coalesce(self._as("map<string,variant>"), F.create_map().cast("map<string,variant>")))
            found = F.coalesce(F.contains(self.text(), key), F.lit(False)) | F.array_contains(keys, key)
        members = F.transform(self._as("array<variant>"), lambda m: F.to_json(m))
        same = F.to_json(F.parse_json(F.lit(json.dumps(x))))
        return found | F.coalesce(F.array_contains(members, same), F.lit(False))

    def text(self) -> Column:
        return F.when(self._is("STRING"), self._as("string"))

    def sort_key(self) -> Column:
        """Null first, then numbers, strings, truth values, anything else."""
        rank = (
            F.when(self._null(), 0)
            .when(self._number().isNotNull(), 1)
            .when(self._is("STRING"), 2)
            .when(self._is("BOOLEAN"), 3)
            .otherwise(4)
        )
        key = F.struct(rank.alias("rank"), self._number().alias("n"), self.text().alias("s"), F.when(self._is("BOOLEAN"), self._as("boolean")).alias("b"))
        return F.when(self._value().isNotNull(), key)


def variant_path(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))


def typed_field(schema: T.StructType, path: str, root: Column | None = None) -> Typed:
    """The field at a dotted path; digits index arrays from 0."""
    kind: T.DataType | None = schema
    column = root
    for part in path.split("."):
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return Typed(F.lit(None), None)
            column = F.col(f"`{part}`") if column is None else column.getField(part)
            kind = kind[part].dataType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            column, kind = F.get(column, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        else:
            return Typed(F.lit(None), None)
    return Typed(column, kind)


def content_id(json_text: Column) -> Column:
    """Equal for equal documents, whatever the order of their keys; text that is no JSON
    counts as it stands."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(json_text)), json_text), 256)
