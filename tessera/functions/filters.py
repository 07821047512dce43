"""Filters on metadata: a small tree, its JSON form, and its compilation to a column that is never null.

Fields are fixed columns or keys of ``custom``, a VARIANT. A value is compared within its own class only: a number never
equals a string, an int never a fraction, and "12" is no number. What an absent field gives is fixed by the operator:
true for notEquals, notIn and notExists, else false.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = ("greaterThan", "lessThan", "greaterThanOrEqual", "lessThanOrEqual")
STRINGS = ("contains", "startsWith", "endsWith")
SIMPLE = ("equals", "notEquals", *COMPARISONS, "in", "notIn", *STRINGS, "exists", "notExists")
LOGICAL = ("and", "or", "not")
#: Names of fixed fields, and their columns.
FIXED = {"documentId": "document_id", "index": "chunk_index", "startOffset": "start_offset", "endOffset": "end_offset", "source": "source"}


@dataclass(frozen=True)
class Filter:
    op: str
    field: str | None = None
    value: Any = None
    parts: tuple[Filter, ...] = ()

    def __post_init__(self) -> None:
        if self.op in SIMPLE:
            if not self.field:
                raise ValueError(f"{self.op} needs a field")
            if self.op in COMPARISONS and (isinstance(self.value, bool) or not isinstance(self.value, int | float)):
                raise ValueError(f"{self.op} needs a number")
            if self.op in STRINGS and not isinstance(self.value, str):
                raise ValueError(f"{self.op} needs a string")
            if self.op in ("in", "notIn") and not isinstance(self.value, list | tuple):
                raise ValueError(f"{self.op} needs a list")
        elif self.op not in LOGICAL or (self.op == "not" and len(self.parts) != 1):
            raise ValueError(f"unknown or ill-formed operator {self.op!r}")

    def __and__(self, other: Filter) -> Filter:
        return all_of(self, other)

    def __or__(self, other: Filter) -> Filter:
        return any_of(self, other)

    def __invert__(self) -> Filter:
        return negated(self)

    def to_json(self) -> dict[str, Any]:
        if self.op in LOGICAL:
            return {"operator": self.op, "filters": [p.to_json() for p in self.parts]}
        out: dict[str, Any] = {"operator": self.op, "field": self.field}
        return out if self.op in ("exists", "notExists") else out | {"value": list(self.value) if isinstance(self.value, tuple) else self.value}

    @staticmethod
    def from_json(node: Any) -> Filter:
        """Raises for ill-formed nodes, so that no filter is widened by mistake."""
        if not isinstance(node, dict) or "operator" not in node:
            raise ValueError(f"no filter: {node!r}")
        if node["operator"] in LOGICAL:
            return Filter(node["operator"], parts=tuple(Filter.from_json(p) for p in node.get("filters", ())))
        if node["operator"] not in ("exists", "notExists") and "value" not in node:
            raise ValueError(f"no value: {node!r}")
        return Filter(node["operator"], node.get("field"), node.get("value"))


def where(field_: str, op: str, value: Any = None) -> Filter:
    return Filter(op, field_, value)


def all_of(*parts: Filter) -> Filter:
    return Filter("and", parts=parts)


def any_of(*parts: Filter) -> Filter:
    return Filter("or", parts=parts)


def negated(part: Filter) -> Filter:
    return Filter("not", parts=(part,))


class Field:
    """A field of a row: presence and typed readings, each null where it does not apply."""

    def present(self) -> Column:
        raise NotImplementedError

    def number(self) -> Column:
        raise NotImplementedError

    def string(self) -> Column:
        raise NotImplementedError

    def equals(self, value: Any) -> Column:
        raise NotImplementedError


class ColumnField(Field):
    """An ordinary column, so that predicates reach the scan."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind

    def present(self) -> Column:
        return self.column.isNotNull()

    def number(self) -> Column:
        return self.column if self.kind in ("int", "double") else F.lit(None).cast("double")

    def string(self) -> Column:
        return self.column if self.kind == "string" else F.lit(None).cast("string")

    def equals(self, value: Any) -> Column:
        same = {"bool": bool, "int": int, "double": float, "string": str}[self.kind]
        return self.column == F.lit(value) if type(value) is same else F.lit(value is None) & self.column.isNull() & F.lit(False)


class VariantField(Field):
    """A key of a VARIANT column."""

    def __init__(self, custom: str, key: str):
        quote = '"' if "'" in key else "'"
        if quote in key or "]" in key:
            raise ValueError(f"no path can name {key!r}")
        path = f"$[{quote}{key}{quote}]"
        self.value = F.variant_get(custom, path, "variant")
        self.kind = F.schema_of_variant(self.value)
        self.read = lambda kind: F.try_variant_get(custom, path, kind)

    def present(self) -> Column:
        return self.value.isNotNull() & ~F.is_variant_null(self.value)

    def number(self) -> Column:
        return F.when(self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), self.read("double"))

    def string(self) -> Column:
        return F.when(self.kind == "STRING", self.read("string"))

    def equals(self, value: Any) -> Column:
        if value is None:
            return F.is_variant_null(self.value)
        if isinstance(value, bool):
            return (self.kind == "BOOLEAN") & (self.read("boolean") == value)
        if isinstance(value, int):
            return (self.kind == "BIGINT") & (self.read("bigint") == value)
        if isinstance(value, float):
            return self.kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (self.read("double") == value)
        if isinstance(value, str):
            return (self.kind == "STRING") & (self.read("string") == value)
        return F.to_json(self.value) == F.to_json(F.parse_json(F.lit(_json(value))))


def _json(value: Any) -> str:
    import json

    return json.dumps(value, sort_keys=True, separators=(",", ":"))


class Fields:
    """How names resolve: fixed columns with their kinds, anything else a key of the VARIANT column ``custom``."""

    def __init__(self, columns: dict[str, tuple[str, str]] | None = None, custom: str | None = "custom"):
        default = {k: (c, "string" if c in ("document_id", "source") else "int") for k, c in FIXED.items()}
        self.columns, self.custom = default if columns is None else columns, custom

    def __getitem__(self, name: str) -> Field:
        if name in self.columns:
            return ColumnField(F.col(self.columns[name][0]), self.columns[name][1])
        if self.custom is None:
            raise KeyError(name)
        return VariantField(self.custom, name)


def compile_filter(node: Filter | Sequence[Filter] | None, fields: Fields | None = None) -> Column:
    """A boolean column that is never null; a list is a conjunction, nothing is true."""
    fields = fields or Fields()
    if node is None:
        return F.lit(True)
    if not isinstance(node, Filter):
        return functools.reduce(lambda a, b: a & b, (compile_filter(n, fields) for n in node), F.lit(True))
    if node.op in ("and", "or"):
        parts = [compile_filter(p, fields) for p in node.parts]
        if not parts:
            return F.lit(node.op == "and")
        return functools.reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)
    if node.op == "not":
        return ~compile_filter(node.parts[0], fields)
    at, never = fields[node.field or ""], F.lit(False)
    known = lambda c: F.coalesce(c, never)
    if node.op in ("equals", "notEquals"):
        same = known(at.equals(node.value))
        return same if node.op == "equals" else ~same
    if node.op in ("in", "notIn"):
        same = functools.reduce(lambda a, b: a | b, (known(at.equals(v)) for v in node.value), never)
        return same if node.op == "in" else ~same
    if node.op in COMPARISONS:
        n, v = at.number(), F.lit(float(node.value))
        return known({"greaterThan": n > v, "lessThan": n < v, "greaterThanOrEqual": n >= v, "lessThanOrEqual": n <= v}[node.op])
    if node.op in STRINGS:
        s, v = at.string(), F.lit(node.value)
        return known({"contains": F.contains(s, v), "startsWith": F.startswith(s, v), "endsWith": F.endswith(s, v)}[node.op])
    there = known(at.present())
    return there if node.op == "exists" else ~there
