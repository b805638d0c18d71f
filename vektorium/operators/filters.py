"""Typed predicates with the store's null rules, lowered to two-valued column expressions.

With fixed columns a missing key is SQL null, and a predicate on it is false for every operator, ``ne``
included. In JSON metadata a key may be present with null: there ``eq null`` and ``ne value`` hold.
Numbers compare as numbers whatever their kind; other kinds must match (else ``eq`` is false and ``ne``
true on a present key); order comparisons hold between numbers only, and ``gte``/``lte`` also where the
values are equal; ``contains`` is a case-sensitive substring of a string. NaN equals nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op}")
        if self.op == "in" and not isinstance(self.value, (list, tuple)):
            raise ValueError("in takes a list")


def _kind(value: Any) -> str:
    return "null" if value is None else "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array"


def _type_kind(t: T.DataType) -> str:
    return "bool" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else "string" if isinstance(t, T.StringType) else "array" if isinstance(t, T.ArrayType) else "other"


def _not_nan(c: Column, t: T.DataType) -> Column:
    return ~F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(True)


def _eq(c: Column, t: T.DataType, value: Any) -> Column:
    if _kind(value) != _type_kind(t) or value != value:
        return F.lit(False)
    if _kind(value) == "array":
        return (F.size(c) == len(value)) & functools.reduce(lambda a, b: a & b, (_eq(F.element_at(c, i + 1), t.elementType, v) for i, v in enumerate(value)), F.lit(True))
    return _not_nan(c, t) & (c == F.lit(value))


def lower(schema: T.StructType, f: Filter) -> Column:
    """The predicate over a column of ``schema``, never null; a field that isn't there is missing in every row."""
    return F.coalesce(_condition(schema, f), F.lit(False))


def _condition(schema: T.StructType, f: Filter) -> Column:
    """The predicate, true exactly where ``lower`` is (else false or null): plain enough for the scan to push down."""
    if f.field not in schema.fieldNames():
        return F.lit(False)
    c, t = F.col(f"`{f.field}`"), schema[f.field].dataType
    if f.op == "eq":
        p = _eq(c, t, f.value)
    elif f.op == "ne":
        p = ~_eq(c, t, f.value) if _kind(f.value) == _type_kind(t) else F.lit(True)
    elif f.op == "in":
        p = functools.reduce(lambda a, b: a | b, (_eq(c, t, v) for v in f.value), F.lit(False)) if not _plain(t, f.value) else _not_nan(c, t) & c.isin(*(v for v in f.value if _kind(v) == _type_kind(t)))
    elif f.op == "contains":
        p = c.contains(F.lit(f.value)) if isinstance(f.value, str) and _type_kind(t) == "string" else F.lit(False)
    else:
        number = _type_kind(t) == "number" and _kind(f.value) == "number" and f.value == f.value
        p = F.lit(False)
        if number:
            p = _not_nan(c, t) & {"gt": c > F.lit(f.value), "gte": c >= F.lit(f.value), "lt": c < F.lit(f.value), "lte": c <= F.lit(f.value)}[f.op]
        elif f.op in ("gte", "lte"):
            p = _eq(c, t, f.value)
    return c.isNotNull() & p


def _plain(t: T.DataType, values: Sequence[Any]) -> bool:
    return _type_kind(t) in ("string", "number") and all(v == v for v in values) and any(_kind(v) == _type_kind(t) for v in values)


def apply(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows that satisfy all filters; no filters, all rows. Simple comparisons reach the parquet scan."""
    for f in filters:
        df = df.where(_condition(df.schema, f))
    return df


def lower_json(doc: Column, f: Filter) -> Column:
    """The predicate over a VARIANT document, where a key can be present with null."""
    present = F.array_contains(F.json_object_keys(F.to_json(doc)), f.field)
    kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{f.field}", "variant"))
    number, text = F.try_variant_get(doc, f"$.{f.field}", "double"), F.try_variant_get(doc, f"$.{f.field}", "string")
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")

    def eq(v: Any) -> Column:
        k = _kind(v)
        if k == "null":
            return kind == "VOID"
        if k == "number":
            return is_number & (number == F.lit(float(v)))
        if k == "bool":
            return (kind == "BOOLEAN") & (text == F.lit(str(v).lower()))
        return (kind == "STRING") & (text == F.lit(v)) if k == "string" else F.lit(False)

    v = f.value
    if f.op == "eq":
        p = eq(v)
    elif f.op == "ne":
        p = ~F.coalesce(eq(v), F.lit(False))
    elif f.op == "in":
        p = functools.reduce(lambda a, b: a | b, (F.coalesce(eq(x), F.lit(False)) for x in v), F.lit(False))
    elif f.op == "contains":
        p = (kind == "STRING") & text.contains(v) if isinstance(v, str) else F.lit(False)
    elif _kind(v) == "number":
        p = is_number & {"gt": number > v, "gte": number >= v, "lt": number < v, "lte": number <= v}[f.op]
    else:
        p = eq(v) if f.op in ("gte", "lte") else F.lit(False)
    return F.coalesce(present & p, F.lit(False))


def violations(df: DataFrame, declared: Mapping[str, str]) -> Column:
    """Names of declared fields whose column has the wrong kind; unknown fields and nulls pass, floats accept ints.

    ``declared`` maps a field to any, int, float, string, bool or array.
    """
    bad = []
    for name, want in declared.items():
        if name not in df.schema.fieldNames() or want == "any":
            continue
        t = df.schema[name].dataType
        have = "int" if isinstance(t, T.IntegralType) else "float" if isinstance(t, T.FractionalType) else _type_kind(t)
        c = F.col(f"`{name}`")
        if have == want or (want == "float" and have == "int"):
            continue
        wrong = c.isNotNull()
        if want == "int" and have == "float":
            wrong = wrong & (F.isnan(c) | (c != F.floor(c)))
        bad.append(F.when(wrong, F.lit(name)))
    return F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")
