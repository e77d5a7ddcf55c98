"""Equality of typed columns: kinds must agree, floats within a relative 1e-9, nothing equals nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Type

TOLERANCE = 1e-9


def tolerant(t: Type) -> bool:
    """Values of the type hold floats."""
    return t.kind == "float" or t.of is not None and tolerant(t.of) or any(tolerant(f) for _, f in t.fields)


def equal(a, b) -> Column:
    """True or false, never null. a and b are Typed."""
    from ..functions.base import Typed

    x, y = a.type, b.type
    if x.kind == "nothing" or y.kind == "nothing":
        return a.col.isNull() if y.kind == "nothing" and x.kind != "nothing" else b.col.isNull() if x.kind == "nothing" and y.kind != "nothing" else F.lit(True)
    if x.kind == "any" or y.kind == "any":
        return F.coalesce(F.to_json(a.col) == F.to_json(b.col), a.col.isNull() & b.col.isNull())
    if x.kind != y.kind:
        both = a.col.isNull() & b.col.isNull()
        return both if x.maybe and y.maybe else F.lit(False)
    if x.kind == "float":
        near = (a.col == b.col) | (F.abs(a.col - b.col) <= F.greatest(F.abs(a.col), F.abs(b.col)) * TOLERANCE)
        return _settled(near, a, b)
    if x.kind == "list" and (tolerant(x) or tolerant(y)):
        same = F.forall(F.zip_with(a.col, b.col, lambda p, q: equal(Typed(p, x.of.optional()), Typed(q, y.of.optional()))), lambda v: v)
        return _settled((F.size(a.col) == F.size(b.col)) & same, a, b)
    if x.kind == "list":
        return a.col.eqNullSafe(b.col) if x.of.kind == y.of.kind else _settled((F.size(a.col) == 0) & (F.size(b.col) == 0), a, b)
    if x.kind == "record":
        if {n for n, _ in x.fields} != {n for n, _ in y.fields}:
            return a.col.isNull() & b.col.isNull() if x.maybe and y.maybe else F.lit(False)
        every = F.lit(True)
        for n, _ in x.fields:
            every = every & equal(a.field(n), b.field(n))
        return _settled(every, a, b)
    return a.col.eqNullSafe(b.col) if x.maybe or y.maybe else a.col == b.col


def _settled(same: Column, a, b) -> Column:
    if not a.type.maybe and not b.type.maybe:
        return same
    return F.when(a.col.isNull() | b.col.isNull(), a.col.isNull() & b.col.isNull()).otherwise(same)
