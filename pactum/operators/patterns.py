"""Patterns as predicates over a typed column, with the columns that they bind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ast import Node
from ..errors import TypeFault
from ..functions.base import Typed, lit
from ..types import BOOLEAN, FLOAT, INTEGER, NOTHING, STRING, Type
from .equality import equal


def literal(value) -> Typed:
    kind = NOTHING if value is None else BOOLEAN if isinstance(value, bool) else INTEGER if isinstance(value, int) else FLOAT if isinstance(value, float) else STRING
    return lit(value, kind)


def matched(p: Node, on: Typed, lower) -> tuple[Column, dict[str, Typed]]:
    """(predicate that is never null, bindings). `lower` builds the bounds of ranges."""
    if p.kind == "any":
        return F.lit(True), {}
    if p.kind == "bind":
        return F.lit(True), {p.name: on}
    if p.kind == "literal":
        return equal(on, literal(p.value)), {}
    if p.kind == "between":
        low, high = lower(p.low), lower(p.high)
        kinds = {on.type.kind, low.type.kind, high.type.kind}
        if kinds <= {"integer", "float"} or kinds == {"string"}:
            return F.coalesce(on.col.between(low.col, high.col), F.lit(False)), {}
        return F.lit(False), {}
    if p.kind == "listing":
        return _listing(p, on, lower)
    if p.kind == "open-record":
        if on.type.kind != "record" or any(on.type.field(n) is None for n, _ in p.fields):
            return F.lit(False), {n: Typed(F.lit(None), NOTHING) for n in _names(p)}
        test, bound = (on.col.isNotNull() if on.type.maybe else F.lit(True)), {}
        for n, x in p.fields:
            t, b = matched(x, on.field(n), lower)
            test, bound = test & t, bound | b
        return test, bound
    raise TypeFault(f"unknown pattern {p.kind}", p.pos)


def _listing(p: Node, on: Typed, lower) -> tuple[Column, dict[str, Typed]]:
    if on.type.kind != "list":
        return F.lit(False), {n: Typed(F.lit(None), NOTHING) for n in _names(p)}
    n = len(p.items)
    size = F.size(on.col)
    test = size >= n if p.open else size == n
    if on.type.maybe:
        test = F.coalesce(on.col.isNotNull() & test, F.lit(False))
    bound: dict[str, Typed] = {}
    element: Type = on.type.of
    for i, x in enumerate(p.items):
        t, b = matched(x, Typed(F.get(on.col, F.lit(i)), element), lower)
        test, bound = test & t, bound | b
    if p.rest:
        bound[p.rest] = Typed(F.slice(on.col, n + 1, F.greatest(size - n, F.lit(0))), on.type)
    return test, bound


def _names(p: Node) -> list[str]:
    if p.kind == "bind":
        return [p.name]
    if p.kind == "listing":
        return [n for x in p.items for n in _names(x)] + ([p.rest] if p.rest else [])
    if p.kind == "open-record":
        return [n for _, x in p.fields for n in _names(x)]
    return []
