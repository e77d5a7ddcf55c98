"""Numeric functions. Results keep the kind of their arguments; ceil, floor and round give integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FLOAT, INTEGER, Type
from .base import Args, Library, Typed, function, out

FUNCTIONS: Library = {}
NUMBER = ("integer", "float")


@function(FUNCTIONS, "abs")
def absolute(a: Args) -> Typed:
    v = a.of(NUMBER, "value")
    return out(a, F.abs(v.col), v.type.required())


def _whole(name: str, build) -> None:
    @function(FUNCTIONS, name)
    def call(a: Args) -> Typed:
        v = a.of(NUMBER, "value")
        return out(a, v.col if v.type.kind == "integer" else build(v.col).cast("bigint"), INTEGER)


_whole("ceil", F.ceil)
_whole("floor", F.floor)
_whole("round", F.round)


def _common(values: list[Typed]) -> tuple[list[Column], Type]:
    if all(v.type.kind == "integer" for v in values):
        return [v.col for v in values], INTEGER
    return [v.col.cast("double") for v in values], FLOAT


def _pick(name: str, first) -> None:
    @function(FUNCTIONS, name)
    def call(a: Args) -> Typed:
        (x, y), t = _common([a.of(NUMBER, "a"), a.of(NUMBER, "b")])
        return out(a, F.when(first(x, y), x).when(y.isNotNull() & x.isNotNull(), y), t)


_pick("min", lambda x, y: x <= y)
_pick("max", lambda x, y: x >= y)


@function(FUNCTIONS, "clamp")
def clamp(a: Args) -> Typed:
    (v, low, high), t = _common([a.of(NUMBER, "value"), a.of(NUMBER, "min", "low"), a.of(NUMBER, "max", "high")])
    every = v.isNotNull() & low.isNotNull() & high.isNotNull()
    return out(a, F.when(every, F.when(v < low, low).when(v > high, high).otherwise(v)), t)
