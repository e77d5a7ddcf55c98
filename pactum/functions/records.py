"""Record functions; records have static names, so all of them are settled in the plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import TypeFault
from ..types import ANY, STRING, listing, record, unified
from .base import Args, Library, Typed, function, lit, out

FUNCTIONS: Library = {}


def assemble(fields: dict[str, Typed]) -> Typed:
    col = F.struct(*[v.col.alias(n) for n, v in fields.items()]) if fields else F.struct()
    return Typed(col, record((n, v.type) for n, v in fields.items()), parts=fields)


def fields_of(a: Args, *names: str) -> dict[str, Typed]:
    v = a.of("record", *names)
    if v.type.kind == "nothing":
        raise TypeFault(f"{a.name}: {names[0]} is nothing", a.pos)
    return {n: v.field(n) for n, _ in v.type.fields}


def named(a: Args) -> list[str]:
    v = a.get("fields")
    if not v.known:
        raise TypeFault(f"{a.name}: fields must be a list of literals", a.pos)
    return list(v.literal)


@function(FUNCTIONS, "keys")
def keys(a: Args) -> Typed:
    names = list(fields_of(a, "record"))
    found = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return Typed(found, listing(STRING), literal=names, known=True)


@function(FUNCTIONS, "values")
def values(a: Args) -> Typed:
    every = list(fields_of(a, "record").values())
    if not every:
        return Typed(F.array(), listing(ANY))
    kinds = {v.type.kind for v in every} - {"nothing"}
    if len(kinds) <= 1 or kinds <= {"integer", "float"} and len(kinds) == 1:
        t = every[0].type
        for v in every[1:]:
            t = unified(t, v.type, a.pos)
        return Typed(F.array(*[v.col for v in every]), listing(t))
    variants = [F.to_variant_object(F.array(v.col)) if v.type.kind in ("record", "list") else v.col.cast("variant") for v in every]
    variants = [F.variant_get(x, "$[0]", "variant") if v.type.kind in ("record", "list") else x for x, v in zip(variants, every, strict=True)]
    return Typed(F.array(*variants), listing(ANY))


@function(FUNCTIONS, "merge")
def merge(a: Args) -> Typed:
    return assemble(fields_of(a, "a") | fields_of(a, "b"))


@function(FUNCTIONS, "pick")
def pick(a: Args) -> Typed:
    own = fields_of(a, "record")
    return assemble({n: own[n] for n in named(a) if n in own})


@function(FUNCTIONS, "omit")
def omit(a: Args) -> Typed:
    gone = set(named(a))
    return assemble({n: v for n, v in fields_of(a, "record").items() if n not in gone})


__all__ = ["FUNCTIONS", "assemble", "lit", "out"]
