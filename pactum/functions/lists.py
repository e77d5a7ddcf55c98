"""List functions over arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import TypeFault
from ..operators.equality import equal, tolerant
from ..types import FLOAT, INTEGER, Type, listing, record, spark_type
from .base import Args, Library, Typed, function, out

FUNCTIONS: Library = {}


def elements(a: Args, *names: str) -> Typed:
    v = a.of("list", *names)
    if v.type.kind == "nothing":
        raise TypeFault(f"{a.name}: {names[0]} is nothing", a.pos)
    return v


@function(FUNCTIONS, "sort")
def sort(a: Args) -> Typed:
    v = elements(a, "list")
    return out(a, F.array_sort(v.col), v.type.required()) if v.type.of.kind not in ("record", "list") else out(a, v.col, v.type.required())


@function(FUNCTIONS, "sort-by")
def sort_by(a: Args) -> Typed:
    v, name = elements(a, "list"), a.constant("field")
    if v.type.of.kind != "record" or v.type.of.field(name) is None:
        return out(a, v.col, v.type.required())
    at = F.transform(v.col, lambda x, i: F.struct(x.getField(name).isNull().alias("n"), x.getField(name).alias("k"), i.alias("i"), x.alias("x")))
    order = at if v.type.of.field(name).kind not in ("record", "list") else F.transform(v.col, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    # Struct order does the sorting: missing last, then the field, then the place in the list; records need no order of their own.
    keyed = F.array_sort(F.transform(order, lambda s: F.struct(s.n, s.k, s.i))) if order is at else None
    if keyed is None:
        return out(a, v.col, v.type.required())
    return out(a, F.transform(keyed, lambda s: F.get(v.col, s.i)), v.type.required())


@function(FUNCTIONS, "reverse")
def reverse(a: Args) -> Typed:
    v = elements(a, "list")
    return out(a, F.reverse(v.col), v.type.required())


@function(FUNCTIONS, "unique")
def unique(a: Args) -> Typed:
    v = elements(a, "list")
    if not tolerant(v.type.of):
        return out(a, F.array_distinct(v.col), v.type.required())
    element = v.type.of
    empty = F.array().cast(spark_type(listing(element)))

    def add(seen, x):
        return F.when(F.exists(seen, lambda y: equal(Typed(x, element), Typed(y, element))), seen).otherwise(F.array_append(seen, x))

    return out(a, F.aggregate(v.col, empty, add), v.type.required())


@function(FUNCTIONS, "flatten")
def flatten(a: Args) -> Typed:
    v = elements(a, "list")
    if v.type.of.kind != "list":
        return out(a, v.col, v.type.required())
    return out(a, F.flatten(v.col), v.type.of.required())


@function(FUNCTIONS, "zip")
def zip_lists(a: Args) -> Typed:
    x, y = elements(a, "a"), elements(a, "b")
    n = F.least(F.size(x.col), F.size(y.col))
    pairs = F.transform(F.slice(x.col, 1, n), lambda v, i: F.struct(v.alias("a"), F.get(y.col, i).alias("b")))
    return out(a, pairs, listing(record([("a", x.type.of), ("b", y.type.of)])))


@function(FUNCTIONS, "range")
def number_range(a: Args) -> Typed:
    return out(a, F.sequence(a.integer("start"), a.integer("end")), listing(INTEGER))


@function(FUNCTIONS, "slice")
def slice_list(a: Args) -> Typed:
    v = elements(a, "list")
    start = F.greatest(a.integer("start"), F.lit(0)).cast("int")
    end = F.greatest(a.integer("end"), F.lit(0)).cast("int")
    return out(a, F.slice(v.col, start + 1, F.greatest(end - start, F.lit(0))), v.type.required())


FOLDS = {"add": lambda s, x: s + x, "multiply": lambda s, x: s * x}


def fold_kind(a: Args, element: Type, initial: Type) -> Type:
    if element.kind not in ("integer", "float", "nothing") or not initial.numeric:
        raise TypeFault(f"fold takes numbers, not {element} and {initial}", a.pos)
    return INTEGER if element.kind != "float" and initial.kind == "integer" else FLOAT


def fold_name(a: Args) -> str:
    fn = a.constant("fn")
    if fn not in FOLDS:
        raise TypeFault(f"fold knows add and multiply, not {fn}", a.pos)
    return fn


@function(FUNCTIONS, "fold")
def fold(a: Args) -> Typed:
    v, initial, fn = elements(a, "list"), a.get("initial"), fold_name(a)
    kind = fold_kind(a, v.type.of, initial.type)
    items = F.transform(v.col, lambda x: x.cast("double")) if kind == FLOAT and v.type.of.kind != "float" else v.col
    if v.type.of.kind == "nothing":
        items = v.col.cast(spark_type(listing(kind)))
    return out(a, F.aggregate(items, initial.col.cast(spark_type(kind)), FOLDS[fn]), kind)
