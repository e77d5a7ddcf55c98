"""Contract types, their Spark types, and inference helpers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

from .ast import Node
from .errors import TypeFault


@dataclass(frozen=True)
class Type:
    kind: str  # string integer float boolean nothing list record any
    of: Type | None = None
    fields: tuple[tuple[str, Type], ...] = ()
    maybe: bool = False

    def __str__(self) -> str:
        core = self.kind
        if self.kind == "list":
            core = f"list of {self.of}"
        elif self.kind == "record":
            core = "record " + ", ".join(f"{n} as {t}" for n, t in self.fields) + " end"
        return f"maybe {core}" if self.maybe and self.kind != "nothing" else core

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "float")

    def field(self, name: str) -> Type | None:
        return next((t for n, t in self.fields if n == name), None)

    def optional(self) -> Type:
        return replace(self, maybe=True)

    def required(self) -> Type:
        return replace(self, maybe=False)


STRING, INTEGER, FLOAT, BOOLEAN = (Type(k) for k in ("string", "integer", "float", "boolean"))
NOTHING = Type("nothing", maybe=True)
ANY = Type("any", maybe=True)


def listing(of: Type) -> Type:
    return Type("list", of=of)


def record(fields) -> Type:
    return Type("record", fields=tuple(fields))


def declared(node: Node) -> Type:
    """The type that a type node stands for."""
    if node.name == "maybe":
        return declared(node.of).optional()
    if node.name == "list":
        return listing(declared(node.of))
    if node.name == "record":
        return record((f.name, declared(f.type)) for f in node.fields)
    return Type(node.name)


def spark_type(t: Type) -> T.DataType:
    if t.kind == "list":
        return T.ArrayType(spark_type(t.of), True)
    if t.kind == "record":
        return T.StructType([T.StructField(n, spark_type(f), True) for n, f in t.fields])
    simple = {"string": T.StringType, "integer": T.LongType, "float": T.DoubleType, "boolean": T.BooleanType, "nothing": T.NullType, "any": T.VariantType}
    return simple[t.kind]()


def from_spark(t: T.DataType) -> Type:
    """The contract type nearest to a Spark type; every value may be missing."""
    if isinstance(t, T.ArrayType):
        return listing(from_spark(t.elementType)).optional()
    if isinstance(t, T.StructType):
        return record((f.name, from_spark(f.dataType)) for f in t.fields).optional()
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER.optional()
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT.optional()
    if isinstance(t, T.BooleanType):
        return BOOLEAN.optional()
    if isinstance(t, T.NullType):
        return NOTHING
    if isinstance(t, T.VariantType):
        return ANY
    return STRING.optional()


def unified(a: Type, b: Type, pos=None) -> Type:
    """The type of a value that is either of two: equal kinds, or nothing and anything."""
    if a.kind == "nothing":
        return b.optional()
    if b.kind == "nothing":
        return a.optional()
    maybe = a.maybe or b.maybe
    if a.kind == "any" or b.kind == "any":
        return ANY
    if a.kind != b.kind:
        if a.numeric and b.numeric:
            return Type("float", maybe=maybe)
        raise TypeFault(f"branches give {a} and {b}", pos)
    if a.kind == "list":
        return Type("list", of=unified(a.of, b.of, pos), maybe=maybe)
    if a.kind == "record":
        if [n for n, _ in a.fields] != [n for n, _ in b.fields] and {n for n, _ in a.fields} != {n for n, _ in b.fields}:
            raise TypeFault(f"branches give {a} and {b}", pos)
        return Type("record", fields=tuple((n, unified(t, b.field(n), pos)) for n, t in a.fields), maybe=maybe)
    return replace(a, maybe=maybe)


def fits(value: Type, wanted: Type) -> bool:
    """A value of one type can stand where the other is wanted."""
    if value.kind in ("nothing", "any") or wanted.kind == "any":
        return True
    if value.kind == "list" and wanted.kind == "list":
        return fits(value.of, wanted.of)
    if value.kind == "record" and wanted.kind == "record":
        return all((f := value.field(n)) is not None and fits(f, t) or value.field(n) is None and t.maybe for n, t in wanted.fields)
    return value.kind == wanted.kind or value.kind == "integer" and wanted.kind == "float"
