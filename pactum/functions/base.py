"""Typed columns and the helpers that functions are made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ast import Node
from ..errors import TypeFault
from ..types import Type, spark_type


@dataclass
class Typed:
    """A column with its contract type; `literal` holds the value where it is known before any row is."""

    col: Column
    type: Type
    literal: Any = field(default=None)
    known: bool = False
    #: Builds the field columns of a record that is put together in the plan, so that no struct is needed for them.
    parts: dict[str, Typed] | None = None

    def field(self, name: str) -> Typed:
        if self.parts is not None:
            return self.parts[name]
        t = self.type.field(name)
        return Typed(self.col.getField(name), t.optional() if self.type.maybe else t)


@dataclass
class Args:
    """The arguments of one call."""

    values: dict[str, Typed]
    name: str
    pos: Any
    env: Any = None
    #: The call stands inside a list step, where no Python function can run.
    inside: bool = False

    def has(self, *names: str) -> bool:
        return any(n in self.values for n in names)

    def get(self, *names: str) -> Typed:
        """The argument under the first of its names that is given."""
        for n in names:
            if n in self.values:
                return self.values[n]
        raise TypeFault(f"{self.name} needs {names[0]}", self.pos)

    def of(self, kinds: str | tuple[str, ...], *names: str) -> Typed:
        v = self.get(*names)
        wanted = (kinds,) if isinstance(kinds, str) else kinds
        if v.type.kind == "nothing":
            return v
        if v.type.kind not in wanted:
            raise TypeFault(f"{self.name}: {names[0]} is {v.type}, not {' or '.join(wanted)}", self.pos)
        return v

    def string(self, *names: str) -> Column:
        return self.of("string", *names).col

    def integer(self, *names: str) -> Column:
        return self.of("integer", *names).col

    def constant(self, *names: str):
        v = self.get(*names)
        if not v.known:
            raise TypeFault(f"{self.name}: {names[0]} must be a literal", self.pos)
        return v.literal

    def maybe(self) -> bool:
        return any(v.type.maybe for v in self.values.values())


Builder = Callable[[Args], Typed]


@dataclass(frozen=True)
class Function:
    name: str
    build: Builder


Library = dict[str, Function]


def function(library: Library, name: str) -> Callable[[Builder], Builder]:
    def put(build: Builder) -> Builder:
        library[name] = Function(name, build)
        return build

    return put


def lit(value: Any, t: Type) -> Typed:
    col = F.lit(value).cast(spark_type(t)) if t.kind != "nothing" else F.lit(None)
    return Typed(col, t, literal=value, known=True)


def out(args: Args, col: Column, t: Type) -> Typed:
    """A result that is nothing where an argument is."""
    return Typed(col, t.optional() if args.maybe() else t)


def fail(message: str, node: Node | None = None) -> Column:
    return F.raise_error(F.lit(message))
