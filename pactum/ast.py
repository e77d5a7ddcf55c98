"""Syntax trees: one node class whose `kind` says what its parts are.

Expressions: literal(value) input(name) name(name) record(fields) list(items) field(of, name) index(of, at) negate(of)
not(of) binary(op, left, right) is(of, what) if(branches, other) match(on, clauses, other) filter(of, var, test)
map(of, var, body) call(name, args) through(value, step) lookup(source, keys).
Patterns: literal any bind(name) between(low, high) listing(items, open, rest) open_record(fields).
Types: type(name, of | fields). Contracts: see parser.contract.
"""

from __future__ import annotations

from typing import Any


class Node:
    __slots__ = ("kind", "parts", "pos")

    def __init__(self, kind: str, pos=None, **parts: Any):
        self.kind, self.pos, self.parts = kind, pos, parts

    def __getattr__(self, name: str) -> Any:
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(name) from None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and self.kind == other.kind and self.parts == other.parts

    __hash__ = None

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.parts.items())})"

    def with_parts(self, **parts: Any) -> Node:
        return Node(self.kind, self.pos, **(self.parts | parts))


def to_plain(x: Any) -> Any:
    """A tree as JSON values."""
    if isinstance(x, Node):
        return {"node": x.kind, "pos": list(x.pos) if x.pos else None} | {k: to_plain(v) for k, v in x.parts.items()}
    if isinstance(x, (list, tuple)):
        return [to_plain(v) for v in x]
    if isinstance(x, float):
        return {"float": repr(x)}
    return x


def from_plain(x: Any) -> Any:
    if isinstance(x, dict) and "float" in x:
        return float(x["float"])
    if isinstance(x, dict):
        parts = {k: from_plain(v) for k, v in x.items() if k not in ("node", "pos")}
        return Node(x["node"], tuple(x["pos"]) if x["pos"] else None, **parts)
    if isinstance(x, list):
        return [from_plain(v) for v in x]
    return x


def walk(x: Any):
    """Every node of a tree, outermost first."""
    if isinstance(x, Node):
        yield x
        for v in x.parts.values():
            yield from walk(v)
    elif isinstance(x, (list, tuple)):
        for v in x:
            yield from walk(v)
