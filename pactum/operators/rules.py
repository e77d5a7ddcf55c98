"""Contract rules as predicates: what they reject and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ast import Node
from ..errors import TagViolation, TypeFault
from ..formatter import expression_text, pattern_text
from ..functions.base import Typed, lit
from ..tags import Taint
from ..types import STRING
from .patterns import matched

MODES = ("raise", "quarantine", "drop", "off")
REJECT = "_reject"


def referred(ref: Node, inputs: dict[str, Typed], outputs: dict[str, Typed]) -> Typed:
    v = (inputs if ref.side == "input" else outputs)[ref.path[0]]
    for name in ref.path[1:]:
        if v.type.kind != "record" or v.type.field(name) is None:
            raise TypeFault(f"rule names unknown field {'.'.join([ref.side, *ref.path])}", ref.pos)
        v = v.field(name)
    return v


def predicates(contract: Node, lower, inputs: dict[str, Typed], outputs: dict[str, Typed]) -> list[tuple[Column, str]]:
    """(what must hold, never null; message) of each require and match rule."""
    env = {"input": lower.bundle(inputs), "output": lower.bundle(outputs)}
    out = []
    for r in contract.rules:
        if r.kind == "require":
            ok = lower.truth(lower.expr(r.test, env), r.pos)
            out.append((F.coalesce(ok, F.lit(False)), r.message or f"{name_of(r.ref)}: {expression_text(r.test)}"))
        elif r.kind == "match-rule":
            on = referred(r.ref, inputs, outputs)
            found = None
            for c in r.clauses:
                test, bound = matched(c.pattern, on, lambda x: lower.expr(x, env))
                inner = env | bound
                if c.guard is not None:
                    test = test & F.coalesce(lower.truth(lower.expr(c.guard, inner), c.pos), F.lit(False))
                value = F.coalesce(lower.truth(lower.expr(c.then, inner), c.pos), F.lit(False))
                found = F.when(test, value) if found is None else found.when(test, value)
            shown = ", ".join(pattern_text(c.pattern) for c in r.clauses)
            out.append((found.otherwise(F.lit(False)), r.message or f"{name_of(r.ref)} matches none of {shown}"))
    return out


def name_of(ref: Node) -> str:
    return ".".join([ref.side, *ref.path])


def enforce_static(contract: Node, output: Taint, outputs: list[str]) -> None:
    """forbid rules, settled before any row is read."""
    for r in contract.rules:
        if r.kind == "forbid-tag":
            for n, t in output.fields:
                if r.tag in t.total() | output.own:
                    raise TagViolation(f"output {n} carries {r.tag}", r.pos)
        elif r.kind == "forbid-field":
            name = r.ref.path[0]
            if r.ref.side == "output" or name in outputs:
                if name in outputs:
                    raise TagViolation(f"output has forbidden field {name}", r.pos)
            for n, t in output.fields:
                if name in t.sources():
                    raise TagViolation(f"output {n} takes its value from input {name}", r.pos)


def apply(df: DataFrame, checks: list[tuple[Column, str]], mode: str) -> DataFrame:
    """df with its rejected rows raised, dropped, or marked in `_reject` (an array of messages, empty if accepted)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "off" or not checks:
        return df.withColumn(REJECT, F.array().cast("array<string>")) if mode == "quarantine" else df
    if mode == "drop":
        for ok, _ in checks:
            df = df.where(ok)
        return df
    reasons = F.array_compact(F.array(*[F.when(~ok, F.lit(message)) for ok, message in checks]))
    if mode == "quarantine":
        return df.withColumn(REJECT, reasons)
    stop = F.raise_error(F.concat(F.lit("rejected: "), F.array_join(reasons, "; "))).cast("boolean")
    return df.where(F.when(F.size(reasons) > 0, stop).otherwise(F.lit(True)))


def text_literal(s: str) -> Typed:
    return lit(s, STRING)
