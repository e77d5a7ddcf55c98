"""Expressions as typed columns over a DataFrame of records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ast import Node, walk
from ..errors import TypeFault
from ..functions import LIBRARY
from ..functions.base import Args, Typed
from ..functions.records import assemble
from ..operators.equality import equal
from ..operators.lookup import join_elements, join_lookup
from ..operators.patterns import literal, matched
from ..types import ANY, BOOLEAN, FLOAT, INTEGER, NOTHING, STRING, Type, declared, fits, listing, spark_type, unified

ORDERED = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
NUMERIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "mod": lambda a, b: a % b}


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Context:
    """What one run of the planner knows besides the expressions: the DataFrame so far, programs, sources."""

    df: DataFrame | None
    used: object = None
    catalog: object = None
    source: object = None
    now: str | None = None
    made: int = 0
    lookups: dict = field(default_factory=dict)

    def fresh(self, what: str) -> str:
        self.made += 1
        return f"{what}:{self.made}"


@dataclass
class Lower:
    """One program's expressions. `inputs` are its input columns; each inlined program has a Lower of its own."""

    program: Node
    inputs: dict[str, Typed]
    context: Context
    #: Values of lookups that depend on a list element: tree identity -> column of the element at hand.
    element_hits: dict[int, Typed] = field(default_factory=dict)
    inside: bool = False

    # ------------------------------------------------------------ programs

    def run(self) -> Typed:
        f = self.program.function
        env = dict(self.inputs)
        uses: dict[str, int] = {}
        for n in walk([[let.value for let in f.lets], f.result]):
            if n.kind == "name":
                uses[n.name] = uses.get(n.name, 0) + 1
        for let in f.lets:
            value = self.expr(let.value, env)
            if not self.inside and self.context.df is not None and uses.get(let.name, 0) > 1 and not value.known and let.value.kind not in ("name", "input", "field") and value.parts is None:
                name = self.context.fresh(f"let:{let.name}")
                self.context.df = self.context.df.withColumn(name, value.col)
                value = Typed(F.col(quote(name)), value.type)
            env[let.name] = value
        return self.expr(f.result, env)

    # ------------------------------------------------------------ expressions

    def expr(self, e: Node, env: dict[str, Typed], wanted: Type | None = None) -> Typed:
        return getattr(self, "on_" + e.kind.replace("-", "_"))(e, env)

    def on_literal(self, e: Node, env) -> Typed:
        return literal(e.value)

    def on_input(self, e: Node, env) -> Typed:
        if e.name not in self.inputs:
            raise TypeFault(f"unknown input ${e.name}", e.pos)
        return self.inputs[e.name]

    def on_name(self, e: Node, env) -> Typed:
        if e.name not in env:
            raise TypeFault(f"undefined name {e.name}", e.pos)
        return env[e.name]

    def on_record(self, e: Node, env) -> Typed:
        return assemble({n: self.expr(v, env) for n, v in e.fields})

    def on_list(self, e: Node, env) -> Typed:
        items = [self.expr(v, env) for v in e.items]
        if not items:
            return Typed(F.array(), listing(NOTHING), literal=[], known=True)
        t = items[0].type
        for v in items[1:]:
            t = unified(t, v.type, e.pos)
        if t.kind == "any":
            raise TypeFault("a list holds values of one type", e.pos)
        known = all(v.known for v in items)
        cols = [self.shaped(v, t, e.pos).col for v in items]
        return Typed(F.array(*cols), listing(t), literal=[v.literal for v in items] if known else None, known=known)

    def on_field(self, e: Node, env) -> Typed:
        v = self.expr(e.of, env)
        if v.type.kind == "record":
            if v.type.field(e.name) is None:
                raise TypeFault(f"no field {e.name} in {v.type}", e.pos)
            return v.field(e.name)
        if v.type.kind == "string" and e.name == "value":
            return v
        if v.type.kind == "any":
            return Typed(F.try_variant_get(v.col, "$." + e.name if e.name.isidentifier() else f"$['{e.name}']", "variant"), ANY)
        if v.type.kind == "nothing":
            return Typed(F.lit(None), NOTHING)
        raise TypeFault(f"{v.type} has no fields", e.pos)

    def on_index(self, e: Node, env) -> Typed:
        v = self.expr(e.of, env)
        if v.type.kind == "any":
            return Typed(F.try_variant_get(v.col, f"$[{e.at}]", "variant"), ANY)
        if v.type.kind != "list":
            raise TypeFault(f"{v.type} is no list", e.pos)
        return Typed(F.get(v.col, F.lit(e.at)), v.type.of.optional())

    def on_negate(self, e: Node, env) -> Typed:
        v = self.expr(e.of, env)
        if not v.type.numeric:
            raise TypeFault(f"cannot negate {v.type}", e.pos)
        known = v.known and v.literal is not None
        return Typed(-v.col, v.type, literal=-v.literal if known else None, known=known)

    def on_not(self, e: Node, env) -> Typed:
        return Typed(~self.truth(self.expr(e.of, env), e.pos), BOOLEAN)

    def bundle(self, fields: dict[str, Typed]) -> Typed:
        """The inputs or outputs as one record."""
        return assemble(fields)

    def truth(self, v: Typed, pos) -> Column:
        if v.type.kind == "any":
            return F.try_variant_get(v.col, "$", "boolean")
        if v.type.kind not in ("boolean", "nothing"):
            raise TypeFault(f"a condition is {v.type}, not boolean", pos)
        return v.col if v.type.kind == "boolean" else F.lit(None).cast("boolean")

    def on_binary(self, e: Node, env) -> Typed:
        a, b = self.expr(e.left, env), self.expr(e.right, env)
        op = e.op
        if op == "or-else":
            t = unified(a.type, b.type, e.pos)
            t = t if b.type.maybe else t.required()
            return Typed(F.coalesce(self.shaped(a, t, e.pos).col, self.shaped(b, t, e.pos).col), t)
        if op in ("and", "or"):
            x, y = self.truth(a, e.pos), self.truth(b, e.pos)
            return Typed(x & y if op == "and" else x | y, BOOLEAN)
        if op in ("=", "!="):
            same = equal(a, b)
            return Typed(same if op == "=" else ~same, BOOLEAN)
        a, b = self.loosened(a, b), self.loosened(b, a)
        maybe = a.type.maybe or b.type.maybe
        if op in ORDERED:
            if not (a.type.numeric and b.type.numeric or a.type.kind == b.type.kind == "string"):
                raise TypeFault(f"cannot order {a.type} and {b.type}", e.pos)
            return Typed(ORDERED[op](a.col, b.col), Type("boolean", maybe=maybe))
        if op == "+" and a.type.kind == b.type.kind == "string":
            return Typed(F.concat(a.col, b.col), Type("string", maybe=maybe))
        if not a.type.numeric or not b.type.numeric:
            raise TypeFault(f"cannot use {op} on {a.type} and {b.type}", e.pos)
        whole = a.type.kind == b.type.kind == "integer"
        x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
        if op == "/":
            found = F.call_function("div", x, y) if whole else x / y
        else:
            found = NUMERIC[op](x, y)
        return Typed(found, Type("integer" if whole else "float", maybe=maybe))

    @staticmethod
    def loosened(v: Typed, other: Typed) -> Typed:
        """A dynamic value as the kind of the other operand."""
        if v.type.kind == "any" and other.type.kind in ("string", "integer", "float", "boolean"):
            return Typed(F.try_variant_get(v.col, "$", spark_type(other.type).simpleString()), other.type.optional())
        return v

    def on_is(self, e: Node, env) -> Typed:
        v = self.expr(e.of, env)
        if e.what == "nothing":
            return Typed(v.col.isNull() if v.type.maybe else F.lit(False), BOOLEAN)
        if v.type.kind == "any":
            shape = F.schema_of_variant(v.col)
            tests = {
                "string": shape == "STRING", "boolean": shape == "BOOLEAN", "integer": shape == "BIGINT", "list": shape.startswith("ARRAY"),
                "record": shape.startswith("OBJECT"), "float": shape.startswith("DECIMAL") | (shape == "DOUBLE") | (shape == "FLOAT"),
            }
            return Typed(F.coalesce(tests[e.what], F.lit(False)), BOOLEAN)
        if v.type.kind != e.what:
            return Typed(F.lit(False), BOOLEAN)
        return Typed(v.col.isNotNull() if v.type.maybe else F.lit(True), BOOLEAN)

    def on_if(self, e: Node, env) -> Typed:
        tests = [self.truth(self.expr(t, env), t.pos) for t, _ in e.branches]
        values = [self.expr(v, env) for _, v in e.branches] + [self.expr(e.other, env)]
        return self.chosen(tests, values, e.pos)

    def chosen(self, tests: list[Column], values: list[Typed], pos) -> Typed:
        """values[i] for the first true test; the last value, if there is one more, otherwise."""
        t = values[0].type
        for v in values[1:]:
            t = unified(t, v.type, pos)
        if len(values) == len(tests):
            t = t.optional()
        cols = [self.shaped(v, t, pos).col for v in values]
        found = F.when(tests[0], cols[0])
        for test, col in zip(tests[1:], cols[1:], strict=False):
            found = found.when(test, col)
        return Typed(found.otherwise(cols[-1]) if len(cols) > len(tests) else found, t)

    def on_match(self, e: Node, env) -> Typed:
        on = self.expr(e.on, env)
        tests, values = [], []
        for c in e.clauses:
            test, bound = matched(c.pattern, on, lambda x: self.expr(x, env))
            inner = env | bound
            if c.pattern.kind == "bind" and any(t.kind == "literal" and t.value is None for t in [x.pattern for x in e.clauses[: e.clauses.index(c)] if x.guard is None]):
                inner[c.pattern.name] = Typed(on.col, on.type.required(), parts=on.parts)  # nothing was caught before
            if c.guard is not None:
                test = test & F.coalesce(self.truth(self.expr(c.guard, inner), c.guard.pos), F.lit(False))
            tests.append(test)
            values.append(self.expr(c.then, inner))
            if c.guard is None and c.pattern.kind in ("any", "bind"):
                break
        else:
            if e.other is not None:
                values.append(self.expr(e.other, env))
            return self.chosen(tests, values, e.pos)
        if len(tests) == 1:
            return values[0]
        return self.chosen(tests[:-1], values, e.pos)

    # ------------------------------------------------------------ lists

    def on_filter(self, e: Node, env) -> Typed:
        return self.stepped(e, self.expr(e.of, env), env)

    def on_map(self, e: Node, env) -> Typed:
        return self.stepped(e, self.expr(e.of, env), env)

    def stepped(self, e: Node, v: Typed, env) -> Typed:
        """filter or map over a list."""
        if v.type.kind != "list":
            raise TypeFault(f"{e.kind} takes a list, not {v.type}", e.pos)
        body = e.test if e.kind == "filter" else e.body
        hits = self.joined_elements(e, body, v, env)
        result: dict[str, Type] = {}

        def inner(x: Column, i: Column) -> Column:
            mine = {k: Typed(F.get(F.col(quote(name)), i), t) for k, (name, t) in hits.items()}
            sub = Lower(self.program, self.inputs, self.context, self.element_hits | mine, True)
            found = sub.expr(body, env | {e.var: Typed(x, v.type.of)})
            result["type"] = found.type
            return F.coalesce(sub.truth(found, body.pos), F.lit(False)) if e.kind == "filter" else found.col

        if v.type.of.kind == "nothing" and v.known and v.literal == []:
            empty = Typed(v.col, v.type)
            inner(F.lit(None), F.lit(0))
            return empty if e.kind == "filter" else Typed(F.array().cast(spark_type(listing(result["type"]))), listing(result["type"]))
        # Lambdas with a place are only used where a lookup needs it.
        place = (lambda x, i: inner(x, i)) if hits else (lambda x: inner(x, F.lit(0)))
        if e.kind == "filter":
            return Typed(F.filter(v.col, place), v.type)
        col = F.transform(v.col, place)
        return Typed(col, Type("list", of=result["type"], maybe=v.type.maybe))

    def joined_elements(self, e: Node, body: Node, v: Typed, env) -> dict[int, tuple[str, Type]]:
        """Joins the lookups of a list step whose keys need the element; tree identity -> (column of hits, record type)."""
        out = {}
        for n in walk(body):
            if n.kind == "lookup" and any(x.kind == "name" and x.name == e.var for x in walk([k for _, k in n.keys])):
                if self.inside or self.context.df is None:
                    raise TypeFault("a lookup that depends on an element works in the outermost list step only", n.pos)
                source, keys, fields, t = self.source_of(n)
                lists = [self.keys_of(k, e.var, v, env) for _, k in n.keys]
                name = self.context.fresh("hits")
                self.context.df = join_elements(self.context.df, lists, source, keys, fields, name)
                out[id(n)] = (name, t)
        return out

    def keys_of(self, key: Node, var: str, v: Typed, env) -> Column:
        """A lookup key for each element of a list."""
        inner = Lower(self.program, self.inputs, self.context, {}, True)
        return F.transform(v.col, lambda x: inner.expr(key, env | {var: Typed(x, v.type.of)}).col)

    # ------------------------------------------------------------ lookups

    def source_of(self, e: Node):
        contract = self.context.source(self.program, e.source) if self.context.source else None
        if contract is None:
            raise TypeFault(f"unknown source {e.source}", e.pos)
        known = {f.name for f in contract.keys}
        for k, _ in e.keys:
            if k not in known:
                raise TypeFault(f"{e.source} is not keyed by {k}", e.pos)
        t = declared(contract.returns).optional()
        return self.context.catalog.rows(contract), [k for k, _ in e.keys], [n for n, _ in t.fields], t

    def on_lookup(self, e: Node, env) -> Typed:
        if id(e) in self.element_hits:
            return self.element_hits[id(e)]
        if self.inside or self.context.df is None:
            raise TypeFault("this lookup must stand before the list step that uses it", e.pos)
        source, keys, fields, t = self.source_of(e)
        values = [self.expr(v, env).col for _, v in e.keys]
        mark = (e.source, *keys, *map(str, values))
        if mark not in self.context.lookups:
            name = self.context.fresh("lookup")
            self.context.df = join_lookup(self.context.df, values, source, keys, fields, name)
            self.context.lookups[mark] = name
        return Typed(F.col(quote(self.context.lookups[mark])), t)

    # ------------------------------------------------------------ calls

    def on_through(self, e: Node, env) -> Typed:
        value = self.expr(e.value, env)
        if e.step.kind == "call":
            return self.called(e.step, env, {"value": value})
        return self.stepped(e.step, value, env)

    def on_call(self, e: Node, env) -> Typed:
        return self.called(e, env, {})

    def called(self, e: Node, env, extra: dict[str, Typed]) -> Typed:
        args = {n: self.expr(v, env) for n, v in e.args.fields} | extra
        name = e.name
        own = next((s for s in self.program.contract.parts.get("sanitizers", []) if s.name == name), None)
        if own is not None:
            name = own.using or own.name
        if name in LIBRARY:
            return LIBRARY[name].build(Args(args, name, e.pos, self.context, self.inside))
        used = self.context.used(self.program, name) if self.context.used else None
        if used is None:
            raise TypeFault(f"unknown function {name}", e.pos)
        inputs = {}
        for f in used.contract.inputs:
            t = declared(f.type)
            if f.name not in args:
                if not t.maybe:
                    raise TypeFault(f"{name} needs {f.name}", e.pos)
                inputs[f.name] = Typed(F.lit(None).cast(spark_type(t)), t)
            else:
                inputs[f.name] = self.shaped(args[f.name], t, e.pos)
        return Lower(used, inputs, self.context, self.element_hits, self.inside).run()

    # ------------------------------------------------------------ shapes

    def shaped(self, v: Typed, t: Type, pos) -> Typed:
        """v as a value of type t."""
        if v.type == t or v.type.required() == t.required():
            return Typed(v.col, t, v.literal, v.known, v.parts)
        if v.type.kind == "any" and t.kind != "any":
            return Typed(F.variant_get(v.col, "$", spark_type(t).simpleString()) if t.kind != "record" else F.from_json(F.to_json(v.col), spark_type(t)), t)
        if t.kind == "any":
            return Typed(v.col.cast("variant") if v.type.kind not in ("record", "list") else F.to_variant_object(v.col), t)
        if not fits(v.type, t):
            raise TypeFault(f"{v.type} where {t} is wanted", pos)
        if v.type.kind == "nothing":
            return Typed(F.lit(None).cast(spark_type(t)), t)
        if t.kind == "record":
            parts = {n: self.shaped(v.field(n), f, pos) if v.type.field(n) is not None else Typed(F.lit(None).cast(spark_type(f)), f) for n, f in t.fields}
            whole = F.struct(*[p.col.alias(n) for n, p in parts.items()])
            return Typed(F.when(v.col.isNotNull(), whole) if v.type.maybe else whole, t, parts=None if v.type.maybe else parts)
        if t.kind == "list" and t.of.kind == "record" and v.type.of.kind == "record":
            return Typed(F.transform(v.col, lambda x: self.shaped(Typed(x, v.type.of), t.of, pos).col), t)
        return Typed(v.col.cast(spark_type(t)), t, v.literal, v.known)


__all__ = ["FLOAT", "INTEGER", "STRING", "Context", "Lower", "quote"]
