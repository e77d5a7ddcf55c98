"""Lifting: a contract over one list runs with that list bound to a whole DataFrame.

filter becomes where, map select, fold and length aggregates, unique distinct, sort and slice orderBy and limit. All
aggregates over one relation without distinct or limits are computed by a single agg, however many filters and maps lie between.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ast import Node
from ..errors import TypeFault
from ..functions.base import Args, Typed
from ..functions.lists import fold_kind, fold_name
from ..functions.records import assemble
from ..operators.equality import tolerant
from ..types import FLOAT, INTEGER, STRING, Type, listing, spark_type
from .lower import Context, Lower, quote


class NotLiftable(Exception):
    """The program needs its list in one row."""


@dataclass
class Relation:
    """A list that is a DataFrame: `value` is the element, over the columns of `df`, of the rows where `keep` holds."""

    df: DataFrame
    value: Typed
    keep: Column | None = None
    order: tuple[tuple[Column, bool], ...] = ()  # (key, descending), the last ones break ties
    distinct: bool = False
    span: tuple[int, int] | None = None
    type: Type = None
    known: bool = False
    literal: object = None
    parts: object = None

    def __post_init__(self):
        self.type = listing(self.value.type)

    def kept(self, col: Column) -> Column:
        return col if self.keep is None else F.when(self.keep, col)

    def frame(self) -> DataFrame:
        """The elements as rows."""
        df = self.df if self.keep is None else self.df.where(self.keep)
        if self.order:
            df = df.orderBy(*[k.desc_nulls_first() if d else k.asc_nulls_last() for k, d in self.order])
        if self.span:
            start, end = self.span
            df = df.offset(start).limit(max(0, end - start)) if start else df.limit(max(0, end))
        v = self.value
        if v.type.kind == "record":
            df = df.select(*[v.field(n).col.alias(n) for n, _ in v.type.fields])
        else:
            df = df.select(v.col.alias("value"))
        return df.distinct() if self.distinct else df

    def simple(self) -> bool:
        return not self.distinct and self.span is None

    def settled(self) -> Relation:
        """The same list without pending steps."""
        if self.simple():
            return self
        df, t = self.frame(), self.value.type
        if t.kind == "record":
            parts = {n: Typed(F.col(quote(n)), f) for n, f in t.fields}
            value = Typed(F.struct(*[F.col(quote(n)) for n, _ in t.fields]), t, parts=parts)
        else:
            value = Typed(F.col("value"), t)
        return Relation(df, value)


@dataclass
class Lifted(Lower):
    """Lowers a body whose list input is a Relation; scalars live over the one row of aggregates."""

    aggregates: dict[int, tuple[DataFrame, dict[str, Column]]] = field(default_factory=dict)
    single: dict[str, DataFrame] = field(default_factory=dict)
    order: Column | None = None

    def aggregate(self, rel: Relation, col: Column) -> Column:
        """A column of the final row that holds an aggregate over a relation's DataFrame."""
        name = self.context.fresh("agg")
        self.aggregates.setdefault(id(rel.df), (rel.df, {}))[1][name] = col
        return F.col(quote(name))

    def run_lifted(self) -> Typed:
        env = dict(self.inputs)
        for let in self.program.function.lets:
            env[let.name] = self.expr(let.value, env)
        return self.expr(self.program.function.result, env)

    def row(self, spark) -> DataFrame:
        """The one row over which scalars are computed."""
        frames = [df.agg(*[c.alias(n) for n, c in cols.items()]) for df, cols in self.aggregates.values()]
        out = frames[0] if frames else spark.range(1).select()
        for other in [*frames[1:], *self.single.values()]:
            out = out.crossJoin(other)  # one row each
        return out

    # ------------------------------------------------------------ relations

    def bundle(self, fields: dict[str, Typed]) -> Typed:
        return Lists(fields) if any(isinstance(v, Relation) for v in fields.values()) else super().bundle(fields)

    def on_field(self, e: Node, env) -> Typed:
        of = self.expr(e.of, env)
        return of.fields[e.name] if isinstance(of, Lists) and e.name in of.fields else super().on_field(e, env)

    def needs_row(self, v) -> None:
        if isinstance(v, Relation):
            raise NotLiftable

    def on_record(self, e: Node, env) -> Typed:
        fields = {n: self.expr(v, env) for n, v in e.fields}
        if any(isinstance(v, Relation) for v in fields.values()):
            return Lists(fields)
        return assemble(fields)

    def on_list(self, e: Node, env):
        if not e.items:
            return super().on_list(e, env)
        items = [self.expr(v, env) for v in e.items]
        if any(isinstance(v, Relation) for v in items):
            return Listed(items)
        return super().on_list(e, env)

    def on_binary(self, e: Node, env) -> Typed:
        for side in (e.left, e.right):
            self.needs_row(self.expr(side, env) if side.kind in ("name", "input", "filter", "map") else None)
        return super().on_binary(e, env)

    def on_match(self, e: Node, env) -> Typed:
        on = self.expr(e.on, env)
        if not isinstance(on, Relation):
            return super().on_match(e, env)
        depth = 0
        for c in e.clauses:
            if c.pattern.kind not in ("listing", "any"):
                raise NotLiftable
            if c.pattern.kind == "listing":
                if c.pattern.rest and any(n.kind == "name" and n.name == c.pattern.rest for n in _walk(c.then)):
                    raise NotLiftable
                depth = max(depth, len(c.pattern.items) + (0 if c.pattern.open else 1))
        head = replace(on, span=(0, depth) if on.span is None else (on.span[0], min(on.span[1], on.span[0] + depth)))
        array = self.gathered(head)
        local = Typed(array.col, array.type)
        sub = Node("name", e.pos, name="(list)")
        return super().on_match(e.with_parts(on=sub), env | {"(list)": local})

    def gathered(self, rel: Relation) -> Typed:
        """A list's elements, in order, as an array in the final row."""
        name = self.context.fresh("list")
        if rel.order and rel.span is not None:
            df = rel.frame()
            # The limit bounds what meets here; rows keep the order of the sort.
            df = df.select(F.struct(*df.columns).alias("v") if rel.value.type.kind == "record" else F.col("value").alias("v"))
            self.single[name] = df.agg(F.collect_list("v").alias(name))
        elif rel.distinct or rel.span is not None:
            raise NotLiftable
        else:
            if not rel.order and self.order is None:
                raise NotLiftable
            keys = [*(k for k, _ in rel.order)] or [self.order]
            if any(d for _, d in rel.order):
                raise NotLiftable
            packed = F.array_sort(F.collect_list(rel.kept(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], rel.value.col.alias("v")))))
            return Typed(F.transform(self.aggregate(rel, packed), lambda s: s["v"]), listing(rel.value.type))
        return Typed(F.coalesce(F.col(quote(name)), F.array().cast(spark_type(listing(rel.value.type)))), listing(rel.value.type))

    def stepped(self, e: Node, v, env):
        if not isinstance(v, Relation):
            return super().stepped(e, v, env)
        if v.distinct or v.span is not None and e.kind == "filter":
            v = v.settled()
        body = e.test if e.kind == "filter" else e.body
        inner = Lower(self.program, {}, Context(None, self.context.used, self.context.catalog, self.context.source, self.context.now))
        used = {n.name for n in _walk(body) if n.kind in ("name", "input")}
        if any(n.kind == "lookup" for n in _walk(body)):
            raise NotLiftable
        scope = {e.var: v.value}
        for name in used - {e.var}:
            outer = env.get(name)
            if outer is not None and not (isinstance(outer, Typed) and outer.known):
                raise NotLiftable  # it would need the aggregates before the rows
            if outer is not None:
                scope[name] = outer
        found = inner.expr(body, scope)
        if e.kind == "filter":
            test = F.coalesce(inner.truth(found, body.pos), F.lit(False))
            return replace(v, keep=test if v.keep is None else v.keep & test)
        return replace(v, value=found)

    # ------------------------------------------------------------ calls

    def called(self, e: Node, env, extra):
        values = {n: self.expr(v, env) for n, v in e.args.fields} | extra
        rel = next((values[n] for n in ("list", "value", "a", "b") if isinstance(values.get(n), (Relation, Listed))), None)
        if rel is None:
            return super().called(e, env, extra)
        make = getattr(self, "list_" + e.name.replace("-", "_"), None)
        if make is None:
            raise NotLiftable
        if isinstance(rel, Listed) and e.name != "flatten":
            raise NotLiftable
        return make(rel, Args({k: v for k, v in values.items() if v is not rel}, e.name, e.pos, self.context))

    def list_length(self, rel: Relation, a: Args) -> Typed:
        if rel.distinct and rel.span is None:
            col = rel.value.col
            if rel.value.type.kind == "record" or tolerant(rel.value.type):
                rel = rel.settled()
            else:
                kept = rel.kept(col)
                empty = F.count_if(col.isNull() if rel.keep is None else col.isNull() & rel.keep)
                extra = F.when(empty > 0, 1).otherwise(0) if rel.value.type.maybe else F.lit(0)
                return Typed(self.aggregate(rel, (F.count_distinct(kept) + extra).cast("bigint")), INTEGER)
        rel = rel.settled()
        counted = F.count(F.lit(1)) if rel.keep is None else F.count_if(rel.keep)
        return Typed(self.aggregate(rel, counted.cast("bigint")), INTEGER)

    def list_fold(self, rel: Relation, a: Args) -> Typed:
        rel = rel.settled()
        fn, initial = fold_name(a), a.get("initial")
        kind = fold_kind(a, rel.value.type, initial.type)
        col = rel.kept(rel.value.col.cast(spark_type(kind)))
        if fn == "add":
            total = F.coalesce(self.aggregate(rel, F.sum(col)), F.lit(0).cast(spark_type(kind)))
            return Typed(initial.col.cast(spark_type(kind)) + total, kind)
        if kind != FLOAT:
            raise NotLiftable
        return Typed(initial.col.cast("double") * F.coalesce(self.aggregate(rel, F.product(col)), F.lit(1.0)), FLOAT)

    def list_unique(self, rel: Relation, a: Args):
        if tolerant(rel.value.type):
            raise NotLiftable
        return replace(rel.settled(), distinct=True, order=())

    def list_sort(self, rel: Relation, a: Args):
        rel = rel.settled()
        return replace(rel, order=((rel.value.col, False),))

    def list_sort_by(self, rel: Relation, a: Args):
        rel, name = rel.settled(), a.constant("field")
        if rel.value.type.kind != "record" or rel.value.type.field(name) is None:
            return rel
        ties = [(self.order, False)] if self.order is not None else [(rel.value.field(n).col, False) for n, _ in rel.value.type.fields if n != name]
        return replace(rel, order=((rel.value.field(name).col, False), *ties))

    def list_reverse(self, rel: Relation, a: Args):
        if rel.span is not None or rel.distinct:
            rel = rel.settled()
        if not rel.order and self.order is None:
            raise NotLiftable
        order = rel.order or ((self.order, False),)
        return replace(rel, order=tuple((k, not d) for k, d in order))

    def list_slice(self, rel: Relation, a: Args):
        start, end = max(0, a.constant("start")), max(0, a.constant("end"))
        if rel.span is not None or rel.distinct:
            raise NotLiftable
        if not rel.order:
            if self.order is None:
                raise NotLiftable
            rel = replace(rel, order=((self.order, False),))
        return replace(rel, span=(start, end))

    def list_flatten(self, rel, a: Args):
        if isinstance(rel, Listed):
            frames = [x.settled().frame() for x in rel.items if isinstance(x, Relation)]
            if len(frames) != len(rel.items):
                raise NotLiftable
            whole = frames[0]
            for f in frames[1:]:
                whole = whole.unionByName(f)
            return _over(whole, rel.items[0].value.type)
        rel = rel.settled()
        if rel.value.type.kind != "list":
            return rel
        df = rel.df if rel.keep is None else rel.df.where(rel.keep)
        return _over(df.select(F.explode(rel.value.col).alias("value")), rel.value.type.of)

    def list_join(self, rel: Relation, a: Args) -> Typed:
        by = a.constant("delimiter")
        rel = rel.settled() if rel.distinct else rel
        array = self.gathered(rel if rel.order or self.order is not None else self._unordered())
        return Typed(F.array_join(array.col, by, ""), STRING)

    def _unordered(self):
        raise NotLiftable


def _over(df: DataFrame, t: Type) -> Relation:
    if t.kind == "record":
        parts = {n: Typed(F.col(quote(n)), f) for n, f in t.fields}
        return Relation(df, Typed(F.struct(*[F.col(quote(n)) for n, _ in t.fields]), t, parts=parts))
    return Relation(df, Typed(F.col("value"), t))


@dataclass
class Listed:
    """A list literal of relations."""

    items: list


@dataclass
class Lists:
    """A result record that holds relations."""

    fields: dict


def _walk(e: Node):
    from ..ast import walk

    return walk(e)
