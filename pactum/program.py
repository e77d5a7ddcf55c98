"""Programs: parsed, checked, and run over DataFrames."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analyzer import Analyzer
from .ast import Node, from_plain, to_plain
from .errors import ContractError, TypeFault
from .formatter import program_text
from .functions.base import Typed
from .operators import rules
from .operators.equality import equal
from .operators.patterns import literal
from .parser import parse
from .plans.dataset import Lifted, Lists, NotLiftable, Relation
from .plans.lower import Context, Lower, quote
from .sources.catalog import Catalog
from .tags import Flow
from .types import Type, declared, record, spark_type

Resolver = Callable[[str], str | None]
IN = "in:"


def folder_resolver(folder: str) -> Resolver:
    """Texts of contracts by name from `<folder>/<name>.*`."""

    def find(name: str) -> str | None:
        for entry in sorted(os.listdir(folder)):
            if entry.partition(".")[0] == name:
                with open(os.path.join(folder, entry), encoding="utf-8") as f:
                    return f.read()
        return None

    return find


@dataclass
class TestResult:
    label: str
    passed: bool
    differences: list[str] = field(default_factory=list)


class Program:
    """A checked contract. `resolver` gives the text of contracts that it uses, by name (or a dict does)."""

    def __init__(self, tree: Node, resolver: Resolver | dict[str, str] | None = None, strict_tags: bool = False):
        self.tree = tree
        self.contract: Node = tree.contract
        self._resolver = resolver.get if isinstance(resolver, dict) else resolver
        self._parsed: dict[str, Node | None] = {}
        self.warnings = Analyzer(tree, self._resolve).check()
        self.strict_tags = strict_tags
        if self.contract.form == "function":
            for name in self.contract.uses:
                found = self._resolve(name)
                if found is not None and found is not tree:
                    Analyzer(found, self._resolve).check()
            self.taint = Flow(tree, lambda n: self._used(tree, n), lambda n: self._source(tree, n), strict_tags).run()
            rules.enforce_static(self.contract, self.taint, [f.name for f in self.contract.outputs])

    @classmethod
    def from_text(cls, text: str, resolver: Resolver | dict[str, str] | None = None, name: str = "<text>", strict_tags: bool = False) -> Program:
        return cls(parse(text, name), resolver, strict_tags)

    @classmethod
    def load(cls, path: str, strict_tags: bool = False) -> Program:
        with open(path, encoding="utf-8") as f:
            return cls.from_text(f.read(), folder_resolver(os.path.dirname(path) or "."), path, strict_tags)

    def _resolve(self, name: str) -> Node | None:
        if name not in self._parsed:
            text = self._resolver(name) if self._resolver else None
            self._parsed[name] = parse(text, name) if text is not None else None
        return self._parsed[name]

    def _used(self, program: Node, name: str) -> Node | None:
        """The function contract that one program calls by a name."""
        found = self._resolve(name)
        return found if found is not None and found.contract.form == "function" else None

    def _source(self, program: Node, name: str) -> Node | None:
        found = self._resolve(name)
        return found.contract if found is not None and found.contract.form == "source" else None

    # ------------------------------------------------------------ schema

    @property
    def input_schema(self) -> T.StructType:
        return _schema([(f.name, declared(f.type), f.tags) for f in self.contract.inputs])

    @property
    def output_schema(self) -> T.StructType:
        """Output types; the metadata of a field names the tags that its values carry."""
        carried = dict(self.taint.fields)
        return _schema([(f.name, declared(f.type), sorted({*f.tags, *(carried[f.name].total() if f.name in carried else ())})) for f in self.contract.outputs])

    def format(self) -> str:
        return program_text(self.tree)

    def to_json(self) -> str:
        return json.dumps(to_plain(self.tree))

    @classmethod
    def from_json(cls, text: str, resolver: Resolver | dict[str, str] | None = None, strict_tags: bool = False) -> Program:
        return cls(from_plain(json.loads(text)), resolver, strict_tags)

    # ------------------------------------------------------------ rows

    def _bound(self, df: DataFrame) -> tuple[DataFrame, dict[str, Typed], list[tuple]]:
        """df with its columns renamed and cast to the inputs; checks of required values."""
        have = {c.replace("_", "-"): c for c in df.columns}
        cols, inputs, checks = [], {}, []
        for f in self.contract.inputs:
            t = declared(f.type)
            name = quote(IN + f.name)
            inputs[f.name] = Typed(F.col(name), t)
            if f.name not in have:
                if not t.maybe:
                    raise ContractError(f"required input {f.name} is missing", f.pos)
                cols.append(F.lit(None).cast(spark_type(t)).alias(IN + f.name))
                continue
            own = df.schema[have[f.name]].dataType
            cols.append(bound_column(F.col(quote(have[f.name])), own, t, f).alias(IN + f.name))
            if not t.maybe:
                checks.append((F.col(name).isNotNull(), f"input {f.name} is missing"))
        return df, inputs, [cols, checks]

    def _shaped_outputs(self, lower: Lower, result: Typed) -> dict[str, Typed]:
        if result.type.kind != "record":
            raise TypeFault(f"the result is {result.type}, not a record", self.tree.function.result.pos)
        out = {}
        for f in self.contract.outputs:
            t = declared(f.type)
            if result.type.field(f.name) is None:
                if not t.maybe:
                    raise TypeFault(f"the result lacks {f.name}", f.pos)
                out[f.name] = Typed(F.lit(None).cast(spark_type(t)), t)
            else:
                v = result.field(f.name)
                out[f.name] = lower.shaped(v, t, f.pos)
        return out

    def transform(self, df: DataFrame, mode: str = "raise", catalog: Catalog | None = None, keep: list[str] | None = None, now: str | None = None, snake: bool = False) -> DataFrame:
        """One output row per record of df, batch or streaming.

        Columns are inputs by name; an underscore in a column name stands for a hyphen. keep: columns of df to carry along.
        mode: what becomes of records that a rule rejects: raise, quarantine (messages in `_reject`), drop, or off.
        snake: output names with underscores instead of hyphens.
        """
        self._function_only()
        df, inputs, (cols, checks) = self._bound(df)
        kept = [F.col(quote(c)).alias(f"keep:{c}") for c in keep or []]
        context = Context(df.select(*kept, *cols), self._used, catalog or Catalog(df.sparkSession), self._source, now)
        lower = Lower(self.tree, inputs, context)
        outputs = self._shaped_outputs(lower, lower.run())
        df = context.df.withColumns({f"out:{n}": v.col for n, v in outputs.items()})
        placed = {n: Typed(F.col(quote(f"out:{n}")), v.type) for n, v in outputs.items()}
        if mode != "off":
            checks = checks + rules.predicates(self.contract, Lower(self.tree, inputs, Context(None, self._used, None, self._source, now)), inputs, placed)
        df = rules.apply(df, checks, mode)
        schema = self.output_schema
        final = [F.col(quote(f"out:{f.name}")).alias(f.name.replace("-", "_") if snake else f.name, metadata=f.metadata) for f in schema]
        marks = [F.col(rules.REJECT)] if mode == "quarantine" else []
        return df.select(*[F.col(quote(f"keep:{c}")).alias(c) for c in keep or []], *final, *marks)

    def _function_only(self) -> None:
        if self.contract.form != "function":
            raise ContractError(f"a {self.contract.form} contract does not run", self.contract.pos)

    # ------------------------------------------------------------ lists as DataFrames

    def aggregate(self, df: DataFrame, order: str | None = None, catalog: Catalog | None = None, now: str | None = None, snake: bool = False, others: dict[str, DataFrame] | None = None, fallback: bool = False) -> DataFrame:
        """Runs a contract whose inputs are lists with each list bound to a DataFrame (others: of further inputs).

        order: the column that says in which order the list's elements stand. Scalar results give one row; a single list
        result gives its elements as rows; lists beside scalars are gathered into arrays. Rules on inputs and outputs raise.
        What can't be lifted is an error, or with fallback runs on the gathered list: that list then has to fit in one
        row of one task, and needs an order.
        """
        self._function_only()
        frames = {self.contract.inputs[0].name: df} | (others or {})
        inputs = {}
        for f in self.contract.inputs:
            t = declared(f.type)
            if t.kind != "list" or f.name not in frames:
                raise ContractError(f"input {f.name} is no list bound to a DataFrame", f.pos)
            inputs[f.name] = relation_of(frames[f.name], t.of, f, order)
        context = Context(None, self._used, catalog, self._source, now)
        by = F.col("order:") if order else None
        lower = Lifted(self.tree, inputs, context, order=by)
        try:
            result = lower.run_lifted()
            return self._lifted_rows(lower, result, inputs, df.sparkSession, snake)
        except NotLiftable:
            if not fallback or others:
                raise TypeFault("this program cannot be lifted", self.tree.function.pos) from None
        if order is None:
            raise ContractError("a list that is gathered into one row needs an order", self.contract.inputs[0].pos)
        name = self.contract.inputs[0].name
        rel = inputs[name]
        key = [by.alias("k")] if order else []
        packed = rel.df.agg(F.array_sort(F.collect_list(F.struct(*key, rel.value.col.alias("v")))).alias("a"))
        row = packed.select(F.transform("a", lambda s: s["v"]).alias(name))
        return self.transform(row, catalog=catalog, now=now, snake=snake)

    def _lifted_rows(self, lower: Lifted, result, inputs: dict, spark: SparkSession, snake: bool) -> DataFrame:
        rename = (lambda n: n.replace("-", "_")) if snake else (lambda n: n)
        names = [f.name for f in self.contract.outputs]
        if isinstance(result, Lists):
            lists = {n: v for n, v in result.fields.items() if isinstance(v, Relation)}
            if len(names) == 1:
                if any(r.kind in ("require", "match-rule") for r in self.contract.rules):
                    raise TypeFault("rules are not checked where the result is one list of rows", self.contract.pos)
                t, f = declared(self.contract.outputs[0].type), self.contract.outputs[0]
                rel = lists[names[0]]
                df = rel.frame()
                if t.of.kind != "record":
                    return df.select(lower.shaped(Typed(F.col("value"), rel.value.type), t.of, f.pos).col.alias(rename(names[0])))
                return df.select(*[lower.shaped(Typed(F.col(quote(n)), rel.value.type.field(n)), x, f.pos).col.alias(rename(n)) for n, x in t.of.fields])
            whole = {n: lower.gathered(v) if isinstance(v, Relation) else v for n, v in result.fields.items()}
            from .functions.records import assemble

            result = assemble(whole)
        outputs = self._shaped_outputs(lower, result)
        checks = rules.predicates(self.contract, lower, inputs, outputs)
        df = lower.row(spark).select(*[v.col.alias(f"out:{n}") for n, v in outputs.items()]) if not checks else rules.apply(lower.row(spark), checks, "raise").select(*[v.col.alias(f"out:{n}") for n, v in outputs.items()])
        return df.select(*[F.col(quote(f"out:{n}")).alias(rename(n)) for n in names])

    # ------------------------------------------------------------ tests and plans

    def run_tests(self, spark: SparkSession, catalog: Catalog | None = None, now: str | None = None) -> list[TestResult]:
        """The contract's own tests, in one DataFrame; floats agree within a relative 1e-9 and expected fields are compared."""
        self._function_only()
        tests = self.contract.tests
        if not tests:
            return []
        rows = []
        types = {f.name: declared(f.type) for f in self.contract.inputs}
        for i, t in enumerate(tests):
            given = {n: plain(v) for n, v in t.given.fields}
            rows.append((i, json.dumps({n: given.get(n) for n in types})))
        schema = T.StructType([T.StructField(n, spark_type(t)) for n, t in types.items()])
        df = spark.createDataFrame(rows, "i int, j string").select("i", F.from_json("j", schema).alias("r")).select("i", "r.*")
        got = {r["i"]: r.asDict(recursive=True) for r in self.transform(df, mode="quarantine", catalog=catalog, keep=["i"], now=now).collect()}
        out = []
        for i, t in enumerate(tests):
            row = got[i]
            wrong = [f"rejected: {m}" for m in row[rules.REJECT]]
            for n, v in t.expect.fields:
                if not alike(row[n], plain(v)):
                    wrong.append(f"{n}: expected {plain(v)!r}, got {row[n]!r}")
            out.append(TestResult(t.label, not wrong, wrong))
        return out

    def explain(self, df: DataFrame, **options) -> str:
        """The physical plan of transform over df."""
        jdf = self.transform(df, **options)._jdf
        return df.sparkSession._jvm.PythonSQLUtils.explainString(jdf.queryExecution(), "formatted")

    def register_view(self, df: DataFrame, view: str, **options) -> DataFrame:
        """transform as a temporary view for SQL."""
        out = self.transform(df, **options)
        out.createOrReplaceTempView(view)
        return out


def _schema(fields) -> T.StructType:
    return T.StructType([T.StructField(n, spark_type(t), True, {"tags": list(tags)} if tags else None) for n, t, tags in fields])


def bound_column(col, own: T.DataType, t: Type, f: Node):
    if t.kind == "string" and isinstance(own, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    if own == spark_type(t):
        return col
    simple = {"string": (T.StringType, T.DateType), "integer": (T.IntegralType,), "float": (T.NumericType,), "boolean": (T.BooleanType,)}
    if t.kind in simple and not isinstance(own, (*simple[t.kind], T.NullType)):
        raise ContractError(f"input {f.name} wants {t}, its column is {own.simpleString()}", f.pos)
    return col.cast(spark_type(t))


def relation_of(df: DataFrame, element: Type, f: Node, order: str | None) -> Relation:
    """A DataFrame as a list input: columns by name for records, the only (or like-named) column for other elements."""
    have = {c.replace("_", "-"): c for c in df.columns}
    keys = [F.col(quote(order)).alias("order:")] if order else []
    if element.kind == "record":
        cols, parts = [], {}
        for n, t in element.fields:
            if n not in have:
                if not t.maybe:
                    raise ContractError(f"required field {n} of {f.name} is missing", f.pos)
                cols.append(F.lit(None).cast(spark_type(t)).alias(n))
            else:
                cols.append(bound_column(F.col(quote(have[n])), df.schema[have[n]].dataType, t, f).alias(n))
            parts[n] = Typed(F.col(quote(n)), t)
        whole = F.struct(*[F.col(quote(n)) for n in parts])
        return Relation(df.select(*keys, *cols), Typed(whole, record(element.fields), parts=parts))
    name = have.get(f.name) or next(c for c in df.columns if c != order)
    col = bound_column(F.col(quote(name)), df.schema[name].dataType, element, f)
    return Relation(df.select(*keys, col.alias("value")), Typed(F.col("value"), element))


def plain(e: Node):
    """The value of a literal expression."""
    if e.kind == "literal":
        return e.value
    if e.kind == "negate":
        return -plain(e.of)
    if e.kind == "list":
        return [plain(v) for v in e.items]
    if e.kind == "record":
        return {n: plain(v) for n, v in e.fields}
    raise ContractError("tests hold literals only", e.pos)


def alike(got, want) -> bool:
    if isinstance(want, dict) and isinstance(got, dict):
        return all(n in got and alike(got[n], v) for n, v in want.items())
    if isinstance(want, list) and isinstance(got, list):
        return len(got) == len(want) and all(map(alike, got, want))
    if isinstance(want, bool) or isinstance(got, bool):
        return got is want
    if isinstance(want, (int, float)) and isinstance(got, (int, float)):
        return abs(got - want) <= max(abs(got), abs(want)) * 1e-9
    return got == want


__all__ = ["Program", "TestResult", "equal", "folder_resolver", "literal"]
