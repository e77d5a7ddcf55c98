"""Static checks, tags, rules, lookups, lifting, streaming, and agreement between row level and dataset level."""

import json

import pytest
from pyspark.sql import functions as F

from pactum import ContractError, PactumError, Program, SyntaxFault, TagViolation, TypeFault
from pactum.lexer import tokens
from pactum.parser import parse, parse_expression
from pactum.sources.catalog import Catalog


def contract(body, inputs="a as integer, s as string", outputs="x as integer", head="", rules="", lets="", name="c", define=None):
    return f"contract {name} {head} input {inputs} end output {outputs} end {rules} end define {define or name} with input {lets} result {{ {body} }} end"


# ---------------------------------------------------------------- lexing and parsing


def test_hyphens():
    assert [t.text for t in tokens("a-1")][:-1] == ["a-1"]
    assert [t.text for t in tokens("a - 1")][:-1] == ["a", "-", "1"]
    assert [(t.kind, t.value) for t in tokens("-9 1e5 2.5e-3 .. _")][:-1] == [("int", -9), ("float", 1e5), ("float", 2.5e-3), ("punct", ".."), ("punct", "_")]
    with pytest.raises(SyntaxFault):
        parse(contract("x: a -1"))


@pytest.mark.parametrize("bad", ['"open', "@", "99999999999999999999"])
def test_bad_tokens(bad):
    with pytest.raises(SyntaxFault):
        tokens(bad)


def test_precedence():
    assert parse_expression("1 + 2 * 3") == parse_expression("1 + (2 * 3)")
    assert parse_expression("a or b and c") == parse_expression("a or (b and c)")
    assert parse_expression("not a = b") == parse_expression("not (a = b)")
    assert parse_expression("10 - 3 - 2") == parse_expression("(10 - 3) - 2")
    assert parse_expression("a or else b through f({})").kind == "through"


@pytest.mark.parametrize(
    "text",
    ["contract", "contract c input a as integer end output x as integer end", contract("x: if a > 1 then 2 end"), contract("x: a < 1 < 2"), contract("x: let y be 2"), contract("x: sort(a)"), contract("x: match a end"), "contract t tags a end end define t with input result {} end"],
)
def test_syntax_errors_have_places(text):
    with pytest.raises(SyntaxFault) as e:
        parse(text, "file")
    assert str(e.value).startswith("file:")


# ---------------------------------------------------------------- static checks

LEAK = contract("y: b", "a as string tagged secret", "y as string", 'tags secret end', "rules forbid tagged secret in output end", "let b be a")

NEGATIVE = {
    "name differs": contract("x: 1", define="d"),
    "no input": contract("x: 1", inputs=""),
    "no output": contract("x: 1", outputs=""),
    "duplicate input": contract("x: 1", inputs="a as integer, a as string"),
    "duplicate output": contract("x: 1", outputs="x as integer, x as integer"),
    "duplicate tag": contract("x: 1", head="tags t, t end"),
    "duplicate sanitizer": contract("x: 1", head="tags t end sanitizers h using sha256 strips t, h using sha256 strips t end"),
    "duplicate test": contract("x: 1", rules='tests test "t" given { a: 1 } expect { x: 1 } end test "t" given { a: 1 } expect { x: 1 } end end'),
    "undeclared field tag": contract("x: 1", inputs="a as integer tagged t"),
    "undeclared sanitizer tag": contract("x: 1", head="tags t end sanitizers h using sha256 strips u end"),
    "unknown sanitizer function": contract("x: 1", head="tags t end sanitizers h using nope strips t end"),
    "rule names unknown field": contract("x: 1", rules="rules require input.b input.b > 1 end end"),
    "forbidden tag undeclared": contract("x: 1", rules="rules forbid tagged t in output end"[:-4] + " end"),
    "test gives unknown input": contract("x: 1", rules='tests test "t" given { b: 1 } expect { x: 1 } end end'),
    "test expects unknown output": contract("x: 1", rules='tests test "t" given { a: 1 } expect { y: 1 } end end'),
    "undefined name": contract("x: b"),
    "unknown input": contract("x: $b"),
    "let shadows input": contract("x: a", lets="let a be 1"),
    "let twice": contract("x: b", lets="let b be 1 let b be 2"),
    "filter shadows": contract("x: length({ list: filter [1] where a a > 0 end })"),
    "map shadows": contract("x: length({ list: map [1] as a do a end })"),
    "binding shadows": contract("x: match 1 when a then a end"),
    "rest shadows": contract("x: match [1] when [p, ..p] then p end"),
    "self recursion": contract("x: c({ a: 1 })"),
    "unknown function": contract("x: f({ a: 1 })"),
    "undeclared source": contract("x: 1", lets="let l be lookup src where k = a end"),
    "duplicate label": contract("x: 1, x: 2"),
    "tag contract without tags": "contract t end",
    "source without type": 'contract s source "s" config path: "p" end keyed-by k as string returns record k as string end end',
    "config not literal": 'contract s source "s" config type: "f", n: 1 + 1 end keyed-by k as string returns record k as string end end',
    "source returns no record": 'contract s source "s" keyed-by k as string returns string end',
}


@pytest.mark.parametrize("what", NEGATIVE)
def test_static_checks(what):
    with pytest.raises(ContractError):
        Program.from_text(NEGATIVE[what])


def test_circles_are_found():
    texts = {n: contract(f"x: {m}({{ a: 1, s: s }}).x", head=f"uses {m}", name=n) for n, m in (("p", "q"), ("q", "p"))}
    with pytest.raises(ContractError, match="circle"):
        Program.from_text(texts["p"], texts)


def test_warns_of_open_matches():
    assert Program.from_text(contract("x: match a when 1 then 2 end", outputs="x as maybe integer")).warnings


@pytest.mark.parametrize(
    "body",
    ["x: a + s", "x: if a then 1 else 2 end", "x: -s", "x: a < s", "x: [1, s]", 'x: fold({ list: [1], initial: 0, fn: "max" })', "x: a.b", "x: { p: 1 }.q", 'x: if a > 1 then "t" else 2 end', "x: s", "x: upper({ value: a })", "y: 1", "x: not a"],
)
def test_type_faults(spark, body):
    df = spark.createDataFrame([(1, "s")], "a long, s string")
    with pytest.raises((TypeFault, PactumError)):
        Program.from_text(contract(body)).transform(df)


# ---------------------------------------------------------------- tags


def test_leaks_are_refused():
    with pytest.raises(TagViolation):
        Program.from_text(LEAK)
    with pytest.raises(TagViolation):
        Program.from_text(contract("y: upper({ value: s })", "s as string", "y as string", rules="rules forbid input.s in output end"))


def test_sanitizers_strip_only_their_tags():
    head = "tags p, q end sanitizers h using sha256 strips p end"
    ok = contract("y: h({ value: s })", "s as string tagged p q", "y as string", head, "rules forbid tagged p in output end")
    assert Program.from_text(ok).output_schema["y"].metadata == {"tags": ["q"]}
    with pytest.raises(TagViolation):
        Program.from_text(ok.replace("forbid tagged p", "forbid tagged q"))


def test_comparisons_declassify_unless_strict():
    text = contract("y: s = \"x\"", "s as string tagged p", "y as boolean", "tags p end", "rules forbid tagged p in output end")
    Program.from_text(text)
    with pytest.raises(TagViolation):
        Program.from_text(text, strict_tags=True)


def test_tags_follow_fields_lists_and_sources():
    head = "tags p end"
    rec = "r as record open as string, shut as string tagged p end"
    forbid = "rules forbid tagged p in output end"
    Program.from_text(contract("y: r.open", rec, "y as string", head, forbid))
    with pytest.raises(TagViolation):
        Program.from_text(contract("y: r.shut", rec, "y as string", head, forbid))
    items = "l as list of record open as string, shut as string tagged p end"
    Program.from_text(contract("y: map l as e do e.open end", items, "y as list of string", head, forbid))
    with pytest.raises(TagViolation):
        Program.from_text(contract("y: map l as e do e.shut end", items, "y as list of string", head, forbid))
    source = 'contract src tags p end source "s" config type: "table", path: "t" end keyed-by k as string returns record v as string tagged p end end'
    with pytest.raises(TagViolation):
        Program.from_text(contract("y: (lookup src where k = s end).v or else s", "s as string", "y as string", "uses src tags p end sources src", forbid), {"src": source})


# ---------------------------------------------------------------- rules

RULES = contract(
    "x: a * 2", "a as integer, s as string", "x as integer", rules='rules require input.a input.a > 0 else reject "positive" end match output.x when between 0 and 10 then true else reject "large" end end'
)


def test_rule_modes(spark):
    df = spark.createDataFrame([(1, "a"), (-1, "b"), (9, "c"), (None, "d")], "a long, s string")
    p = Program.from_text(RULES)
    marked = {r.s: r._reject for r in p.transform(df, mode="quarantine", keep=["s"]).collect()}
    assert marked == {"a": [], "b": ["positive", "large"], "c": ["large"], "d": ["input a is missing", "positive", "large"]}
    assert [r.s for r in p.transform(df, mode="drop", keep=["s"]).collect()] == ["a"]
    assert p.transform(df, mode="off").count() == 4
    with pytest.raises(Exception, match="rejected"):
        p.transform(df).collect()


def test_missing_inputs(spark):
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(ContractError):
        Program.from_text(contract("x: a")).transform(df)
    assert Program.from_text(contract("x: a", "a as integer, s as maybe string")).transform(df).first().x == 1


# ---------------------------------------------------------------- lookups

SOURCE = 'contract src source "s" config type: "file", path: "{path}", collection: "rows" end keyed-by k as string, n as integer returns record v as string, w as maybe float end end'
LOOKUP = contract("v: r.v, w: r.w, hit: r is record", "k as string, n as integer", "v as maybe string, w as maybe float, hit as boolean", "sources src", lets="let r be lookup src where k = $k, n = $n end")


def test_lookup_takes_the_first_of_its_key(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"rows": [{"k": "a", "n": 1, "v": "first", "w": 2.5}, {"k": "a", "n": 1, "v": "second"}, {"k": "a", "n": 2, "v": "third"}, {"k": None, "n": 3, "v": "no"}]}))
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3)], "k string, n long")
    p = Program.from_text(LOOKUP, {"src": SOURCE.format(path=path)})
    got = p.transform(df, mode="off").collect()
    assert sorted((r.v, r.w, r.hit) for r in got if r.hit) == [("first", 2.5, True), ("third", None, True)]
    assert sum(not r.hit for r in got) == 2


def test_lookups_of_elements(spark):
    src = spark.createDataFrame([("a", 1, "A", None), ("b", 1, "B", 1.0)], "k string, n long, v string, w double")
    text = contract("vs: map l as e do (lookup src where k = e, n = 1 end).v or else \"?\" end", "l as list of string", "vs as list of string", "sources src")
    p = Program.from_text(text, {"src": SOURCE})
    df = spark.createDataFrame([(["b", "x", "a"],), ([],)], "l array<string>")
    assert sorted(r.vs for r in p.transform(df, catalog=Catalog(spark).register("src", src)).collect()) in ([[], ["B", "?", "A"]], [None, ["B", "?", "A"]])


def test_unknown_source_types_are_refused(spark):
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    with pytest.raises(PactumError, match="no reader"):
        Program.from_text(LOOKUP, {"src": SOURCE.format(path="p").replace('"file"', '"http"')}).transform(df)


# ---------------------------------------------------------------- inlining


def test_names_of_inlined_contracts_stay_apart(spark):
    inner = contract("x: b + a", "a as integer", "x as integer", lets="let b be a * 10", name="inner")
    outer = contract("x: b + inner({ a: b }).x", "a as integer", "x as integer", "uses inner", lets="let b be a + 1")
    df = spark.createDataFrame([(1,)], "a long")
    assert Program.from_text(outer, {"inner": inner}).transform(df).first().x == 2 + 22


# ---------------------------------------------------------------- dataset level

SHAPES = {
    "aggregates": (
        'n: length({ list: k }), t: fold({ list: map k as x do x.v * 2 end, initial: 5, fn: "add" }), d: length({ list: unique({ list: map $l as u do u.g end }) }), f: match sort-by({ list: k, field: "v" }) when [h, ..] then h.g else "none" end, e: length({ list: filter k where z z.v > 1000 end })',
        "n as integer, t as integer, d as integer, f as string, e as integer",
    ),
    "lists": ('a: map (slice({ list: sort-by({ list: k, field: "v" }), start: 1, end: 4 })) as s do s.v end, b: join({ list: map k as j do j.g end, delimiter: "," })', "a as list of integer, b as string"),
    "empty": ('n: length({ list: none }), t: fold({ list: map none as x do x.v end, initial: 7, fn: "add" }), f: match sort-by({ list: none, field: "v" }) when [] then "none" when [h, ..r] then h.g end', "n as integer, t as integer, f as maybe string"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_dataset_level_equals_row_level(spark, shape):
    body, outputs = SHAPES[shape]
    text = contract(body, "l as list of record i as integer, v as integer, g as string end", outputs, lets="let k be filter $l where y y.v mod 3 != 0 end let none be filter $l where w w.v > 99999 end")
    rows = spark.range(50).select(F.col("id").alias("i"), ((F.col("id") * 37) % 101).alias("v"), F.concat(F.lit("g"), F.col("id") % 7).alias("g"))
    p = Program.from_text(text)
    lifted = p.aggregate(rows.repartition(5), order="i", fallback=False).first().asDict()
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("i", "v", "g"))).alias("l"))
    assert lifted == p.transform(packed).first().asDict()


def test_fallback_runs_on_the_gathered_list(spark):
    text = contract("m: match l when [a, b, ..rest] then length({ list: rest }) else 0 end", "l as list of integer", "m as integer")
    rows = spark.range(9).select(F.col("id").alias("i"), F.col("id").alias("l"))
    assert Program.from_text(text).aggregate(rows, order="i", fallback=True).first().m == 7
    with pytest.raises(TypeFault):
        Program.from_text(text).aggregate(rows, order="i")
    with pytest.raises(ContractError):
        Program.from_text(text).aggregate(rows, fallback=True)


def test_one_scan_for_all_aggregates(spark):
    text = contract('n: length({ list: k }), t: fold({ list: map k as x do x.v end, initial: 0, fn: "add" })', "l as list of record v as integer end", "n as integer, t as integer", lets="let k be filter $l where y y.v > 3 end")
    rows = spark.range(10).select(F.col("id").alias("v"))
    plan = Program.from_text(text).aggregate(rows, fallback=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range") == 1


# ---------------------------------------------------------------- streaming and plans


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, "s") for i in range(10)], "a long, s string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = Program.from_text(RULES).transform(stream, mode="drop", keep=["a"])
    q = out.writeStream.format("memory").queryName("out_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.x for r in spark.sql("select * from out_stream").collect()) == [2, 4, 6, 8, 10]


def test_plans_stay_in_the_jvm_and_prune_columns(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("a"), F.lit("x").alias("s"), F.lit(1.5).alias("unused")).write.parquet(str(tmp_path / "t"))
    text = contract("x: to-string({ value: 2.5 * a }), y: s through upper({})", outputs="x as string, y as string")
    plan = Program.from_text(text).explain(spark.read.parquet(str(tmp_path / "t")))
    assert "unused" not in plan and "Python" not in plan


def test_names_and_metadata(spark):
    p = Program.from_text(contract("x-y: a-b", "a-b as integer", "x-y as integer"))
    df = spark.createDataFrame([(4,)], "a_b int")
    assert p.transform(df, snake=True).columns == ["x_y"]
    assert p.transform(df).first()["x-y"] == 4
    assert p.input_schema.simpleString() == "struct<a-b:bigint>"


# ---------------------------------------------------------------- whole tables


def test_rules_hold_over_whole_tables(spark):
    """Rules on the list input and on outputs are enforced when the list is a DataFrame, or refused."""
    body, outputs = 'n: length({ list: $l }), t: fold({ list: $l, initial: 0, fn: "add" })', "n as integer, t as integer"
    rows = spark.range(4).select(F.col("id").alias("l")).repartition(3)
    for rules, good in (("require input.l length({ list: input.l }) > 3 end", True), ("require input.l length({ list: input.l }) > 4 end", False), ("require output.t output.t = 6 end", True), ("require output.t output.t < 6 end", False)):
        p = Program.from_text(contract(body, "l as list of integer", outputs, rules=f"rules {rules} end"))
        if good:
            assert p.aggregate(rows).first().t == 6
        else:
            with pytest.raises(Exception, match="rejected"):
                p.aggregate(rows).collect()
    p = Program.from_text(contract("k: filter $l where x x > 1 end", "l as list of integer", "k as list of integer", rules="rules require input.l length({ list: input.l }) > 4 end end"))
    with pytest.raises(TypeFault):
        p.aggregate(rows)


def test_lookups_of_elements_over_shuffled_rows(spark):
    """Each row gets the records of its own list, whatever shuffles lie before, with equal, empty, null and unknown lists."""
    source = spark.createDataFrame([(f"k{i}", 1, f"v{i}", None) for i in range(40)], "k string, n long, v string, w double")
    text = contract('vs: map l as e do (lookup src where k = e, n = 1 end).v or else "?" end, i: $i', "i as integer, l as list of string", "i as integer, vs as list of string", "sources src")
    rows = [(i, [f"k{(i * j) % 50}" for j in range(i % 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, l array<string>").repartition(7, "l").groupBy("i").agg(F.first("l").alias("l"))
    p = Program.from_text(text, {"src": SOURCE})
    got = {r.i: r.vs for r in p.transform(df, catalog=Catalog(spark).register("src", source)).collect()}
    want = {i: ["v" + k[1:] if int(k[1:]) < 40 else "?" for k in keys] for i, keys in rows}
    assert {i: v or [] for i, v in got.items()} == want
