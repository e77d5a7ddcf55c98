"""Registered queries, command line, JSON records, streaming writers, and that the corpus part is optional."""

import json
import os
import subprocess
import sys

from pactum import Program
from pactum.sources.records import from_file, from_text, to_text
from pactum.streaming import per_batch, quarantined

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXT = 'contract double input a as integer, s as maybe string end output x as integer, s as maybe string end rules require input.a input.a > 0 else reject "positive" end end tests test "one" given { a: 1 } expect { x: 2 } end end end define double with input result { x: a * 2, s: s } end'


def test_registered_queries_have_sql():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"lift_mixed", "top_k", "lookup_customer"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
    assert {n for n in names if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"} == {"uuid_gen"}


def test_nothing_else_needs_the_corpus_part():
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n def find_spec(self, n, p, t=None):\n  if n in ('pactum.llm', 'corpus_pipeline'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert 'lift_mixed' in e.queries() and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_json_records(spark, tmp_path):
    p = Program.from_text(TEXT)
    (tmp_path / "in.json").write_text('{"a": 21}')
    assert to_text(p.transform(from_file(spark, p, str(tmp_path / "in.json")))).first().value == '{"x":42,"s":null}'
    assert [r.x for r in p.transform(from_text(spark, p, '{"a": 1}', '{"a": 2, "s": "t"}')).collect()] == [2, 4]


def test_command_line(tmp_path, capsys):
    from pactum.__main__ import main

    (tmp_path / "double.txt").write_text(TEXT)
    path = str(tmp_path / "double.txt")
    assert main(["check", path]) == 0 and main(["lex", path]) == 0 and main(["fmt", path]) == 0 and main(["parse", path]) == 0
    out = capsys.readouterr().out
    assert "contract double" in out and json.loads(out[out.index("\n{") :])["node"] == "program"
    (tmp_path / "bad.txt").write_text(TEXT.replace("a * 2", "b * 2"))
    assert main(["check", str(tmp_path / "bad.txt")]) == 1
    assert "undefined name b" in capsys.readouterr().err
    assert main(["nothing"]) == 2


def test_quarantine_of_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (-1, "b"), (3, "c")], "a long, s string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    p = Program.from_text(TEXT)
    q = quarantined(p, stream, str(tmp_path / "cp"), str(tmp_path / "good"), str(tmp_path / "bad")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [2, 6]
    assert [list(r._reject) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [["positive"]]


def test_whole_list_programs_per_batch(spark, tmp_path):
    df = spark.createDataFrame([(1,), (5,)], "l long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    text = 'contract c input l as list of integer end output t as integer end end define c with input result { t: fold({ list: l, initial: 0, fn: "add" }) } end'
    seen = []
    q = per_batch(Program.from_text(text), stream, lambda out, number: seen.append(out.first().t)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(seen) == 6
