"""Command line: python -m pactum (run | check | test | fmt | lex | parse | ir | explain) FILE [INPUT.json | JSON]."""

from __future__ import annotations

import json
import sys

from .ast import to_plain
from .errors import PactumError
from .lexer import tokens
from .parser import parse
from .program import Program


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    verb, path = args[:2]
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        if verb == "lex":
            for t in tokens(text, path):
                print(f"{t.pos[1]}:{t.pos[2]}\t{t.kind}\t{t.text}")
        elif verb == "parse":
            print(json.dumps(to_plain(parse(text, path)), indent=1))
        elif verb == "fmt":
            from .formatter import program_text

            print(program_text(parse(text, path)), end="")
        elif verb in ("check", "ir"):
            program = Program.load(path)
            print("\n".join(program.warnings) if verb == "check" else program.to_json())
        elif verb == "test":
            results = Program.load(path).run_tests(session())
            for r in results:
                print(("ok    " if r.passed else "FAIL  ") + r.label, *r.differences, sep="\n      ")
            return int(not all(r.passed for r in results))
        elif verb in ("run", "explain"):
            from .sources.records import from_file, from_text, to_text

            program, spark = Program.load(path), session()
            given = args[2] if len(args) > 2 else sys.stdin.read()
            df = from_text(spark, program, given) if given.lstrip()[:1] in ("{", "[") else from_file(spark, program, given)
            if verb == "explain":
                print(program.explain(df))
            else:
                for row in to_text(program.transform(df)).toLocalIterator():
                    print(row.value)
        else:
            print(__doc__)
            return 2
    except PactumError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
