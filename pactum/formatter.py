"""Canonical source text of trees. Formatting what was formatted changes nothing; comments are not kept."""

from __future__ import annotations

from .ast import Node

LEVEL = {"or": 1, "or-else": 1, "and": 2, "=": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "mod": 6}
FORMS = ("if", "match", "filter", "map", "lookup", "through")
WRITTEN = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t"}


def quoted(s: str) -> str:
    return '"' + "".join(WRITTEN.get(c, c) for c in s) + '"'


def literal_text(v: object) -> str:
    if v is None:
        return "nothing"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, float):
        text = repr(v)
        return text if any(c in text for c in ".e") else text + ".0"
    return str(v)


def expression_text(e: Node, level: int = 0, pad: str = "") -> str:
    k = e.kind
    if k == "binary":
        own = LEVEL[e.op]
        op = "or else" if e.op == "or-else" else e.op
        # Comparisons do not chain; the others lean left.
        text = f"{expression_text(e.left, own + (own == 4), pad)} {op} {expression_text(e.right, own + 1, pad)}"
        return f"({text})" if own < level else text
    if k == "not":
        text = f"not {expression_text(e.of, 3, pad)}"
        return f"({text})" if level > 3 else text
    if k == "is":
        text = f"{expression_text(e.of, 5, pad)} is {e.what}"
        return f"({text})" if level > 4 else text
    if k == "negate":
        text = f"- {expression_text(e.of, 7, pad)}" if e.of.kind == "literal" else f"-{expression_text(e.of, 7, pad)}" if e.of.kind != "name" else f"- {expression_text(e.of, 7, pad)}"
        return f"({text})" if level > 7 else text
    if k in FORMS:
        text = form_text(e, pad)
        return f"({text})" if level > 0 else text
    if k == "literal":
        return literal_text(e.value)
    if k == "input":
        return "$" + e.name
    if k == "name":
        return e.name
    if k == "field":
        return f"{expression_text(e.of, 8, pad)}.{e.name}"
    if k == "index":
        return f"{expression_text(e.of, 8, pad)}.{e.at}"
    if k == "call":
        return f"{e.name}({expression_text(e.args, 0, pad)})"
    if k == "list":
        return "[" + ", ".join(expression_text(v, 0, pad) for v in e.items) + "]"
    if k == "record":
        return "{ " + ", ".join(f"{n}: {expression_text(v, 0, pad)}" for n, v in e.fields) + " }" if e.fields else "{}"
    raise ValueError(k)


def form_text(e: Node, pad: str) -> str:
    more = pad + "  "
    if e.kind == "if":
        parts = [f"if {expression_text(t, 0, more)} then {expression_text(v, 0, more)}" for t, v in e.branches]
        return f"\n{pad}else ".join([*parts, expression_text(e.other, 0, more)]) + f"\n{pad}end"
    if e.kind == "match":
        lines = [f"match {expression_text(e.on, 0, more)}", *[f"{more}{clause_text(c, more)}" for c in e.clauses]]
        if e.other is not None:
            lines.append(f"{more}else {expression_text(e.other, 0, more)}")
        return "\n".join([*lines, f"{pad}end"])
    if e.kind == "filter":
        return f"filter {expression_text(e.of, 0, pad)} where {e.var} {expression_text(e.test, 1, pad)} end"
    if e.kind == "map":
        return f"map {expression_text(e.of, 0, pad)} as {e.var} do {expression_text(e.body, 0, pad)} end"
    if e.kind == "lookup":
        return f"lookup {e.source} where " + ", ".join(f"{k} = {expression_text(v, 0, pad)}" for k, v in e.keys) + " end"
    head = expression_text(e.value, 1 if e.value.kind != "through" else 0, pad)
    return f"{head} through {expression_text(e.step, 0, pad)}"


def clause_text(c: Node, pad: str) -> str:
    guard = f" and {expression_text(c.guard, 1, pad)}" if c.guard is not None else ""
    return f"when {pattern_text(c.pattern)}{guard} then {expression_text(c.then, 0, pad)}"


def pattern_text(p: Node) -> str:
    if p.kind == "any":
        return "_"
    if p.kind == "bind":
        return p.name
    if p.kind == "literal":
        return literal_text(p.value)
    if p.kind == "between":
        return f"between {expression_text(p.low, 4)} and {expression_text(p.high, 4)}"
    if p.kind == "listing":
        items = [pattern_text(x) for x in p.items] + ([".." + (p.rest or "")] if p.open else [])
        return "[" + ", ".join(items) + "]"
    return "{ " + ", ".join(f"{n}: {pattern_text(x)}" for n, x in p.fields) + " }" if p.fields else "{}"


def type_text(t: Node) -> str:
    if t.name == "maybe":
        return f"maybe {type_text(t.of)}"
    if t.name == "list":
        return f"list of {type_text(t.of)}"
    if t.name == "record":
        return "record " + ", ".join(field_text(f) for f in t.fields) + " end"
    return t.name


def field_text(f: Node) -> str:
    return f"{f.name} as {type_text(f.type)}" + (" tagged " + " ".join(f.tags) if f.tags else "")


def block(head: str, lines: list[str], joint: str = "") -> list[str]:
    return [f"  {head}", *[f"    {x}{joint if i < len(lines) - 1 else ''}" for i, x in enumerate(lines)], "  end", ""]


def rule_text(r: Node) -> str:
    if r.kind == "forbid-tag":
        return f"forbid tagged {r.tag} in output"
    ref = ".".join([r.ref.side, *r.ref.path])
    if r.kind == "forbid-field":
        return f"forbid {ref} in output"
    other = f"\n      else reject {quoted(r.message)}" if r.message is not None else ""
    if r.kind == "require":
        return f"require {ref}\n      {expression_text(r.test, 1, '      ')}{other}\n    end"
    clauses = "".join(f"\n      {clause_text(c, '      ')}" for c in r.clauses)
    return f"match {ref}{clauses}{other}\n    end"


def program_text(p: Node) -> str:
    c = p.contract
    lines = [f"contract {c.name}"]
    if c.uses:
        lines += [f"  uses {', '.join(c.uses)}", ""]
    if c.tags:
        lines += block("tags", [t.name + (f" {quoted(t.about)}" if t.about is not None else "") for t in c.tags], ",")
    if c.form == "source":
        lines += [f"  source {quoted(c.source)}", ""]
        if c.config:
            lines += block("config", [f"{k}: {expression_text(v)}" for k, v in c.config], ",")
        lines += [f"  keyed-by {', '.join(map(field_text, c.keys))}", "", f"  returns {type_text(c.returns)}"]
    elif c.form == "function":
        if c.sanitizers:
            made = [s.name + (f" using {s.using}" if s.using else "") + f" strips {' '.join(s.strips)}" for s in c.sanitizers]
            lines += block("sanitizers", made, ",")
        if c.sources:
            lines += [f"  sources {', '.join(c.sources)}", ""]
        lines += block("input", list(map(field_text, c.inputs)), ",") + block("output", list(map(field_text, c.outputs)), ",")
        if c.rules:
            lines += block("rules", list(map(rule_text, c.rules)))
        if c.tests:
            made = [f"test {quoted(t.label)}\n      given {expression_text(t.given)}\n      expect {expression_text(t.expect)}\n    end" for t in c.tests]
            lines += block("tests", made)
    while lines[-1] == "":
        lines.pop()
    lines.append("end")
    f = p.function
    if f is not None:
        lines += ["", f"define {f.name} with input"]
        lines += [f"  let {x.name} be {expression_text(x.value, 0, '  ')}" for x in f.lets]
        lines += ["", f"  result {expression_text(f.result, 0, '  ')}", "end"]
    return "\n".join(lines) + "\n"
