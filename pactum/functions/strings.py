"""String functions. Positions and lengths count code points; white space is the six ASCII kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeFault
from ..types import BOOLEAN, INTEGER, STRING, listing
from .base import Args, Library, Typed, function, out

FUNCTIONS: Library = {}
SPACE = " \t\n\v\f\r"

# POSIX bracket classes and their Java names.
CLASSES = {
    "alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct",
    "print": "Print", "graph": "Graph", "cntrl": "Cntrl", "xdigit": "XDigit", "blank": "Blank",
}


def java_pattern(posix: str) -> str:
    """A POSIX extended pattern as a Java one: bracket classes, literal brackets and backslashes inside brackets."""

    def bracket(m: re.Match) -> str:
        body = m[2]
        parts, at = [], 0
        while at < len(body):
            c = re.match(r"\[:(\w+):\]", body[at:])
            if c:
                if c[1] not in CLASSES:
                    raise TypeFault(f"unknown character class {c[1]}")
                parts.append(rf"\p{{{CLASSES[c[1]]}}}")
                at += len(c[0])
            else:
                parts.append("\\" + body[at] if body[at] in "\\[]&^" and not (body[at] == "^" and at == 0 and not m[1]) or body[at] == "^" else body[at])
                at += 1
        return f"[{m[1]}{''.join(parts)}]"

    return re.sub(r"\[(\^?)(\]?(?:\[:\w+:\]|[^\]])*)\]", bracket, posix)


def _simple(name: str, build) -> None:
    @function(FUNCTIONS, name)
    def call(a: Args) -> Typed:
        return out(a, build(a.string("value")), STRING)


_simple("upper", F.upper)
_simple("lower", F.lower)
_simple("trim", lambda c: F.btrim(c, F.lit(SPACE)))
_simple("trim-start", lambda c: F.ltrim(c, F.lit(SPACE)))
_simple("trim-end", lambda c: F.rtrim(c, F.lit(SPACE)))


@function(FUNCTIONS, "substring")
def substring(a: Args) -> Typed:
    start = F.greatest(a.integer("start"), F.lit(0)).cast("int")
    end = F.greatest(a.integer("end"), F.lit(0)).cast("int")
    return out(a, F.substring(a.string("value"), start + 1, F.greatest(end - start, F.lit(0))), STRING)


@function(FUNCTIONS, "replace")
def replace(a: Args) -> Typed:
    return out(a, F.replace(a.string("value"), a.string("find"), a.string("replacement")), STRING)


@function(FUNCTIONS, "split")
def split(a: Args) -> Typed:
    value, by = a.string("value"), a.string("delimiter")
    letters = F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, ""))
    # A quoted pattern; a delimiter that holds the end of quoting is quoted in two parts.
    quoted = F.concat(F.lit("\\Q"), F.replace(by, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(value, quoted)
    known = a.get("delimiter")
    if known.known:
        found = letters if known.literal == "" else parts
    else:
        found = F.when(by == "", letters).otherwise(parts)
    return out(a, found, listing(STRING))


@function(FUNCTIONS, "join")
def join(a: Args) -> Typed:
    v = a.of("list", "list")
    items = v.col if v.type.of.kind == "string" else F.transform(v.col, lambda x: F.lit("")) if v.type.of.kind != "nothing" else v.col.cast("array<string>")
    delimiter = a.get("delimiter")
    if delimiter.known:
        return out(a, F.array_join(items, delimiter.literal, ""), STRING)
    each = F.transform(items, lambda x: F.coalesce(x, F.lit("")))
    glued = F.aggregate(F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))), F.coalesce(F.get(each, F.lit(0)), F.lit("")), lambda s, x: F.concat(s, delimiter.col, x))
    return out(a, glued, STRING)


@function(FUNCTIONS, "starts-with")
def starts_with(a: Args) -> Typed:
    return out(a, F.startswith(a.string("value"), a.string("prefix")), BOOLEAN)


@function(FUNCTIONS, "ends-with")
def ends_with(a: Args) -> Typed:
    return out(a, F.endswith(a.string("value"), a.string("suffix")), BOOLEAN)


@function(FUNCTIONS, "contains")
def contains(a: Args) -> Typed:
    return out(a, F.contains(a.string("value"), a.string("substring", "search")), BOOLEAN)


@function(FUNCTIONS, "length")
def length(a: Args) -> Typed:
    if a.has("list"):
        return out(a, F.size(a.of("list", "list").col).cast("bigint"), INTEGER)
    v = a.of(("string", "list"), "value")
    return out(a, (F.size(v.col) if v.type.kind == "list" else F.length(v.col)).cast("bigint"), INTEGER)


def _pad(name: str, build) -> None:
    @function(FUNCTIONS, name)
    def call(a: Args) -> Typed:
        value, fill = a.string("value"), a.string("fill")
        width = F.greatest(a.integer("width"), F.length(value).cast("bigint")).cast("int")
        return out(a, F.when(fill == "", value).otherwise(build(value, width, fill)), STRING)


_pad("pad-left", F.lpad)
_pad("pad-right", F.rpad)


def pattern_column(a: Args) -> Column:
    """The Java pattern of the argument; of a value known per row only, the bracket classes are put into Java's words."""
    given = a.get("pattern")
    if given.known:
        return F.lit(java_pattern(given.literal))
    col = a.string("pattern")
    for posix, java in CLASSES.items():
        col = F.replace(col, F.lit(f"[:{posix}:]"), F.lit(rf"\p{{{java}}}"))
    return F.replace(col, F.lit("&&"), F.lit(r"&\&"))


@function(FUNCTIONS, "regex-match")
def regex_match(a: Args) -> Typed:
    return out(a, F.regexp_like(a.string("value"), pattern_column(a)), BOOLEAN)


@function(FUNCTIONS, "regex-replace")
def regex_replace(a: Args) -> Typed:
    literal = F.regexp_replace(a.string("replacement"), r"([\\$])", r"\\$1")
    return out(a, F.regexp_replace(a.string("value"), pattern_column(a), literal), STRING)
