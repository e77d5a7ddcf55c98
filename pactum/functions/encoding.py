"""Base64, URL and JSON encoding."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..types import ANY, STRING, Type
from .base import Args, Library, Typed, function, out

FUNCTIONS: Library = {}


@function(FUNCTIONS, "base64-encode")
def base64_encode(a: Args) -> Typed:
    return out(a, F.regexp_replace(F.base64(F.encode(a.string("value"), "UTF-8")), r"[\r\n]", ""), STRING)


@function(FUNCTIONS, "base64-decode")
def base64_decode(a: Args) -> Typed:
    clean = F.regexp_replace(a.string("value"), r"[^A-Za-z0-9+/]", "")
    # A single left-over character carries no whole byte.
    whole = F.when(F.length(clean) % 4 == 1, F.substring(clean, F.lit(1), F.length(clean) - 1)).otherwise(clean)
    return out(a, F.decode(F.unbase64(whole), "UTF-8"), STRING)


@function(FUNCTIONS, "url-encode")
def url_encode(a: Args) -> Typed:
    found = F.url_encode(a.string("value"))
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        found = F.replace(found, F.lit(was), F.lit(now))
    return out(a, found, STRING)


@function(FUNCTIONS, "url-decode")
def url_decode(a: Args) -> Typed:
    value = a.string("value")
    # Percent signs that begin no escape stand for themselves.
    mended = F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25")
    return out(a, F.coalesce(F.try_url_decode(value), F.try_url_decode(mended)), STRING)


@F.pandas_udf(StringType())
def exact_float(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None or x != x else f"{x:.17g}")


def has_float(t: Type) -> bool:
    return t.kind == "float" or t.of is not None and has_float(t.of) or any(has_float(f) for _, f in t.fields)


def quoted(col):
    return F.regexp_replace(F.regexp_replace(F.to_json(F.struct(col.alias("v"))), r'^\{"v":', ""), r"\}$", "")


def json_text(v: Typed, inside: bool = False):
    """JSON of a value; floats have 17 significant digits, but inside list steps the shortest that say the same."""
    t = v.type
    if t.kind == "nothing":
        return F.lit("null")
    if t.kind == "any":
        return F.coalesce(F.to_json(v.col), F.lit("null"))
    if t.kind == "string":
        found = quoted(v.col)
    elif t.kind in ("integer", "boolean"):
        found = v.col.cast("string")
    elif t.kind == "float":
        found = v.col.cast("string") if inside else exact_float(v.col)
    elif t.kind == "record" and has_float(t):
        parts = []
        for i, (n, _) in enumerate(t.fields):
            parts += [F.lit(("," if i else "") + json.dumps(n, ensure_ascii=False) + ":"), json_text(v.field(n), inside)]
        found = F.when(v.col.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    else:
        found = F.to_json(v.col, {"ignoreNullFields": "false"})
    return F.coalesce(found, F.lit("null"))


@function(FUNCTIONS, "json-encode")
def json_encode(a: Args) -> Typed:
    return Typed(json_text(a.get("value"), a.inside), STRING)


@function(FUNCTIONS, "json-parse")
def json_parse(a: Args) -> Typed:
    return Typed(F.parse_json(a.string("value")), ANY)
