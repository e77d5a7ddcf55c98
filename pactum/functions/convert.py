"""Conversions. Text of floats has six significant digits, with `.0` where nothing follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeFault
from ..types import FLOAT, INTEGER, STRING
from .base import Args, Library, Typed, function, out

FUNCTIONS: Library = {}
NUMBER = r"^[ \t\n\x0B\f\r]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
WHOLE = r"^[ \t\n\x0B\f\r]*([+-]?\d+)"


def float_text(x: Column) -> Column:
    """Six significant digits, without trailing zeros but with `.0` where nothing follows; JVM-side, so it works in lambdas."""
    short = x.cast("string")
    # Of plain notation and at most six digits, the shortest form is that of six digits.
    plain = (x == 0) | (F.abs(x).between(1e-3, 999_999.0) & (F.length(F.translate(short, "-.", "")) <= 6))
    whole_number = (F.abs(x) < 1e6) & (x != 0) & (x == F.floor(x))
    return F.when(whole_number, F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).when(plain, short).otherwise(_six_digits(x))


def _six_digits(x: Column) -> Column:
    shown = F.format_string("%.5e", x)
    minus = F.when(F.startswith(shown, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_extract(shown, r"^-?([\d.]+)e", 1), r"\.", "")
    power = F.regexp_extract(shown, r"e([+-]\d+)$", 1).try_cast("int")
    whole = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    fixed = F.regexp_replace(F.regexp_replace(F.when(power >= 0, whole).otherwise(small), r"0+$", ""), r"\.$", ".0")
    head = F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5)), r"\.?0+$", "")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    wide = F.concat(head, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    text = F.concat(minus, F.when(power.between(-4, 5), fixed).otherwise(wide))
    return F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf")).otherwise(text)


def text_of(v: Typed, pos=None):
    kind = v.type.kind
    if kind == "string":
        return v.col
    if kind == "nothing":
        return F.lit("nothing")
    if kind in ("integer", "boolean"):
        found = v.col.cast("string")
    elif kind == "float":
        found = float_text(v.col)
    else:
        raise TypeFault(f"to-string takes no {v.type}", pos)
    return F.coalesce(found, F.lit("nothing")) if v.type.maybe else found


@function(FUNCTIONS, "to-string")
def to_string(a: Args) -> Typed:
    v = a.get("value")
    col = text_of(v, a.pos)
    if v.type.kind == "string" and v.type.maybe:
        col = F.coalesce(col, F.lit("nothing"))
    return Typed(col, STRING)


@function(FUNCTIONS, "to-float")
def to_float(a: Args) -> Typed:
    v = a.of(("integer", "float", "string"), "value")
    if v.type.kind == "string":
        found = F.regexp_extract(v.col, NUMBER, 1)
        return out(a, F.when(v.col.isNotNull(), F.when(found == "", F.lit(0.0)).otherwise(found.try_cast("double"))), FLOAT)
    return out(a, v.col.cast("double"), FLOAT)


@function(FUNCTIONS, "to-integer")
def to_integer(a: Args) -> Typed:
    v = a.of(("integer", "float", "string", "boolean"), "value")
    if v.type.kind == "string":
        found = F.regexp_extract(v.col, WHOLE, 1)
        return out(a, F.when(v.col.isNotNull(), F.when(found == "", F.lit(0)).otherwise(found.try_cast("bigint"))).cast("bigint"), INTEGER)
    return out(a, v.col.cast("bigint"), INTEGER)
