"""Dates as text in ISO form or as records; everything is in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeFault
from ..types import INTEGER, STRING, record
from .base import Args, Library, Typed, function, out
from .records import assemble

FUNCTIONS: Library = {}
PARTS = ("year", "month", "day", "hour", "minute", "second")
DATE = record((p, INTEGER) for p in PARTS)
# Format directives and their patterns for reading and writing.
DIRECTIVES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "p": "a", "I": "hh", "e": "d", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "n": "\n", "t": "\t", "%": "'%'",
}
# How much text a directive reads.
READS = {
    "Y": r"\d{1,4}", "m": r"\d{1,2}", "d": r"\d{1,2}", "e": r"\d{1,2}", "H": r"\d{1,2}", "M": r"\d{1,2}", "S": r"\d{1,2}", "y": r"\d{2}",
    "b": r"[A-Za-z]{3}", "h": r"[A-Za-z]{3}", "B": r"[A-Za-z]+", "a": r"[A-Za-z]{3}", "A": r"[A-Za-z]+", "p": r"[AaPp][Mm]", "I": r"\d{1,2}", "j": r"\d{1,3}",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def expanded(fmt: str) -> list[tuple[str, str]]:
    """(kind, text) of a format: 'd' directives and 'l' literal text."""
    fmt = fmt.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S").replace("%D", "%m/%d/%y").replace("%R", "%H:%M")
    out_parts: list[tuple[str, str]] = []
    for m in re.finditer(r"%(.)|([^%]+)|%$", fmt, re.DOTALL):
        if m[1]:
            if m[1] not in DIRECTIVES:
                raise TypeFault(f"unsupported date directive %{m[1]}")
            out_parts.append(("l", "%") if m[1] == "%" else ("l", DIRECTIVES[m[1]]) if m[1] in "nt" else ("d", m[1]))
        else:
            out_parts.append(("l", m[0]))
    return out_parts


def iso(col: Column) -> Column:
    """The instant of an ISO text; a date alone is midnight."""
    return F.coalesce(
        F.try_to_timestamp(F.regexp_extract(col, r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})", 1), F.lit("y-M-d'T'H:m:s")),
        F.try_to_timestamp(F.regexp_extract(col, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("y-M-d")),
    )


def checked(value: Column, found: Column, what: str) -> Column:
    return F.when(value.isNull(), None).when(found.isNull(), F.raise_error(F.concat(F.lit(f"{what}: cannot read "), value))).otherwise(found)


@function(FUNCTIONS, "parse-date")
def parse_date(a: Args) -> Typed:
    value, fmt = a.string("value"), expanded(a.constant("format"))
    pattern, order = "^", []
    for kind, text in fmt:
        if kind == "l":
            pattern += re.sub(r"\s+", lambda m: r"\s*", re.escape(text).replace("\\ ", " ").replace("\\\n", "\n").replace("\\\t", "\t"))
        else:
            pattern += f"({READS[text]})"
            order.append(text)
    got = {d: F.regexp_extract(value, pattern, i + 1) for i, d in enumerate(order)}
    ok = F.regexp_like(value, F.lit(pattern))

    def number(*names: str, default: int) -> Column:
        for n in names:
            if n in got:
                return got[n].try_cast("bigint")
        return F.lit(default).cast("bigint")

    year = number("Y", default=1900)
    if "y" in got and "Y" not in got:
        short = got["y"].try_cast("bigint")
        year = F.when(short < 69, short + 2000).otherwise(short + 1900)
    month = number("m", default=1)
    word = next((got[n] for n in ("b", "h", "B") if n in got), None)
    if word is not None:
        place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(word, 1, 3)))
        month = F.when(place > 0, place)
    hour = number("H", default=0)
    if "I" in got:
        clock = got["I"].try_cast("bigint") % 12
        hour = clock + F.when(F.lower(got["p"]) == "pm", 12).otherwise(0) if "p" in got else clock
    parts = [year, month, number("d", "e", default=0), hour, number("M", default=0), number("S", default=0)]
    fine = ok & parts[1].between(1, 12) & parts[2].between(0 if not {"d", "e"} & set(order) else 1, 31) & parts[3].between(0, 23) & parts[4].between(0, 59) & parts[5].between(0, 61)
    bad = F.raise_error(F.concat(F.lit("parse-date: cannot read "), value))
    whole = F.struct(*[p.cast("bigint").alias(n) for p, n in zip(parts, PARTS, strict=True)])
    return out(a, F.when(value.isNull(), None).when(F.coalesce(fine, F.lit(False)), whole).otherwise(bad.cast(whole_type())), DATE)


def whole_type():
    from ..types import spark_type

    return spark_type(DATE)


@function(FUNCTIONS, "format-date")
def format_date(a: Args) -> Typed:
    v = a.of("record", "date")
    part = {p: v.field(p).col if v.type.field(p) is not None else F.lit(0).cast("bigint") for p in PARTS}
    instant = F.try_make_timestamp(*[part[p].cast("int") if p != "second" else part[p].cast("decimal(8,6)") for p in PARTS])
    pieces = []
    for kind, text in expanded(a.constant("format")):
        if kind == "l":
            pieces.append(F.lit(text))
        elif text in ("Y", "m", "d", "H", "M", "S"):
            which = dict(zip("YmdHMS", PARTS, strict=True))[text]
            pieces.append(F.lpad(part[which].cast("string"), 4 if text == "Y" else 2, "0") if text != "Y" else part[which].cast("string"))
        elif text == "e":
            pieces.append(F.lpad(part["day"].cast("string"), 2, " "))
        else:
            pieces.append(F.date_format(instant, DIRECTIVES[text]))
    return out(a, F.concat(*pieces) if pieces else F.lit(""), STRING)


def by_unit(a: Args, build) -> Column:
    """build(unit) for the unit of the call, which a row may name; unknown units count as seconds."""
    given = a.get("unit")
    if given.known:
        return build(given.literal.removesuffix("s"))
    name = F.regexp_replace(a.string("unit"), "s$", "")
    found = build("second")
    for unit in ("minute", "hour", "day", "month", "year"):
        found = F.when(name == unit, build(unit)).otherwise(found)
    return F.when(name.isNotNull(), found)


@function(FUNCTIONS, "date-diff")
def date_diff(a: Args) -> Typed:
    start, end = a.string("from", "a"), a.string("to", "b")
    seconds = F.unix_timestamp(checked(end, iso(end), "date-diff")) - F.unix_timestamp(checked(start, iso(start), "date-diff"))
    size = by_unit(a, lambda unit: F.lit(SECONDS.get(unit, 1)))
    return out(a, F.when(seconds >= 0, F.floor(seconds / size)).otherwise(F.ceil(seconds / size)).cast("bigint"), INTEGER)


@function(FUNCTIONS, "date-add")
def date_add(a: Args) -> Typed:
    value, amount = a.string("date"), a.integer("amount")
    at = checked(value, iso(value), "date-add")

    def moved_by(unit: str) -> Column:
        if unit not in ("month", "year"):
            return F.timestamp_seconds(F.unix_timestamp(at) + amount * SECONDS.get(unit, 1))
        # Days past the end of the month run over into the next one.
        months = amount * (12 if unit == "year" else 1)
        first = F.date_trunc("month", at) + F.make_interval(F.lit(0), months.cast("int"))
        return F.timestamp_seconds(F.unix_timestamp(first) + (F.dayofmonth(at) - 1) * 86400 + F.pmod(F.unix_timestamp(at), F.lit(86400)))

    moved = by_unit(a, moved_by)
    short = F.regexp_like(value, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")) & (F.pmod(F.unix_timestamp(moved), F.lit(86400)) == 0)
    full = F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out(a, F.when(short, F.date_format(moved, "yyyy-MM-dd")).otherwise(full), STRING)


@function(FUNCTIONS, "now-date")
def now_date(a: Args) -> Typed:
    fixed = getattr(a.env, "now", None)
    return Typed(F.lit(fixed) if fixed else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING)


__all__ = ["FUNCTIONS", "assemble"]
