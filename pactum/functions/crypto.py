"""Digests and identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import STRING
from .base import Args, Library, Typed, function, out

FUNCTIONS: Library = {}
BLOCK = 64


@function(FUNCTIONS, "sha256")
def sha256(a: Args) -> Typed:
    return out(a, F.sha2(a.string("value"), 256), STRING)


DIGITS = "0123456789ABCDEF"


def padded(key: Column, pad: int) -> Column:
    """The key's bytes, hashed if over a block and filled up to one with zeros, each combined with pad by exclusive or."""
    raw = F.encode(key, "UTF-8")
    raw = F.when(F.octet_length(raw) > BLOCK, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    digits = F.rpad(F.hex(raw), 2 * BLOCK, "0")
    high, low = ("".join(DIGITS[d ^ nibble] for d in range(16)) for nibble in (pad >> 4, pad & 15))

    def flipped(i: Column) -> Column:
        first, second = (F.substring(digits, 2 * i + k, F.lit(1)) for k in (1, 2))
        return F.concat(F.translate(first, DIGITS, high), F.translate(second, DIGITS, low))

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), flipped), ""))


@function(FUNCTIONS, "hmac-sha256")
def hmac_sha256(a: Args) -> Typed:
    value, key = a.string("value"), a.get("key")
    if key.known:
        raw = key.literal.encode("utf-8")
        raw = hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw
        raw = raw.ljust(BLOCK, b"\0")
        inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    else:
        inner, outer = (padded(a.string("key"), pad) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return out(a, F.sha2(F.concat(outer, digest), 256), STRING)


@function(FUNCTIONS, "uuid")
def uuid(a: Args) -> Typed:
    return Typed(F.uuid(), STRING)
