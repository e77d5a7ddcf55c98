"""The standard library: name -> builder over typed columns."""

from . import convert, crypto, dates, encoding, lists, numeric, records, strings
from .base import Function, Library

LIBRARY: Library = {}
for _part in (strings, numeric, lists, records, dates, encoding, crypto, convert):
    LIBRARY |= _part.FUNCTIONS
NAMES = frozenset(LIBRARY)

__all__ = ["LIBRARY", "NAMES", "Function"]
