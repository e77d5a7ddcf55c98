"""Byte-pair encoding and decoding with a public tokenizer file.

A word's symbols form a doubly linked list and its mergeable pairs a priority queue of merge ranks; entries whose
symbols have changed since are skipped when they come up. Words repeat, so a bounded cache keeps their ids. Decoding
looks every id up and joins the vocabulary strings, as a tokenizer without a decoder does.

Defined results: null and empty texts give no ids and an empty decoded text; the two special tokens are recognised in
the raw text; symbols that are not in the vocabulary are left out, as the file names no unknown token; equal texts
get equal values; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = regex.compile(r"[ \t\n\r]")
# Code points (hexadecimal, first and last) that are letters or numbers to the regex module, not yet to the
# tables of the tokenizers library.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 "
    "16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
).split()
# Capital letters (first and last) that only the library knows, and how far on their small ones stand.
CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),)
_SMALL = {c: c + d for a, b, d in CAPITALS for c in range(a, b + 1)}
_NEWER = "".join("-".join(f"\\U{int(c, 16):08X}" for c in x.split("-")) for x in NEWER)
FAR = re.compile("[\u0558-\U0010ffff]")
HAS_NEWER = regex.compile(f"[{_NEWER}{''.join(map(chr, _SMALL))}]")
#: Characters of a very long text that are in work at once.
PIECE = 1 << 20
#: Words kept in the cache of a worker.
CACHE = 1 << 18


def holds_newer(text: str) -> bool:
    """Whether a text has a character of NEWER or CAPITALS; those are far above the letters of most texts."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(FAR.search(text) and HAS_NEWER.search(text))
    return False


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class _Ids(dict):
    """Word to its ids as little-endian 32-bit integers."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        made = self[key] = self.make(key)
        return made


class Encoder:
    def __init__(self, text: str):
        """text: a tokenizer file's."""
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        ids = self.vocab
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.strings = {i: s for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        chars = byte_characters()
        self.first = [ids.get(c) for c in chars]
        self.last = [ids.get(c + self.suffix) for c in chars]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.words = regex.compile(pattern)
        # The same words where letters and numbers are only those that the library knows.
        for kind in ("L", "N"):
            pattern = pattern.replace(f"[\\p{{{kind}}}]", f"(?:(?![{_NEWER}])\\p{{{kind}}})")
        self.older = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{_NEWER}]|[^\s\p{{L}}\p{{N}}])"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.ids = _Ids(self._word)
        self.texts = _Ids(self._text)

    def normalise(self, text: str) -> str:
        """NFC, then character by character to lower case. White space needs no care, as no word holds any."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.translate(_SMALL) if holds_newer(text) else text

    def split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.older.findall(text.translate(_SMALL)) if holds_newer(text) else self.words.findall(text)

    def symbols(self, data: bytes) -> list[int]:
        head = [self.first[b] for b in data[:-1]]
        return [s for s in [*head, self.last[data[-1]]] if s is not None]

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges of a symbol list, lowest rank first and leftmost among equals."""
        merge, n = self.merge, len(symbols)
        queue = []
        for i in range(n - 1):
            m = merge.get((symbols[i], symbols[i + 1]))
            if m:
                queue.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        sym: list[int | None] = list(symbols)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        while queue:
            _, i, a, b, made = pop(queue)
            if sym[i] != a:
                continue
            j = nxt[i]
            if j >= n or sym[j] != b:
                continue
            sym[i] = made
            sym[j] = None
            after = nxt[i] = nxt[j]
            if after < n:
                prv[after] = i
                m = merge.get((made, sym[after]))
                if m:
                    push(queue, (m[0], i, made, sym[after], m[1]))
            before = prv[i]
            if before >= 0:
                m = merge.get((sym[before], made))
                if m:
                    push(queue, (m[0], before, sym[before], made, m[1]))
        return [s for s in sym if s is not None]

    def _word(self, word: str) -> bytes:
        ids = self.merged(self.symbols(word.encode("utf-8")))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _text(self, ids: bytes) -> str:
        return " ".join([self.strings[i] for (i,) in struct.iter_unpack("<I", ids)])

    def chunks(self, text: str) -> list[bytes]:
        """Ids of a text, word by word."""
        if "<|" not in text:
            return [*map(self.ids.__getitem__, self.split(text))]
        out: list[bytes] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                out += map(self.ids.__getitem__, self.split(part))
        return out

    def pieces(self, text: str) -> Iterator[list[bytes]]:
        """chunks of a text, about PIECE characters at a time; no word or special token holds the white space it is cut at."""
        at = 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                m = SPACE.search(text, end)
                end = m.start() if m else len(text)
            yield self.chunks(text[at:end])
            at = end

    def encode(self, text: str) -> list[int]:
        return [i for (i,) in struct.iter_unpack("<I", b"".join(self.chunks(text)))]

    def decode(self, ids: list[int]) -> str:
        return self._text(struct.pack(f"<{len(ids)}I", *ids))

    def decode_chunks(self, chunks: list[bytes]) -> str:
        return " ".join(map(self.texts.__getitem__, [c for c in chunks if c]))


@lru_cache(maxsize=2)
def _parsed(text: str) -> Encoder:
    return Encoder(text)


def encoder(path: str) -> Encoder:
    return _parsed(Path(path).read_text(encoding="utf-8"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the decoded text of every row."""

    def whole(enc: Encoder, text: str) -> tuple:
        chunks = [c for part in enc.pieces(text) for c in part]
        return b"".join(chunks), enc.decode_chunks(chunks)

    return _run(docs, path, "doc_id long, ids binary, decoded string", whole, ("ids", "decoded"), (pa.binary(), pa.string()))


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; texts and ids don't leave the worker."""

    def digest(enc: Encoder, text: str) -> tuple:
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        for chunks in enc.pieces(text):
            raw = b"".join(chunks)
            if raw:
                decoded.update((" " if n else "").encode() + enc.decode_chunks(chunks).encode("utf-8"))
                ids.update(raw)
                n += len(raw) // 4
        return n, ids.hexdigest(), decoded.hexdigest()

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest, names, (pa.int64(), pa.string(), pa.string()))


def _run(docs: DataFrame, path: str, schema: str, make, names, kinds) -> DataFrame:
    small_batches(docs.sparkSession)
    # The driver reads the file, which executors need not have.
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _parsed(shared.value)
        for batch in batches:
            rows = [make(enc, text.as_py() or "") for text in batch.column(1)]
            cols = [*zip(*rows, strict=True)] or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)
