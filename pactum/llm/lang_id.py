"""Language identification by prediction by partial matching.

For each language a context tree over bytes (orders 0 to 3) is counted on a bounded sample of labelled texts and then
frozen. A byte's code length is taken at the longest context that the language has seen, with escapes of method C
down to shorter ones and to the uniform distribution at the end. The trees are compiled into one table of exact code
lengths per (context, byte, language), so that a text costs two gathers a byte and a sum.

The sample is of pieces of PIECE_BYTES from anywhere in the texts, drawn by hash. Parameters that bound the fit: SAMPLE_BYTES
over all languages together, CONTEXTS contexts (should a sample hold more that were met twice, the most frequent ones stay),
127 byte values (the rest share an escape symbol).

Defined results: null texts and texts without a letter are `und` with score 0; where nothing can be learned every
text is; ties go to the language that sorts first; repeated rows get equal results; columns besides doc_id, text and
lang are ignored and lang is read only in training rows; a null doc_id is not held out and not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DEPTH = 3
SAMPLE_BYTES = 8 << 20
PIECE_BYTES = 4 << 10
CONTEXTS = 65_536
SYMBOLS = 128
OTHER = SYMBOLS - 1
PAD = b"\n" * DEPTH
WINDOW = 1 << 20
#: A column name that no table has.
BEST = "__pactum_best"
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class PPM:
    """Compiled code lengths of several languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        if not samples:
            return
        raw = [np.frombuffer(PAD + PAD.join(samples[x]), dtype=np.uint8) for x in self.langs]
        seen = np.bincount(np.concatenate(raw), minlength=256) if raw else np.zeros(256)
        common = np.sort(np.argsort(-seen, kind="stable")[: SYMBOLS - 1])
        self.symbol = np.full(256, OTHER, dtype=np.int32)
        self.symbol[common] = np.arange(len(common))
        coded = [self.symbol[r] for r in raw]
        self._compile(coded)

    def _compile(self, coded: list[np.ndarray]) -> None:
        counts = [[self._grams(x, k) for x in coded] for k in range(DEPTH + 1)]
        langs = len(self.langs)
        base = np.full((SYMBOLS, langs), 8.0)
        base[OTHER] = np.log2(256.0) - np.log2(256 - SYMBOLS + 1)
        tables = np.zeros((CONTEXTS, SYMBOLS, langs), dtype=np.float32)
        tables[0] = self._row(base, [self._at(counts[0][i], 0) for i in range(langs)])
        made, rows_of = 1, [{(): 0}]
        state = np.zeros((SYMBOLS,) * DEPTH, dtype=np.int32)
        room = CONTEXTS - 1
        for k in range(1, DEPTH + 1):
            total: dict[int, int] = {}
            for keys, n in counts[k]:
                ctx, inv = np.unique(keys >> 7, return_inverse=True)
                for c, t in zip(ctx.tolist(), np.bincount(inv, weights=n, minlength=len(ctx)).tolist(), strict=True):
                    total[c] = total.get(c, 0) + int(t)
            # Two counts at least, and short contexts before long ones, so that every suffix of a kept one is kept.
            kept = sorted((c for c, t in total.items() if t > 1), key=lambda c: (-total[c], c))[: max(0, room)]
            room -= len(kept)
            here = {}
            for c in kept:
                path = tuple((c >> 7 * (k - 1 - i)) & 127 for i in range(k))
                parent = rows_of[k - 1].get(path[1:])
                if parent is None:
                    continue
                here[path] = made
                tables[made] = self._row(tables[parent], [self._at(counts[k][i], c) for i in range(langs)])
                made += 1
                state[(slice(None),) * (DEPTH - k) + path] = here[path]
            rows_of.append(here)
        self.state = state.reshape(-1)
        self.cost = tables[:made].reshape(-1, langs)

    @staticmethod
    def _grams(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(x) <= k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        key = np.zeros(len(x) - k, dtype=np.int64)
        for i in range(k + 1):
            key <<= 7
            key |= x[i : len(x) - k + i]
        return np.unique(key, return_counts=True)

    @staticmethod
    def _at(grams: tuple[np.ndarray, np.ndarray], context: int) -> tuple[np.ndarray, np.ndarray]:
        keys, n = grams
        a, b = np.searchsorted(keys, [context << 7, (context + 1) << 7])
        return keys[a:b] & 127, n[a:b]

    @staticmethod
    def _row(shorter: np.ndarray, seen: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Code lengths in one context: its own symbols, and an escape to the shorter context for the others."""
        out = shorter.copy()
        for i, (symbols, n) in enumerate(seen):
            if len(symbols):
                whole = n.sum() + len(symbols)
                out[:, i] += np.log2(whole / len(symbols))
                out[symbols, i] = np.log2(whole / n)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: one row per text, one column per language."""
        out = np.zeros((len(texts), len(self.langs)))
        group: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            if len(t) > WINDOW:
                for at in range(0, len(t), WINDOW):
                    before = (PAD + t[max(0, at - DEPTH) : at])[-DEPTH:]
                    out[i] += self._bits(before + t[at : at + WINDOW], [DEPTH])[0]
                continue
            group.append(i)
            held += len(t) + DEPTH
            if held > WINDOW:
                self._flush(texts, group, out)
                held = 0
        self._flush(texts, group, out)
        return out

    def _flush(self, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
        group_now = [i for i in group if texts[i]]
        if group_now:
            starts, at = [], 0
            for i in group_now:
                starts.append(at + DEPTH)
                at += DEPTH + len(texts[i])
            out[group_now] = self._bits(b"".join(PAD + texts[i] for i in group_now), starts)
        group.clear()

    def _bits(self, joined: bytes, starts: list[int]) -> np.ndarray:
        x = self.symbol[np.frombuffer(joined, dtype=np.uint8)]
        ctx = (x[:-3] << 14 | x[1:-2] << 7 | x[2:-1]) if DEPTH == 3 else None
        cost = self.cost[self.state[ctx] << 7 | x[3:]]
        first = np.asarray(starts) - DEPTH
        ends = np.append(first[1:] - DEPTH, len(cost))
        cuts = np.stack([first, ends], axis=1).reshape(-1)
        cuts = cuts[:-1] if cuts[-1] >= len(cost) else cuts
        return np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2]


def fit(docs: DataFrame) -> PPM:
    """Trees of the languages of the labelled texts that are not held out, from a bounded sample by hash of doc_id and place."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    raw = F.encode("text", "UTF-8")
    pieces = F.floor(F.octet_length("text") / PIECE_BYTES) + 1
    sizes = {r["lang"]: (r["n"], r["m"]) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n"), F.sum(pieces).alias("m")).collect()}
    if not sizes:
        return PPM({})
    each = SAMPLE_BYTES // len(sizes)
    share = F.lit(0.0)
    for lang, (n, m) in sizes.items():
        # More for few pieces, as their number varies; the sum below holds the bound.
        part = min(1.0, each / max(1, n) * (1 + 4 / m**0.5))
        share = F.when(F.col("lang") == lang, F.lit(part)).otherwise(share)
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda i: F.pmod(F.xxhash64("doc_id", i), F.lit(1_000_003)) / 1_000_003.0 < share)
    cut = F.transform(drawn, lambda i: F.struct(F.xxhash64("doc_id", i).alias("o"), F.substring(raw, (i * PIECE_BYTES + 1).cast("int"), F.lit(PIECE_BYTES)).alias("t")))
    picked = rows.select("lang", F.explode(cut).alias("p")).select("lang", "p.o", "p.t").collect()
    samples: dict[str, list[bytes]] = {x: [] for x in sizes}
    room = dict.fromkeys(sizes, each)
    for r in sorted(picked, key=lambda r: (r["lang"], r["o"], r["t"])):
        t = bytes(r["t"])
        if t and len(t) <= room[r["lang"]]:
            room[r["lang"]] -= len(t)
            samples[r["lang"]].append(t)
    return PPM(samples)


SCHEMA = "lang_pred string, score double, bits double"


def predict(docs: DataFrame, model: PPM) -> DataFrame:
    """docs with lang_pred, score (posterior of the best language under equal priors) and bits (its code length)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ppm = shared.value
        for texts in batches:
            ok = [isinstance(t, str) and bool(LETTER.search(t)) for t in texts]
            if not ppm.langs:
                yield pd.DataFrame({"lang_pred": ["und"] * len(ok), "score": 0.0, "bits": 0.0})
                continue
            bits = ppm.lengths([t.encode() if good else b"" for t, good in zip(texts, ok, strict=True)])
            win = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), win]
            score = 1.0 / np.exp2(np.minimum(0.0, least[:, None] - bits)).sum(axis=1)
            yield pd.DataFrame({
                "lang_pred": [ppm.langs[w] if good else "und" for w, good in zip(win, ok, strict=True)],
                "score": np.where(ok, score, 0.0),
                "bits": np.where(ok, least, 0.0),
            })

    return docs.withColumn(BEST, best("text"))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for every row of docs."""
    model = fit(docs)
    out = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), f"{BEST}.lang_pred", f"{BEST}.score", f"{BEST}.bits")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text is in a learned language with a posterior of `least` or more."""
    own = docs.columns
    out = predict(docs, fit(docs)).where((F.col(f"{BEST}.lang_pred") != "und") & (F.col(f"{BEST}.score") >= least))
    return out.select(*own)
