"""Language-model scoring with a hierarchical Pitman-Yor model.

Words are generated in context restaurants that share one parent: a context is the whole word before (or the beginning of
the text), the parent is the corpus-wide unigram restaurant, and its base is uniform over the
training vocabulary and one unknown word. A customer who opens a table in a context is a customer of the parent.

The seating is sampled by Gibbs sweeps over dishes (a word in a context, then a word in the parent): all customers of a
dish leave and are seated again one after another by the Chinese-restaurant rule, given all other dishes, and a
Metropolis-Hastings test makes up for weights that depend on the tables opened on the way.
Past the eighth customer, blocks of up to an eighth of those seated are seated at once by a binomial draw. Dishes are
dealt by word, so a word's contexts meet in one task. The tables of other tasks count in a sweep as the exact number of their
dishes times the tables a dish has in the task's own part of that context, drawn towards those of contexts with about as many
dishes where that part is small; every total of the tables kept is exact. After the burn-in, SAMPLES sweeps are kept and their predictive probabilities averaged.

Discounts come from the counts of words and pairs seen once and twice. Words are 64-bit hashes.

Words and contexts have a home, one of as many as the training texts' bytes ask for. Pairs live at the home of their word as a
few arrays in one row; what a context's pairs have in common is summed at the home of the context and handed back to each home in the order of
its own contexts, so that neither pairs nor texts' words pass through joins as rows of their own.

Scoring: the HOT most frequent (context, word) pairs are shared with all tasks and settle most tokens where the text
is read; the others are sent to the homes of their words, SLICES parts of the texts one after the other. Nothing is left out on either side.

Defined results: null and empty texts are one end token; repeated rows are scored alike; a null doc_id is neither held out
nor left out of training; without training tokens every probability is 1; an empty table gives an empty result; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_tokens, mix64, small_batches

BEGIN = mix64(np.array([0x626567696E], dtype=np.uint64))
END = mix64(np.array([0x656E64], dtype=np.uint64))
HOT = 1 << 19
BURN_IN = 2
SAMPLES = 3
STRENGTH = 1.0
CHUNK = 1 << 20
#: Bytes of training texts that a home is made for.
PER_HOME = 1 << 22
#: Parts of the texts that are scored one after the other, so that the pairs of one part only lie on disk.
SLICES = 4
#: Bytes of texts that are cut into words at once, rows of arrays in one Arrow batch, and bytes of them that are held back.
TOGETHER = 1 << 20
ROWS = 16
HELD = 1 << 24
#: Dishes that contexts of about the same size count for in a context's tables a dish.
POOLED = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix64(word ^ (context + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def words_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word hashes with the end token, contexts) of each text."""
    return [(np.concatenate((h, END)), np.concatenate((BEGIN, h))) for h, _ in batch_tokens(texts)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


# ---------------------------------------------------------------- rows of arrays

ROW = "to int, kind int, tag long, data binary"
COUNTED, STATED, ASKED, HANDED, SEATED, CONTEXT, KNOWN, UNKNOWN, SETTLED, PART, FRESH = range(11)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of counts (in as few bytes as they need, byte by byte), of hashes and of floats."""
    out = []
    for a in arrays:
        if a.dtype.kind == "i":
            k = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            out += [struct.pack("<BQ", k, len(a)), np.ascontiguousarray(a, dtype="<i8").view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()]
        else:
            out += [struct.pack("<BQ", 16 if a.dtype.kind == "u" else 17, len(a)), a.tobytes()]
    return b"".join(out)


def load(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        k, n = struct.unpack_from("<BQ", data, at)
        at += 9
        if k < 16:
            whole = np.zeros((n, 8), dtype=np.uint8)
            whole[:, :k] = np.frombuffer(data, dtype=np.uint8, count=k * n, offset=at).reshape(k, n).T
            out.append(whole.view("<i8").reshape(-1))
            at += k * n
        else:
            out.append(np.frombuffer(data, dtype=np.uint64 if k == 16 else np.float64, count=n, offset=at))
            at += 8 * n
    return out


def rows_of(items: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """ROW batches of (to, kind, tag, data)."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        to, kind, tag, data = zip(*held, strict=True)
        arrays = [pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(tag, pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["to", "kind", "tag", "data"])

    for item in items:
        held.append(item)
        size += len(item[3])
        if size >= HELD or len(held) >= 4096:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in ("to", "kind", "tag", "data")), strict=True)


def by_home(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[int, list[np.ndarray]]]]]]:
    """(home, kind -> its (tag, arrays) in order of tags) of a task's rows."""
    homes = defaultdict(list)
    for to, *row in each(batches):
        homes[to].append(row)
    for to in sorted(homes):
        kinds = defaultdict(list)
        for kind, tag, data in homes.pop(to):
            kinds[kind].append((tag, data))
        yield to, defaultdict(list, {kind: [(tag, load(data)) for tag, data in sorted(found)] for kind, found in kinds.items()})


def home(h: np.ndarray, homes: int) -> np.ndarray:
    """The home of a hash; it grows with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)


def parted(at: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, place) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(at)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True):
        if j > i:
            yield int(at[i]), slice(i, j)


def order_of(h: np.ndarray) -> np.ndarray:
    """The stable order of hashes: their high bits and places are sorted as one number, all bits only where that leaves hashes out of order."""
    low = (1 << max(1, len(h) - 1).bit_length()) - 1
    mixed = h & np.uint64(~low & 0xFFFFFFFFFFFFFFFF) | np.arange(len(h), dtype=np.uint64)
    mixed.sort()
    order = (mixed & np.uint64(low)).astype(np.int64)
    there = h[order]
    return np.argsort(h, kind="stable") if (there[1:] < there[:-1]).any() else order


def placed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, the first place of each, and of all hashes the places among the distinct."""
    order = order_of(h)
    there = h[order]
    new = np.concatenate(([True], there[1:] != there[:-1])) if len(h) else np.zeros(0, dtype=bool)
    at = np.empty(len(h), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return there[new], order[new], at


def runs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of sorted pairs, and how many pairs each has."""
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, dtype=np.int64)
    return w[first], np.diff(np.concatenate((first, [len(w)]))).astype(np.int64)


def total(at: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=of, minlength=n).astype(np.int64)


def dealt(df: DataFrame, homes: int, work: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> DataFrame:
    """What work makes of the rows of each home."""
    return df.repartition(homes, "to").mapInArrow(lambda it: rows_of(work(it)), ROW)


def made(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> DataFrame:
    return df.mapInArrow(lambda it: rows_of(work(it)), ROW)


# ---------------------------------------------------------------- counting


def _together(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """(texts, further columns) of several batches at once."""
    held, size = [[] for _ in range(len(columns) + 1)], 0
    for b in batches:
        texts = _texts(b)
        for out, new in zip(held, (texts, *(b.column(k).to_pylist() for k in columns)), strict=True):
            out += new
        size += sum(map(len, texts))
        if size >= TOGETHER:
            yield tuple(held)
            held, size = [[] for _ in range(len(columns) + 1)], 0
    if held[0]:
        yield tuple(held)


def _count(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator:
    words, contexts, held = [], [], 0

    def emit() -> Iterator:
        w, u = np.concatenate(words), np.concatenate(contexts)
        _, first, at = placed(pair_key(w, u))
        c = np.bincount(at)
        first, c = first[order := order_of(w[first])], c[order]
        w, u = w[first], u[first]
        for to, part in parted(home(w, homes)):
            yield to, COUNTED, 0, dump(*runs(w[part]), u[part], c[part])

    for (texts,) in _together(batches):
        for w, u in words_of(texts):
            words.append(w)
            contexts.append(u)
            held += len(w)
            if held >= CHUNK:
                yield from emit()
                words, contexts, held = [], [], 0
    if held:
        yield from emit()


def octave(c: np.ndarray) -> np.ndarray:
    """Eight bins an octave."""
    return np.floor(np.log2(c) * 8).astype(np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator:
    """The pairs of each home by word and context, and the sums that the model needs."""
    for to, kinds in by_home(batches):
        found = [x for _, x in kinds[COUNTED]]
        w = np.concatenate([np.repeat(words, n) for words, n, _, _ in found])
        u, c = (np.concatenate([x[k] for x in found]) for k in (2, 3))
        order = order_of(u)
        order = order[order_of(w[order])]
        w, u, c = w[order], u[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (u[1:] != u[:-1]))))
        w, u, c = w[first], u[first], np.add.reduceat(c, first)
        words, n = runs(w)
        yield to, COUNTED, 0, dump(words, n, u, c)
        facts = [c.sum(), len(c), (c == 1).sum(), (c == 2).sum(), len(n), (n == 1).sum(), (n == 2).sum()]
        yield to, STATED, 0, dump(np.array(facts, dtype=np.int64), np.bincount(octave(c)))


def _contexts_of(batches: Iterator[pa.RecordBatch], homes: int, kind: int) -> Iterator:
    """What each home adds to its contexts: pairs, or customers and tables."""
    for to, what, _, data in each(batches):
        if what == kind:
            _, _, u, *counts = load(data)
            own, _, at = placed(u)
            sums = [np.bincount(at)] if kind == COUNTED else [total(at, x, len(own)) for x in counts[: SAMPLES + 1]]
            for q, part in parted(home(own, homes)):
                yield q, ASKED, to, dump(own[part], *(x[part] for x in sums))


def _hand_back(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator:
    """The sums of each context, for each home in the order of its own contexts; and for this one, where they are kept."""
    for to, kinds in by_home(batches):
        found = kinds[ASKED]
        own, _, at = placed(np.concatenate([x[0] for _, x in found]))
        sums = [total(at, np.concatenate([x[k] for _, x in found]), len(own)) for k in range(1, len(found[0][1]))]
        if keep:
            yield to, CONTEXT, 0, dump(own, *sums)
        i = 0
        for p, x in found:
            part = at[i : i + len(x[0])]
            i += len(part)
            yield p, HANDED, to, dump(*(s[part] for s in sums))


# ---------------------------------------------------------------- seating


def seat(c: np.ndarray, opening: np.ndarray, more: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers (descending) who are seated one after another.

    opening + more * t is the weight of a new table when t are open; an open dish weighs its customers less d a table.
    """
    t = np.ones(len(c))
    i = 1
    live = int(np.searchsorted(-c, -i, side="left"))
    while live:
        step = max(1, i // 8)
        tt = t[:live]
        new = opening[:live] + more[:live] * tt
        share = new / (new + i - d * tt)
        if step == 1:
            tt += rng.random(live) < share
        else:
            tt += rng.binomial(np.minimum(step, c[:live] - i).astype(np.int64), share)
        i += step
        live = int(np.searchsorted(-c, -i, side="left"))
    return t


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    low = x.copy()
    for k in range(1, 8):
        low *= x + k
    low, y = np.log(low), x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_rising(opening: np.ndarray, more: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum of log(opening + more * j) for j below t."""
    x = opening / more
    return t * np.log(more) + log_gamma(x + t) - log_gamma(x)


def reseat(t: np.ndarray | None, c: np.ndarray, opening: np.ndarray, more: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """One step of the tables of dishes (t, or None at first) whose customers all leave and come back.

    The proposal seats them by a restaurant whose weights do not depend on the tables opened so far (a new table weighs
    a + d * t), with `a` from a pilot seating; it is accepted by the ratio of the true weights, which t alone decides.
    """
    pilot = seat(c, opening, more, d, rng)
    if t is None:
        return pilot
    a = np.maximum(opening + (more - d) * pilot, 0.05 * opening + 1e-9)
    fresh = seat(c, a, np.full(len(c), d), d, rng)

    def weight(tables: np.ndarray) -> np.ndarray:
        return log_rising(opening, more, tables) - log_rising(a, np.full(len(c), d), tables)

    taken = np.log(rng.random(len(c))) < weight(fresh) - weight(t)
    return np.where(taken, fresh, t)


class Gibbs:
    """Samples the seating of the dishes of one task.

    word, context, count: one entry per (context, word) pair; all contexts of a word are here. dishes: for each of
    these pairs the number of pairs of its context in the whole corpus; pairs, vocabulary: number of pairs and of words in the whole corpus.
    """

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, dishes: np.ndarray, pairs: int, vocabulary: int, d2: float, d1: float, seed: int):
        order = self.order = np.argsort(-count, kind="stable")
        self.word, self.context, self.c = word[order], context[order], count[order]
        _, at, self.u = placed(self.context)
        self.dishes = dishes[order][at]
        _, self.head, self.w = placed(self.word)
        self.nw = len(self.head)
        self.d2, self.d1, self.v = d2, d1, vocabulary
        self.rng = np.random.default_rng(seed)
        self.first = True
        self.mine = np.bincount(self.u)
        self.size = np.log2(self.dishes).astype(np.int64)
        self.t = np.ones(len(self.c))
        self.m = np.bincount(self.w, weights=self.t, minlength=self.nw)
        self.tw = np.ones(self.nw)
        #: For contexts without a dish here, their dishes stand for their tables.
        self.elsewhere = float(pairs - self.dishes.sum())

    def tables(self) -> np.ndarray:
        """Tables of each context in the whole corpus, as far as the task's own dishes tell."""
        own = np.bincount(self.u, weights=self.t)
        alike = (np.bincount(self.size, weights=own) / np.maximum(1, np.bincount(self.size, weights=self.mine)))[self.size]
        return own + (self.dishes - self.mine) * (own + POOLED * alike) / (self.mine + POOLED)

    def sweep(self) -> None:
        d2, d1, s = self.d2, self.d1, STRENGTH
        tables = self.tables()
        root = self.tw.sum() * self.v / max(1, self.nw)
        customers = tables.sum() + self.elsewhere
        rest = self.m[self.w] - self.t
        left = np.where(rest > 0, np.minimum(self.tw[self.w], np.maximum(rest, 1)), 0.0)
        p = (np.maximum(rest - d1 * left, 0) + (s + d1 * root) / (self.v + 1)) / (s + customers)
        opening = (s + d2 * np.maximum(tables[self.u] - self.t, 0)) * p
        # One customer sits at one table.
        k = int(np.searchsorted(-self.c, -1, side="left"))
        self.t[:k] = reseat(None if self.first else self.t[:k], self.c[:k], opening[:k], d2 * p[:k], d2, self.rng)
        self.m = np.bincount(self.w, weights=self.t, minlength=self.nw)
        order = np.argsort(-self.m, kind="stable")
        base = 1.0 / (self.v + 1)
        opening = (s + d1 * np.maximum(root - self.tw[order], 0)) * base
        was = np.minimum(self.tw, self.m)[order]
        m = self.m[order]
        k = int(np.searchsorted(-m, -1, side="left"))
        fresh = reseat(None if self.first else was[:k], m[:k], opening[:k], np.full(k, d1 * base), d1, self.rng)
        self.first = False
        self.tw = np.ones(self.nw)
        self.tw[order[:k]] = fresh


def _sample(batches: Iterator[pa.RecordBatch], pairs: int, vocabulary: int, d2: float, d1: float) -> Iterator:
    for to, kinds in by_home(batches):
        ((_, (words, n, u, c)),) = kinds[COUNTED]
        w = np.repeat(words, n)
        _, _, at = placed(u)
        dishes = np.concatenate([x for _, (x,) in kinds[HANDED]])[at]
        g = Gibbs(w, u, c, dishes, pairs, vocabulary, d2, d1, seed=int(w[0]) & 0x7FFFFFFF)
        seats, whole = [], [np.add.reduceat(c, np.cumsum(n) - n)]
        for k in range(BURN_IN + SAMPLES):
            g.sweep()
            if k >= BURN_IN:
                t = np.empty(len(c), dtype=np.int64)
                t[g.order] = g.t
                seats.append(t)
                whole += [g.m.astype(np.int64), g.tw.astype(np.int64)]
        yield to, SEATED, 0, dump(words, n, u, c, *seats, *whole)
        yield to, STATED, 0, dump(np.array([t.sum() for t in seats] + [r.sum() for r in whole[2::2]], dtype=np.int64))


# ---------------------------------------------------------------- model


class Facts:
    """What holds for the whole corpus."""

    def __init__(self, tokens: int, vocabulary: int, d2: float, d1: float, tables: list[int], roots: list[int]):
        self.tokens, self.vocabulary, self.d2, self.d1, self.tables, self.roots = tokens, vocabulary, d2, d1, tables, roots
        nothing = np.zeros(1, dtype=np.int64)
        self.unknown = [float(self.parent(s, nothing, nothing)[0]) for s in range(SAMPLES)] if tokens else [1.0] * SAMPLES

    def parent(self, s: int, m: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Probability of a word in the unigram restaurant of a sample."""
        return (m - self.d1 * r + (STRENGTH + self.d1 * self.roots[s]) / (self.vocabulary + 1)) / (STRENGTH + self.tables[s])

    def share(self, cu: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """What a context leaves to the parent."""
        return (STRENGTH + self.d2 * tables) / (STRENGTH + cu)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))


class Pairs:
    """The pairs of one home: words, n, w, u, c, lp; of its words cw, m and r. A home may have none."""

    def __init__(self, kinds: dict, facts: Facts):
        none, hashes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        seated = [x for _, x in kinds[SEATED]] or [[hashes, none, hashes, *[none] * (2 + 3 * SAMPLES)]]
        handed = [x for _, x in kinds[HANDED]] or [[none] * (1 + SAMPLES)]
        ((self.words, self.n, self.u, self.c, *rest),) = seated
        t, (self.cw, *whole) = rest[:SAMPLES], rest[SAMPLES:]
        self.m, self.r = whole[::2], whole[1::2]
        self.w = np.repeat(self.words, self.n)
        _, _, at = placed(self.u)
        cu, *tables = (np.concatenate(x)[at] for x in zip(*handed, strict=True))
        mean = np.zeros(len(self.c))
        for s in range(SAMPLES):
            mean += self.c - facts.d2 * t[s] + (STRENGTH + facts.d2 * tables[s]) * np.repeat(facts.parent(s, self.m[s], self.r[s]), self.n)
        self.lp = np.log10(mean / SAMPLES / (STRENGTH + cu))


def _frequent(batches: Iterator[pa.RecordBatch], facts: Facts, least: int) -> Iterator:
    for to, kinds in by_home(batches):
        x = Pairs(kinds, facts)
        top = octave(x.c) >= least
        yield to, KNOWN, 0, dump(pair_key(x.w[top], x.u[top]), np.repeat(x.cw, x.n)[top], x.lp[top])


class Model:
    """Rows of arrays of seated pairs, of contexts and what homes know of theirs; and tables of the averaged predictive probabilities."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        small_batches(docs.sparkSession, ROWS)
        self.scratch = scratch
        train = docs.where(~held_out(F.col("doc_id"))).select("text")
        # By the data alone, so that every cluster draws the same seating.
        size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        homes = self.homes = max(1, -(-size // PER_HOME))
        counts = scratch.write(dealt(made(train, lambda it: _count(it, homes)), homes, _merge))
        sums, self.bins = np.zeros(7, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for facts, bins in _stated(counts):
            sums += facts
            both = np.zeros(max(len(bins), len(self.bins)), dtype=np.int64)
            both[: len(bins)] += bins
            both[: len(self.bins)] += self.bins
            self.bins = both
        tokens, pairs, once, twice, v, few, two = map(int, sums)
        d2, d1 = _discount(once, twice), _discount(few, two)
        asked = made(counts, lambda it: _contexts_of(it, homes, COUNTED))
        dishes = dealt(asked, homes, lambda it: _hand_back(it, False))
        here = counts.where(f"kind = {COUNTED}").unionAll(dishes)
        self.seated = scratch.write(dealt(here, homes, lambda it: _sample(it, pairs, v, d2, d1)))
        scratch.release(counts)
        drawn = sum((x for (x,) in _stated(self.seated)), np.zeros(2 * SAMPLES, dtype=np.int64)).tolist()
        self.facts = Facts(tokens, v, d2, d1, drawn[:SAMPLES], drawn[SAMPLES:])
        asked = made(self.seated, lambda it: _contexts_of(it, homes, SEATED))
        self.shared = scratch.write(dealt(asked, homes, lambda it: _hand_back(it, True)))
        self.known = self.seated.where(f"kind = {SEATED}").unionAll(self.shared.where(f"kind = {HANDED}"))

    @property
    def unknown(self) -> list[float]:
        return self.facts.unknown

    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, count of the word, log probability) of the pairs above a count that at most HOT pairs exceed, by key."""
        above = np.flatnonzero(np.cumsum(self.bins[::-1]) > HOT)
        least, facts = (len(self.bins) - int(above[0]) if len(above) else 0), self.facts
        # Written, so that the shuffle of the pairs doesn't stay on disk.
        rows = self.scratch.write(dealt(self.known, self.homes, lambda it: _frequent(it, facts, least)))
        found = [load(r.data) for r in rows.select("data").toLocalIterator()]
        self.scratch.release(rows)
        if not found:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0)
        keys, cw, lp = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys)
        return keys[order], cw[order], lp[order]

    @property
    def pairs(self) -> DataFrame:
        facts = self.facts

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, kinds in by_home(batches):
                x = Pairs(kinds, facts)
                yield pa.RecordBatch.from_pydict({"w": x.w.view(np.int64), "u": x.u.view(np.int64), "c": x.c, "cw": np.repeat(x.cw, x.n), "lp": x.lp})

        return self.known.repartition(self.homes, "to").mapInArrow(work, "w long, u long, c long, cw long, lp double")

    @property
    def words(self) -> DataFrame:
        facts = self.facts

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, _, data in each(batches):
                words, _, _, _, *rest = load(data)
                cw, *whole = rest[SAMPLES:]
                yield pa.RecordBatch.from_pydict({"w": words.view(np.int64), "cw": cw} | {f"p{s}": facts.parent(s, whole[2 * s], whole[2 * s + 1]) for s in range(SAMPLES)})

        return self.seated.where(f"kind = {SEATED}").mapInArrow(work, "w long, cw long, " + ", ".join(f"p{s} double" for s in range(SAMPLES)))

    @property
    def contexts(self) -> DataFrame:
        facts = self.facts

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, _, data in each(batches):
                u, cu, *tables = load(data)
                yield pa.RecordBatch.from_pydict({"u": u.view(np.int64)} | {f"n{s}": facts.share(cu, tables[s]) for s in range(SAMPLES)})

        return self.shared.where(f"kind = {CONTEXT}").mapInArrow(work, "u long, " + ", ".join(f"n{s} double" for s in range(SAMPLES)))


def _stated(rows: DataFrame) -> Iterator[list[np.ndarray]]:
    return (load(r.data) for r in rows.where(f"kind = {STATED}").select("data").toLocalIterator())


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


# ---------------------------------------------------------------- scoring


def place(block: np.ndarray, homes: int) -> np.ndarray:
    """Where the parts of a block of texts meet."""
    return home(mix64(block.astype(np.uint64)), homes)


def _ask(batches: Iterator[pa.RecordBatch], hot, facts: Facts, homes: int) -> Iterator:
    """Of each block of texts what the hot pairs settle, and for each home the other pairs of its words."""
    keys, cw, lp = hot.value
    base = facts.base(cw)
    block: list[tuple] = []
    held = 0

    def emit() -> Iterator:
        tag = np.array([block[0][0]], dtype=np.int64)
        doc = np.array([x[1] or 0 for x in block], dtype=np.int64).view(np.uint64)
        null, test, tokens = (np.array(x, dtype=np.int64) for x in zip(*((b[1] is None, b[2], len(b[3])) for b in block), strict=True))
        i = np.repeat(np.arange(len(block)), tokens)
        w, u = (np.concatenate([x[k] for x in block]) for k in (3, 4))
        key = pair_key(w, u)
        # By pair, and the same pairs by text: neighbours are looked up in one place.
        order = order_of(key)
        i, w, u, key = i[order], w[order], u[order], key[order]
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        hit = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
        got, where = at[hit], i[hit]
        sums = [np.bincount(where, weights=x[got], minlength=len(block)).astype(np.float64) for x in (lp, base)]
        yield int(place(tag, homes)[0]), SETTLED, int(tag[0]), dump(doc, null, test, tokens, np.bincount(where, minlength=len(block)), *sums)
        for kind, those in ((KNOWN, ~hit & (test[i] == 0)), (UNKNOWN, ~hit & (test[i] == 1))):
            far = np.flatnonzero(those)
            # Pairs of a text once, by home.
            new = np.concatenate(([True], (key[far][1:] != key[far][:-1]) | (i[far][1:] != i[far][:-1]))) if len(far) else np.zeros(0, dtype=bool)
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate((first, [len(far)]))).astype(np.int64)
            to_home = home(w[far[first]], homes)
            order = np.argsort(to_home.astype(np.uint16) if homes < 1 << 16 else to_home, kind="stable")
            far, n = far[first[order]], n[order]
            for to, part in parted(to_home[order]):
                x = far[part]
                yield to, kind, int(tag[0]), dump(i[x].astype(np.int64), n[part], *((key[x],) if kind == KNOWN else (w[x], u[x])))

    for texts, rid, doc, test in _together(batches, "rid", "doc_id", "test"):
        for r, d, t, (w, u) in zip(rid, doc, test, words_of(texts), strict=True):
            block.append((r, d, t, w, u))
            held += len(w)
            if held >= CHUNK:
                yield from emit()
                block, held = [], 0
    if block:
        yield from emit()


def _parts(block: np.ndarray, i: np.ndarray, known: np.ndarray, lp: np.ndarray, base: np.ndarray, homes: int) -> Iterator:
    """Sums by text, for each place where blocks meet."""
    if len(i):
        # Blocks come in runs: a run's place in the order of blocks and i make one number.
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        tags, run = np.unique(block[starts], return_inverse=True)
        rank = np.empty(len(tags), dtype=np.int64)
        rank[np.lexsort((tags, place(tags, homes)))] = np.arange(len(tags))
        both = np.repeat(rank[run], np.diff(np.concatenate((starts, [len(i)])))) << int(i.max()).bit_length() | i
        order = order_of(both.astype(np.uint64) << np.uint64(64 - max(1, int(both.max()).bit_length())))
        block, i = block[order], i[order]
        first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (i[1:] != i[:-1]))))
        known, lp, base = (np.add.reduceat(x[order], first) for x in (known, lp, base))
        block, i = block[first], i[first]
        for to, part in parted(place(block, homes)):
            yield to, PART, 0, dump(block[part], i[part], known[part], lp[part], base[part])


def _answer(batches: Iterator[pa.RecordBatch], facts: Facts, homes: int) -> Iterator:
    for to, kinds in by_home(batches):
        for tag, x in kinds[SETTLED]:
            yield to, SETTLED, tag, dump(*x)
        asked = [(tag, kind, x) for kind in (KNOWN, UNKNOWN) for tag, x in kinds[kind]]
        if not asked:
            continue
        block = np.concatenate([np.full(len(x[0]), tag) for tag, _, x in asked])
        i, n = (np.concatenate([x[k] for _, _, x in asked]) for k in (0, 1))
        key = np.concatenate([x[2] if kind == KNOWN else pair_key(x[2], x[3]) for _, kind, x in asked])
        pairs = Pairs(kinds, facts)
        own = pair_key(pairs.w, pairs.u)
        order = order_of(own)
        own = own[order]
        at = np.minimum(np.searchsorted(own, key), max(0, len(own) - 1))
        hit = own[at] == key if len(own) else np.zeros(len(key), dtype=bool)
        cw, lp = np.zeros(len(key), dtype=np.int64), np.zeros(len(key))
        cw[hit], lp[hit] = np.repeat(pairs.cw, pairs.n)[order[at[hit]]], pairs.lp[order[at[hit]]]
        # Every pair of a training text has been seen, so only held-out texts can hold others.
        far = np.flatnonzero(~hit)
        if len(far):
            w, u = (np.concatenate([x[k] if kind == UNKNOWN else np.zeros(len(x[0]), dtype=np.uint64) for _, kind, x in asked])[far] for k in (2, 3))
            spot = np.minimum(np.searchsorted(pairs.words, w), max(0, len(pairs.words) - 1))
            seen = pairs.words[spot] == w if len(pairs.words) else np.zeros(len(w), dtype=bool)
            of = lambda x: np.where(seen, x[spot], 0) if len(x) else np.zeros(len(w), dtype=np.int64)
            cw[far] = of(pairs.cw)
            tables = [of(x) for s in range(SAMPLES) for x in (pairs.m[s], pairs.r[s])]
            order = np.argsort(u)
            for q, part in parted(home(u[order], homes)):
                x = order[part]
                yield q, FRESH, 0, dump(u[x], block[far[x]], i[far[x]], n[far[x]], *(y[x] for y in tables))
        yield from _parts(block, i, np.where(cw > 0, n, 0), n * lp, n * facts.base(cw), homes)


def _back_off(batches: Iterator[pa.RecordBatch], facts: Facts, homes: int) -> Iterator:
    """Pairs that were never seen: their words' share in what their contexts leave."""
    for _, kinds in by_home(batches):
        if not kinds[FRESH]:
            continue
        u, block, i, n, *tables = (np.concatenate(x) for x in zip(*(x for _, x in kinds[FRESH]), strict=True))
        shares = [np.ones(len(u)) for _ in range(SAMPLES)]
        for _, (own, cu, *all_tables) in kinds[CONTEXT]:
            spot = np.minimum(np.searchsorted(own, u), len(own) - 1)
            seen = own[spot] == u
            for s in range(SAMPLES):
                shares[s][seen] = facts.share(cu, all_tables[s])[spot[seen]]
        mean = sum(shares[s] * (facts.parent(s, tables[2 * s], tables[2 * s + 1]) if facts.tokens else 1.0) for s in range(SAMPLES)) / SAMPLES
        nothing = np.zeros(len(u), dtype=np.int64)
        yield from _parts(block, i, nothing, n * np.log10(mean), nothing.astype(np.float64), homes)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_up(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    for _, kinds in by_home(batches):
        blocks = {tag: (x[:4], [y.copy() for y in x[4:]]) for tag, x in kinds[SETTLED]}
        for _, (block, i, *parts) in kinds[PART]:
            for tag, part in parted(block):
                for whole, x in zip(blocks[tag][1], parts, strict=True):
                    whole[i[part]] += x[part]
        for tag in sorted(blocks):
            (doc, null, test, n), (known, lp, base) = blocks[tag]
            arrays = [pa.array(doc.view(np.int64), mask=null == 1), pa.array(test == 1), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens, dtype=np.int64)), pa.array(base), pa.array(lp)]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCORED.split(", ")])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = Model(docs, scratch)
    homes, facts = model.homes, model.facts
    hot = spark.sparkContext.broadcast(model.frequent())
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out(F.col("doc_id")).alias("test"), "text")
    found = []
    for k in range(SLICES):
        asked = made(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES)) == k), lambda it: _ask(it, hot, facts, homes))
        found.append(scratch.write(dealt(model.known.unionAll(asked), homes, lambda it: _answer(it, facts, homes))))
    scratch.release(model.seated)
    answers = found[0]
    for x in found[1:]:
        answers = answers.unionAll(x)
    fresh = dealt(answers.where(f"kind = {FRESH}").unionAll(model.shared.where(f"kind = {CONTEXT}")), homes, lambda it: _back_off(it, facts, homes))
    every = answers.where(f"kind <> {FRESH}").unionAll(fresh)
    return every.repartition(homes, "to").mapInArrow(lambda it: _sum_up(it, facts.tokens), SCORED)
