"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct 5-word shingles. The sketch keeps, for each of 128 buckets, the leading-zero
count and ten mantissa bits of the smallest hash that fell there (16 bits a bucket). Buckets without a hash
borrow the register of a non-empty bucket in a fixed pseudo-random order. Runs of five registers make 25 band
keys; documents that share a key are candidates. Candidates are thinned by the Jaccard estimate that is
corrected for accidental register collisions, and what is left is confirmed on the full shingle sets.

Within the documents of one band key links to the most central one are tried first. The documents of keys that then
still hold several components are joined exactly, by prefix filtering: with a document's shingles in order of their
frequency among these documents, two sets can be similar enough only where the shortest prefixes that leave less than the
needed overlap share a shingle. Texts over one template differ in shingles of their own, which come first, so a group of
them makes no pairs unless they are linked.

Defined results: a null, empty or white-space text has n_shingles 0 and is linked with nothing; repeated rows and
texts with equal sets are linked at once through a 128-bit fingerprint of the set, whatever their number; an empty
table gives an empty result; ties are settled by the smaller doc_id; columns besides doc_id and text are ignored.
Rows with a null doc_id are not part of any result;
rows that share a doc_id count as one document, linked where any of its texts is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Membership, Scratch, batch_token_hashes, mix64, small_batches
from .graph import join_components, pairs_in_groups, pivot_pairs, split_groups

WORDS = 5
BUCKETS = 128
ROWS = 5
BANDS = 25
MANTISSA = 10
#: Below this many shingles registers are borrowed too often for the estimate to be trusted.
ESTIMATE_FROM = 1024
#: Six standard deviations of the estimate below the threshold.
SLACK = 0.22

_K = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_ROW_SALT = mix64(np.arange(101, 101 + ROWS, dtype=np.uint64))
_donors = np.random.RandomState(7)
DONORS = np.stack([_donors.permutation(BUCKETS) for _ in range(BUCKETS)])


def shingle_set(tokens: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's token hashes."""
    n = len(tokens)
    if not n:
        return tokens
    if n < WORDS:
        h = np.array([n], dtype=np.uint64)
        for i in range(n):
            h = mix64(h ^ (tokens[i : i + 1] * _K[i]))
        return h
    m = n - WORDS + 1
    s = tokens[:m] * _K[0]
    for i in range(1, WORDS):
        s = s + tokens[i : i + m] * _K[i]
    return np.unique(mix64(s))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, as signed integers."""
    a = mix64(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = mix64(s + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def registers(s: np.ndarray) -> np.ndarray:
    """128 compressed registers: leading zeros of the bucket's least hash, then its mantissa bits."""
    shift = np.uint64(64 - 7)
    edges = np.searchsorted(s, np.arange(BUCKETS, dtype=np.uint64) << shift)
    stop = np.append(edges[1:], len(s))
    full = stop > edges
    low = np.zeros(BUCKETS, dtype=np.uint64)
    low[full] = s[edges[full]] << np.uint64(7)  # 57 bits at the top
    # Leading zeros through the exponent of an exact power-of-two comparison.
    lead = np.zeros(BUCKETS, dtype=np.uint64)
    rest = low.copy()
    for step in (32, 16, 8, 4, 2, 1):
        zero = rest < (np.uint64(1) << np.uint64(64 - step))
        lead[zero] += np.uint64(step)
        rest[zero] <<= np.uint64(step)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    reg = (lead << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if not full.all() and full.any():
        empty = np.flatnonzero(~full)
        hit = full[DONORS[empty]]
        reg[empty] = reg[DONORS[empty, hit.argmax(axis=1)]]
    return reg


def band_keys(reg: np.ndarray) -> np.ndarray:
    """25 keys of a register row, each carrying its band's number in the hash."""
    r = reg[..., : ROWS * BANDS].reshape(*reg.shape[:-1], BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), r.shape[:-1])
    for i in range(ROWS):
        h = mix64(h ^ (r[..., i] + _ROW_SALT[i]))
    return h.view(np.int64)


def collision_rate() -> float:
    """Chance that registers of different hashes agree: equal leading zeros, then equal mantissas."""
    return sum(0.25**i for i in range(1, 57)) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    c = collision_rate()
    return np.maximum(0.0, ((a == b).mean(axis=-1) - c) / (1 - c))


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


SKETCH = "doc_id long, n long, f1 long, f2 long, reg binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, f1, f2, regs, bands = [], [], [], [], []
        for tokens in batch_token_hashes(_bytes(batch.column(1))):
            s = shingle_set(tokens)
            a, b = fingerprint(s)
            reg = registers(s)
            n.append(len(s))
            f1.append(a)
            f2.append(b)
            regs.append(reg.tobytes())
            bands.append(band_keys(reg) if len(s) else np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n", "f1", "f2", "reg", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t).view(np.int64) for t in batch_token_hashes(_bytes(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(rows, BUCKETS) for k in ("ra", "rb"))
        few = np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()) < ESTIMATE_FROM
        keep = few | (estimate(a, b) >= least)
        yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))


def link_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Components of documents under 100 * |A and B| >= percent * |A or B|.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.
    Jobs run while this is called, as each round depends on the links found before.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketch = scratch.write(docs.mapInArrow(_sketch, SKETCH))
    classes = scratch.write(sketch.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    components = _link_classes(docs, sketch, classes, percent, scratch)
    members = sketch.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2").join(
        classes.select("f1", "f2", F.col("n").alias("n_shingles"), "rep"), ["f1", "f2", "n_shingles"], "left"
    )
    if components is None:
        out = members.withColumn("component_id", F.coalesce("rep", "doc_id"))
    else:
        out = members.join(components.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn(
            "component_id", F.coalesce("root", "rep", "doc_id")
        )
    scratch.release_all(but=[sketch, classes, *([] if components is None else [components])])
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _link_classes(docs: DataFrame, sketch: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Components (node, root) of the classes' representatives, or None where none is linked."""
    # Of rows that share a doc_id each is a candidate under it.
    reps = sketch.where("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "reg", "bands")
    rows = reps.select(F.explode("bands").alias("key"), "id", F.col("n").alias("size"))
    shared = rows.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p < q").select("key")
    rows = scratch.write(rows.join(shared, "key", "left_semi"))
    if rows.isEmpty():
        return None
    wanted = scratch.write(rows.select("id").distinct())
    reps = scratch.write(reps.select("id", "n", "reg").join(wanted, "id", "left_semi"))
    # Only documents of a shared key have their sets built, once; the bounded filter spares most others the join.
    likely = docs.where(Membership(wanted, F.xxhash64("id")).test(F.xxhash64("doc_id")))
    likely = likely.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = scratch.write(likely.mapInArrow(_sets, "id long, items array<long>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return scratch.write(_confirm(reps, sets, scratch.write(pairs), percent))

    components = join_components(None, confirmed(pivot_pairs(rows, percent)), scratch)
    open_rows = split_groups(rows, components, 0, scratch)[1]
    if not open_rows.isEmpty():
        prefixes = scratch.write(_prefixes(sets, open_rows.select("id").distinct(), percent))
        pairs = pairs_in_groups(split_groups(prefixes, components, 0, scratch)[1], components, percent, scratch)
        components = join_components(components, confirmed(pairs), scratch)
    return components


def _prefixes(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(key, id, size, pos): for each set, as many of its rarest shingles as must hold one of any set similar enough."""
    # Rows that share a doc_id may hold several sets under it.
    own = sets.join(ids, "id", "left_semi").select("id", F.xxhash64("items").alias("set"), F.size("items").alias("size"), F.explode("items").alias("key"))
    often = own.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ranked = own.join(often, "key").groupBy("id", "set", "size").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("r"))
    first = ranked.select("id", "size", F.posexplode(F.slice("r", 1, F.expr(f"cast(size - (size * {percent}L + 99) div 100 + 1 as int)"))).alias("pos", "x"))
    return first.where("x.df > 1").select("x.key", "id", "size", "pos")


def _confirm(reps: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate and then whose full shingle sets are similar enough."""
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("reg").alias(f"r{side}")), side)
    likely = pairs.mapInArrow(partial(_likely, least=percent / 100 - SLACK), "a long, b long, na long, nb long")
    both = likely.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
    shared = F.size(F.array_intersect("ia", "ib"))
    both = both.withColumn("shared", shared).where(F.expr(f"100L * shared >= {percent}L * (size(ia) + size(ib) - shared)"))
    return both.select("a", "b").distinct()


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without near copies: the one with the smallest doc_id of each component stays.

    Returns the columns of docs. Rows with a null doc_id pass, as nothing can be said about them; of several rows
    with one doc_id all stay or all go.
    """
    decided = link_documents(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(decided, "doc_id", "left_anti").select(*docs.columns)
