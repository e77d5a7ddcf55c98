"""Length-bucketed packing with optimal bucket boundaries.

Lengths are words [^\\x20\\x09-\\x0D]+ plus one end token. A global histogram of lengths (exact below 512, then 256
steps an octave, so a few thousand bins at most whatever the corpus) with each bin's rows, sum and true maximum feeds a
dynamic programme that picks the bucket boundaries with the least total padding among those maxima: the least of all while
lengths are below 512 or bins hold one length, else no bucket is cut inside a bin, which is under half a percent
wide. Inside a bucket documents are numbered in hash order and cut into batches of floor(budget / boundary) documents, so a
batch never holds more padded tokens than the budget, unless one document alone does.

Numbering needs no global sort: documents are numbered inside hash chunks of about 1,024, and chunk offsets come from
running sums over the chunk counts, in parts. Rows with equal id and length are one entry with a count.

Defined results: null and empty texts have length 1; ties of hash order are settled by doc_id; repeated rows are
packed as often as they occur; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

BUDGET = 65_536
BUCKETS = 16
CHUNK = 1_024


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, k: int) -> list[int]:
    """Boundaries (each one of lengths) of at most k buckets with the least padding.

    lengths: ascending upper lengths of the bins; counts: rows; totals: sum of true lengths of the rows.
    """
    m = len(lengths)
    if not m:
        return []
    c = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    t = np.concatenate(([0], np.cumsum(totals))).astype(np.float64)
    top = lengths.astype(np.float64)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    back = []
    for _ in range(min(k, m)):
        after = cost.copy()
        take = np.full(m + 1, -1)
        for j in range(1, m + 1):
            every = cost[:j] + top[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])
            i = int(every.argmin())
            if every[i] < after[j]:
                after[j], take[j] = every[i], i
        cost = after
        back.append(take)
    found, j, level = [], m, len(back) - 1
    while j > 0:
        i = back[level][j]
        if i >= 0:
            found.append(int(lengths[j - 1]))
            j = i
        level -= 1
    return found[::-1]


def lengths_of(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
    step = F.expr("cast(pow(2, greatest(0, floor(log2(n_tokens)) - 8)) as bigint)")
    return docs.select("doc_id", n.cast("long").alias("n_tokens")).withColumn("bin", F.ceil(F.col("n_tokens") / step).cast("long") * step)


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_len, batch, slot, padding."""
    scratch = Scratch(docs.sparkSession, "packing")
    # Rows that agree in both are numbered together, so that no id, not even null, is many rows.
    rows = scratch.write(lengths_of(docs).groupBy("doc_id", "n_tokens", "bin").agg(F.count(F.lit(1)).alias("c")))
    hist = rows.groupBy("bin").agg(F.max("n_tokens").alias("m"), F.sum("c").alias("c"), F.sum(F.col("n_tokens") * F.col("c")).alias("t"), F.count(F.lit(1)).alias("g")).orderBy("bin").collect()
    tops, counts, totals, groups = (np.array([r[k] for r in hist], dtype=np.int64) for k in range(1, 5))
    bounds = best_boundaries(tops, counts, totals, buckets) or [1]
    chunks = max(1, -(-int(groups.sum()) // CHUNK))
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    lengths = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = rows.select("doc_id", "n_tokens", "c", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(chunks)).alias("chunk"))

    def before(window) -> Column:
        return F.coalesce(F.sum("c").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # Running sums in three steps: within chunks, of chunks within their part, of parts.
    sizes = placed.groupBy("bucket", "chunk").agg(F.sum("c").alias("c")).withColumn("part", F.floor(F.col("chunk") / CHUNK))
    parts = sizes.groupBy("bucket", "part").agg(F.sum("c").alias("c"))
    parts = parts.select("bucket", "part", before(Window.partitionBy("bucket").orderBy("part")).alias("whole"))
    offsets = sizes.select("bucket", "part", "chunk", before(Window.partitionBy("bucket", "part").orderBy("chunk")).alias("off"))
    offsets = offsets.join(parts, ["bucket", "part"]).select("bucket", "chunk", (F.col("off") + F.col("whole")).alias("off"))
    order = Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens")
    numbered = placed.withColumn("rn", before(order)).join(offsets, ["bucket", "chunk"])
    numbered = numbered.select("doc_id", "n_tokens", "bucket", F.get(lengths, F.col("bucket")).alias("bucket_len"), (F.col("off") + F.col("rn")).alias("first"), "c")
    each = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    few = numbered.where(F.col("c") <= CHUNK).withColumn("k", each)
    # Many equal rows are dealt out in pieces before they become rows again.
    pieces = numbered.where(F.col("c") > CHUNK).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(c - 1) div {CHUNK}")))).repartition("doc_id", "piece")
    many = pieces.withColumns({"first": F.col("first") + F.col("piece") * CHUNK, "c": F.least(F.lit(CHUNK), F.col("c") - F.col("piece") * CHUNK)}).withColumn("k", each).drop("piece")
    at = F.col("first") + F.col("k")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    return few.unionByName(many).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(at / fit).cast("long").alias("batch"),
        F.pmod(at, fit).cast("long").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
