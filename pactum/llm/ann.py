"""Nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by its nearest pivots in order (the head of
its permutation); each index block posts its vectors into one inverted file per pivot, with the rank. A query adds up,
over the files of its own pivots, what shared pivots save of the footrule distance, and the vectors with the smallest
distance are reranked by the exact inner product in double precision.

Pivots order directions, and the measure is the inner product: so a line fitted in each block over its pivots turns the
footrule into a cosine, which times the vector's norm is what candidates are ranked by. With equal norms that is the order
of the footrule itself.

PIVOTS bounds the sample (it is the only thing all tasks share), HEAD the permutation's length. Of a block of n rows
RERANK * sqrt(k * n) are reranked, whatever n; blocks have about BLOCK rows and meet the queries in packs of about
QUERIES, as the stated query set asks every row. The README has the measured recall.

Equal vectors are one entry that carries its smallest ids, as many as a result can name; so hot vectors cost one row.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths have no inner product and are never compared; fewer candidates than k give fewer rows; ties go to
the smaller vec_id; rows that repeat a vec_id with the same vector count once; an empty table gives an empty result;
columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

PIVOTS = 128
HEAD = 64
RERANK = 3.2
BLOCK = 8192
QUERIES = 8192
#: Pivots of so many lengths are sampled, the most common ones; those of further lengths are drawn at random.
LENGTHS = 16
#: Pivots whose distances fit the line from the footrule to the cosine.
FITTED = 16


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    return rows.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v")).where(fine)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, as squares of very large or small components leave the range of doubles.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def heads(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first, ties to the smaller number."""
    near = -(x @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :HEAD]


class Block:
    """One index block: vectors and their postings."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray):
        """pivots: of length one."""
        self.x = x
        directions = unit(x)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        head = heads(directions, pivots)
        self.width = head.shape[1]
        pivot = head.reshape(-1)
        order = np.argsort(pivot, kind="stable")
        self.rows = (order // self.width).astype(np.int32)
        # What a pivot at rank r can save at most against its absence.
        self.gain = (self.width - order % self.width).astype(np.int16)
        self.at = np.searchsorted(pivot[order], np.arange(len(pivots) + 1))
        few = pivots[:FITTED]
        gains = np.stack([self.footrule_gain(h) for h in heads(few, pivots)]).astype(np.float64)
        cosines = few @ directions.T
        spread = gains - gains.mean()
        self.slope = max(float((spread * cosines).sum() / max(1.0, (spread**2).sum())), 1e-9)
        self.offset = float(cosines.mean() - self.slope * gains.mean())

    def footrule_gain(self, head: np.ndarray) -> np.ndarray:
        """For each row, half of what its footrule distance to a query with this head is below the largest one."""
        total = np.zeros(len(self.x), dtype=np.int32)
        for rank, p in enumerate(head):
            a, b = self.at[p], self.at[p + 1]
            total[self.rows[a:b]] += np.minimum(self.gain[a:b], self.width - rank)
        return total

    def search(self, q: np.ndarray, head: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best of the reranked part, with all that tie with the last."""
        n = len(self.x)
        take = min(n, int(np.ceil(RERANK * np.sqrt(k * n))))
        near = self.norm * (self.offset + self.slope * self.footrule_gain(head))
        part = np.argpartition(-near, take - 1)[:take]
        score = np.einsum("ij,j->i", self.x[part], q)
        if len(part) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            part, score = part[score >= edge], score[score >= edge]
        return part, score


def _by_length(counts: dict[int, int], value) -> Column:
    """value(rows of a length), by the length in column d."""
    out = F.lit(1)
    for d, n in sorted(counts.items()):
        out = F.when(F.col("d") == d, value(n)).otherwise(out)
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest rows of each query but itself: query_id, rank, vec_id, score.

    rows: vec_id, embedding. queries: vec_id, a subset of the ids of rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    used = scratch.write(usable(rows))
    least = Window.partitionBy("v").orderBy("vec_id")
    ids = used.distinct().withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    entry = ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entry = scratch.write(entry.select(F.element_at("ids", 1).alias("cid"), "ids", "v", F.size("v").alias("d")))
    asked = used.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = scratch.write(asked.join(entry.select("v", "d", F.struct("cid", "d").alias("qcid")), "v").select("query_id", "qcid"))
    sizes = {r["d"]: r["count"] for r in entry.groupBy("d").count().collect()}
    common = sorted(sizes, key=lambda d: (-sizes[d], d))[:LENGTHS]
    drawn = Window.partitionBy("d").orderBy(F.xxhash64("cid", "v"))
    sample = entry.where(F.col("d").isin(common)).withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= PIVOTS)
    found: dict[int, list] = {}
    for r in sample.select("d", "r", "v").collect():
        found.setdefault(r["d"], []).append((r["r"], r["v"]))
    pivots = {d: unit(np.array([v for _, v in sorted(some)])) for d, some in found.items()}
    shared = spark.sparkContext.broadcast(pivots)
    wanted = asked.select("qcid.cid", "qcid.d").distinct()
    asking = {r["d"]: r["count"] for r in wanted.groupBy("d").count().collect()}
    blocks, packs = _by_length(sizes, lambda n: -(-n // BLOCK)), _by_length(asking, lambda n: -(-n // QUERIES))

    def dealt(number: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), number - 1))

    left = entry.withColumn("p", dealt(packs)).select(F.col("d").alias("d"), F.pmod(F.xxhash64("cid"), blocks).alias("b"), "p", "cid", "v")
    # A stated query set, in packs, against every block of the index.
    ask = entry.join(wanted, ["cid", "d"], "left_semi").withColumn("b", dealt(blocks))
    ask = ask.select(F.col("d").alias("d"), F.col("b").cast("long").alias("b"), F.pmod(F.xxhash64("cid"), packs).cast("int").alias("p"), F.col("cid").alias("qcid"), F.col("v").alias("qv"))

    def search(index: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asks):
            return pd.DataFrame({"d": [], "qcid": [], "cid": [], "score": []}).astype({"d": "int32", "qcid": "int64", "cid": "int64"})
        d = int(index["d"].iloc[0])
        own = shared.value.get(d)
        if own is None:
            own = unit(np.random.RandomState(d & 0x7FFFFFFF).standard_normal((PIVOTS, d)))
        block = Block(np.stack(index["v"].to_numpy()), own)
        ids = index["cid"].to_numpy()
        q = np.stack(asks["qv"].to_numpy())
        cids, scores, counts = [], [], []
        for x, head in zip(q, heads(unit(q), own), strict=True):
            part, score = block.search(x, head, k + 1)
            order = np.lexsort((ids[part], -score))[: k + 1]
            cids.append(ids[part[order]])
            scores.append(score[order])
            counts.append(len(order))
        return pd.DataFrame({"d": np.int32(d), "qcid": np.repeat(asks["qcid"].to_numpy(), counts), "cid": np.concatenate(cids), "score": np.concatenate(scores)})

    found = left.groupBy("d", "b", "p").cogroup(ask.groupBy("d", "b", "p")).applyInPandas(search, "d int, qcid long, cid long, score double")
    best = Window.partitionBy("d", "qcid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    found = found.join(entry.select("d", "cid", "ids"), ["d", "cid"]).select("d", "qcid", "score", F.explode("ids").alias("vec_id"))
    named = Window.partitionBy("d", "qcid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(named)).where(F.col("r") <= k + 1)
    lists = found.groupBy("d", "qcid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    mine = asked.select("query_id", "qcid.d", F.col("qcid.cid").alias("qcid")).join(lists, ["d", "qcid"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"
    )


def exact_nearest(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    """Brute force, for tests and recall."""
    out = {}
    for i in np.flatnonzero(np.isin(ids, queries)):
        s = np.einsum("ij,j->i", x, x[i])
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out
