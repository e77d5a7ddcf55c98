"""Helpers shared by the corpus operators: shared scratch tables and byte-level tokenising."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it; a temporary one only in local mode, where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pactum-shared-")
        atexit.register(shutil.rmtree, named, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written into the shared folder, so that lineage ends and lost executors cost one task.

    A table is released once nothing that is still lazy reads it.
    """

    #: Those that may hold tables, so that a run of several operators can let go of them in between.
    live: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        Scratch.live.append(self)
        self.root = f"{shared_dir(spark).rstrip('/')}/pactum-{label}-{uuid.uuid4().hex}"
        self.made = 0
        self.held: list[str] = []

    def write(self, df: DataFrame, options: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
        """by: the last column, of few values (32 at most), each of which gets files of its own, so that reads of some skip the others."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        # Tasks write the files of all values side by side, without a sort.
        asked = {FILE_CLEANUP: "true"} | ({WRITERS: "32"} if by else {})
        before = {k: self.spark.conf.get(k, None) for k in asked}
        for k, v in asked.items():
            self.spark.conf.set(k, v)
        try:
            df.write.options(**(options or {})).partitionBy(*[by] if by else []).parquet(path)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pactum_path = path
        self.held.append(path)
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Scratch tables of the same columns as one: a plan with one scan, where a union has one for each."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._pactum_path for t in tables])

    def release(self, *tables: DataFrame) -> None:
        self._delete(getattr(t, "_pactum_path", None) for t in tables)

    def release_all(self, but: list[DataFrame] = ()) -> None:
        """Deletes every table but those that the result reads."""
        kept = {t._pactum_path for t in but}
        self._delete([p for p in self.held if p not in kept])

    @classmethod
    def release_since(cls, mark: int) -> None:
        """Deletes the tables of all made after the first `mark`, once nothing lazy reads them."""
        for scratch in cls.live[mark:]:
            scratch.release_all()
        del cls.live[mark:]

    def _delete(self, paths) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in paths:
            if name in self.held:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
                self.held.remove(name)


class Membership:
    """A bit array of bounded size that says which rows may belong to a set of ids; none that belong are missed.

    At most 2**24 bits (2 MB) are gathered and shared, whatever the number of ids: with very many ids it lets more rows
    through, and the exact join that follows drops them.
    """

    def __init__(self, ids: DataFrame, key: Column):
        """key: the 64-bit hash of a row's id."""
        bits = 1 << 16
        n = ids.count()
        while bits < 8 * n and bits < 1 << 24:
            bits *= 2
        spot = ids.select(F.pmod(key, F.lit(bits)).alias("s"))
        words = spot.groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m"))
        self.array = np.zeros(bits // 64, dtype=np.int64)
        for w, m in words.collect():
            self.array[w] = m
        self.bits = bits
        self.spark = ids.sparkSession
        self._shared = None

    def test(self, key: Column) -> Column:
        """Whether a row may belong, inside the JVM: the bits come from a one-row scalar subquery."""
        one = self.spark.createDataFrame([(self.array.tolist(),)], "bits array<long>")
        spot = F.pmod(key, F.lit(self.bits))
        word = F.get(one.scalar(), F.floor(spot / 64).cast("int"))
        return F.call_function("shiftright", word, (spot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    @property
    def shared(self):
        if self._shared is None:
            self._shared = self.spark.sparkContext.broadcast(self.array)
        return self._shared

    def only(self):
        """A function over Arrow batches that keeps the rows whose column `hash` may belong."""
        shared, bits = self.shared, self.bits

        def work(batches):
            array = shared.value
            for batch in batches:
                spot = batch.column("hash").to_numpy() % bits
                hit = (array[spot >> 6] >> (spot & 63)) & 1 == 1
                if hit.any():
                    yield batch.filter(pa.array(hit))

        return work


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, as one row may hold a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


# ---------------------------------------------------------------- tokens as numpy arrays

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 48
_FNV_BASE = np.uint64(0xCBF29CE484222325)
_FNV_PRIME = np.uint64(0x100000001B3)
_WINDOW = 1 << 21


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def _hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token; the bytes past the 48th enter through xxhash."""
    h = np.full(len(starts), _FNV_BASE, dtype=np.uint64)
    size = ends - starts
    order = np.argsort(-np.minimum(size, _LONG), kind="stable")
    first = starts[order]
    cut = np.minimum(size[order], _LONG)
    live = np.searchsorted(-cut, -np.arange(1, _LONG + 1), side="right")
    ho = h[order]
    for k in range(_LONG):
        n = live[k]
        if not n:
            break
        ho[:n] = (ho[:n] ^ buf[first[:n] + k]) * _FNV_PRIME
    h[order] = ho
    for i in np.flatnonzero(size > _LONG):
        h[i] ^= np.uint64(xxhash.xxh64_intdigest(buf[starts[i] + _LONG : ends[i]].tobytes()))
    return mix64(h ^ size.astype(np.uint64))


def windows(raw: bytes):
    """raw in pieces of about two megabytes that end at white space, or longer where a token is."""
    at = 0
    while at < len(raw):
        end = at + _WINDOW
        if end < len(raw):
            view = np.frombuffer(raw, dtype=np.uint8, offset=end)
            step = 0
            while step < len(view):
                hit = np.flatnonzero(_SPACE[view[step : step + 65536]])
                if len(hit):
                    step += int(hit[0])
                    break
                step += 65536
            end += min(step, len(view))
        yield raw[at:end]
        at = end


def _tokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, last two bytes) of each token of a lower-cased buffer."""
    s, e = _spans(buf)
    tail = buf[e - 1].astype(np.int32)
    two = e - s > 1
    tail[two] |= buf[e[two] - 2].astype(np.int32) << 8
    return s, _hash_spans(buf, s, e), tail


def token_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and last two bytes of the words [^\\x20\\x09-\\x0D]+ of a UTF-8 text after A-Z are lower-cased."""
    parts = [_tokens(_LOWER[np.frombuffer(piece, dtype=np.uint8)])[1:] for piece in windows(raw)]
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))


def batch_tokens(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """token_hashes of several texts; short texts share one pass."""
    out: list = [None] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not group:
            return
        joined = b" ".join(texts[i] for i in group)
        s, h, tail = _tokens(_LOWER[np.frombuffer(joined, dtype=np.uint8)])
        cuts = np.searchsorted(s, np.cumsum([len(texts[i]) + 1 for i in group]))
        at = 0
        for i, c in zip(group, cuts, strict=True):
            out[i] = h[at:c], tail[at:c]
            at = c
        group.clear()
        held = 0

    for i, t in enumerate(texts):
        if len(t) > _WINDOW:
            out[i] = token_hashes(t)
            continue
        group.append(i)
        held += len(t) + 1
        if held > _WINDOW:
            flush()
    flush()
    return out


def batch_token_hashes(texts: list[bytes]) -> list[np.ndarray]:
    return [h for h, _ in batch_tokens(texts)]
