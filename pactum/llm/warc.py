"""WARC records: writing, parsing, and resolution of not-modified revisits.

A revisit of the server-not-modified profile holds the headers of a 304 answer and no payload. It is resolved by an
as-of join on the canonical URL: the latest full response that was captured strictly before it (ties: the larger record id).
If the validators agree (ETag by weak comparison, or Last-Modified where either side has no ETag), the stored headers
are updated with those of the 304, except for the headers that describe the stored payload or one connection.

The as-of join works in time blocks: inside a (URL, block) by a running maximum, across blocks by a running maximum
over one row per block. So a URL that holds a third of all captures is spread over its blocks.

Defined results: a revisit without an earlier full response is `orphan`; with disagreeing or missing validators
`mismatch`; else `resolved`. Null URLs canonicalise to null and match nothing; records with a null time are orphans or ignored;
repeated records resolve alike; an empty table gives an empty result; bytes that are no record
come out as one of kind `malformed` and end nothing; a date that can't be read is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_batches

#: Rows that a time block holds on average.
PER_BLOCK = 4096
# Headers of a stored response that a 304 may not change.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, www. and default port; path without a trailing slash; sorted query without utm_ keys; no scheme or fragment."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    part = [F.regexp_extract(url, pattern, k) for k in (1, 2, 3)]
    host = F.regexp_replace(F.lower(part[0]), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(part[1], r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part[2], "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.when(F.regexp_like(url, F.lit(pattern)), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


# ---------------------------------------------------------------- records as bytes


MALFORMED = "malformed"


def write_record(kind: str, record_id: int, url: str, date: str, status: str, headers: list[tuple[str, str]], payload: bytes) -> bytes:
    http = "".join([f"HTTP/1.1 {status}\r\n", *[f"{k}: {v}\r\n" for k, v in headers], "\r\n"]).encode("utf-8") + payload
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{record_id}>"), ("WARC-Target-URI", url), ("WARC-Date", date)]
    if kind == "revisit":
        named.append(("WARC-Profile", PROFILE))
    named += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode("utf-8") + b"\r\n" + http + b"\r\n\r\n"


def _head(data: bytes, at: int, end: int) -> tuple[str, dict[str, str], int]:
    stop = data.find(b"\r\n\r\n", at, end)
    if stop < 0:
        raise ValueError("a header block doesn't end")
    first, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        last = name.strip().lower()
        out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return first, out, stop + 4


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file: kind, record_id, url, date, status, headers (lower-case names), payload.

    What is no record is one of kind `malformed`, which holds the bytes up to the next record's first line.
    """
    at = 0
    while at < len(data):
        try:
            record, at = _record(data, at)
        except (ValueError, KeyError):
            after = data.find(b"\r\nWARC/", at)
            end = len(data) if after < 0 else after + 2
            record = {"kind": MALFORMED, "record_id": None, "url": None, "date": None, "status": "", "headers": {}, "payload": data[at:end]}
            at = end
        yield record


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at `at`, and where the next one does."""
    first, named, body = _head(data, at, len(data))
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    end = body + int(named["content-length"])
    if not body <= end <= len(data):
        raise ValueError("a record is cut short")
    status, headers, start = "", {}, end
    if named.get("content-type", "").startswith("application/http"):
        line, headers, start = _head(data, body, end)
        status = line.split(" ", 2)[1] if " " in line else ""
    record = {
        "kind": named.get("warc-type"), "record_id": named.get("warc-record-id", "").strip("<>"), "url": named.get("warc-target-uri"),
        "date": named.get("warc-date"), "status": status, "headers": headers, "payload": data[start:end],
    }
    while data[end : end + 2] == b"\r\n":
        end += 2
    return record, end


def read_archive(files: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Records of a column `content` of WARC bytes: kind, record_id, url, ts (timestamp), status, headers, and n_bytes of the payload."""
    small_batches(files.sparkSession, 64)
    schema = "kind string, record_id string, url string, date string, status string, headers map<string,string>, n_bytes long" + ", payload binary" * keep_payload
    kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.int64()] + [pa.binary()] * keep_payload
    names = ["kind", "record_id", "url", "date", "status", "headers", "n_bytes"] + ["payload"] * keep_payload

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [r | {"headers": list(r["headers"].items()), "n_bytes": len(r["payload"])} for r in parse_records(content.as_py() or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.select("content").mapInArrow(work, schema).withColumn("ts", F.try_to_timestamp("date")).drop("date")


# ---------------------------------------------------------------- resolution


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def validators_agree(stored: Column, fresh: Column) -> Column:
    tags = stored["etag"].isNotNull() & fresh["etag"].isNotNull()
    dates = stored["last-modified"] == fresh["last-modified"]
    return F.coalesce(F.when(tags, _weak(stored["etag"]) == _weak(fresh["etag"])).otherwise(dates), F.lit(False))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """stored, updated with what the 304 may change."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS))
    rest = F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False)))
    return F.map_concat(rest, allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical, resolved_id, status, headers (null unless resolved).

    records: record_id, url, ts (timestamp), kind (response or revisit), status (HTTP), headers (map, lower-case names).
    """
    # Read once: the steps below go over the records several times.
    rec = Scratch(records.sparkSession, "warc").write(records.select("record_id", "url", F.unix_micros("ts").alias("t"), "kind", "status", "headers", canonical_url(F.col("url")).alias("canonical")))
    full = rec.where((F.col("kind") == "response") & (F.col("status") == "200") & F.col("t").isNotNull() & F.col("canonical").isNotNull())
    visits = rec.where(F.col("kind") == "revisit")
    span = rec.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("t").alias("n")).first()
    low = span["a"] or 0
    width = max(1, -(-((span["b"] or 0) - low + 1) // max(1, -(-span["n"] // PER_BLOCK))))
    block = F.floor((F.col("t") - F.lit(low)) / F.lit(width))
    events = full.select("canonical", "t", F.struct(F.col("t").alias("at"), F.col("record_id").alias("id")).alias("full"), F.lit(None).cast(dict(rec.dtypes)["record_id"]).alias("asker"))
    events = events.unionByName(visits.where("t is not null and canonical is not null").select("canonical", "t", F.lit(None).cast(events.schema["full"].dataType).alias("full"), F.col("record_id").alias("asker")))
    events = events.withColumn("block", block)
    inside = Window.partitionBy("canonical", "block").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("full").over(inside)).where("asker is not null")
    last = events.groupBy("canonical", "block").agg(F.max("full").alias("last"))
    before = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical", "block", F.max("last").over(before).alias("carried"))
    found = near.join(carried, ["canonical", "block"]).select(F.col("asker").alias("record_id"), "t", "canonical", F.coalesce("near", "carried").getField("id").alias("stored_id")).distinct()
    mine = visits.join(found, ["record_id", "t", "canonical"], "left")
    stored = full.select(F.col("record_id").alias("stored_id"), F.col("headers").alias("stored")).dropDuplicates(["stored_id"])
    both = mine.join(stored, "stored_id", "left")
    agree = validators_agree(F.col("stored"), F.col("headers"))
    status = F.when(F.col("stored_id").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    fine = F.col("status") == "resolved"
    return both.select("record_id", "canonical", "stored_id", status.alias("status"), "stored", "headers").select(
        "record_id",
        "canonical",
        F.col("stored_id").alias("resolved_id"),
        "status",
        F.when(fine, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"),
    )


# ---------------------------------------------------------------- an archive of the pages table

#: Seconds between a page's capture and its revisit in the archive made of a pages table.
DELAY = 3600


def archive_pages(pages: DataFrame) -> DataFrame:
    """A column `content`: for each page a WARC file of its full response and of a 304 revisit an hour later.

    The capture of page n is n seconds after 2024-01-01. The revisit's ETag is that of the page itself; so a page
    whose URL was captured again within the hour, with another body, gives a mismatch.
    """
    small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        from datetime import UTC, datetime, timedelta
        from email.utils import format_datetime

        start = datetime(2024, 1, 1, tzinfo=UTC)
        for batch in batches:
            out = []
            for number, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (text or "").encode("utf-8")
                tag = f'"{hashlib.md5(body).hexdigest()}"'
                then = start + timedelta(seconds=number)
                later = then + timedelta(seconds=DELAY)
                stamp = [t.strftime("%Y-%m-%dT%H:%M:%SZ") for t in (then, later)]
                head = [("Date", format_datetime(then, usegmt=True)), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))), ("ETag", tag), ("Cache-Control", "max-age=60")]
                fresh = [("Date", format_datetime(later, usegmt=True)), ("ETag", "W/" + tag), ("Cache-Control", "max-age=600"), ("Content-Length", "0"), ("Connection", "close")]
                out.append(
                    write_record("response", 2 * number, url or "", stamp[0], "200 OK", head, body)
                    + write_record("revisit", 2 * number + 1, url or "", stamp[1], "304 Not Modified", fresh, b"")
                )
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])

    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(work, "content binary")


def resolve_pages(pages: DataFrame) -> DataFrame:
    """The revisits of archive_pages, resolved: page_id, canonical, resolved_page, status and the merged headers as columns."""
    records = read_archive(archive_pages(pages))
    number = F.regexp_extract("record_id", r"(-?\d+)$", 1).cast("long")
    found = resolve(records.withColumn("record_id", number))
    names = {"etag": "etag", "date": "date", "cache_control": "cache-control", "content_length": "content-length", "content_type": "content-type"}
    return found.select(
        ((F.col("record_id") - 1) / 2).cast("long").alias("page_id"),
        "canonical",
        (F.col("resolved_id") / 2).cast("long").alias("resolved_page"),
        "status",
        *[F.col("headers").getItem(k).alias(c) for c, k in names.items()],
        F.size("headers").cast("long").alias("n_headers"),
    )
