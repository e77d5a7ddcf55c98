"""The corpus queries: each op<N>_ entry applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html_text, jpeg, lang_id, line_dedup, near_dup, packing, pitman_yor, warc
from .common import table

#: The public tokenizer file of op5.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict_languages(table(spark, sf_dir, "documents"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_documents(table(spark, sf_dir, "documents"), percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_pages(table(spark, sf_dir, "pages"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.read_features(jpeg.store_texts(table(spark, sf_dir, "documents")))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM toks),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, md5(unnest(s)) AS h FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM items a JOIN items b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sizes s JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY 1) r ON r.node = s.doc_id
"""

OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, html, regexp_matches(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') AS ok,
    lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*[^?#]*\?([^#]*)', 1) AS query
  FROM pages WHERE page_id IS NOT NULL),
kept AS (
  SELECT page_id, html, ok, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '')
    || regexp_replace(path, '/+$', '') AS place,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS q
  FROM parts),
caps AS (
  SELECT page_id, coalesce(html, '') AS body, CASE WHEN ok THEN place || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical
  FROM kept),
found AS (
  SELECT v.page_id, v.canonical, v.body, max(f.page_id) AS resolved
  FROM caps v LEFT JOIN caps f ON f.canonical = v.canonical AND f.page_id < v.page_id + 3600 GROUP BY 1, 2, 3),
told AS (
  SELECT f.*, strlen(r.body) AS n, CASE WHEN resolved IS NULL THEN 'orphan' WHEN md5(r.body) = md5(f.body) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM found f LEFT JOIN caps r ON r.page_id = f.resolved)
SELECT page_id, canonical, resolved AS resolved_page, status,
  CASE WHEN status = 'resolved' THEN 'W/"' || md5(body) || '"' END AS etag,
  CASE WHEN status = 'resolved' THEN strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id + 3600), '%a, %d %b %Y %H:%M:%S GMT') END AS date,
  CASE WHEN status = 'resolved' THEN 'max-age=600' END AS cache_control,
  CASE WHEN status = 'resolved' THEN n::VARCHAR END AS content_length,
  CASE WHEN status = 'resolved' THEN 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN status = 'resolved' THEN 5 END::BIGINT AS n_headers
FROM told
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lang_id": op1_lang_id,
        "op2_near_dup": op2_near_dup,
        "op3_line_dedup": op3_line_dedup,
        "op4_html_text": op4_html_text,
        "op5_bpe": op5_bpe,
        "op6_packing": op6_packing,
        "op7_warc": op7_warc,
        "op8_media": op8_media,
        "op9_ann": op9_ann,
        "op10_lm_score": op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dup": OP2_SQL, "op7_warc": OP7_SQL}
