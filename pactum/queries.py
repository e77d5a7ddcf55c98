"""Registered queries: contracts run over the driver's tables, each with the SQL that says the same.

`ROW` programs give one row per record, `LIFTED` programs take a whole table as their list. Identifiers have no underscores; columns
are renamed on the way in and out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .program import Program
from .sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2024-01-01T00:00:00Z"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract(name: str, inputs: str, outputs: str, body: str, head: str = "", rules: str = "", lets: str = "") -> str:
    return f"contract {name}\n{head}\ninput {inputs} end\noutput {outputs} end\n{rules}\nend\ndefine {name} with input\n{lets}\nresult {{ {body} }}\nend\n"


@lru_cache(maxsize=256)
def program(text: str, library: tuple[tuple[str, str], ...] = ()) -> Program:
    return Program.from_text(text, dict(library))


# ---------------------------------------------------------------- row level: name -> (table, columns carried along, contract, SQL)

LINE = "l-orderkey as integer, l-linenumber as integer"

ROW: dict[str, tuple[str, list[str], str, str]] = {}


def row(name: str, table: str, keep: str, inputs: str, outputs: str, body: str, sql: str, lets: str = "", head: str = "", rules: str = "") -> None:
    ROW[name] = (table, keep.split(), contract("q-" + name.replace("_", "-"), inputs, outputs, body, head, rules, lets), sql)


row(
    "arith_lineitem", "lineitem", "l_orderkey l_linenumber",
    "l-extendedprice as float, l-discount as float, l-tax as float, l-quantity as float",
    "net as float, gross as float, unit as float, loss as float, size-class as string",
    'net: net, gross: net * (1.0 + $l-tax), unit: $l-extendedprice / $l-quantity, loss: -($l-extendedprice - net), size-class: if $l-quantity < 10.0 then "small" else if $l-quantity < 30.0 then "medium" else "large" end',
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS net, l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax) AS gross,
    l_extendedprice / l_quantity AS unit, -(l_extendedprice - l_extendedprice * (1.0::DOUBLE - l_discount)) AS loss,
    CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_class FROM lineitem""",
    lets="let net be $l-extendedprice * (1.0 - $l-discount)",
)
row(
    "int_div_mod", "lineitem", "l_orderkey l_linenumber", "l-partkey as integer, l-suppkey as integer",
    "over as integer, rest as integer, less as integer, neg-over as integer, neg-rest as integer",
    "over: $l-partkey / 7, rest: $l-partkey mod 7, less: $l-suppkey - $l-partkey, neg-over: (0 - $l-partkey) / 7, neg-rest: (0 - $l-partkey) % 7",
    """SELECT l_orderkey, l_linenumber, l_partkey // 7 AS over, l_partkey % 7 AS rest, l_suppkey - l_partkey AS less, (0 - l_partkey) // 7 AS neg_over, (0 - l_partkey) % 7 AS neg_rest FROM lineitem""",
)
row(
    "compare_bool", "orders", "o_orderkey", "o-totalprice as float, o-orderstatus as string, o-custkey as integer",
    "eq as boolean, ne as boolean, lt as boolean, gt as boolean, le as boolean, ge as boolean, both as boolean, either as boolean, neither as boolean, strings as boolean, kinds as boolean",
    """eq: $o-orderstatus = "F", ne: $o-orderstatus != "F", lt: $o-totalprice < 100000.0, gt: $o-totalprice > 100000.0, le: $o-custkey <= 500, ge: $o-custkey >= 500,
    both: $o-orderstatus = "O" and $o-custkey > 700, either: $o-orderstatus = "O" or $o-custkey > 700, neither: not ($o-orderstatus = "O" or $o-custkey > 700), strings: $o-orderstatus < "G", kinds: $o-custkey = 1.0""",
    """SELECT o_orderkey, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS ne, o_totalprice < 100000 AS lt, o_totalprice > 100000 AS gt, o_custkey <= 500 AS le, o_custkey >= 500 AS ge,
    o_orderstatus = 'O' AND o_custkey > 700 AS both, o_orderstatus = 'O' OR o_custkey > 700 AS either, NOT (o_orderstatus = 'O' OR o_custkey > 700) AS neither, o_orderstatus < 'G' AS strings, false AS kinds FROM orders""",
)
row(
    "float_equality", "lineitem", "l_orderkey l_linenumber", "l-discount as float, l-tax as float", "near as boolean, zero as boolean",
    "near: $l-discount + 0.1 + 0.2 = $l-discount + 0.3, zero: $l-tax - $l-tax = 0.0",
    "SELECT l_orderkey, l_linenumber, true AS near, true AS zero FROM lineitem",
)
row(
    "if_bucket", "customer", "c_custkey", "c-acctbal as float, c-mktsegment as string", "band as string, rank as integer",
    'band: if $c-acctbal < 0.0 then "debt" else if $c-acctbal < 5000.0 then "normal" else "rich" end, rank: if $c-mktsegment = "BUILDING" then 1 else 2 end',
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal' ELSE 'rich' END AS band, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END::BIGINT AS rank FROM customer",
)
row(
    "match_range", "part", "p_partkey", "p-size as integer, p-retailprice as float", "size-band as string, price-band as string",
    'size-band: match $p-size when between 1 and 10 then "s" when between 11 and 30 then "m" else "l" end, price-band: match $p-retailprice when between 0 and 1000.0 then "cheap" when _ then "dear" end',
    "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 's' WHEN p_size BETWEEN 11 AND 30 THEN 'm' ELSE 'l' END AS size_band, CASE WHEN p_retailprice BETWEEN 0 AND 1000 THEN 'cheap' ELSE 'dear' END AS price_band FROM part",
)
row(
    "match_literal", "orders", "o_orderkey", "o-orderstatus as string, o-orderpriority as string", "status as string, urgent as boolean, none as maybe integer",
    'status: match $o-orderstatus when "F" then "finished" when "O" then "open" else "pending" end, urgent: match $o-orderpriority when "1-URGENT" then true when p then false end, none: match $o-orderstatus when "never" then 1 end',
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS status, o_orderpriority = '1-URGENT' AS urgent, NULL::BIGINT AS none FROM orders",
)
row(
    "match_guard", "customer", "c_custkey", "c-acctbal as float, c-nationkey as integer", "label as string",
    'label: match $c-nationkey when n and n > 20 then "far: " + to-string({ value: n }) when n and $c-acctbal < 0.0 then "debt" when _ then "near" end',
    "SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN 'far: ' || c_nationkey WHEN c_acctbal < 0 THEN 'debt' ELSE 'near' END AS label FROM customer",
)
row(
    "string_case_trim", "customer", "c_custkey", "c-name as string, c-mktsegment as string",
    "up as string, low as string, trimmed as string, left as string, right as string",
    'up: upper({ value: $c-name }), low: lower({ value: $c-mktsegment }), trimmed: trim({ value: "\\t " + $c-name + " \\n" }), left: trim-start({ value: "  " + $c-name + " " }), right: trim-end({ value: " " + $c-name + "\\t" })',
    "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, c_name AS trimmed, c_name || ' ' AS \"left\", ' ' || c_name AS \"right\" FROM customer",
)
row(
    "string_substring", "documents", "doc_id", "text as string", "head as string, middle as string, clamped as string, none as string",
    "head: substring({ value: $text, start: 0, end: 12 }), middle: substring({ value: $text, start: 5, end: 25 }), clamped: substring({ value: $text, start: -3, end: 4 }), none: substring({ value: $text, start: 9, end: 2 })",
    "SELECT doc_id, substr(text, 1, 12) AS head, substr(text, 6, 20) AS middle, substr(text, 1, 4) AS clamped, '' AS none FROM documents",
)
row(
    "string_replace_split_join", "part", "p_partkey", "p-name as string, p-type as string", "swapped as string, n as integer, dashed as string, first as maybe string",
    'swapped: replace({ value: $p-name, find: "a", replacement: "<a>" }), n: length({ list: words }), dashed: join({ list: words, delimiter: "--" }), first: words.0',
    "SELECT p_partkey, replace(p_name, 'a', '<a>') AS swapped, len(string_split(p_type, ' '))::BIGINT AS n, replace(p_type, ' ', '--') AS dashed, string_split(p_type, ' ')[1] AS first FROM part",
    lets='let words be split({ value: $p-type, delimiter: " " })',
)
row(
    "string_predicates", "part", "p_partkey", "p-type as string, p-brand as string", "starts as boolean, ends as boolean, has as boolean, old as boolean",
    'starts: starts-with({ value: $p-type, prefix: "S" }), ends: ends-with({ value: $p-brand, suffix: "1" }), has: contains({ value: $p-type, substring: "N" }), old: contains({ value: $p-brand, search: "#2" })',
    "SELECT p_partkey, starts_with(p_type, 'S') AS starts, ends_with(p_brand, '1') AS ends, contains(p_type, 'N') AS has, contains(p_brand, '#2') AS old FROM part",
)
row(
    "string_length_pad", "documents", "doc_id", "text as string, lang as string", "size as integer, left as string, right as string, long as string",
    'size: length({ value: $text }), left: pad-left({ value: $lang, width: 7, fill: "xyz" }), right: pad-right({ value: $lang, width: 5, fill: "." }), long: pad-left({ value: "abcdef", width: 3, fill: "-" })',
    "SELECT doc_id, length(text)::BIGINT AS size, lpad(lang, 7, 'xyz') AS \"left\", rpad(lang, 5, '.') AS \"right\", 'abcdef' AS long FROM documents",
)
row(
    "regex_match", "pages", "page_id", "url as string", "secure as boolean, numbered as boolean, alpha as boolean",
    'secure: regex-match({ value: $url, pattern: "^https://" }), numbered: regex-match({ value: $url, pattern: "/[[:digit:]]{3,}" }), alpha: regex-match({ value: $url, pattern: "^[[:alpha:]]+$" })',
    "SELECT page_id, regexp_matches(url, '^https://') AS secure, regexp_matches(url, '/[[:digit:]]{3,}') AS numbered, regexp_matches(url, '^[[:alpha:]]+$') AS alpha FROM pages",
)
row(
    "regex_replace", "pages", "page_id", "url as string", "masked as string, bare as string",
    'masked: regex-replace({ value: $url, pattern: "[0-9]+", replacement: "$N" }), bare: regex-replace({ value: $url, pattern: "[?#].*", replacement: "" })',
    "SELECT page_id, regexp_replace(url, '[0-9]+', '$N', 'g') AS masked, regexp_replace(url, '[?#].*', '', 'g') AS bare FROM pages",
)
row(
    "numeric_fns", "customer", "c_custkey", "c-acctbal as float, c-nationkey as integer",
    "a as float, up as integer, down as integer, near as integer, lo as float, hi as float, held as integer, fheld as float",
    "a: abs({ value: $c-acctbal }), up: ceil({ value: $c-acctbal }), down: floor({ value: $c-acctbal }), near: round({ value: $c-acctbal }), lo: min({ a: $c-acctbal, b: 1000.0 }), hi: max({ a: $c-acctbal, b: $c-nationkey }), held: clamp({ value: $c-nationkey, min: 5, max: 15 }), fheld: clamp({ value: $c-acctbal, low: 0.0, high: 999.5 })",
    """SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS up, floor(c_acctbal)::BIGINT AS down, round(c_acctbal)::BIGINT AS near, least(c_acctbal, 1000.0::DOUBLE) AS lo,
    greatest(c_acctbal, c_nationkey::DOUBLE) AS hi, least(greatest(c_nationkey, 5), 15)::BIGINT AS held, least(greatest(c_acctbal, 0.0::DOUBLE), 999.5::DOUBLE) AS fheld FROM customer""",
)
row(
    "record_ops", "customer", "c_custkey", "c-name as string, c-nationkey as integer, c-acctbal as float",
    "names as string, n as integer, first as string, merged as integer, picked as string, left as string, same as boolean",
    """names: join({ list: keys({ record: rec }), delimiter: "," }), n: length({ list: values({ record: rec }) }), first: rec.name, merged: merge({ a: rec, b: { nation: $c-nationkey + 100 } }).nation,
    picked: join({ list: keys({ record: pick({ record: rec, fields: ["bal", "name", "zip"] }) }), delimiter: "," }), left: join({ list: keys({ record: omit({ record: rec, fields: ["bal"] }) }), delimiter: "," }),
    same: rec = { bal: $c-acctbal, nation: $c-nationkey, name: $c-name }""",
    "SELECT c_custkey, 'name,nation,bal' AS names, 3::BIGINT AS n, c_name AS first, (c_nationkey + 100)::BIGINT AS merged, 'bal,name' AS picked, 'name,nation' AS \"left\", true AS same FROM customer",
    lets="let rec be { name: $c-name, nation: $c-nationkey, bal: $c-acctbal }",
)
row(
    "date_parse_format", "orders", "o_orderkey", "o-orderdate as string", "year as integer, month as integer, day as integer, shown as string, named as string",
    'year: d.year, month: d.month, day: d.day, shown: format-date({ date: d, format: "%d/%m/%Y %H:%M:%S" }), named: format-date({ date: d, format: "%b %Y" })',
    """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS shown, strftime(o_orderdate, '%b %Y') AS named FROM orders""",
    lets='let d be parse-date({ value: $o-orderdate, format: "%Y-%m-%dT%H:%M:%S" })',
)
row(
    "date_add_diff", "events", "event_id", "ts as string", "plus as string, minus as string, month as string, days as integer, hours as integer, now as string",
    """plus: date-add({ date: $ts, amount: 10, unit: "days" }), minus: date-add({ date: $ts, amount: -90, unit: "minutes" }), month: date-add({ date: $ts, amount: 1, unit: "months" }),
    days: date-diff({ from: "2020-01-01T00:00:00", to: $ts, unit: "days" }), hours: date-diff({ from: $ts, to: "2020-01-01T00:00:00", unit: "hours" }), now: now-date({})""",
    """WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
    SELECT event_id, strftime(t + INTERVAL 10 DAY, '%Y-%m-%dT%H:%M:%SZ') AS plus, strftime(t - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS minus,
    strftime(date_trunc('month', t) + INTERVAL 1 MONTH + (t - date_trunc('month', t)), '%Y-%m-%dT%H:%M:%SZ') AS month,
    (epoch(t)::BIGINT - epoch(TIMESTAMP '2020-01-01')::BIGINT) // 86400 AS days, (epoch(TIMESTAMP '2020-01-01')::BIGINT - epoch(t)::BIGINT) // 3600 AS hours, '2024-01-01T00:00:00Z' AS now FROM e""",
)
row(
    "encode_base64_url", "pages", "page_id", "url as string", "b64 as string, back as string, web as string, plain as string",
    "b64: base64-encode({ value: $url }), back: base64-decode({ value: base64-encode({ value: $url }) }), web: url-encode({ value: $url }), plain: url-decode({ value: url-encode({ value: $url }) })",
    "SELECT page_id, base64(encode(url)) AS b64, url AS back, url_encode(url) AS web, url AS plain FROM pages",
)
row(
    "json_encode_parse", "events", "event_id", "props as string, event-type as string, user-id as integer", "k as maybe integer, kind as boolean, encoded as string, name as string",
    'k: json-parse({ value: $props }).k, kind: json-parse({ value: $props }) is record, encoded: json-encode({ value: { user: $user-id, kind: $event-type, none: nothing } }), name: json-encode({ value: $event-type })',
    """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, true AS kind, '{"user":' || user_id || ',"kind":"' || event_type || '","none":null}' AS encoded, '"' || event_type || '"' AS name FROM events""",
)
row(
    "sha256_hash", "customer", "c_custkey", "c-name as string", "digest as string", "digest: $c-name through sha256({})",
    "SELECT c_custkey, sha256(c_name) AS digest FROM customer",
)
row(
    "convert_text", "lineitem", "l_orderkey l_linenumber", "l-partkey as integer, l-quantity as float, l-returnflag as string", "i as string, f as string, b as string, whole as integer, back as integer, real as float, junk as float",
    'i: to-string({ value: $l-partkey }), f: to-string({ value: $l-quantity }), b: to-string({ value: $l-returnflag = "N" }), whole: to-integer({ value: $l-quantity }), back: to-integer({ value: to-string({ value: $l-partkey }) + " parts" }), real: to-float({ value: $l-partkey }), junk: to-float({ value: $l-returnflag })',
    """SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS i, printf('%.1f', l_quantity) AS f, (l_returnflag = 'N')::VARCHAR AS b, trunc(l_quantity)::BIGINT AS whole, l_partkey AS back, l_partkey::DOUBLE AS real, 0.0::DOUBLE AS junk FROM lineitem""",
)
row(
    "embedding_folds", "embeddings", "vec_id", "embedding as list of float", "n as integer, positive as integer, clipped as float, head as float, top as float",
    """n: length({ list: $embedding }), positive: length({ list: filter $embedding where x x > 0.0 end }), clipped: fold({ list: map $embedding as x do (if x > 0.0 then 1.0 else 0.5 end) end, initial: 0.0, fn: "add" }),
    head: match $embedding when [a, b, ..] then a + b else 0.0 end, top: match reverse({ list: sort({ list: $embedding }) }) when [m, ..rest] then m else 0.0 end""",
    """SELECT vec_id, len(embedding)::BIGINT AS n, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)) AS clipped,
    embedding[1]::DOUBLE + embedding[2]::DOUBLE AS head, list_max(embedding)::DOUBLE AS top FROM embeddings""",
)
row(
    "uses_inline", "orders", "o_orderkey", "o-totalprice as float, o-orderpriority as string", "tax as float, shout as string",
    "tax: vat({ amount: $o-totalprice, rate: 0.2 }).due, shout: (label({ text: $o-orderpriority })).out", 
    "SELECT o_orderkey, o_totalprice * 0.2::DOUBLE AS tax, upper(trim(o_orderpriority)) || '!' AS shout FROM orders",
    head="uses vat, label",
)
row(
    "sanitize_pii", "customer", "c_custkey", "c-name as string tagged pii, c-acctbal as float tagged restricted, c-mktsegment as string", "who as string, wealthy as boolean, segment as string",
    "who: hide({ value: $c-name }), wealthy: $c-acctbal > 5000.0, segment: $c-mktsegment",
    "SELECT c_custkey, sha256(c_name) AS who, c_acctbal > 5000 AS wealthy, c_mktsegment AS segment FROM customer",
    head="tags pii \"personal\", restricted end\nsanitizers hide using sha256 strips pii end",
    rules="rules forbid tagged pii in output forbid tagged restricted in output forbid input.c-name in output end",
)

LIBRARY = (
    ("vat", contract("vat", "amount as float, rate as float", "due as float", "due: $amount * $rate")),
    ("label", contract("label", "text as string", "out as string", 'out: shouted + "!"', lets="let shouted be $text through trim({}) through upper({})")),
    (
        "customers",
        "contract customers\n source \"customers\"\n config type: \"table\", path: \"customers\" end\n keyed-by c-custkey as integer\n returns record c-name as string, c-acctbal as float, c-nationkey as integer end\nend",
    ),
    (
        "nations",
        "contract nations\n source \"nations\"\n config type: \"table\", path: \"nations\" end\n keyed-by n-nationkey as integer\n returns record n-name as string end\nend",
    ),
)


def _row_query(name: str) -> Query:
    table, keep, text, _ = ROW[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return program(text, LIBRARY).transform(read(spark, sf_dir, table), keep=keep, now=NOW, snake=True)

    return run


# ---------------------------------------------------------------- row level over nested lists

ORDER_LISTS = contract(
    "order-lists",
    "lines as list of record no as integer, qty as float, part as integer end",
    "n as integer, big as integer, total as float, product as integer, dearest as maybe integer, parts as list of integer, flags as list of string, back as list of integer, middle as list of integer, distinct as integer, shape as string, pairs as integer, both as list of integer, run as list of integer, joined as string",
    """n: length({ list: $lines }), big: length({ list: big }), total: fold({ list: map big as b do b.qty end, initial: 0.0, fn: "add" }), product: fold({ list: nos, initial: 1, fn: "multiply" }),
    dearest: match sort-by({ list: $lines, field: "qty" }) when [f, ..] then f.no end,
    parts: sort({ list: parts }), flags: map $lines as l do (if l.qty > 25.0 then "big" else "small" end) end, back: reverse({ list: nos }), middle: slice({ list: nos, start: 1, end: 3 }),
    distinct: length({ list: unique({ list: map nos as x do x mod 3 end }) }), shape: match nos when [] then "none" when [x] then "one" when [x, y] then "two" when [first, ..rest] then "many" end,
    pairs: length({ list: zip({ a: nos, b: middle-nos }) }), both: flatten({ list: [nos, [0]] }), run: range({ start: 1, end: length({ list: $lines }) }), joined: join({ list: map nos as x do to-string({ value: x }) end, delimiter: "-" })""",
    lets="""let big be filter $lines where l l.qty > 25.0 end
    let nos be map $lines as l do l.no end
    let parts be map $lines as l do l.part end
    let middle-nos be slice({ list: nos, start: 0, end: 2 })""",
)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("bigint").alias("no"), F.col("l_quantity").alias("qty"), F.col("l_partkey").alias("part")).alias("l"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("lines"))


def list_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program(ORDER_LISTS).transform(order_lines(spark, sf_dir), keep=["l_orderkey"], snake=True).select(
        "l_orderkey", "n", "big", F.round("total", 2).alias("total"), "product", "dearest", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("parts", "flags", "back", "middle", "both", "run")], "distinct", "shape", "pairs", "joined"
    )


LIST_SQL = """
WITH o AS (SELECT l_orderkey, list({'no': l_linenumber::BIGINT, 'qty': l_quantity, 'part': l_partkey} ORDER BY l_linenumber, l_quantity, l_partkey) AS lines FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, lines, list_transform(lines, lambda l: l.no) AS nos, list_filter(lines, lambda l: l.qty > 25) AS big FROM o)
SELECT l_orderkey, len(lines)::BIGINT AS n, len(big)::BIGINT AS big, round(coalesce(list_sum(list_transform(big, lambda b: b.qty)), 0)::DOUBLE, 2) AS total, list_product(nos)::BIGINT AS product,
  (SELECT arg_min(u.l.no, struct_pack(q := u.l.qty, i := u.i)) FROM (SELECT unnest(lines) AS l, generate_subscripts(lines, 1) AS i) u) AS dearest,
  array_to_string(list_sort(list_transform(lines, lambda l: l.part)), ',') AS parts, array_to_string(list_transform(lines, lambda l: CASE WHEN l.qty > 25 THEN 'big' ELSE 'small' END), ',') AS flags,
  array_to_string(list_reverse(nos), ',') AS back, array_to_string(nos[2:3], ',') AS middle, array_to_string(list_concat(nos, [0]), ',') AS "both", array_to_string(generate_series(1, len(lines)), ',') AS run,
  len(list_distinct(list_transform(nos, lambda x: x % 3)))::BIGINT AS "distinct", CASE len(nos) WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS shape, least(len(nos), 2)::BIGINT AS pairs,
  array_to_string(nos, '-') AS joined
FROM p
"""

# ---------------------------------------------------------------- maybe, lookups, rules

MAYBE = contract(
    "maybe-labels", "quality as maybe integer, toxic as maybe integer", "grade as integer, missing as boolean, label as string, both as boolean",
    'grade: $quality or else -1, missing: $quality is nothing, label: match $toxic when nothing then "unknown" when 1 then "toxic" when _ then "clean" end, both: $quality = $toxic',
)
LOOKUP = contract(
    "lookup-customer", "o-custkey as integer, o-totalprice as float", "name as maybe string, nation as maybe string, covered as boolean, approved as boolean",
    "name: c.c-name, nation: n.n-name, covered: match c when nothing then false when k then k.c-acctbal >= $o-totalprice end, approved: (c.c-acctbal or else 0.0) > 0.0",
    head="sources customers, nations",
    lets="let c be lookup customers where c-custkey = $o-custkey end\nlet n be lookup nations where n-nationkey = c.c-nationkey end",
)
LOOKUP_LIST = contract(
    "lookup-lines", "keys as list of integer", "names as list of string, known as integer",
    'names: map $keys as k do (lookup nations where n-nationkey = k end).n-name or else "?" end, known: length({ list: filter $keys where j (lookup nations where n-nationkey = j end) is record end })',
    head="sources nations",
)
RULES = contract(
    "checked-line", "l-quantity as float, l-discount as float, l-returnflag as string", "total as float, flag as string",
    "total: $l-quantity * (1.0 - $l-discount), flag: $l-returnflag",
    rules="""rules
      require input.l-quantity input.l-quantity > 5.0 else reject "few" end
      require output.total output.total < 45.0 and input.l-discount <= 0.09 else reject "much" end
      match output.flag when "N" then true when "A" then true when "R" and input.l-quantity > 30.0 then true else reject "returned" end
    end""",
)
RULE_SQL = """SELECT l_orderkey, l_linenumber, l_quantity * (1.0::DOUBLE - l_discount) AS total, l_returnflag AS flag,
  array_to_string(list_filter([CASE WHEN NOT l_quantity > 5 THEN 'few' END, CASE WHEN NOT (l_quantity * (1.0::DOUBLE - l_discount) < 45 AND l_discount <= 0.09) THEN 'much' END,
  CASE WHEN NOT (l_returnflag IN ('N', 'A') OR (l_returnflag = 'R' AND l_quantity > 30)) THEN 'returned' END], lambda x: x IS NOT NULL), ';') AS reject FROM lineitem"""


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    found = Catalog(spark).register("customers", read(spark, sf_dir, "customer"), "c_custkey")
    return found.register("nations", read(spark, sf_dir, "nation"), "n_nationkey")


def maybe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return program(MAYBE).transform(docs, keep=["doc_id"], snake=True)


def lookup_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program(LOOKUP, LIBRARY).transform(read(spark, sf_dir, "orders"), keep=["o_orderkey"], catalog=catalog(spark, sf_dir), snake=True)


def lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    shifted = orders.withColumn("o_custkey", F.col("o_custkey") + 700)
    return program(LOOKUP, LIBRARY).transform(shifted, keep=["o_orderkey"], catalog=catalog(spark, sf_dir), snake=True)


def lookup_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("bigint"), (F.col("c_nationkey") + 10).cast("bigint")).alias("keys"))
    out = program(LOOKUP_LIST, LIBRARY).transform(rows, keep=["c_custkey"], catalog=catalog(spark, sf_dir), snake=True)
    return out.select("c_custkey", F.array_join("names", ",").alias("names"), "known")


def rules_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = program(RULES).transform(read(spark, sf_dir, "lineitem"), mode="quarantine", keep=["l_orderkey", "l_linenumber"], snake=True)
    return out.withColumn("reject", F.array_join("_reject", ";")).drop("_reject")


def rules_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program(RULES).transform(read(spark, sf_dir, "lineitem"), mode="drop", keep=["l_orderkey", "l_linenumber"], snake=True)


LOOKUP_SQL = """SELECT o_orderkey, c_name AS name, n_name AS nation, coalesce(c_acctbal >= o_totalprice, false) AS covered, coalesce(c_acctbal, 0) > 0 AS approved
  FROM (SELECT *, o_custkey + {0} AS k FROM orders) o LEFT JOIN customer ON c_custkey = k LEFT JOIN nation ON n_nationkey = c_nationkey"""

# ---------------------------------------------------------------- whole tables as lists

LINES = "lines as list of record l-orderkey as integer, l-linenumber as integer, l-quantity as float, l-extendedprice as float, l-discount as float, l-returnflag as string, l-shipmode as maybe string end"
PEOPLE = "people as list of record c-custkey as integer, c-name as string, c-acctbal as float, c-mktsegment as string, c-nationkey as integer end"

LIFT_ARITH = contract(
    "lift-arith", LINES, "n as integer, revenue as float, mean as float, kept as integer, biggest as float",
    """n: length({ list: $lines }), revenue: fold({ list: map $lines as l do l.l-extendedprice * (1.0 - l.l-discount) end, initial: 0.0, fn: "add" }),
    mean: fold({ list: map kept as k do k.l-quantity end, initial: 0.0, fn: "add" }) / to-float({ value: length({ list: kept }) }), kept: length({ list: kept }),
    biggest: match reverse({ list: sort({ list: map $lines as m do m.l-extendedprice end }) }) when [top, ..] then top else 0.0 end""",
    lets="let kept be filter $lines where l l.l-discount > 0.05 end",
)
LIFT_STRINGS = contract(
    "lift-strings", PEOPLE, "names as string, shouted as integer, segments as integer",
    """names: join({ list: map (filter $people where p p.c-nationkey = 3 end) as q do q.c-name through trim({}) end, delimiter: "; " }),
    shouted: length({ list: filter (map $people as r do r.c-mktsegment through lower({}) end) where s starts-with({ value: s, prefix: "b" }) end }),
    segments: length({ list: unique({ list: map $people as t do t.c-mktsegment end }) })""",
)
#: For generated records: its result doesn't grow with the list.
SHAPE_STRINGS = contract(
    "shape-strings", PEOPLE, "shouted as integer, segments as integer, letters as integer",
    """shouted: length({ list: filter (map $people as r do r.c-mktsegment through lower({}) end) where s starts-with({ value: s, prefix: "b" }) end }),
    segments: length({ list: unique({ list: map $people as t do t.c-mktsegment through upper({}) end }) }),
    letters: fold({ list: map $people as u do length({ value: u.c-name through trim({}) through replace({ find: "Customer", replacement: "C" }) }) end, initial: 0, fn: "add" })""",
)
LIFT_LISTS = contract(
    "lift-lists", PEOPLE, "nations as integer, sorted as integer, lowest as string, page as list of string",
    """nations: length({ list: unique({ list: map $people as p do p.c-nationkey end }) }), sorted: length({ list: sort-by({ list: $people, field: "c-acctbal" }) }),
    lowest: match sort-by({ list: $people, field: "c-acctbal" }) when [first, ..rest] then first.c-name when [] then "none" end,
    page: map (slice({ list: sort-by({ list: $people, field: "c-acctbal" }), start: 2, end: 5 })) as q do q.c-name end""",
)
LIFT_MIXED = contract(
    "lift-mixed", LINES, "active as integer, total as float, mean as float, flags as integer, small as integer, cheapest as integer, checksum as string",
    """active: n, total: total, mean: total / to-float({ value: n }), flags: length({ list: unique({ list: map $lines as f do f.l-returnflag end }) }), small: length({ list: filter kept where s s.l-quantity < 10.0 end }),
    cheapest: match sort-by({ list: kept, field: "l-extendedprice" }) when [first, ..rest] then first.l-orderkey when [] then -1 end, checksum: sha256({ value: to-string({ value: n }) + ":" + to-string({ value: length({ list: $lines }) }) })""",
    lets="""let kept be filter $lines where l l.l-returnflag = "N" end
    let n be length({ list: kept })
    let total be fold({ list: map kept as k do k.l-quantity end, initial: 0.0, fn: "add" })""",
)
TOP_K = contract(
    "top-k", LINES, "best as list of record l-orderkey as integer, l-linenumber as integer, l-extendedprice as float end",
    'best: map (slice({ list: reverse({ list: sort-by({ list: $lines, field: "l-extendedprice" }) }), start: 0, end: 10 })) as l do { l-orderkey: l.l-orderkey, l-linenumber: l.l-linenumber, l-extendedprice: l.l-extendedprice } end',
)
UNION = contract(
    "union-distinct", "one as list of integer, two as list of integer", "keys as list of integer", "keys: unique({ list: flatten({ list: [$one, $two] }) })",
)
PRODUCT = contract(
    "fold-product", "sizes as list of float", "product as float, n as integer", 'product: fold({ list: filter $sizes where s s < 3.0 end, initial: 2.0, fn: "multiply" }), n: length({ list: $sizes })',
)


def lifted(text: str, table: str, order: str | None = None) -> Query:
    return lambda spark, sf_dir: program(text).aggregate(read(spark, sf_dir, table), order=order, snake=True, fallback=False)


def lines_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def lift_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = program(LIFT_ARITH).aggregate(lines_table(spark, sf_dir), snake=True, fallback=False)
    return out.select("n", F.round("revenue", 2).alias("revenue"), F.round("mean", 6).alias("mean"), "kept", "biggest")


def lift_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = program(LIFT_MIXED).aggregate(lines_table(spark, sf_dir), snake=True, fallback=False)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


def lift_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = program(LIFT_LISTS).aggregate(read(spark, sf_dir, "customer"), snake=True, fallback=False)
    return out.withColumn("page", F.array_join("page", ","))


def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = read(spark, sf_dir, "customer").select("c_nationkey"), read(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 5).alias("k"))
    return program(UNION).aggregate(one, others={"two": two}, snake=True, fallback=False)


def scientific(col: Column) -> Column:
    """Text of a float as C prints it with %.6e; Java has words of its own for what isn't finite."""
    odd = F.when(F.isnan(col), "nan").when(col == float("inf"), "inf").when(col == float("-inf"), "-inf")
    return F.coalesce(odd, F.when(col.isNotNull(), F.format_string("%.6e", col)))


def fold_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = program(PRODUCT).aggregate(read(spark, sf_dir, "supplier").select((F.col("s_nationkey") / 10.0 + 1.0).alias("sizes")), snake=True, fallback=False)
    return out.select(scientific(F.col("product")).alias("product"), "n")


HMAC = contract("hmac", "c-name as string, c-mktsegment as string", "fixed as string, keyed as string", 'fixed: hmac-sha256({ value: $c-name, key: "secret" }), keyed: hmac-sha256({ value: $c-name, key: $c-mktsegment })')
#: A key up to a block long, filled up with zeros, combined byte by byte with 0x36 and 0x5c.
HMAC_SQL = """WITH pads AS (
  SELECT k, from_hex(array_to_string(list_transform(b, lambda x: printf('%02x', xor(x, 54))), '')) AS i, from_hex(array_to_string(list_transform(b, lambda x: printf('%02x', xor(x, 92))), '')) AS o
  FROM (SELECT k, list_transform(range(0, 64), lambda n: CASE WHEN n < length(k) THEN ascii(substr(k, n + 1, 1)) ELSE 0 END) AS b FROM (SELECT DISTINCT c_mktsegment AS k FROM customer UNION SELECT 'secret')))
SELECT c_custkey, sha256(f.o || from_hex(sha256(f.i || encode(c_name)))) AS fixed, sha256(p.o || from_hex(sha256(p.i || encode(c_name)))) AS keyed
FROM customer JOIN pads p ON p.k = c_mktsegment JOIN pads f ON f.k = 'secret'"""
MATCH_RECORD = contract(
    "match-record", "o-orderstatus as string, o-orderpriority as string, o-totalprice as float, o-custkey as integer", "kind as string",
    """kind: match order
      when { state: { status: "F", rank: r }, thousands: between 100 and 200 } then "closed " + r
      when { state: { status: "F" } } then "closed"
      when { state: { rank: "1-URGENT" }, buyers: [c] } then "urgent for " + to-string({ value: c })
      when { state: { status: "O" }, thousands: n } and n > 300 then "large " + to-string({ value: n })
      else "other"
    end""",
    lets="""let order be {
      state: { status: $o-orderstatus, rank: $o-orderpriority }, thousands: floor({ value: $o-totalprice / 1000.0 }),
      buyers: if $o-custkey mod 2 = 0 then [$o-custkey] else [$o-custkey, 0] end
    }""",
)
UUID = contract("uuid-gen", "c-name as string", "id as string, size as integer", "id: id, size: length({ value: id })", lets="let id be uuid({})")


def simple(text: str, table: str, keep: list[str]) -> Query:
    return lambda spark, sf_dir: program(text).transform(read(spark, sf_dir, table), keep=keep, snake=True)


OTHERS: dict[str, tuple[Query, str | None]] = {
    "list_ops": (list_ops, LIST_SQL),
    "or_else_is_nothing": (
        maybe_labels,
        """SELECT d.doc_id, coalesce(quality, -1)::BIGINT AS grade, quality IS NULL AS missing, CASE WHEN toxic IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS label,
        quality IS NOT DISTINCT FROM toxic AS "both" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "lookup_customer": (lookup_customer, LOOKUP_SQL.format(0)),
    "lookup_miss": (lookup_miss, LOOKUP_SQL.format(700)),
    "lookup_in_list": (
        lookup_in_list,
        """SELECT c_custkey, coalesce(a.n_name, '?') || ',' || coalesce(b.n_name, '?') AS names, ((a.n_name IS NOT NULL)::INT + (b.n_name IS NOT NULL)::INT)::BIGINT AS known
        FROM customer LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_nationkey + 10""",
    ),
    "rules_quarantine": (rules_quarantine, RULE_SQL),
    "rules_drop": (rules_drop, f"SELECT l_orderkey, l_linenumber, total, flag FROM ({RULE_SQL}) WHERE reject = ''"),
    "lift_arith": (
        lift_arith,
        """SELECT count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity) FILTER (l_discount > 0.05), 6) AS mean, count(*) FILTER (l_discount > 0.05) AS kept, max(l_extendedprice) AS biggest FROM lineitem""",
    ),
    "lift_strings": (
        lifted(LIFT_STRINGS, "customer", "c_custkey"),
        """SELECT string_agg(trim(c_name), '; ' ORDER BY c_custkey) FILTER (c_nationkey = 3) AS names, count(*) FILTER (starts_with(lower(c_mktsegment), 'b')) AS shouted, count(DISTINCT c_mktsegment) AS segments FROM customer""",
    ),
    "lift_lists": (
        lift_lists,
        """SELECT count(DISTINCT c_nationkey) AS nations, count(*) AS sorted, arg_min(c_name, struct_pack(b := c_acctbal, k := c_custkey)) AS lowest,
        (SELECT string_agg(c_name, ',' ORDER BY c_acctbal, c_custkey) FROM (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 3 OFFSET 2)) AS page FROM customer""",
    ),
    "lift_mixed": (
        lift_mixed,
        """SELECT count(*) FILTER (l_returnflag = 'N') AS active, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS total, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS mean, count(DISTINCT l_returnflag) AS flags,
        count(*) FILTER (l_returnflag = 'N' AND l_quantity < 10) AS small, arg_min(l_orderkey, struct_pack(p := l_extendedprice, o := l_orderkey, l := l_linenumber)) FILTER (l_returnflag = 'N') AS cheapest,
        sha256((count(*) FILTER (l_returnflag = 'N')) || ':' || count(*)) AS checksum FROM lineitem""",
    ),
    "top_k": (
        lifted(TOP_K, "lineitem"),
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC LIMIT 10",
    ),
    "union_distinct": (union_distinct, "SELECT c_nationkey::BIGINT AS keys FROM customer UNION SELECT (s_nationkey + 5)::BIGINT FROM supplier"),
    "fold_product": (fold_product, "SELECT printf('%.6e', 2.0::DOUBLE * product(s_nationkey / 10.0::DOUBLE + 1.0::DOUBLE) FILTER (s_nationkey / 10.0::DOUBLE + 1.0::DOUBLE < 3)) AS product, count(*) AS n FROM supplier"),
    "hmac": (simple(HMAC, "customer", ["c_custkey"]), HMAC_SQL),
    "match_record": (
        simple(MATCH_RECORD, "orders", ["o_orderkey"]),
        """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND floor(o_totalprice / 1000) BETWEEN 100 AND 200 THEN 'closed ' || o_orderpriority
        WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 THEN 'urgent for ' || o_custkey
        WHEN o_orderstatus = 'O' AND floor(o_totalprice / 1000) > 300 THEN 'large ' || floor(o_totalprice / 1000)::BIGINT ELSE 'other' END AS kind FROM orders""",
    ),
    "uuid_gen": (simple(UUID, "customer", ["c_custkey"]), None),
}


def queries() -> dict[str, Query]:
    return {name: _row_query(name) for name in ROW} | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, _, sql) in ROW.items()} | {name: sql for name, (_, sql) in OTHERS.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift_mixed(spark, sf_dir)
