"""Near duplicates, line dedup, WARC, JPEG, nearest neighbours, components, pipeline."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactum.llm import ann, graph, jpeg, line_dedup, near_dup, warc
from pactum.llm.common import Scratch, token_hashes
from pactum.llm.graph import connected_components


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


# ---------------------------------------------------------------- components


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 10), (20, 20)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    want = {n: 1 for n in range(1, 6)} | {10: 10, 11: 10} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 241)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# ---------------------------------------------------------------- near duplicates


def slow_components(texts, percent):
    sets = {}
    for i, t in texts:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in (t or "")).split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts, n = [], 0
    for size in (3, 5, 8, 12, 40, 150, 400):
        for _ in range(3):
            words = text_of(rng, size).split()
            for _ in range(6):
                copy = list(words)
                for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, size // 80)])):
                    copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
                texts.append((n, " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
                n += 1
    texts += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one two three")]
    df = spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.link_documents(df, 85).collect()}
    assert got == slow_components(texts, 85)
    kept = near_dup.keep_one(df, 80)
    want = slow_components(texts, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i][1] == i} and kept.columns == df.columns
    assert near_dup.link_documents(df.limit(0)).count() == 0


def test_twins_over_a_template_are_all_linked(spark):
    """400 shingles in common: twins are 0.86 alike, all others 0.83, so that band keys are full of pairs that fail."""
    core = " ".join(f"core{i}" for i in range(404))
    texts = []
    for pair in range(60):
        for side in (0, 1):
            own = " ".join(f"own{pair}x{side}x{i}" for i in range(33))
            texts.append((2 * pair + side, f"{core} " + " ".join(f"pair{pair}x{i}" for i in range(9)) + f" {own}"))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.link_documents(df, 85).collect()}
    assert got == slow_components(texts, 85) and {c for _, c in got.values()} == set(range(0, 120, 2))


def test_pairs_of_groups(spark):
    """All pairs of different components, whichever component is the largest; sizes, shared groups and places count."""
    from pactum.llm.graph import pairs_in_groups, pivot_pairs, split_groups

    scratch = Scratch(spark, "test")
    rng = random.Random(4)
    rows = sorted({(rng.randrange(6), i, 100 + i % 30) for i in range(40) for _ in range(3)})
    root = {i: i - i % 4 if i < 20 else i for i in range(40)}
    df = spark.createDataFrame(rows, "key long, id long, size long")
    components = spark.createDataFrame([(i, r) for i, r in root.items() if i < 20], "node long, root long")
    for percent, shared in ((50, 1), (90, 1), (50, 2)):
        want = {}
        for (k, a, x), (m, b, y) in itertools.combinations(rows, 2):
            if k == m and root[a] != root[b] and 100 * min(x, y) >= percent * max(x, y):
                want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + 1
        got = {tuple(r) for r in pairs_in_groups(df, components, percent, scratch, shared).collect()}
        assert got == {p for p, c in want.items() if c >= shared}
    star = {tuple(r) for r in pivot_pairs(df, 50).collect()}
    assert all(a < b for a, b in star) and len(star) < len(rows)
    small, large = split_groups(df, components, 15, scratch)
    sizes = {k: sum(r[0] == k for r in rows) for k in range(6)}
    assert {r.key for r in small.collect()} == {k for k in sizes if sizes[k] <= 15} and {r.key for r in large.collect()} == {k for k in sizes if sizes[k] > 15}


def test_components_are_joined_by_further_links(spark):
    from pactum.llm.graph import join_components

    scratch, rng = Scratch(spark, "test"), random.Random(3)
    every, components = [], None
    for _ in range(3):
        links = [tuple(sorted(rng.sample(range(120), 2))) for _ in range(25)]
        every += links
        components = join_components(components, scratch.write(spark.createDataFrame(links, "a long, b long")), scratch)
    assert join_components(components, scratch.write(components.selectExpr("node a", "root b").limit(0)), scratch) is components
    root = {n: n for link in every for n in link}
    for _ in root:
        for a, b in every:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in components.collect()} == root


def test_registers_and_estimate():
    rng = np.random.RandomState(0)
    pool = rng.randint(0, 2**63, 40000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    for share in (0.2, 0.5, 0.85):
        found = []
        for k in range(20):
            part = rng.permutation(pool)[:6000]
            n = int(6000 * share)
            a, b = part[: n + (6000 - n) // 2], np.concatenate((part[:n], part[n + (6000 - n) // 2 :]))
            found.append(near_dup.estimate(near_dup.registers(np.unique(a)), near_dup.registers(np.unique(b))))
        assert np.mean(found) == pytest.approx(share, abs=0.04)
    s = np.array([1 << 50, (1 << 63) + 5], dtype=np.uint64)
    reg = near_dup.registers(s)
    assert reg[64] >> near_dup.MANTISSA == 57 - 3 and set(reg.tolist()) == {reg[0], reg[64]}


def test_short_texts_are_one_shingle():
    a, b = (near_dup.shingle_set(token_hashes(t)[0]) for t in (b"a b c d", b"a b c d e"))
    assert len(a) == 1 and len(b) == 1 and a[0] != b[0]


# ---------------------------------------------------------------- lines


def test_line_dedup(spark):
    rng = random.Random(1)
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "word6x")
    other = text_of(rng, 60)
    docs = [
        (1, f"{base}\n{other}\nshort line\n"),
        (2, f"{near}\nshort line\n{base.upper()}!"),
        (3, other),
        (4, None),
        (5, ""),
        (6, "x " * 30_000),
        (7, text_of(rng, 50) + "\n" + text_of(rng, 50)),
        (None, base),
    ]
    df = spark.createDataFrame([(*d, "c", 1, 2) for d in docs], "doc_id long, text string, source string, n_dropped int, gone int")
    out = line_dedup.dedup_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == docs[0][1] and got[1].n_dropped == 0
    assert got[2].text == "" and got[2].n_dropped == 3 and got[2].n_lines == 3
    assert got[3].text == "" and got[3].n_dropped == 1
    assert got[4].text is None and got[4].n_lines == 0 and got[5].text == "" and got[6].text == docs[5][1] and got[7].text == docs[6][1]
    assert got[None].text == base and got[1].source == "c"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_blocks_follow_their_definition(spark):
    """Majorities of three hashes that follow each other, begun where the low bits of the first are zero."""
    text = " ".join(f"w{i}" for i in range(50))  # 49 features: one in four begins a block
    words = text.split()
    pairs = spark.createDataFrame(list(zip(words, words[1:])), "a string, b string").select(F.xxhash64("a", "b")).collect()
    h = sorted(r[0] for r in pairs)
    want = set()
    for i, x in enumerate(h):
        if x % 4 == 0:
            y, z = h[(i + 1) % len(h)], h[(i + 2) % len(h)]
            want.add(x & y | y & z | x & z)
    got = line_dedup.block_keys(spark.createDataFrame([(1, text)], "h long, norm string")).collect()
    assert {r.key for r in got} == want and {(r.id, r.size) for r in got} == {(1, len(text))}
    whole = {r.key for r in line_dedup.block_keys(spark.createDataFrame([(1, text)], "h long, norm string"), all_hashes=True).collect()}
    assert want < whole and len(whole) == len(h)


def test_edit_similarity(spark):
    pairs = [("abcdefghij", "abcdefghij"), ("abcdefghij", "abcdefghxx"), ("abcdefghij", "abcdefgxxx"), ("a" * 5000, "a" * 5000), ("ab" * 2500, "ba" * 2500), ("a" * 100, "a" * 50)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(line_dedup.similar("a", "b", 0.8)).collect()]
    assert got == [True, True, False, True, True, False]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_recall_of_fuzzy_lines(spark):
    """Copies with a changed letter, a changed word or every tenth word changed, by brute force 0.8 or more alike."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    pairs = []
    for n in (5, 8, 12, 20, 30, 45, 60):
        for k in range(24):
            words = [rng.choice(vocabulary) for _ in range(n)]
            copy = list(words)
            if k % 3:
                for i in rng.sample(range(n), 1 if k % 3 == 1 else max(1, n // 10)):
                    copy[i] = rng.choice(vocabulary)
            else:
                i = rng.randrange(n)
                copy[i] = copy[i][:1] + "q" + copy[i][2:]
            a, b = " ".join(words), " ".join(copy)
            if a != b and edits(a, b) <= 0.2 * max(len(a), len(b)):
                pairs.append((n, a, b))
    rows = [(2 * i + side, t) for i, (_, *both) in enumerate(pairs) for side, t in enumerate(both)]
    out = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(out[2 * i] for i in range(len(pairs)))
    found = [out[2 * i + 1] for i in range(len(pairs))]
    assert len(pairs) > 140 and sum(found) >= 0.95 * len(pairs)


def test_lines_of_few_words(spark):
    """Equal lines of few words go; fuzzy copies where the characters are many enough, whatever the script."""
    script = "".join(chr(0x4E00 + 37 * i) for i in range(40))
    lines = ["Copyright Somebody", script + "。", "Antidisestablishmentarianism, uncharacteristically"]
    near = ["Copyright Samebody", script[:20] + "一" + script[21:], "Antidisestablishmentarianism uncharakteristically"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(near))], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ("\n".join(lines), 0), 2: ("", 3), 3: (near[0], 2)}


def test_long_lines_with_a_part_put_in(spark):
    rng = random.Random(9)
    line = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(715))
    put = line[:100] + " zzzzzz" * 40 + line[100:]
    df = spark.createDataFrame([(1, line), (2, put)], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()] == [0, 1]


def test_lines_against_brute_force(spark):
    """Every pair of lines by edit distance over a real table: what stays, and the share of linked lines that are found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect() if r.text)
    norm = [(d, k, " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())) for d, t in texts for k, line in enumerate(t.split("\n"))]
    first, fuzzy = {}, []
    for d, k, line in norm:
        if line and line not in first:
            first[line] = (d, k)
            fuzzy += [line] if 20 <= len(line) <= 400 else []
    root = {line: line for line in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lines = pd.DataFrame({"t": fuzzy, "n": [len(x) for x in fuzzy]})
    # Edit distance is at least half the sum of what the letters' counts differ by.
    for c in "aeinrsthdol":
        lines[f"c{c}"] = [x.count(c) for x in fuzzy]
    apart = " + ".join(f"abs(x.c{c} - y.c{c})" for c in "aeinrsthdol")
    sql = f"SELECT x.t, y.t FROM lines x JOIN lines y ON x.t < y.t AND abs(x.n - y.n) <= 0.2 * greatest(x.n, y.n) AND {apart} <= 0.4 * greatest(x.n, y.n) WHERE levenshtein(x.t, y.t) <= 0.2 * greatest(x.n, y.n)"
    for a, b in duckdb.sql(sql).fetchall():
        x, y = sorted((find(a), find(b)), key=lambda line: first[line])
        root[y] = x
    gone = collections.Counter(d for d, k, line in norm if line and len(line) <= 400 and first[find(line)] != (d, k))
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect() if r.n_dropped}
    assert sum(gone.values()) > 100 and sum(got.values()) >= 0.95 * sum(gone.values())
    long = {d for d, _, line in norm if len(line) > 400}
    assert all(got[d] <= gone[d] for d in got if d not in long)


def test_pairs_of_lines_are_tested_once(spark, monkeypatch):
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(hashlib.sha1(f"{i} {k}".encode()).hexdigest() for k in range(20))) for i in range(6)]
    seen, verify = [], line_dedup._verify

    def counted(texts, pairs, least):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return verify(texts, pairs, least)

    monkeypatch.setattr(line_dedup, "_verify", counted)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen and len(seen) == len(set(seen)) and all(r.n_dropped == 0 for r in got)


def test_large_groups_of_lines_are_tested_whole(spark, monkeypatch):
    """All lines in one group: every pair that is similar enough is linked, whatever else two lines have in common."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    lines = []
    for _ in range(25):
        words = [word() for _ in range(24)]
        lines += [" ".join(words), " ".join(w[:3] + "é" + w[4:] if i % 2 else w for i, w in enumerate(words))]
    root = {x: min(x, y) for x, y in zip(lines[::2], lines[1::2])} | {y: min(x, y) for x, y in zip(lines[::2], lines[1::2])}
    monkeypatch.setattr(line_dedup, "block_keys", lambda df, all_hashes=False: df.select(F.lit(1).cast("long").alias("key"), F.col("h").alias("id"), F.length("norm").alias("size")))
    occ = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "h long, norm string")
    found = {r.node: r.root for r in line_dedup.link_lines(occ, Scratch(spark, "test")).collect()}
    assert all(found.get(2 * i, -1) == found.get(2 * i + 1, -2) for i in range(25))
    assert len(set(found.values())) == len(set(root.values())) == 25


def test_lines_that_share_any_block_are_tested(spark):
    """Long lines with many changed words: one equal block of all is enough, wherever it begins."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    lines = []
    for n in (36, 70, 110) * 30:
        words = [word() for _ in range(n)]
        copy = list(words)
        for i in rng.sample(range(n), round(0.17 * n)):
            copy[i] = word()
        lines += [" ".join(words), " ".join(copy)]
    keys = collections.defaultdict(set)
    for r in line_dedup.block_keys(spark.createDataFrame(list(enumerate(lines)), "h long, norm string"), all_hashes=True).collect():
        keys[r.id].add(r.key)
    want = {2 * i + 1 for i in range(len(lines) // 2) if keys[2 * i] & keys[2 * i + 1] and edits(*lines[2 * i : 2 * i + 2]) <= 0.2 * max(map(len, lines[2 * i : 2 * i + 2]))}
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert len(want) > 60 and {r.doc_id for r in out if r.n_dropped} == want


def test_blocks_of_the_same_lines_are_one_group(spark, monkeypatch):
    """A passage makes one group of its lines, not one for each of its blocks; every pair that shares a block stays in some group."""
    passages = [" ".join(hashlib.sha1(f"{p} {k}".encode()).hexdigest()[:7] for k in range(50)) for p in range(3)]
    own = lambda i: " ".join(hashlib.sha1(f"own {i} {k}".encode()).hexdigest()[:8] for k in range(20))
    lines = [f"{passages[i % 3]} {own(i)}" + (f" {passages[1]}" if i % 5 == 0 else "") for i in range(30)]
    seen, pivots = [], line_dedup.pivot_pairs

    def counted(rows, percent):
        seen.extend((r.key, r.id) for r in rows.collect())
        return pivots(rows, percent)

    monkeypatch.setattr(line_dedup, "pivot_pairs", counted)
    df = spark.createDataFrame(list(enumerate(lines)), "h long, norm string")
    line_dedup.link_lines(df, Scratch(spark, "test"))
    blocks, groups = collections.defaultdict(set), collections.defaultdict(list)
    for r in line_dedup.block_keys(df, all_hashes=True).collect():
        blocks[r.key].add(r.id)
    for key, i in seen:
        groups[key].append(i)
    want = {frozenset(x) for x in blocks.values() if len(x) > 1}
    assert 3 <= len(want) < sum(len(x) > 1 for x in blocks.values())
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_texts_of_lines_are_let_go_before_their_blocks_are_written(spark, monkeypatch):
    held, blocks, write = {}, [], Scratch.write

    def written(self, df, *options):
        out = write(self, df, *options)
        held[out._pactum_path] = set(df.columns)
        if {"key", "id"} <= set(df.columns):
            blocks.append(sum({"pos", "norm"} <= held[p] for p in self.held))
        return out

    monkeypatch.setattr(Scratch, "write", written)
    rows = [(i, "\n".join(f"line {i % 7} of {k} with a few words that are its own {k * k}" for k in range(5))) for i in range(20)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 20 and blocks and not any(blocks)


def test_pairs_of_lines_are_tested_in_parts(spark, monkeypatch):
    """Texts of few pairs lie on the disk at once, and the distinct lines are gone by then; the result is the same."""
    rows = [(i, "\n".join(f"line {i % 11} of {k} with a few words that are its own {k * k}" for k in range(4))) for i in range(22)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    sizes, whole, held, verify, write = [], [], {}, line_dedup._verify, Scratch.write

    def written(self, df, *options):
        out = write(self, df, *options)
        held[out._pactum_path] = self, df.columns == ["h", "norm"]
        return out

    def counted(texts, pairs, least):
        sizes.append(pairs.count())
        whole.append(sum(path in self.held for path, (self, lines) in held.items() if lines))
        return verify(texts, pairs, least)

    monkeypatch.setattr(Scratch, "write", written)
    monkeypatch.setattr(line_dedup, "_verify", counted)
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 10)
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == want and any(text != rows[i][1] for i, text in got)
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2 and set(whole) == {1}


def test_texts_are_normalised_and_blocks_made_once(spark):
    """Neither plan tests a list for rows before it is dealt out, which would make the list twice."""
    docs = spark.createDataFrame([(1, "Some line, of words\nand (another) one\n\n")], "doc_id long, text string")
    lines = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12))), (2, "one two"), (3, "solitary")], "h long, norm string")
    for df, costly, most in ((line_dedup.occurrences(docs), "regexp_replace(", 1), (line_dedup.block_keys(lines, all_hashes=True), "array_distinct(", 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(costly) == most
    assert [(r.pos, r.size) for r in line_dedup.occurrences(docs).orderBy("pos").collect()] == [(0, 18), (1, 15)]
    got = collections.Counter(r.id for r in line_dedup.block_keys(lines, all_hashes=True).collect())
    assert got == {1: 11 + 31, 2: 1, 3: 2}


def test_a_pair_in_several_groups_is_made_once(spark):
    """Without the lists of groups the join makes a row for each group that a pair shares; the pairs are the same for lines of too many groups."""
    rows = [(key, i, 100) for key in range(8) for i in range(10) if key == 0 or (i + key) % 3] + [(100 + key, i, 100) for key in range(80) for i in (0, 1)]
    df = spark.createDataFrame(rows, "key long, id long, size int")
    pairs = graph.pairs_in_groups(df, None, 80, Scratch(spark, "test"))
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(a, b) for a in range(10) for b in range(a + 1, 10)]
    few = graph.pairs_in_groups(df.where("id > 1"), None, 80, Scratch(spark, "test"))
    few.collect()
    plan, made = [few._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().endswith("Join") and "before_a" in node.toString().split("\n")[0]:
            made.append(node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    assert made == [28]


def test_small_tables_are_dealt_out_at_once(spark, monkeypatch):
    """Each part is a plan in the driver: few blocks and lines are dealt out together, many in parts, with the same result."""
    rows = [(i, "\n".join(f"line {i % 11} of {k} with a few words that are its own {k * k}" for k in range(4))) for i in range(22)]
    df, write, made = spark.createDataFrame(rows, "doc_id long, text string"), Scratch.write, []

    def written(self, df, *options):
        made.append(df.columns)
        return write(self, df, *options)

    monkeypatch.setattr(Scratch, "write", written)
    want = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert made.count(["key", "id", "size"]) == 2 and made.count(["h", "norm"]) == 2 and any(text != rows[i][1] for i, text in want)
    made.clear()
    monkeypatch.setattr(line_dedup, "BLOCKS_AT_ONCE", 30)
    monkeypatch.setattr(line_dedup, "LINES_AT_ONCE", 10)
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()) == want
    assert made.count(["key", "id", "size"]) == line_dedup.PARTS + 1 and made.count(["h", "norm"]) == line_dedup.LINE_PARTS + 1


def test_lines_of_one_word_that_repeats(spark):
    """The bound from above settles long lines of repeated words, with words put in: pieces keep to their place."""
    words = ["escoas"] * 900
    for at in (40, 333, 612):
        words[at] = "xylem"
    a, b = " ".join(["escoas"] * 930), " ".join(words)
    c = " ".join(["escoas", "xylems"] * 450)
    df = spark.createDataFrame([(a, b), (b, a), (a, c)], "a string, b string")
    assert [r[0] for r in df.select(line_dedup.similar("a", "b", 0.8)).collect()] == [True, True, False]


def test_rows_that_share_an_id(spark):
    rows = [(1, "one line here\nanother line"), (1, "one line here\nanother line"), (1, "third line of text\none line here"), (2, "another line")] + [(None, "one line here")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert sum(d == 0 and t == "one line here" for d, t, _ in got) == 2
    # The texts of document 1 are two documents; the equal rows are one.
    lines = [t.split("\n") if t else [] for d, t, _ in got if d]
    assert sum("third line of text" in x for x in lines) == 1 and {len(x) for x in lines} <= {0, 1, 2}
    assert [r for r in got if r[0] == 2][0][1] == ""


def test_plans_hold_no_python(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert "Python" not in line_dedup.dedup_lines(df)._jdf.queryExecution().toString()


# ---------------------------------------------------------------- WARC


def test_records_round_trip():
    one = warc.write_record("response", 1, "http://a/", "2024-01-01T00:00:00Z", "200 OK", [("ETag", '"x"'), ("Set-Cookie", "a"), ("Set-Cookie", "b")], b"body\r\n\r\nmore")
    two = warc.write_record("revisit", 2, "http://a/", "2024-01-02T00:00:00Z", "304 Not Modified", [("ETag", 'W/"x"')], b"")
    a, b = warc.parse_records(one + two)
    assert a["payload"] == b"body\r\n\r\nmore" and a["headers"]["set-cookie"] == "a, b" and a["status"] == "200"
    assert b["kind"] == "revisit" and b["payload"] == b"" and b["record_id"] == "urn:record:2"
    assert list(warc.parse_records(b"")) == []
    for bad in (b"junk\r\n\r\n", one[:-30], b"WARC/1.1\r\nno colon\r\n\r\n"):
        (got,) = warc.parse_records(bad)
        assert got["kind"] == warc.MALFORMED and got["payload"] == bad
    after = list(warc.parse_records(one + b"junk\r\n\r\n" + b"WARC/1.1\r\nno colon\r\n\r\n" + two))
    assert [r["kind"] for r in after] == ["response", warc.MALFORMED, warc.MALFORMED, "revisit"]


def test_canonical_urls(spark):
    cases = {
        "HTTP://user@WWW.Example.COM:80/a/b/?b=2&utm_source=x&a=1#frag": "example.com/a/b?a=1&b=2", "https://example.com": "example.com", "//x.org/p?": "x.org/p", "no url": None, None: None,
        "https://example.com:8443/A": "example.com:8443/A",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == cases


def test_revisits_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_BLOCK", 4)
    rng = random.Random(6)
    rows = []
    for i in range(200):
        url = "http://hot/" if rng.random() < 0.4 else f"http://h{rng.randrange(9)}/"
        kind, status = rng.choice([("response", "200"), ("response", "404"), ("revisit", "304")])
        rows.append((i, url if i % 50 else None, rng.randrange(60), kind, status, {"etag": rng.choice(['"a"', 'W/"a"', '"b"']), "date": str(i), "content-length": str(i)}))
    rows.append((500, "http://hot/", None, "revisit", "304", {"etag": '"a"'}))
    df = spark.createDataFrame(rows, "record_id long, url string, s long, kind string, status string, headers map<string,string>")
    got = {r.record_id: r for r in warc.resolve(df.withColumn("ts", F.timestamp_seconds("s"))).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for i, url, t, kind, _, headers in rows:
        if kind != "revisit":
            continue
        earlier = [(r[2], r[0], r[5]) for r in rows if r[3] == "response" and r[4] == "200" and r[1] == url and url and t is not None and r[2] < t]
        if not earlier:
            assert (got[i].status, got[i].resolved_id, got[i].headers) == ("orphan", None, None)
            continue
        best = max(earlier, key=lambda e: e[:2])
        same = best[2]["etag"].removeprefix("W/") == headers["etag"].removeprefix("W/")
        assert (got[i].resolved_id, got[i].status) == (best[1], "resolved" if same else "mismatch")
        if same:
            assert got[i].headers == {"etag": headers["etag"], "date": headers["date"], "content-length": best[2]["content-length"]}


def test_pages_archive_edges(spark):
    df = spark.createDataFrame([(1, "http://a/x", "one", 1), (2, "http://A/x/", "two", 1), (3, None, None, 1), (None, "http://a/x", "z", 1)], "page_id long, url string, html string, kind int")
    got = {r.page_id: r for r in warc.resolve_pages(df).collect()}
    assert (got[2].status, got[2].resolved_page) == ("resolved", 2) and (got[1].status, got[1].resolved_page) == ("mismatch", 2) and got[3].status == "orphan"
    assert got[2].content_length == "3" and got[2].cache_control == "max-age=600" and got[2].n_headers == 5
    assert warc.resolve_pages(df.limit(0)).count() == 0


# ---------------------------------------------------------------- JPEG


def test_texts_round_trip(spark):
    texts = ["", None, "short", "é" * 500, "x" * 192, "y" * 193, "z" * 40_000, "short", "".join(map(chr, range(32, 3000)))]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in jpeg.read_features(jpeg.store_texts(df)).collect()}
    stored = {r.doc_id: bytes(r.media) for r in jpeg.store_texts(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert got[2].feature == got[7].feature and got[0].media_sha256 == got[1].media_sha256
    assert jpeg.read_features(jpeg.store_texts(df.limit(0))).count() == 0


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def bytes(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, b[i : i + 8])), 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


def colour_image(w, h, sampling, rng, restart=0):
    """A baseline JPEG with AC coefficients, and the DC values of its first component."""
    import struct

    dc = jpeg.canonical([(4, s) for s in range(12)])
    symbols = [0x00, 0xF0, 0x01, 0x12, 0x23, 0x35]
    ac = jpeg.canonical([(3, s) for s in symbols])
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-w // (8 * hm)), -(-h // (8 * vm))
    luma = np.zeros((down * sampling[0][1], across * sampling[0][0]), dtype=int)
    parts, out, pred = [], Bits(), [0] * len(sampling)
    for m in range(across * down):
        if restart and m and m % restart == 0:
            parts.append(out.bytes() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8]))
            out, pred = Bits(), [0] * len(sampling)
        for c, (hs, vs) in enumerate(sampling):
            for b in range(hs * vs):
                value = int(rng.randint(-100, 100))
                if c == 0:
                    luma[m // across * vs + b // hs, m % across * hs + b % hs] = value
                diff, pred[c] = value - pred[c], value
                size = abs(diff).bit_length()
                out.put(*dc[size])
                if size:
                    out.put(diff if diff > 0 else diff + (1 << size) - 1, size)
                k = 1
                while k < 64 and rng.rand() < 0.7:
                    s = symbols[rng.randint(1, len(symbols))]
                    k += 16 if s == 0xF0 else (s >> 4) + 1
                    if k > 63:
                        break
                    out.put(*ac[s])
                    if s & 15:
                        out.put(int(rng.randint(0, 1 << (s & 15))), s & 15)
                out.put(*ac[0])
    parts.append(out.bytes())

    def dht(kind, table):
        sizes = [sum(1 for _, n in table.values() if n == k) for k in range(1, 17)]
        body = bytes([kind, *sizes, *sorted(table, key=lambda s: table[s][0])])
        return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body

    n = len(sampling)
    head = b"\xff\xd8\xff\xdb" + struct.pack(">H", 67) + b"\x00" + bytes([16] * 64) + b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, h, w, n)
    head += b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling)) + dht(0, dc) + dht(16, ac)
    head += b"\xff\xdd" + struct.pack(">HH", 4, restart) if restart else b""
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\x00\x3f\x00"
    return head + b"".join(parts) + b"\xff\xd9", np.clip((luma * 16 + 4) // 8 + 128, 0, 255)


@pytest.mark.parametrize("sampling,restart", [(((1, 1),), 0), (((2, 2), (1, 1), (1, 1)), 0), (((2, 1), (1, 1), (1, 1)), 3), (((1, 1), (1, 1), (1, 1)), 2)])
def test_images_with_colour_and_detail(sampling, restart):
    rng = np.random.RandomState(8)
    made = [colour_image(w, h, sampling, rng, restart) for w, h in ((40, 24), (17, 9), (64, 64))]
    for (_, want), got in zip(made, jpeg.thumbnails([jpeg.parse(d) for d, _ in made]), strict=True):
        assert np.array_equal(got, want)


@pytest.mark.parametrize("bad", [b"", b"GIF", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00", b"\xff\xd8\xff\xd9"])
def test_what_is_no_baseline_jpeg_is_refused(bad):
    with pytest.raises((ValueError, IndexError)):
        jpeg.parse(bad)


def test_payloads_of_several_images(spark, monkeypatch):
    monkeypatch.setattr(jpeg, "TILE", 192 * 3)
    payloads = [jpeg.padded(bytes(range(32, 127)) * n) for n in (1, 6, 7, 40)]
    for p, m in zip(payloads, jpeg.encode_all(payloads), strict=True):
        images = jpeg.parse_all(m)
        assert len(images) == -(-len(p) // 576)
        assert b"".join(map(jpeg.payload_of, images, jpeg.thumbnails(images))) == p


def test_a_text_of_more_than_one_image():
    p = jpeg.padded(b"0123456789abcdef" * 600_000)
    assert len(p) > jpeg.TILE
    images = jpeg.parse_all(jpeg.encode_all([p])[0])
    assert len(images) == 2 and b"".join(map(jpeg.payload_of, images, jpeg.thumbnails(images))) == p


# ---------------------------------------------------------------- nearest neighbours


def recall(got, want):
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def neighbours(df):
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_neighbours_against_brute_force(spark):
    """Hot vectors, ties, vectors that take no part and those of another length; scores are exact and ordered."""
    rng = np.random.RandomState(3)
    x = rng.randn(300, 16)
    x[50:90] = x[50]
    rows = [(i * 5, v.tolist(), "c") for i, v in enumerate(x)]
    short = [(8000, [1.0, 2.0], "c"), (8020, [2.0, 0.5], "c"), (8021, [-1.0, 3.0], "c")]
    odd = [(7001, None, "c"), (7002, [0.0] * 16, "c"), (7003, [float("nan")] * 16, "c"), (7004, [None, *[1.0] * 15], "c"), (7005, [float("inf"), *[1.0] * 15], "c"), (7006, [1.0], "c"), rows[3]]
    df = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<double>, score string")
    got = neighbours(df)
    ids = np.array([r[0] for r in rows])
    want = ann.exact_nearest(ids, x, ids[ids % 20 == 0], 20)
    assert [v for v, _ in got.pop(8000)] == [8021, 8020] and [v for v, _ in got.pop(8020)] == [8000, 8021]
    assert set(got) == set(want) and recall(got, want) >= 0.9
    place = {v: i for i, v in enumerate(ids.tolist())}
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda r: (-r[1], r[0]))
        assert np.allclose([s for _, s in found], [x[place[q]] @ x[place[v]] for v, _ in found], rtol=1e-12)
    # All of the hot vector's copies are found by each other, the smallest ids first.
    assert [v for v, _ in got[260]] == [v for v, _ in want[260]]


@pytest.mark.parametrize("kind", ["unit", "norms", "clusters"])
def test_recall_through_the_query(spark, kind):
    """Several blocks of random directions, of varied norms, and of clusters."""
    rng = np.random.RandomState(7)
    n = 9000
    x = rng.randn(n, 64) if kind != "clusters" else rng.randn(60, 64)[rng.randint(60, size=n)] + 0.5 * rng.randn(n, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms":
        x *= np.exp(0.5 * rng.randn(n, 1))
    ids = np.arange(n) * 4
    df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.array(x.tolist())}))
    want = ann.exact_nearest(ids, x, ids[ids % 20 == 0], 20)
    assert recall(neighbours(df), want) >= 0.9


def test_recall_on_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
        rows = df.collect()
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
        assert recall(neighbours(df), ann.exact_nearest(ids, x, ids[ids % 20 == 0], 20)) >= 0.9


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_footrule_gain_is_the_footrule_distance():
    rng = np.random.RandomState(1)
    x, pivots = rng.randn(50, 8), ann.unit(rng.randn(100, 8))
    block = ann.Block(x, pivots)
    h = ann.heads(x, pivots)
    gain = block.footrule_gain(h[0])
    place = np.full((50, 100), ann.HEAD)
    np.put_along_axis(place, h, np.arange(ann.HEAD)[None], axis=1)
    distance = np.abs(place - place[0]).sum(axis=1)
    assert np.array_equal(2 * (gain[0] - gain), distance)


# ---------------------------------------------------------------- pipeline


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    docs = [(i, text_of(rng, 80), "en", f"s{i}", 1) for i in range(30)]
    docs += [(100, docs[0][1], "en", "s", 1), (101, "12345 67890", "en", "s", 1), (102, None, None, "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(30)) <= out and not {101, 102} & out
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ties, clashing columns and an empty table, stage by stage against plain Python."""
    import corpus_pipeline

    rng = random.Random(6)
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n_dropped string, bucket int"
    base = text_of(rng, 90)
    near = base.split()
    near[40] = "other"
    docs = [(i, text_of(rng, 60), "en") for i in range(20)]
    docs += [(30, base, "en"), (30, base, "en"), (31, " ".join(near), "en"), (32, None, "en"), (33, "", None), (34, "1 2 3", None), (None, text_of(rng, 50), "en")]
    docs += [(40, "\n".join(text_of(rng, 30) for _ in range(400)), "en"), (41, text_of(rng, 40) + "\n" + docs[0][1], "en")]
    rows = [(*d, "s", len(d[1] or ""), "x", 7) for d in docs]
    df = spark.createDataFrame(rows, kinds)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # 31 is a near copy of 30 as a line and loses it; what is left of it, an empty text, is linked with nothing.
    assert out == collections.Counter([*range(20), 30, 30, 31, None, 40, 41])
    lines = {r.doc_id: r for r in corpus_pipeline.lines(spark, df, str(tmp_path)).collect()}
    assert lines[41].text == docs[-1][1].split("\n")[0] and lines[41].n_chars == len(lines[41].text) and lines[31].text == "" and lines[0].n_dropped == "x"
    (tmp_path / "none").mkdir()
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
