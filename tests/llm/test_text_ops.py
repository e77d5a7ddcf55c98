"""Language ID, BPE, HTML extraction, packing, language model: brute force and edge cases."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import bpe, html_text, lang_id, packing, pitman_yor
from pactum.llm.common import batch_tokens, token_hashes
from pactum.llm.queries import TOKENIZER

WORDS = "the of and to in that a is it for on was be with as le la et un des der die und das ein".split()


def sample(n, seed=1):
    rng = np.random.RandomState(seed)
    en, fr = WORDS[:15], WORDS[15:19] + ["oui", "que", "leau"]
    return [(i, " ".join(rng.choice(en if i % 2 else fr, 5 + i % 40)), "en" if i % 2 else "fr") for i in range(n)]


# ---------------------------------------------------------------- tokens


@pytest.mark.parametrize("text", ["", " ", "A b\tC\n", "é É x", "x" * 200 + " y", "a\x0bb\x0cc\rd", "tail "])
def test_tokens_follow_the_pattern(text):
    h, tail = token_hashes(text.encode())
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert len(h) == len(words)
    assert [t.to_bytes(2, "big").lstrip(b"\0") for t in tail.tolist()] == [w.encode()[-2:] for w in words]
    assert len(set(h.tolist())) == len(set(words))


def test_long_texts_are_tokenised_in_windows(monkeypatch):
    from pactum.llm import common

    text = (" ".join(f"w{i}" for i in range(3000)) + " " + "z" * 9000 + " end").encode()
    whole = token_hashes(text)
    monkeypatch.setattr(common, "_WINDOW", 1000)
    for got in (common.token_hashes(text), batch_tokens([b"a", text, b""])[1]):
        assert np.array_equal(got[0], whole[0]) and np.array_equal(got[1], whole[1])


# ---------------------------------------------------------------- language identification


def slow_bits(samples, text):
    """Code length of a text under one language's order-3 contexts, straight from counts."""
    counts = collections.defaultdict(collections.Counter)
    for joined in samples:
        for i in range(len(joined)):
            for k in range(4):
                if i >= k:
                    counts[joined[i - k : i]][joined[i]] += 1
    total, data = 0.0, b"\n\n\n" + text
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / whole)
                break
            total -= math.log2(len(seen) / whole)
        else:
            total += 8
    return total


def test_code_lengths_equal_the_definition(monkeypatch):
    texts = [b"the cat sat on the mat", b"the cat sat on the mat", b"a bat"]
    model = lang_id.PPM({"x": texts})
    joined = b"\n\n\n" + b"\n\n\n".join(texts)
    # Contexts met once are pruned from the compiled tables: a text all of whose contexts were met twice has exact lengths.
    assert model.lengths([b"the cat sat"])[0, 0] == pytest.approx(slow_bits([joined], b"the cat sat"), rel=1e-5)
    long = b"the cat sat on the mat " * 300
    whole = model.lengths([long])[0, 0]
    monkeypatch.setattr(lang_id, "WINDOW", 1000)
    assert model.lengths([long, b"the"])[0, 0] == pytest.approx(whole, rel=1e-6)


def test_language_predictions(spark):
    rows = sample(200) + [(900, None, "en"), (901, "", "fr"), (902, "123 ...", None), (903, "the of and", None), (904, "the of and", None), (None, "que leau", "fr")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in lang_id.predict_languages(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and [got[i].score for i in (900, 901, 902)] == [0.0] * 3
    assert got[903].lang_pred == got[904].lang_pred == "en" and got[903].score == got[904].score and 0 < got[903].score <= 1
    assert got[None].lang_pred == "fr" and not got[None].held_out
    kept = lang_id.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got) - {900, 901, 902}


def test_languages_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lang_id.predict_languages(empty).count() == 0
    none = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert lang_id.predict_languages(none).first().lang_pred == "und"


# ---------------------------------------------------------------- BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    texts = ["Hello World's it'll 42", "Σας ΟΔΟΣ İx", "<|endoftext|>a<|startoftext|>", "日本語 🙂 é", "", "  \n\t", "x" * 5000, "a b c", None, "dup", "dup", "ﬁ ½ Ⅷ ²", "it<|x|>"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digest_documents(df, TOKENIZER).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), t
    assert bpe.digest_documents(df.limit(0), TOKENIZER).count() == 0
    assert bpe.encode_documents(df, TOKENIZER).where("doc_id = 0").first().decoded == lib.decode(lib.encode(texts[0]).ids, skip_special_tokens=False)


def test_every_code_point_is_split_as_in_the_library():
    """One in seven of all code points, and all that the library's tables lack, between two letters."""
    from tokenizers import Tokenizer

    lib, enc = Tokenizer.from_file(TOKENIZER), bpe.encoder(TOKENIZER)
    ranges = [[int(c, 16) for c in x.split("-")] for x in bpe.NEWER]
    points = sorted({c for r in ranges for c in range(r[0], r[-1] + 1, 5)} | {c for c in range(3, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF and c < 0xE000 or c % 97 == 0 and c > 0xE000})
    texts = [f"a{chr(c)}b 1{chr(c)}2" for c in points if not 0xD800 <= c <= 0xDFFF]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(t) == e.ids, ascii(t)


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    enc = bpe.encoder(TOKENIZER)
    text = "it's a LONG text\n" * 50 + "<|endoftext|>end " + "y" * 400
    whole = enc.chunks(text)
    monkeypatch.setattr(bpe, "PIECE", 37)
    parts = [*enc.pieces(text)]
    assert len(parts) > 10 and [c for p in parts for c in p] == whole and [*enc.pieces("")] == []


def test_merges_equal_rank_by_rank_merging():
    enc = bpe.encoder(TOKENIZER)
    rng = np.random.RandomState(3)

    def slow(symbols):
        symbols = list(symbols)
        while True:
            ranked = [(enc.merge[p][0], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in enc.merge]
            if not ranked:
                return symbols
            _, i = min(ranked)
            symbols[i : i + 2] = [enc.merge[(symbols[i], symbols[i + 1])][1]]

    for _ in range(300):
        word = "".join(rng.choice(list("aeinrstholc"), rng.randint(1, 30)))
        symbols = enc.symbols(word.encode())
        assert enc.merged(symbols) == slow(symbols)
    assert enc.decode(enc.encode("the end")) == "the</w> end</w>"


# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>
line&nbsp;here.<p>Second <a href="x">link</a> text.<div class="ad">Buy now and save a lot of money today.</div>
<!-- <p>hidden</p> --><p>Short.</p><aside>Side words in plenty are here.</aside><form><p>Your mail</p><input></form>
<div style="display: none"><p>Not seen</p></div><div class="share-links"><a>Tweet</a></div></article></main>
<section id="comments"><p>Great article, I read it twice and liked it.</p></section><footer>&copy; Us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst bold line here.\nSecond link text.\nShort."


@pytest.mark.parametrize("page", ["", None, "<", "<!--", "<script>x", "<p", "</", "<p class='x>y</p>", "<title>", "&#xZZ;", "<nav>Home", "<a href=\"<p>\">"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_without_an_article_element():
    words = "word " * 40
    page = f"<body><div class='menu'><a>A</a> <a>B</a></div><div><p>{words}</p><p>{words}</p></div><div id='sidebar'><p>{words}</p></div><ul><li><a>x y</a></li></ul></body>"
    assert html_text.main_text(page) == "\n".join([words.strip()] * 2)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav><a>Home</a></nav><article><h1>Two words</h1><p>And then a text of some length that says what it is about.</p></article>", "Two words\nAnd then a text of some length that says what it is about."),
        ("<article><p>A text of some length that says what it is about, as before.</p><p>See <a>the full report of the committee</a></p><p>And one more of these, which ends the text.</p></article>", "A text of some length that says what it is about, as before.\nSee the full report of the committee\nAnd one more of these, which ends the text."),
        ("<div class='layout with-sidebar'><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><main><h2>News</h2><p>Some words stand here, enough to be a paragraph of the page.</p></main><aside><p>Some words stand here too, and they are beside the article.</p></aside></div>", "News\nSome words stand here, enough to be a paragraph of the page."),
        ("<div><h1>Plain page</h1><p>There is no class and no article on this page, only a paragraph.</p><ul><li>first of two things</li><li>second of two things</li></ul><p><a>Read more</a></p></div>", "Plain page\nThere is no class and no article on this page, only a paragraph.\nfirst of two things\nsecond of two things"),
        ("<article><h1>A</h1><p>One two three.</p><ul><li><a>Related piece</a></li><li><a>Other piece</a></li></ul></article>", "A\nOne two three."),
    ],
)
def test_headings_links_and_wrappers(page, want):
    assert html_text.main_text(page) == want


def test_pages_of_the_table():
    """Against what the table's own pages are made of: an article element, cut at its blocks by another parser."""
    import html.parser

    import pyarrow.parquet as pq

    class Article(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.blocks = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.blocks += [[]] if tag in ("p", "h1", "article") else []
            self.blocks[-1] += [" "] if tag == "br" else []

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.blocks += [[]] if tag in ("p", "h1", "article") else []

        def handle_data(self, data):
            self.blocks[-1] += [data] if self.depth else []

    table = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for r in table:
        parser = Article()
        parser.feed(r["html"])
        parser.close()
        blocks = [" ".join("".join(b).split()) for b in parser.blocks]
        assert html_text.main_text(r["html"]) == "\n".join(b for b in blocks if b), r["page_id"]


def test_the_tree_fits_its_table():
    table = np.array(html_text.LABELLED, dtype=float)
    assert (html_text.tree().predict(table[:, :-1]) == (table[:, -1] == 1)).mean() >= 0.98


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, "c"), (2, None, None, "c"), (3, "v", "x" * 200_000, "c")], "page_id long, url string, html string, text string")
    got = extract_rows(df)
    assert got[1][0].n_chars == len(html_text.main_text(PAGE)) and got[1][0].url == "u"
    assert [r.text for r in got[2]] == ["", ""] and len(got[3]) == 1
    assert html_text.extract(df.limit(0)).count() == 0


def extract_rows(df):
    out = collections.defaultdict(list)
    for r in html_text.extract(df).collect():
        out[r.page_id].append(r)
    return out


# ---------------------------------------------------------------- packing


def test_boundaries_are_optimal():
    rng = np.random.RandomState(5)
    for k in (1, 2, 3, 5):
        lengths = np.sort(rng.choice(40, 9, replace=False)) + 1
        counts = rng.randint(1, 20, 9)
        got = packing.best_boundaries(lengths, counts, lengths * counts, k)

        def padding(bounds, lengths=lengths, counts=counts):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))

        best = min(padding((*c, lengths[-1])) for n in range(k) for c in itertools.combinations(lengths[:-1], n))
        assert len(got) <= k and padding(got) == best
    assert packing.best_boundaries(np.zeros(0), np.zeros(0), np.zeros(0), 3) == []


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 16)
    rng = np.random.RandomState(2)
    rows = [(i, " ".join(["w"] * int(n)), "x") for i, n in enumerate(rng.randint(0, 700, 300))] + [(7, None, "x"), (7, "", "x"), (None, "a b", "x"), (1000, "w " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string")
    got = packing.pack(df, budget=2000, buckets=4).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1 if i is not None else -1, len((t or "").split()) + 1) for i, t, _ in rows)
    batches = collections.defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for key, members in batches.items():
        top = members[0].bucket_len
        fit = max(1, 2000 // top)
        assert sorted(m.slot for m in members) == list(range(len(members)))
        last = max(b for k, b in batches if k == key[0])
        assert len(members) == fit or key[1] == last
        assert top == max(r.n_tokens for r in got if r.bucket == key[0])
    assert packing.pack(df.limit(0)).count() == 0


def test_many_equal_rows_are_packed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 8)
    df = spark.createDataFrame([(None, "a b")] * 100 + [(5, "c d e")] * 50 + [(i, "f") for i in range(10, 60)], "doc_id long, text string")
    got = packing.pack(df, budget=12, buckets=2).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter({(None, 3): 100, (5, 4): 50} | {(i, 2): 1 for i in range(10, 60)})
    for b in {r.bucket for r in got}:
        fit = 12 // next(r.bucket_len for r in got if r.bucket == b)
        assert sorted(r.batch * fit + r.slot for r in got if r.bucket == b) == list(range(sum(r.bucket == b for r in got)))


# ---------------------------------------------------------------- language model


def test_base_score_and_gain(spark):
    rows = [(i, t) for i, t, _ in sample(300)] + [(1000, None), (1001, ""), (1002, "Novel words Only"), (None, "the of")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in pitman_yor.score(df).collect()}
    assert len(got) == len(rows)
    toks = {i: re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) + ["\0"] for i, t in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    counts = collections.Counter(w for i in toks if not held[i] for w in toks[i])
    n, v = sum(counts.values()), len(counts)
    for i, words in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(words), n)
        assert r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    per = [sum(getattr(got[i], k) for i in toks if held[i]) for k in ("score", "base_score")]
    assert per[0] > per[1]
    assert pitman_yor.score(df.limit(0)).count() == 0


def test_contexts_are_whole_words(spark):
    """Words with one ending have restaurants of their own: what follows one of them says nothing of the other."""
    rows = [(i, "xxing left " * 30 + "yying right " * 30) for i in range(40)]
    asked = [(1000, "xxing left"), (1001, "xxing right")]
    held = {i for i, _ in rows + asked if zlib.crc32(str(i).encode()) % 5 == 1}
    df = spark.createDataFrame(rows + asked, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score(df).collect()}
    assert len(held) < 20 and got[1000] > got[1001] + 1
    w, u = pitman_yor.words_of([b"aaing b ccing"])[0]
    assert len(w) == 4 and len(set(u.tolist())) == 4 and u[1:].tolist() == w[:-1].tolist()


def test_joined_pairs_score_like_hot_ones(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t, _ in sample(60)], "doc_id long, text string")
    whole = {r.doc_id: r.score for r in pitman_yor.score(df).collect()}
    monkeypatch.setattr(pitman_yor, "HOT", 3)
    for r in pitman_yor.score(df).collect():
        assert r.score == pytest.approx(whole[r.doc_id], rel=1e-9)


def test_scores_do_not_depend_on_the_cluster(spark):
    """Neither on how rows are dealt out nor on the number of shuffle partitions."""
    df = spark.createDataFrame([(i, t) for i, t, _ in sample(120)], "doc_id long, text string")
    one = {r.doc_id: r.score for r in pitman_yor.score(df.repartition(2)).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = {r.doc_id: r.score for r in pitman_yor.score(df.repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == pytest.approx(two, rel=1e-9)


def test_pairs_of_many_homes(spark, monkeypatch):
    """No table between steps has a row for each pair or asked word, and neither homes, blocks nor slices change what is known."""
    import pathlib

    from pactum.llm.common import Scratch

    rng = np.random.RandomState(4)
    rows = [(i, " ".join(f"w{int(x * x * 600)}" for x in rng.random_sample(120))) for i in range(80)] + [(1000, None), (1001, ""), (None, "of the of"), (1006, "Never seen Words of these"), (1007, "Never seen Words of these")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in pitman_yor.score(df).collect()}
    for name, value in (("PER_HOME", 4000), ("CHUNK", 3000), ("SLICES", 3), ("HOT", 20)):
        monkeypatch.setattr(pitman_yor, name, value, raising=False)
    written, write = [], Scratch.write

    def counted(self, frame):
        out = write(self, frame)
        written.append((out.count(), sum(f.stat().st_size for f in pathlib.Path(out._pactum_path.removeprefix("file:")).glob("*.parquet"))))
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    got = {r.doc_id: r for r in pitman_yor.score(df).collect()}
    toks = [re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    pairs = len({p for w in toks for p in zip(["\0", *w], [*w, "\1"], strict=True)})
    assert pairs > 4000 and max(n for n, _ in written) < pairs / 2
    assert got.keys() == whole.keys() and len(got) == len(rows)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (whole[i].held_out, whole[i].n_tokens, whole[i].n_known, whole[i].train_tokens)
        assert r.base_score == pytest.approx(whole[i].base_score, rel=1e-9)
        # Another seating is drawn where words have other homes.
        assert r.score == pytest.approx(whole[i].score, rel=0.1)
    assert sum(r.score for r in got.values()) == pytest.approx(sum(r.score for r in whole.values()), rel=0.01)


def test_order_of_hashes():
    """Stable order and places of hashes as numpy's sorts give them, also where high bits are alike and one number can't hold hash and place."""
    h = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    h[1000:2000] = h[:1000]
    for x in (h, h >> np.uint64(52), h & np.uint64(255), h[:0], h[:1], np.full(4, 2**64 - 1, dtype=np.uint64)):
        assert (pitman_yor.order_of(x) == np.argsort(x, kind="stable")).all()
        for got, want in zip(pitman_yor.placed(x), np.unique(x, return_index=True, return_inverse=True), strict=True):
            assert (got == want).all()


def test_sums_of_texts_in_any_order():
    """Parts of texts of many blocks are summed once by block and text, whatever order they come in."""
    rng = np.random.default_rng(4)
    block, i = np.repeat(np.array([7, 1 << 40, 3, 7]), 200), rng.integers(0, 900, 800)
    n, lp = rng.integers(1, 5, 800), rng.random(800)
    got = {}
    for _, _, _, data in pitman_yor._parts(block, i, n, lp, lp, 5):
        for b, t, k, x, _ in zip(*pitman_yor.load(data), strict=True):
            assert (b, t) not in got
            got[b, t] = k, x
    want = {(b, t): (n[hit].sum(), lp[hit].sum()) for b, t in zip(block, i, strict=True) for hit in [(block == b) & (i == t)]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_arrays_of_counts():
    for top in (0, 1, 255, 256, 1 << 40, (1 << 63) - 1):
        a, h, x = np.array([0, top, top // 2]), np.array([top, 1 << 63], dtype=np.uint64), np.array([0.5, -top])
        for one, two in zip(pitman_yor.load(pitman_yor.dump(a, h, x, a[:0])), (a, h, x, a[:0]), strict=True):
            assert one.tolist() == two.tolist()


def test_seating_follows_the_restaurant(spark):
    """Averages of sampled tables against the exact posterior of small dishes."""
    d, opening, more = 0.5, 0.8, 0.1
    c = np.full(20000, 6)
    t, rng = None, np.random.default_rng(1)
    for _ in range(12):
        t = pitman_yor.reseat(t, c, np.full(20000, opening), np.full(20000, more), d, rng)
    weights = np.zeros(7)

    def seatings(sizes, left, w):
        if not left:
            weights[len(sizes)] += w
            return
        for i, s in enumerate(sizes):
            seatings([*sizes[:i], s + 1, *sizes[i + 1 :]], left - 1, w * (s - d))
        seatings([*sizes, 1], left - 1, w * (opening + more * len(sizes)))

    seatings([1], 5, 1.0)
    exact = (np.arange(7) * weights).sum() / weights.sum()
    assert t.mean() == pytest.approx(exact, rel=0.01)


def test_predictive_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in sample(40)], "doc_id long, text string")
    from pactum.llm.common import Scratch

    model = pitman_yor.Model(df, Scratch(spark, "t"))
    words = {r.w: r for r in model.words.collect()}
    for u in model.contexts.limit(5).collect():
        own = {r.w: 10**r.lp for r in model.pairs.where(F.col("u") == u.u).collect()}
        back = [sum(u[f"n{s}"] * words[w][f"p{s}"] for s in range(pitman_yor.SAMPLES)) / pitman_yor.SAMPLES for w in words if w not in own]
        none = sum(u[f"n{s}"] * model.unknown[s] for s in range(pitman_yor.SAMPLES)) / pitman_yor.SAMPLES
        assert sum(own.values()) + sum(back) + none == pytest.approx(1.0, rel=1e-6)
