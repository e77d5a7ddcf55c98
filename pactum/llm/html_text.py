"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density, those of its two
neighbours, and where it stands (inside an article, inside furniture such as menus or adverts, a heading, a paragraph or the like). A
decision tree (Gini splits) is trained on the small labelled table below when the module is first used and says which
blocks are main text. Scripts, styles, hidden parts and form controls never become blocks.

Defined results: null and empty pages and pages without main text give an empty text; unclosed tags, comments and
raw-text elements run to the end of the page; blocks keep page order; equal pages get equal texts; an empty table gives
an empty result; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<=\s)(hidden)(?=\s|$)""")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

# HTML element names by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED_TAGS = frozenset("head svg math object applet audio video canvas select button template noscript datalist map".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split())
# Words in class and id names that mark page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner nav "
    "navbar navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail footer foot header masthead topbar "
    "comment comments commentlist discussion disqus reply replies respond cookie cookies consent gdpr notice notices notification "
    "notifications alert modal popup overlay newsletter subscribe subscription signup login register share sharing social related "
    "recommended recommendations recirc widget widgets toolbar pagination pager skip copyright disclaimer form search outbrain taboola".split()
)
ARTICLE_NAMES = frozenset("article articlebody post entry story content main hentry".split())

FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "article", "furniture", "heading", "prose")
# Fixed values, the labelled table: the features in the order above, then 1 for main text.
LABELLED = (
    # paragraphs and headings of articles
    (80, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 1, 1), (45, 0.1, 9, 0.0, 60, 0.0, 1, 0, 0, 1, 1), (12, 0.0, 40, 0.0, 55, 0.0, 1, 0, 0, 1, 1),
    (3, 0.0, 50, 0.0, 44, 0.1, 1, 0, 0, 1, 1), (1, 0.0, 20, 0.0, 2, 0.0, 1, 0, 0, 1, 1), (2, 0.0, 1, 0.0, 30, 0.0, 1, 0, 0, 1, 1),
    (8, 0.0, 3, 1.0, 60, 0.0, 1, 0, 1, 1, 1), (6, 0.0, 2, 1.0, 1, 0.0, 1, 0, 1, 1, 1), (10, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 1, 1),
    (150, 0.2, 8, 0.0, 12, 0.0, 1, 0, 0, 1, 1), (30, 0.3, 25, 0.0, 4, 1.0, 1, 0, 0, 1, 1), (5, 0.2, 40, 0.0, 3, 1.0, 1, 0, 0, 1, 1),
    (25, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1, 1), (9, 0.0, 7, 0.4, 1, 1.0, 1, 0, 0, 1, 1),
    # links alone inside articles
    (4, 1.0, 60, 0.0, 5, 1.0, 1, 0, 0, 0, 0), (7, 1.0, 5, 1.0, 6, 1.0, 1, 0, 0, 0, 0), (2, 1.0, 30, 0.0, 3, 0.0, 1, 0, 0, 0, 0),
    (12, 0.9, 40, 0.0, 10, 0.9, 1, 0, 0, 0, 0), (5, 1.0, 4, 1.0, 0, 0.0, 1, 0, 0, 0, 0),
    # furniture inside and outside articles
    (20, 0.0, 60, 0.0, 50, 0.0, 1, 1, 0, 1, 0), (60, 0.0, 70, 0.0, 65, 0.0, 1, 1, 0, 1, 0), (3, 0.0, 50, 0.0, 40, 0.0, 1, 1, 0, 0, 0),
    (5, 0.0, 60, 0.0, 30, 0.0, 1, 1, 1, 1, 0), (120, 0.1, 30, 0.0, 2, 1.0, 1, 1, 0, 1, 0), (9, 1.0, 9, 1.0, 9, 1.0, 1, 1, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0, 0),
    (40, 0.0, 30, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (70, 0.0, 60, 0.0, 65, 0.0, 0, 1, 0, 1, 0), (14, 0.1, 60, 0.0, 0, 0.0, 0, 1, 0, 1, 0),
    (4, 0.0, 2, 1.0, 30, 0.0, 0, 1, 1, 1, 0), (25, 0.6, 4, 0.0, 25, 0.6, 0, 1, 0, 1, 0), (150, 0.0, 100, 0.0, 80, 0.0, 0, 1, 0, 1, 0),
    # pages without an article element
    (60, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 1, 1), (40, 0.1, 7, 0.0, 45, 0.0, 0, 0, 0, 1, 1), (25, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 1, 1),
    (18, 0.0, 30, 0.0, 35, 0.1, 0, 0, 0, 1, 1), (120, 0.2, 3, 1.0, 1, 0.0, 0, 0, 0, 1, 1), (6, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 1, 1),
    (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1, 1), (5, 0.0, 45, 0.0, 30, 0.0, 0, 0, 1, 1, 1),
    (3, 0.0, 35, 0.0, 50, 0.0, 0, 0, 1, 1, 1), (20, 0.0, 6, 0.0, 22, 0.0, 0, 0, 0, 1, 1), (16, 0.3, 25, 0.1, 18, 0.0, 0, 0, 0, 1, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 40, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (15, 0.9, 12, 1.0, 14, 0.9, 0, 0, 0, 0, 0),
    (3, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (4, 0.5, 3, 1.0, 4, 0.5, 0, 0, 0, 0, 0), (30, 0.8, 3, 0.0, 28, 0.8, 0, 0, 0, 0, 0),
    (2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1, 1, 0), (8, 0.6, 50, 0.0, 6, 1.0, 0, 0, 0, 0, 0), (5, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 0),
    # short headings right after menus
    (2, 0.0, 1, 1.0, 40, 0.0, 1, 0, 1, 1, 1), (3, 0.0, 6, 1.0, 60, 0.0, 1, 0, 1, 1, 1), (1, 0.0, 1, 1.0, 30, 0.0, 1, 0, 1, 1, 1),
    (4, 0.0, 2, 1.0, 25, 0.0, 0, 0, 1, 1, 1), (2, 0.0, 3, 1.0, 18, 0.2, 0, 0, 1, 1, 1), (3, 0.0, 1, 1.0, 9, 0.6, 1, 0, 1, 1, 1),
    # paragraphs rich in links
    (7, 0.85, 40, 0.0, 50, 0.0, 1, 0, 0, 1, 1), (12, 0.7, 30, 0.0, 20, 0.0, 1, 0, 0, 1, 1), (20, 0.6, 45, 0.1, 30, 0.0, 1, 0, 0, 1, 1),
    (9, 0.5, 3, 0.0, 30, 0.2, 1, 0, 0, 1, 1), (25, 0.8, 60, 0.3, 40, 0.5, 1, 0, 0, 1, 1), (15, 0.6, 35, 0.0, 50, 0.1, 0, 0, 0, 1, 1),
    (6, 0.65, 12, 0.0, 3, 1.0, 1, 0, 0, 1, 1), (8, 0.9, 2, 0.0, 1, 1.0, 1, 0, 0, 1, 1),
    # paragraphs that are a link
    (2, 1.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1, 0), (3, 1.0, 50, 0.0, 4, 1.0, 1, 0, 0, 1, 0), (5, 1.0, 30, 0.0, 40, 0.0, 0, 0, 0, 1, 0),
    # text of lists, tables and plain divisions
    (18, 0.0, 20, 0.0, 25, 0.0, 1, 0, 0, 0, 1), (6, 0.0, 5, 0.0, 7, 0.0, 1, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (8, 0.0, 9, 0.1, 2, 1.0, 0, 0, 0, 0, 1), (45, 0.1, 50, 0.0, 3, 1.0, 0, 0, 0, 1, 1),
    (3, 0.0, 5, 0.0, 1, 1.0, 0, 0, 0, 0, 1), (14, 0.2, 30, 0.0, 2, 1.0, 0, 0, 0, 1, 1), (12, 0.3, 14, 0.2, 9, 0.4, 1, 0, 0, 0, 1), (60, 0.1, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 1, 0, 0, 0, 1),
)


# ---------------------------------------------------------------- blocks


def blocks_of(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """(text, words, words in links, in an article, in furniture, heading, prose) of each block in page order."""
    out: list[tuple[str, int, int, int, int, int, int]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, article, furniture, dropped
    link = 0
    article = furniture = dropped = 0
    heading = prose = 0
    at, size, lower = 0, len(page), None

    def close() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                inside = len(entities.unescape(" ".join(linked)).split())
                out.append((" ".join(words), len(words), min(inside, len(words)), int(article > 0), int(furniture > 0), heading, prose))
            text.clear()
            linked.clear()

    def say(piece: str) -> None:
        if piece and not dropped:
            text.append(piece)
            if link:
                linked.append(piece)

    while at < size:
        cut = page.find("<", at)
        if cut < 0:
            say(page[at:])
            break
        if cut > at:
            say(page[at:cut])
        if page.startswith("<!--", cut):
            end = page.find("-->", cut + 2)
            at = size if end < 0 else end + 3
            continue
        m = TAG.match(page, cut)
        if not m:
            say("<")
            at = cut + 1
            continue
        at = m.end()
        closing, name = (m[1], m[2]) if m[2] else (m[4], m[5])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "a":
                link = 0
            if name in BLOCK_TAGS or name in DROPPED_TAGS:
                if name in BLOCK_TAGS:
                    close()
                    heading = prose = 0
                if any(s[0] == name for s in stack):
                    while stack:
                        tag, article, furniture, dropped = stack.pop()
                        if tag == name:
                            break
            continue
        if name in RAW_TAGS:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == size else _raw_end(page, name, at)
            if end < 0:
                at = size
            else:
                stop = page.find(">", end)
                at = size if stop < 0 else stop + 1
            continue
        attributes = m[3] or m[6] or ""
        if name == "br":
            say(" ")
            continue
        if name == "a":
            link = 1
            continue
        if name in VOID_TAGS and name != "hr":
            continue
        if name not in BLOCK_TAGS and name not in DROPPED_TAGS:
            continue
        if name in BLOCK_TAGS:
            close()
            heading = int(len(name) == 2 and name[0] == "h" and name[1].isdigit())
            prose = int(name in PROSE_TAGS)
            if name == "p" and stack and stack[-1][0] == "p":
                _, article, furniture, dropped = stack.pop()
            if name in ("hr", "html", "body"):
                continue
        stack.append((name, article, furniture, dropped))
        known = names_of(attributes) if attributes else {}
        if name in ("article", "main") or known.get("role") in ("main", "article") or known.get("article"):
            article += 1
            # What a wrapper is called says nothing of the article in it, as in a page named by its sidebar.
            furniture = 0
        if name in FURNITURE_TAGS or known.get("furniture") or known.get("role") in FURNITURE_ROLES or (name == "header" and not article):
            furniture += 1
        if name in DROPPED_TAGS or known.get("hidden"):
            dropped += 1
    close()
    return out


def _raw_end(page: str, name: str, at: int) -> int:
    m = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
    return m.start() if m else -1


@lru_cache(maxsize=4096)
def names_of(attributes: str) -> dict:
    """What a tag's attributes say of its part of the page."""
    found: dict = {}
    for key, a, b, c, bare in ATTRIBUTE.findall(attributes):
        value = a or b or c
        key = key.lower()
        if bare or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            found["hidden"] = True
        elif key == "role":
            found["role"] = value.lower()
        elif key in ("class", "id"):
            parts = {x.lower() for x in NAME_PART.findall(value)} | set(re.split(r"[^a-z0-9]+", value.lower()))
            if parts & FURNITURE_NAMES and not (parts & {"article", "post", "entry", "story"} and parts & {"header", "body", "content", "text"}):
                found["furniture"] = True
            elif parts & ARTICLE_NAMES:
                found["article"] = True
    return found


def features(blocks: list[tuple]) -> np.ndarray:
    n = np.array([b[1] for b in blocks], dtype=np.float64)
    density = np.array([b[2] for b in blocks], dtype=np.float64) / np.maximum(1, n)
    rest = np.array([b[3:7] for b in blocks], dtype=np.float64).reshape(-1, 4)
    zero = np.zeros(1)
    near = [np.concatenate((zero, n[:-1])), np.concatenate((zero, density[:-1])), np.concatenate((n[1:], zero)), np.concatenate((density[1:], zero))]
    return np.column_stack([n, density, *near, rest])


# ---------------------------------------------------------------- decision tree


class Tree:
    """Binary decision tree by Gini impurity, grown until leaves are pure or splits stop helping."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.feature: list[int] = []
        self.edge: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.value: list[float] = []
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.value)
        self.feature.append(-1)
        self.edge.append(0.0)
        self.child.append((-1, -1))
        self.value.append(float(y.mean()))
        if depth and 0 < y.mean() < 1 and (best := self._split(x, y)):
            _, f, edge = best
            self.feature[me], self.edge[me] = f, edge
            low = x[:, f] <= edge
            self.child[me] = (self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))
        return me

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray) -> tuple[float, int, float] | None:
        found = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            left = np.arange(1, len(t))
            ones = np.cumsum(t)[:-1]
            right, more = len(t) - left, t.sum() - ones
            impurity = ones * (left - ones) / left + more * (right - more) / right
            impurity[v[1:] == v[:-1]] = np.inf
            i = int(impurity.argmin())
            if np.isfinite(impurity[i]) and (found is None or impurity[i] < found[0] - 1e-12):
                found = (float(impurity[i]), f, float((v[i] + v[i + 1]) / 2))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        feature, edge = np.array(self.feature), np.array(self.edge)
        child, value = np.array(self.child), np.array(self.value)
        rows = np.arange(len(x))
        while (feature[node] >= 0).any():
            f = feature[node]
            low = x[rows, np.maximum(f, 0)] <= edge[node]
            node = np.where(f < 0, node, np.where(low, child[node, 0], child[node, 1]))
        return value[node] >= 0.5


@lru_cache(maxsize=1)
def tree() -> Tree:
    table = np.array(LABELLED, dtype=np.float64)
    return Tree(table[:, :-1], table[:, -1])


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = tree().predict(features(blocks))
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(lambda p: main_text(p if isinstance(p, str) else None))

    out = pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
