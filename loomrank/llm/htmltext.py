"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags), each with the
tags, classes, ids and roles of its ancestors and the shape of its text.  A two-label CRF
(article, other) is trained on labelled pages and decoded by Viterbi.  The labelled pages
are made by a seeded generator of page layouts, because the corpus has no labels: the
same kinds of page furniture under varying tags and names, around articles with short
and long paragraphs, headings and lists.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import release

#: Elements whose content is no text of the page.
_HIDDEN = frozenset("script style noscript template textarea title iframe svg select object".split())
_CLOSES = {tag: re.compile(f"</{tag}\\s*>", re.IGNORECASE) for tag in _HIDDEN}
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open element of these kinds.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


class Block:
    """A leaf block: its text, how much of it is linked, and what its ancestors are."""

    __slots__ = ("inside", "inner_header", "linked", "marks", "own", "text")

    def __init__(self, text: str, at: tuple, linked: int) -> None:
        self.text, self.linked = text, linked
        self.own, self.marks, self.inside, self.inner_header = at


def pieces_of(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, closing, attributes) of a page in one forward scan; the last piece has no tag.

    Comments and declarations have no tag either, elements without text come as " ".  A > inside a
    quoted attribute does not end a tag; after a quote that is never closed, quotes mean nothing in the rest of
    the page, so no stretch is scanned more than twice.
    """
    at = pos = 0
    quotes = True
    while (pos := page.find("<", pos)) >= 0:
        if page.startswith(("<!", "<?"), pos):
            end, skip = (page.find("-->", pos + 4), 3) if page.startswith("<!--", pos) else (page.find(">", pos), 1)
            if end < 0:
                if skip == 1:
                    break
                end = len(page)
            yield page[at:pos], "", False, ""
            at = pos = end + skip
            continue
        m = _OPEN.match(page, pos)
        if not m:
            pos += 1
            continue
        end = m.end()
        while quotes and (c := _MARK.search(page, end)) and c[0] != ">":
            end = page.find(c[0], c.end()) + 1
            if not end:
                quotes = False
        end = page.find(">", m.end()) if not quotes else c.start() if c else -1
        if end < 0:
            break
        tag, closing = m[2].lower(), bool(m[1])
        before, attrs = page[at:pos], page[m.end() : end]
        at = pos = end + 1
        if tag in _HIDDEN and not closing:
            close = _CLOSES[tag].search(page, pos)
            at = pos = close.end() if close else len(page)
            yield before, " ", False, ""
        else:
            yield before, tag, closing, attrs
    yield page[at:], "", False, ""


def blocks(page: str | None, known: Mapping[str, object] | None = None) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments, titles and markup give no text.

    Marks are the tags and names of all ancestors (those in ``known`` only, if it is given).  A block shares them with
    its parent where it adds none, so deep pages cost no more than their length.
    """
    out: list[Block] = []
    if not page:
        return out
    root = ("-", frozenset(), False, False)
    stack: list[tuple] = [root]
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1], linked))
            parts.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    for before, tag, closing, attrs in pieces_of(page):
        if before:
            parts.append(before)
            if links:
                linked += len(before)
        if tag in ("", " "):
            parts.append(tag)
            continue
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        links = 0
        if tag in _VOID:
            continue
        if closing:
            if open_tags[tag] > 0:
                while pop() != tag:
                    pass
            continue
        ends = _ENDS.get(tag, {"p"})
        while stack[-1][0] in ends:
            pop()
        if attrs.rstrip().endswith("/"):
            continue
        names = {"t:" + tag} | {"c:" + n for a in _ATTR.findall(attrs) for n in _NAME.findall("".join(a).lower())}
        _, marks, inside, inner_header = stack[-1]
        new = {n for n in names if n not in marks and (known is None or n in known)}
        marks = marks | new if new else marks
        within = inside or tag in ("article", "main")
        #: A header of the article: both are among the ancestors, in either order.
        header = inner_header or (tag == "header" and inside) or (within and not inside and open_tags["header"] > 0)
        stack.append((tag, marks, within, header))
        open_tags[tag] += 1
    flush()
    return out


def block_features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        fs = {"bias", "own:" + b.own, f"inside:{b.inside}"} | b.marks
        if b.inner_header:
            fs.add("inner-header")
        n = len(b.text)
        fs.add(f"linked:{min(4, b.linked * 4 // max(1, n))}")
        if b.text[-1] in ".!?…":
            fs.add("ends")
        if "©" in b.text:
            fs.add("copyright")
        if i == 0:
            fs.add("first")
        if i == len(page) - 1:
            fs.add("last")
        out.append(sorted(fs))
    return out


class Chain:
    """Two-label linear-chain CRF; label 1 is article."""

    def __init__(self) -> None:
        self.weights: dict[str, tuple[float, float]] = {}
        self.step = np.zeros((2, 2))

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], rounds: int = 150, rate: float = 0.2, l2: float = 1e-4) -> None:
        """Maximum likelihood by Adam on the gradient from forward-backward over all pages at once."""
        names = sorted({f for p in pages for b in p for f in b})
        at = {f: i for i, f in enumerate(names)}
        longest = max(map(len, pages))
        n = len(pages)
        row, col = [], []
        for i, p in enumerate(pages):
            for t, b in enumerate(p):
                row += [i * longest + t] * len(b)
                col += [at[f] for f in b]
        row, col = np.array(row), np.array(col)
        size = np.array([len(p) for p in pages])
        live = np.arange(longest)[None, :] < size[:, None]
        gold = np.zeros((n, longest), int)
        for i, y in enumerate(labels):
            gold[i, : len(y)] = y
        w, a = np.zeros((len(names), 2)), np.zeros((2, 2))
        mom = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
        both = live[:, 1:] & live[:, :-1]
        gold_step = np.zeros((2, 2))
        np.add.at(gold_step, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        total = live.sum()
        for r in range(1, rounds + 1):
            e = np.stack([np.bincount(row, weights=w[col, y], minlength=n * longest) for y in (0, 1)], axis=1).reshape(n, longest, 2)
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, longest):
                fwd[:, t] = e[:, t] + np.logaddexp(fwd[:, t - 1, :1] + a[0], fwd[:, t - 1, 1:] + a[1])
            for t in range(longest - 2, -1, -1):
                nxt = e[:, t + 1] + bwd[:, t + 1]
                new = np.logaddexp(nxt[:, :1] + a[:, 0], nxt[:, 1:] + a[:, 1])
                bwd[:, t] = np.where(live[:, t + 1, None], new, 0)
            lz = np.logaddexp.reduce(np.take_along_axis(fwd, (size - 1)[:, None, None].repeat(2, 2), 1)[:, 0], axis=1)
            node = np.exp(fwd + bwd - lz[:, None, None]) * live[:, :, None]
            err = node.copy()
            np.add.at(err, (np.arange(n)[:, None], np.arange(longest)[None, :], gold), -live.astype(float))
            gw = np.stack([np.bincount(col, weights=err.reshape(-1, 2)[row, y], minlength=len(names)) for y in (0, 1)], axis=1)
            edge = fwd[:, :-1, :, None] + a + (e + bwd)[:, 1:, None, :] - lz[:, None, None, None]
            ga = (np.exp(np.minimum(edge, 0)) * both[:, :, None, None]).sum(axis=(0, 1)) - gold_step
            for k, (x, g) in enumerate(((w, gw / total + l2 * w), (a, ga / total + l2 * a))):
                m, v = mom[2 * k], mom[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        self.weights = {f: (float(w[i, 0]), float(w[i, 1])) for f, i in at.items()}
        self.step = a

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi labels."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        get, back = self.weights.get, []
        v0 = v1 = 0.0
        for i, fs in enumerate(page):
            known = [x for f in fs if (x := get(f))]
            e0, e1 = sum(x[0] for x in known), sum(x[1] for x in known)
            if i:
                a0, b0, a1, b1 = v0 + s00, v1 + s10, v0 + s01, v1 + s11
                back.append((b0 > a0, b1 > a1))
                v0, v1 = max(a0, b0) + e0, max(a1, b1) + e1
            else:
                v0, v1 = e0, e1
        y = [int(v1 > v0)]
        for from0, from1 in reversed(back):
            y.append(int(from1 if y[-1] else from0))
        return y[::-1]


#: Page furniture by kind: enclosing tags and the names (class, id, role) it goes by.
FURNITURE = {
    "menu": (("nav", "div", "ul"), ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "links")),
    "header": (("header", "div"), ("header", "masthead", "site-header", "logo", "banner", "top")),
    "footer": (("footer", "div"), ("footer", "site-footer", "colophon", "copyright", "bottom", "legal")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "aside", "related", "widget", "recommended", "popular", "trending", "tags")),
    "notice": (("div", "section", "dialog"), ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "paywall")),
    "advert": (("div", "aside", "section", "ins"), ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "adsbox", "banner-ad")),
    "form": (("form", "div"), ("form", "newsletter", "subscribe", "signup", "login", "search", "searchform", "contact-form")),
    "comments": (("div", "section", "ol"), ("comments", "comment", "replies", "reply", "discussion", "disqus", "responses", "comment-list")),
    "share": (("div", "ul"), ("share", "social", "sharing", "follow", "buttons", "toolbar")),
}
BODIES = (("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "main"), ("section", "story"), ("div", "post-body"), ("div", "text"))


def labelled_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and the labels of its leaf blocks."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick("abcdefghilmnoprstuvéñ") for _ in range(int(rng.integers(2, 9))))

    def sentence() -> str:
        return " ".join(word() for _ in range(int(rng.integers(1, 16)))).capitalize() + pick(("." * 1, ".", "!", "?", ""))

    parts, y = ["<!DOCTYPE html><html><head><title>x</title></head><body>"], []

    def furniture(kind: str) -> None:
        tags, names = FURNITURE[kind]
        tag, name = pick(tags), pick(names)
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        parts.append(f"<{tag}>" if bare else f'<{tag} {pick(("class", "id", "class"))}="{name}">')
        n = int(rng.integers(1, 6))
        if kind in ("menu", "share") or (kind in ("sidebar", "footer") and rng.random() < 0.5):
            parts.append("<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n)) + "</ul>")
            y.extend([0] * n)
        elif kind == "form":
            parts.append(f'<label>{word()}</label><input name="q"><button>{word()}</button>')
            y.extend([0] * 2)
        elif rng.random() < 0.3:
            parts.append(f"&copy; {sentence()}" if kind == "footer" else sentence())
            y.append(0)
        else:
            for _ in range(n):
                parts.append(f"<{(t := pick(('p', 'div', 'h3', 'p')))}>{sentence()} {sentence()}</{t}>")
                y.append(0)
        parts.append(f"</{tag}>")

    before = [k for k in ("menu", "header", "notice", "advert", "sidebar", "form") if rng.random() < 0.5]
    after = [k for k in ("comments", "share", "sidebar", "form", "advert", "notice", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    for k in before:
        furniture(k)
    outer = rng.random() < 0.3
    parts.append('<div class="wrapper"><div class="container">' if outer else "")
    tag, name = pick(BODIES)
    parts.append(f'<{tag} class="{name}">' if name else f"<{tag}>")
    inner = rng.random() < 0.2
    parts.append(("<header>" if inner else "") + f"<h1>{sentence()}</h1>" + ("</header>" if inner else ""))
    y.append(1)
    for _ in range(int(rng.integers(1, 12))):
        r = rng.random()
        if r < 0.12:
            furniture(pick(("advert", "share", "notice", "advert", "comments")))
        elif r < 0.2:
            parts.append(f"<h2>{sentence()}</h2>")
            y.append(1)
        elif r < 0.27:
            n = int(rng.integers(1, 5))
            parts.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(n)) + "</ul>")
            y.extend([1] * n)
        elif r < 0.32:
            parts.append(f"<blockquote>{sentence()}</blockquote>")
            y.append(1)
        else:
            text = " ".join(sentence() for _ in range(int(rng.integers(1, 5))))
            parts.append(f'<p><a href="#">{word()}</a> {text}' if rng.random() < 0.1 else f"<p>{text}</p>")
            y.append(1)
    if rng.random() < 0.3:
        furniture("comments")
    parts.append(f"</{tag}>" + ("</div></div>" if outer else ""))
    for k in after:
        furniture(k)
    parts.append("</body></html>")
    return "".join(parts), y


def labelled_pages(n: int, seed: int) -> tuple[list[list[list[str]]], list[list[int]]]:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    while len(xs) < n:
        page, y = labelled_page(rng)
        found = blocks(page)
        if len(found) == len(y):
            xs.append(block_features(found))
            ys.append(y)
    return xs, ys


def train(n: int = 1500, seed: int = 17) -> Chain:
    chain = Chain()
    chain.fit(*labelled_pages(n, seed))
    return chain


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page, chain.weights)
    return "\n".join(b.text for b, y in zip(found, chain.decode(block_features(found))) if y)


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    A null or empty html gives an empty text, and so does a page of furniture alone.  White
    space (as Unicode has it) inside a block becomes one space.  Null ids and urls keep their
    null; repeated rows are extracted each.
    """
    model = pages.sparkSession.sparkContext.broadcast(chain or train())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for html in batches:
            yield pd.Series([main_text(h, model.value) for h in html], dtype=object)
        release()

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
