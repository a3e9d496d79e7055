"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into blocks, the text between block-level tags, in page order. Scripts, styles, the head and controls make no
blocks; character references are decoded, runs of white space become one space. Features of a
block are the tags of its ancestors, the words of their class and id, its own length, punctuation, share of
links and place. The field has two labels, content and the rest; it is trained once a process, by gradient ascent on
the likelihood, on labelled pages that ``labelled()`` composes from many layouts (seeded, ``PAGES``
of them), and pages are decoded by Viterbi. Content blocks are joined by one space.

Null and empty pages, and pages without content, give the empty text; an empty table gives no rows. Nothing is cut or capped,
in depth, length or attributes: an element's end is found by a list of the open elements of its tag. Repeated rows each have
their result; ids and urls may be null and are passed through; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import emit, small_batches

PAGES, STEPS = 400, 120
MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics"
INLINE = frozenset(f"{MATH} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())  # formulas run on in their sentence
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg select textarea button option iframe object canvas audio video annotation annotation-xml".split())
#: Which open elements a start tag ends, where their end tags may be left out.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Elements that an implied end does not reach beyond.
SCOPE = frozenset("ul ol dl table article section div main aside nav header footer form blockquote body".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    share = linked / max(1, len(text))
    out = [f"words:{min(words.bit_length(), 7)}", f"links:{0 if share == 0 else 1 if share < 0.5 else 2}"]
    out.append("stop" if text[-1:] in ".!?…»\"" else "open")
    if "©" in text:
        out.append("rights")
    if text.count(",") + text.count(". ") > 2:
        out.append("prose")
    return out


class Blocks(HTMLParser):
    """Collects (features, text) of the blocks of a page; features that ``known`` lacks are left out."""

    def __init__(self, known: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.found: list[tuple[list[str], str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.active: dict[str, int] = {}
        #: Where each tag's open elements are, so that the last one is found however deep it is.
        self.depth: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.silent: list[str] = []
        self.links = 0
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                own = text_features(text, self.linked)
                parent = f"in:{self.open[-1][0]}" if self.open else "in:"
                self.found.append(([*self.active, parent, *own], text))
            self.parts = []
        self.linked = 0

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        names = [f"tag:{tag}"]
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                names += [f"name:{w}" for w in _WORD.findall(v.lower())]
        names = [n for n in set(names) if self.known is None or n in self.known]
        for n in names:
            self.active[n] = self.active.get(n, 0) + 1
        self.depth.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, names))

    def _pop(self) -> None:
        tag, names = self.open.pop()
        self.depth[tag].pop()
        for n in names:
            if self.active[n] == 1:
                del self.active[n]
            else:
                self.active[n] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in SILENT:
            if tag == "body" or not self.silent or self.silent[-1] == tag:
                self.silent.append(tag)
            return
        if tag == "body":
            self.silent = []
        if tag in INLINE:
            self.links += tag == "a"
            return
        if self.silent and self.silent[0] == "head" and tag not in VOID:
            self.silent = []  # an unclosed head ends where the body's content begins
        self.flush()
        if tag in VOID:
            return
        ends = ENDS.get(tag, {"p"})
        while self.open and self.open[-1][0] in ends:
            self._pop()
        if tag == "li":
            self._close("li", SCOPE)
        self._push(tag, attrs)

    def _close(self, tag: str, scope: frozenset[str] = frozenset()) -> None:
        """Ends the last open element of a tag, unless one of ``scope`` is open within it."""
        at = self.depth.get(tag)
        if at and not any(self.depth[t][-1] > at[-1] for t in scope if self.depth.get(t)):
            start = at[-1]
            while len(self.open) > start:
                self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            if tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        if tag in VOID:
            return
        self.flush()
        self.links = 0
        self._close(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


def blocks(html: str | None, known: frozenset[str] | None = None) -> list[tuple[list[str], str]]:
    p = Blocks(known)
    p.feed(html or "")
    p.close()
    p.flush()
    n = len(p.found)
    for i, (names, _) in enumerate(p.found):
        names.append("first" if i == 0 else "last" if i == n - 1 else "middle")
    return p.found


# Labelled pages


def _words(r: random.Random, n: int, end: str = "") -> str:
    syllables = ("ta", "ren", "of", "mi", "lo", "és", "der", "un", "ki", "pa", "the", "sch", "on", "que")
    out = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for i in range(4, n - 1, 9):
        out[i] += r.choice([",", ".", ""])
    return " ".join(out).capitalize() + end


def labelled(r: random.Random) -> tuple[str, list[str]]:
    """A page in a random layout, and the texts of its content blocks in order."""
    pick, say = r.choice, lambda a, b, end="": _words(r, r.randint(a, b), end)
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return text

    def links(n: int) -> str:
        return "".join(f"<li><a href='/x'>{say(1, 3)}</a></li>" for _ in range(n))

    def side(names: list[str], tags: list[str], inner: str) -> str:
        tag = pick([t for t in tags if t != "p" or not inner.startswith("<p")])
        own = f" {pick(['class', 'class', 'id'])}=\"{pick(names)}\"" if tag in ("div", "section", "ul", "p", "ol") or r.random() < 0.4 else ""
        return f"<{tag}{own}>{inner}</{tag}>"

    def menu(n: int) -> str:
        """Links of a menu as a list, a table or one line."""
        kind = r.random()
        if kind < 0.65:
            return f"<ul>{links(n)}</ul>"
        own = [f"<a href='/x'>{say(1, 3)}</a>" for _ in range(n)]
        return "<table><tr>" + "".join(f"<td>{x}</td>" for x in own) + "</tr></table>" if kind < 0.85 else pick([" | ", " ", " · "]).join(own)

    def sentence(text: str) -> str:
        """The text with a link or emphasis around some of its words; characters stay."""
        words = text.split(" ")
        if len(words) < 3 or r.random() < 0.6:
            return text
        i = r.randrange(len(words) - 1)
        j = r.randint(i + 1, len(words) - 1)
        tag = pick(["a", "a", "em", "b", "code"])
        return " ".join([*words[:i], f"<{tag}" + (" href='/y'" if tag == "a" else "") + ">" + " ".join(words[i:j]) + f"</{tag}>", *words[j:]])

    def prose(n: int) -> str:
        return "".join(f"<p>{say(1, 70, pick(['.', '.', '!']))}</p>" for _ in range(n))

    nav = lambda: side(["nav", "menu", "main-menu", "navbar", "breadcrumb", "navigation"], ["nav", "nav", "div"], menu(r.randint(2, 8)))
    head = lambda: side(["header", "site-header", "masthead", "topbar", "branding"], ["header", "header", "div"], pick([say(1, 6), f"<h1>{say(1, 4)}</h1>", f"<p>{say(2, 12)}</p>", f"<a href='/'>{say(1, 3)}</a>"]))
    foot = lambda: side(["footer", "site-footer", "copyright", "bottom", "legal"], ["footer", "footer", "div"], pick(["&copy; ", ""]) + pick([say(1, 9, "."), f"<p>{say(3, 25, '.')}</p>", f"<ul>{links(4)}</ul>"]))
    ad = lambda: side(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "sponsor"], ["div", "aside", "section", "p"], pick([say(1, 30, pick([".", "!", ""])), prose(1), f"<p>{say(2, 9)}</p>"]))
    notice = lambda: side(["notice", "cookie", "cookie-notice", "banner", "alert", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe"], ["div", "section", "aside"], pick([say(3, 40, "."), prose(1), f"<p>{say(4, 30, '.')} <a href='#'>{say(1, 2)}</a></p>"]))
    bar = lambda: side(["sidebar", "side", "widget", "related", "share", "social", "recommended", "trending", "toc", "tags"], ["aside", "aside", "div", "section"], pick([prose(r.randint(1, 2)), f"<h3>{say(1, 4)}</h3><ul>{links(4)}</ul>", f"<h2>{say(1, 3)}</h2><p>{say(3, 30, '.')}</p>"]))
    form = lambda: side(["form", "search", "login", "signup"], ["form", "form", "div"], f"<label>{say(1, 4)}</label><input><p>{say(1, 12)}</p><button>{say(1, 2)}</button>")
    talk = lambda: side(["comments", "comment-list", "comment", "replies", "discussion", "respond", "disqus", "disqus_thread", "comments-area", "reader-comments"], ["section", "div", "ol"], f"<h3>{say(1, 3)}</h3>" * r.randint(0, 1) + "".join(pick([f"<div class='comment'><p>{say(2, 50, '.')}</p></div>", f"<li class='comment'><p>{say(2, 50, '.')}</p></li>", f"<article class='comment'><p>{say(2, 50, '.')}</p></article>", f"<p>{say(2, 50, '.')}</p>", f"<div>{say(2, 30, '.')}</div>"]) for _ in range(r.randint(1, 4))))

    def body() -> str:
        parts = [f"<h1>{keep(say(1, 9, pick(['', '.'])))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(0 if parts else 1, 7)):
            kind = r.random()
            if kind < 0.72:
                t = keep(say(1, pick([4, 20, 90]), pick([".", ".", "!", ""])))
                t = sentence(t)
                parts.append(pick([f"<p>{t}</p>", f"<p>{t}</p>", f"<p class='{pick(['lead', 'first', 'x', 'indent'])}'>{t}</p>", f"<p>{t}", f"<p><b>{t}</b><br>", f"<div>{t}</div>"]))
            elif kind < 0.8:
                parts.append(f"<h2>{keep(say(1, 6))}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{keep(say(1, 12))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote>{keep(say(3, 30, '.'))}</blockquote>")
            elif kind < 0.93:
                parts.append(f"<table><tr><td>{keep(say(1, 4))}</td><td>{keep(say(1, 4))}</td></tr></table>")
            else:
                parts.append(pick([ad, bar, notice, form])())
        return "".join(parts)

    much = r.choice([0.15, 0.5, 0.5])
    before = [f() for f in (nav, head, ad, notice, bar, form) if r.random() < much]
    r.shuffle(before)
    wrap = r.random()
    if wrap < 0.45:
        own = f"<article>{body()}</article>"
    elif wrap < 0.58:
        own = f"<main>{body()}</main>"
    elif wrap < 0.84:
        own = f"<div {pick(['class', 'id'])}=\"{pick(['content', 'post', 'entry', 'article', 'story', 'main', 'article-body', 'post-content', 'text', 'body'])}\">{body()}</div>"
    else:
        own = body()
    if r.random() < 0.2 and wrap < 0.45:
        own = f"<main>{own}</main>"
    if r.random() < 0.25 and own.endswith("</article>"):
        own = own[: -len("</article>")] + talk() + "</article>"
    after = [f() for f in (talk, bar, ad, form, notice, foot, foot) if r.random() < 0.8 * much]
    inner = "".join(before) + own + "".join(after)
    if r.random() < 0.3:
        inner = f"<div class=\"{pick(['page', 'wrapper', 'container', 'site'])}\">{inner}</div>"
    top = f"<head><title>{say(1, 5)}</title>{pick(['', '<style>p {}</style>', '<script>let x = 1;</script>'])}</head>" if r.random() < 0.8 else ""
    return f"<html>{top}<body>{inner}</body></html>", kept


# The field


class Field:
    """Weights of features and of neighbouring labels; label 1 is content."""

    def __init__(self, names: list[str], weights: np.ndarray, steps: np.ndarray):
        self.index = {n: i for i, n in enumerate(names)}
        self.known = frozenset(names)
        self.weights = weights  # features x 2
        self.steps = steps  # 2 x 2

    def scores(self, found: list[tuple[list[str], str]]) -> np.ndarray:
        out = np.zeros((len(found), 2))
        for i, (names, _) in enumerate(found):
            at = [self.index[n] for n in names if n in self.index]
            out[i] = self.weights[at].sum(0)
        return out

    def decode(self, s: np.ndarray) -> list[int]:
        """The best labels for the scores of a page's blocks (Viterbi)."""
        (t00, t01), (t10, t11) = self.steps.tolist()
        back = []
        a, b = s[0].tolist() if len(s) else (0.0, 0.0)
        for x, y in s[1:].tolist():
            a0, b0, a1, b1 = a + t00, b + t10, a + t01, b + t11
            back.append((int(b0 > a0), int(b1 > a1)))
            a, b = max(a0, b0) + x, max(a1, b1) + y
        label = int(b > a)
        out = [label] * min(1, len(s))
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def extract(self, html: str | None) -> str:
        found = blocks(html, self.known)
        labels = self.decode(self.scores(found))
        return " ".join(t for (_, t), y in zip(found, labels, strict=True) if y)


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, penalty: float = 1e-3) -> Field:
    """Trains on (features of each block, labels) of pages by Adam on the regularised log-likelihood."""
    names = sorted({n for p, _ in pages for f in p for n in f})
    index = {n: i for i, n in enumerate(names)}
    pages = [p for p in pages if p[1]]
    longest, n = max(len(y) for _, y in pages), len(pages)
    x = np.zeros((n, longest, len(names)))
    y = np.zeros((n, longest), int)
    here = np.zeros((n, longest), bool)
    for i, (p, labels) in enumerate(pages):
        for j, f in enumerate(p):
            x[i, j, [index[k] for k in f]] = 1
        y[i, : len(labels)] = labels
        here[i, : len(labels)] = True
    flat, both = x[here], here[:, 1:]
    truth = np.eye(2)[y]
    want = np.zeros((2, 2))
    np.add.at(want, (y[:, :-1][both], y[:, 1:][both]), 1)
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(t), np.zeros_like(t))]

    def total(v: np.ndarray, axis: int) -> np.ndarray:
        m = v.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for k in range(1, steps + 1):
        s = np.zeros((n, longest, 2))
        s[here] = flat @ w
        fwd, bwd = s.copy(), np.zeros_like(s)
        for j in range(1, longest):
            new = total(fwd[:, j - 1, :, None] + t, 1) + s[:, j]
            fwd[:, j] = np.where(here[:, j, None], new, fwd[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = total(t + (s[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
            bwd[:, j] = np.where(here[:, j + 1, None], new, 0)
        z = total(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        pair = np.exp(fwd[:, :-1, :, None] + t + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])[both]
        grads = [flat.T @ (truth - p)[here] / n - penalty * w, (want - pair.sum(0)) / n - penalty * t]
        for v, g, (m1, m2) in zip((w, t), grads, state, strict=True):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            v += 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
    return Field(names, w, t)


@cache
def trained(pages: int = PAGES, steps: int = STEPS, seed: int = 7) -> Field:
    r = random.Random(seed)
    data = []
    for _ in range(pages):
        html, kept = labelled(r)
        found, want, labels = blocks(html), iter([*kept, None]), []
        nxt = next(want)
        for _, text in found:
            hit = text == nxt
            labels.append(int(hit))
            if hit:
                nxt = next(want)
        assert nxt is None, "a content block was not found again"
        data.append(([f for f, _ in found], labels))
    return fit(data, steps)


def _extractor(field: Field):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [field.extract(h) for h in b.column("html").to_pylist()]
            yield emit({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(got, pa.string()), "n_chars": pa.array(list(map(len, got)), pa.int64())})

    return extract


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extractor(trained()), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
