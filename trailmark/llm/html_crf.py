"""Main text of web pages by a conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: maximal runs of text within
one block-level element, in page order.  Each has features of its ancestors
(tags, words of class, id and role) and of its text; a linear-chain
conditional random field, trained on labelled pages, says which of them are
the article, and Viterbi decoding gives the best labelling of the whole page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_batches

# Element names of HTML, and of MathML and SVG where they stand in a line.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics svg g text tspan""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are cut out whole: scripts, styles and what forms hold.
CUT = frozenset("script style template select textarea".split())
#: An opening tag of the key closes an open element of these names, up to one of the fences.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Open elements that a missing end tag is looked for in, and that a block has features of.
NEAREST = 64
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A leaf block: its text, the features of its ancestors, and how many of
    its characters are in links.
    """

    text: str
    above: frozenset[str]
    parent: str
    linked: int


def _name_words(attributes: str) -> frozenset[str]:
    found: set[str] = set()
    for m in NAMED.finditer(attributes):
        found.update("w:" + w.lower() for w in NAME_WORD.findall(m[1] or m[2] or m[3] or ""))
    return frozenset(found)


class Tags:
    """Cuts a page into texts and tags in one pass.

    A ``>`` within quotes belongs to an attribute.  Once a quote turns out to
    be open to the end of the page, quotes count for nothing from there on, so
    no character is looked at again and again.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``."""
        page = self.page
        if self.quotes:
            k = at
            while True:
                m = STOP.search(page, k)
                if m is None:
                    break
                if m[0] == ">":
                    return m.start()
                k = page.find(m[0], m.end()) + 1
                if not k:
                    break
            self.quotes = False
        return page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """``(text before, name in lower case, whether it ends, attributes)``;
        the name is empty where only text or a comment stands.
        """
        page, at, kept = self.page, 0, 0
        while True:
            at = page.find("<", at)
            if at < 0 or at > self.last and not page.startswith("<!--", at):
                yield page[kept:], "", False, ""
                return
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                yield page[kept:at], "", False, ""
                at = kept = stop + 3 if stop >= 0 else len(page)
                continue
            if page[at + 1] in "!?":
                yield page[kept:at], "", False, ""
                at = kept = page.find(">", at) + 1
                continue
            m = TAG_NAME.match(page, at + 1)
            stop = self.end(m.end()) if m else -1
            if stop < 0:  # a bare sign
                at += 1
                continue
            yield page[kept:at], m[2].lower(), bool(m[1]), page[m.end() : stop]
            at = kept = stop + 1
            if not m[1] and m[2].lower() in CUT and page[stop - 1] != "/":
                found = CLOSING[m[2].lower()].search(page, at)
                at = kept = found.end() if found else len(page)


CLOSING = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in CUT}


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order; none of a null or empty page."""
    if not page:
        return []
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []  # open elements with their own features
    above: list[frozenset[str]] = []  # what blocks at the current place are in
    open_: Counter = Counter()
    parts: list[str] = []
    linked = in_link = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                if not above:
                    above.append(frozenset().union(*(own for _, own in stack[-NEAREST:])))
                blocks.append(Block(text, above[0], stack[-1][0] if stack else "", linked))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        for name, _ in stack[to:]:
            open_[name] -= 1
        del stack[to:]
        above.clear()

    def close(names: tuple[str, ...], fences: tuple[str, ...] = (), most: int | None = None) -> None:
        if not any(open_[n] for n in names):
            return
        for k in range(len(stack) - 1, -1 if most is None else max(-1, len(stack) - 1 - most), -1):
            if stack[k][0] in names:
                pop(k)
                return
            if stack[k][0] in fences:
                return

    for text, name, ends, attributes in Tags(page):
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not name or name in CUT:
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if ends else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            continue
        end_block()
        in_link = 0
        if ends:
            close((name,))
            continue
        if name in CLOSES:
            close(*CLOSES[name], NEAREST)
        elif stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        own = frozenset(("t:" + name,))
        stack.append((name, own | _name_words(attributes) if attributes else own))
        open_[name] += 1
        above.clear()
    end_block()
    return blocks


def features(blocks: list[Block]) -> list[set[str]]:
    """Features of each block of a page."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        f = set(b.above)
        f.add("parent:" + b.parent)
        f.add(f"len:{min(8, words.bit_length())}")
        f.add(f"links:{min(4, 4 * b.linked // n)}")
        f.add("end:" + ("." if b.text[-1] in ".!?…:;\"'»”。！？" else "a" if b.text[-1].isalnum() else "x"))
        f.add(f"stops:{min(3, b.text.count('. ') + b.text.count(', '))}")
        f.add("first" if i == 0 else "last" if i == len(blocks) - 1 else "inner")
        f.add("start:" + ("A" if b.text[0].isupper() else "a" if b.text[0].islower() else "x"))
        if "©" in b.text:
            f.add("copyright")
        if "t:head" in f or "t:title" in f:
            f.add("in head")
        out.append(f)
    return out


@dataclass(frozen=True)
class ChainField:
    """Weights of (feature, label) and (label, next label); label 1 is article."""

    weights: dict[str, tuple[float, float]]
    step: tuple[tuple[float, float], tuple[float, float]]

    def viterbi(self, page: list[set[str]]) -> list[int]:
        """The best labelling; ties go to label 0."""
        get, none = self.weights.get, (0.0, 0.0)
        (s00, s01), (s10, s11) = self.step
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, f in enumerate(page):
            e0 = e1 = 0.0
            for name in f:
                w = get(name, none)
                e0 += w[0]
                e1 += w[1]
            if i:
                x0, y0, x1, y1 = a + s00, b + s10, a + s01, b + s11
                back.append((int(y0 > x0), int(y1 > x1)))
                a, b = max(x0, y0) + e0, max(x1, y1) + e1
            else:
                a, b = e0, e1
        labels = [int(b > a)] if page else []
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def train(pages: Iterable[tuple[list[set[str]], list[int]]], epochs: int = 8, rate: float = 0.3, l2: float = 1e-3, seed: int = 4) -> ChainField:
    """Maximise the conditional likelihood of labelled pages by AdaGrad."""
    pages = [(f, y) for f, y in pages if f]
    index: dict[str, int] = {}
    seqs = [([np.array([index.setdefault(x, len(index)) for x in sorted(f)]) for f in fs], np.array(y)) for fs, y in pages]
    w, step = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gs = np.full_like(w, 1e-8), np.full_like(step, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(seqs)):
            ids, y = seqs[k]
            n = len(ids)
            emit = np.array([w[i].sum(axis=0) for i in ids])
            fwd, bwd = emit.copy(), np.zeros((n, 2))
            for i in range(1, n):
                fwd[i] += np.logaddexp(fwd[i - 1, 0] + step[0], fwd[i - 1, 1] + step[1])
            for i in range(n - 2, -1, -1):
                nxt = emit[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(step[:, 0] + nxt[0], step[:, 1] + nxt[1])
            z = np.logaddexp(*fwd[-1])
            delta = -np.exp(fwd + bwd - z)
            delta[np.arange(n), y] += 1
            pair = np.exp(fwd[:-1, :, None] + step + (emit[1:] + bwd[1:])[:, None, :] - z)
            ds = -pair.sum(axis=0)
            np.add.at(ds, (y[:-1], y[1:]), 1)
            for i, d in zip(ids, delta, strict=True):
                g = d - l2 * w[i]
                gw[i] += g * g
                w[i] += rate * g / np.sqrt(gw[i])
            gs += ds * ds
            step += rate * ds / np.sqrt(gs)
    return ChainField({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, tuple(map(tuple, step.tolist())))


class PageMaker:
    """Makes labelled pages: usual layouts and names, filled with made-up words.

    Articles come in ``article``, ``main`` and in named or nameless containers;
    around and within them stand menus, banners, notices, adverts, forms,
    sidebars, comments and footers.
    """

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.main: set[str] = set()

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return "".join(self.pick("ka", "lo", "mi", "ter", "an", "é", "sch", "ung", "re", "on", "qu", "ión") for _ in range(self.rng.integers(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.integers(low, high + 1)))

    def sentences(self, low: int, high: int) -> str:
        style = self.rng.random()
        made = []
        for _ in range(self.rng.integers(low, high + 1)):
            s = self.words(1, 14).capitalize() + self.pick(".", ".", ".", "!", "?")
            s = s.replace(" ", ", ", 1) if self.chance(0.3) else s
            made.append(s.upper() if style < 0.06 else re.sub(r"(\w)( |$)", r"\1***\2", s) if style < 0.12 else s.replace(" ", " | ") if style < 0.16 else s)
        return " ".join(made)

    def body(self, text: str) -> str:
        """Text of the article."""
        self.main.add(" ".join(text.split()))
        return html.escape(text, quote=False)

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.rng.integers(low, high + 1)))

    def named(self, tag: str, names: str, inner: str) -> str:
        how = self.pick("class", "class", "id")
        return f'<{tag} {how}="{self.pick(*names.split())}">{inner}</{tag}>'

    def aside_text(self) -> str:
        return self.pick(self.sentences(1, 3), self.words(2, 8))

    def advert(self) -> str:
        return self.named("div", "ad ads advert ad-banner sponsored promo advertisement", self.pick(self.aside_text(), f"<p>{self.aside_text()}</p>", f'<a href="/x">{self.words(2, 6)}</a>'))

    def notice(self) -> str:
        return self.named("div", "cookie-notice notice consent cookie-banner gdpr alert popup newsletter", f"<p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>")

    def form(self) -> str:
        return f"<form><label>{self.words(1, 3)}</label><input name=q><p>{self.words(1, 6)}</p><button>{self.word()}</button></form>"

    def menu(self) -> str:
        inner = f"<ul>{self.links(2, 8)}</ul>"
        return self.pick(f"<nav>{inner}</nav>", self.named("div", "nav menu navbar navigation breadcrumbs topnav", inner), f"<header>{self.words(1, 4)}{inner}</header>", self.named("ul", "menu nav tabs", self.links(2, 8)))

    def sidebar(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.pick(f"<ul>{self.links(3, 7)}</ul>", f"<p>{self.sentences(1, 2)}</p>")
        return self.pick(f"<aside>{inner}</aside>", self.named("div", "sidebar related widget recommended right-column trending", inner))

    def comments(self) -> str:
        one = lambda: self.named("div", "comment comment-body reply", f"<b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p>")
        inner = f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(self.rng.integers(1, 5)))
        return self.pick(self.named("section", "comments responses discussion", inner), self.named("div", "comments comment-list disqus_thread comments-area", inner))

    def footer(self) -> str:
        inner = self.pick(f"&copy; {self.word()}.example.com &middot; {self.aside_text()}", f"<p>&copy; 20{self.rng.integers(10, 30)} {self.words(1, 4)}</p>", f"<ul>{self.links(2, 5)}</ul>{self.sentences(1, 2)}", self.sentences(1, 2))
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", self.named("div", "footer site-footer copyright bottom", inner))

    def paragraph(self) -> str:
        text = self.body(self.sentences(1, self.pick(1, 3, 8)))
        kind = self.rng.random()
        if kind < 0.08:
            return f"<ul>{''.join(f'<li>{self.body(self.words(2, 12))}</li>' for _ in range(3))}</ul>"
        if kind < 0.14:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.18:
            return f"<pre>{text}</pre>"
        if kind < 0.24:
            return f"<h2>{self.body(self.words(1, 6).capitalize())}</h2>"
        if kind < 0.28:
            return f"<table><tr><td>{self.body(self.words(1, 5))}</td><td>{self.body(self.words(1, 5))}</td></tr></table>"
        if kind < 0.33:
            return self.pick(f"<div>{text}</div>", f"<div>{text}</div>", f"<noscript><p>{text}</p></noscript>", f"<figure><figcaption>{text}</figcaption></figure>")
        if kind < 0.43:
            return f"<p><b>{text}<br>"
        return f"<p>{text}{self.pick('</p>', '</p>', '</p>', '')}"

    def article(self) -> str:
        title = self.words(1, 9).capitalize()
        parts = [self.pick(f"<h1>{self.body(title)}</h1>", f"<h1>{self.body(title)}</h1>", f"<header><h1>{self.body(title)}</h1></header>", "")]
        for _ in range(self.rng.integers(1, 9)):
            parts.append(self.paragraph())
            if self.chance(0.08):
                parts.append(self.pick(self.advert, self.form, self.sidebar, self.notice)())
        if self.chance(0.25):
            parts.append(self.comments())
        inner = "".join(parts)
        kind = self.rng.random()
        if kind < 0.45:
            return f"<article>{inner}</article>"
        if kind < 0.6:
            return f"<main>{inner}</main>"
        if kind < 0.9:
            return self.named("div", "content article post entry-content article-body story main-content text page-content", inner)
        return f"<div>{inner}</div>"

    def page(self) -> tuple[str, set[str]]:
        """A page and the texts of its article blocks."""
        self.main = set()
        above = [f() for f, p in ((self.menu, 0.9), (self.advert, 0.5), (self.notice, 0.3), (self.form, 0.2), (self.sidebar, 0.2)) if self.chance(p)]
        middle = self.article()
        below = [f() for f, p in ((self.comments, 0.3), (self.sidebar, 0.3), (self.advert, 0.2), (self.form, 0.1), (self.notice, 0.1)) if self.chance(p)]
        below.append(self.footer())
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(above)}{middle}{''.join(below)}</body></html>", self.main


def labelled_pages(n: int = 240, seed: int = 40) -> list[tuple[list[set[str]], list[int]]]:
    """Features and labels of ``n`` made pages."""
    maker, out = PageMaker(seed), []
    for _ in range(n):
        page, main = maker.page()
        blocks = leaf_blocks(page)
        out.append((features(blocks), [int(b.text in main) for b in blocks]))
    return out


def main_text(page: str | None, field: ChainField) -> str:
    """The article of a page, blocks joined by a space."""
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, y in zip(blocks, field.viterbi(features(blocks)), strict=True) if y)


def with_main_text(pages: DataFrame, field: ChainField | None = None, html_col: str = "html", out: str = "main") -> DataFrame:
    """``pages`` with a struct (``out``) of ``text``, the whole article, and
    ``n_chars``, its code points.

    Null and empty pages, and pages without an article, have an empty text.
    Without ``field`` one is trained on made pages first.
    """
    text_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(field or train(labelled_pages()))

    @F.pandas_udf("text string, n_chars long")
    def extract(htmls: pd.Series) -> pd.DataFrame:
        texts = [main_text(h if isinstance(h, str) else None, held.value) for h in htmls]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return pages.withColumn(out, extract(quoted(html_col)))


def token_f1(found: str, wanted: str) -> float:
    """Overlap of the words of two texts, repeats counted."""
    a, b = pd.Series(found.split()).value_counts(), pd.Series(wanted.split()).value_counts()
    both = int(pd.concat((a, b), axis=1).min(axis=1, skipna=False).fillna(0).sum()) if len(a) and len(b) else 0
    total = int(a.sum() + b.sum())
    return 2 * both / total if total else 1.0 if math.isclose(len(found), len(wanted)) else 0.0
