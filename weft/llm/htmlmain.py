"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded top-down.

A page becomes a tree of block elements (inline elements add to the block they stand in). Each node has features: its tag,
attribute tokens of its own and of its ancestors, depth, place among its siblings and how they compare, and the density of its
subtree (text, links, tags, punctuation). Boosted trees give each node a probability of main text. The decoder then chooses one
consistent labelling: below a node that is left out everything is left out, and of all such labellings the one with the
greatest weighted log-likelihood is taken, in one pass up and one down the tree.

The trees are trained here, by numpy, on pages whose nodes have known labels: text of a bounded sample of pages (``TRAIN_PAGES`` rows of at
most ``TRAIN_CHARS`` characters, the least by a hash of page_id and text, documented bounds) is laid out in many page designs with and without telling tags and
attributes, half of them with little or nothing around a short article; the sampled pages that mark their article (or main) element themselves
are trained on as they are, too.

Text that a page hides (``hidden``, ``display: none``) is read like any other: style sheets aren't worked out.

Text of kept nodes: character references decoded, white space inside a block made one space and trimmed, blocks in page order joined by a line feed.

Cases: a null or empty page gives an empty text; a page without mark-up is one block; pages are read whole; broken or cut-off mark-up is read as far as it makes sense;
repeated rows give equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._batches import small_batches
from weft.session import table

TRAIN_PAGES, TRAIN_CHARS, TRAIN_LAYOUTS, PAGE_WEIGHT, TREES, DEPTH, RATE, MAX_DEPTH = 120, 500_000, 700, 60, 70, 4, 0.25, 32
_SKIP = frozenset(("script", "style", "noscript", "template", "head", "iframe", "svg", "object", "textarea", "select", "option", "button", "canvas", "audio", "video", "dialog"))
#: What a head may hold; any other start tag, and text, ends it, as </head> may be left out.
_IN_HEAD = _SKIP - {"head"} | {"base", "basefont", "bgsound", "link", "meta", "noframes"}
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_BLOCK = (
    "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "header", "footer", "nav", "aside",
    "form", "fieldset", "legend", "label", "address", "details", "summary", "hgroup", "center", "menu",
)
_IS_BLOCK = frozenset(_BLOCK)
#: A start tag of the key closes an open element of the values, inside the nearest of the scopes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "menu", "body", "html"))
_CLUES = (
    ("article", "content", "story", "post", "entry", "main", "body", "text", "prose", "read"),
    ("nav", "menu", "breadcrumb", "breadcrumbs", "toolbar", "tabs", "navbar", "pagination", "pager", "toc"),
    ("header", "masthead", "banner", "logo", "top", "branding", "head"),
    ("footer", "foot", "bottom", "copyright", "legal", "colophon", "contentinfo"),
    ("sidebar", "side", "aside", "rail", "widget", "complementary", "secondary"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense", "teaser"),
    ("cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "banner", "privacy", "warning", "paywall", "dialog"),
    ("form", "subscribe", "newsletter", "signup", "login", "search", "register", "contact", "input"),
    ("comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "thread", "reader", "readers", "commentlist"),
    ("related", "share", "sharing", "social", "recommended", "more", "tags", "popular", "trending", "meta", "byline", "author"),
)
_CLUE = [frozenset(c) for c in _CLUES]
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "clues", "parent", "children", "items", "label", "own", "links", "linked", "inputs", "index", "kept")

    def __init__(self, tag: str, clues: tuple, parent: Node | None) -> None:
        self.tag, self.clues, self.parent, self.label = tag, clues, parent, None
        self.children: list[Node] = []
        self.items: list = []  # text pieces and child nodes, in order
        self.own = self.links = self.linked = self.inputs = 0
        self.index, self.kept = 0, True


class _Events(HTMLParser):
    """(kind, tag or text, attributes) of a page in order; kind 0 is a start tag, 1 an end tag, 2 text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append((0, tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.events.append((1, tag, None))

    def handle_data(self, data: str) -> None:
        self.events.append((2, data, None))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown keyword, or none: a comment up to '>', as in HTML
            return self.parse_bogus_comment(i, report)


def _left_open(events: list[tuple]) -> set[int]:
    """Places of the start tags of skipped elements that no end tag closes."""
    opens: dict[str, list[int]] = {}
    for i, (kind, tag, _) in enumerate(events):
        if kind < 2 and tag in _SKIP:
            if kind == 0:
                opens.setdefault(tag, []).append(i)
            elif opens.get(tag):
                opens[tag].pop()
    return {i for found in opens.values() for i in found}


class _Tree:
    def __init__(self) -> None:
        self.root = self.at = Node("html", (0,) * len(_CLUES), None)
        self.nodes = [self.root]
        self.skipping: list[str] = []
        self.loose = False  # what is skipped last has no end tag, so it ends with the next block or skipped element
        self.anchor = 0

    def read(self, events: list[tuple]) -> None:
        loose = _left_open(events)
        for i, (kind, name, attrs) in enumerate(events):
            if kind == 0:
                self.start(name, attrs, i in loose)
            elif kind == 1:
                self.end(name)
            else:
                self.data(name)

    def _unskip(self) -> None:
        self.skipping.pop()
        self.loose = False

    def start(self, tag: str, attrs: list, loose: bool) -> None:
        if self.loose and (tag in _IS_BLOCK or tag in _SKIP):
            self._unskip()
        if self.skipping and self.skipping[-1] == "head" and tag not in _IN_HEAD:
            if tag == "title":
                self.skipping.append(tag)
                return
            self._unskip()
        if self.skipping and self.skipping[-1] == "title" and tag == "body":
            self.skipping.clear()
        if tag in _SKIP:
            if tag == "head":
                if not self.skipping:
                    self.skipping.append(tag)
            elif not self.skipping or self.skipping[-1] == "head" or not loose:
                self.skipping.append(tag)
                self.loose = loose
            return
        if self.skipping:
            return
        if tag == "a":
            self.anchor = 1
            self.at.links += 1
        if tag == "br":
            self.at.items.append(" ")
        if tag == "input":
            self.at.inputs += 1
        if tag not in _IS_BLOCK or tag == "html":
            return
        self.anchor = 0
        if self.at.tag == "p":
            self._up(self.at.parent)
        if tag in _CLOSES:
            n = self.at
            while n.parent is not None and n.tag not in _SCOPE:
                if n.tag in _CLOSES[tag]:
                    self._up(n.parent)
                    if tag != "tr":
                        break
                n = n.parent
        said = set()
        for k, v in attrs:
            if k in ("class", "id", "role", "itemprop", "aria-label") and v:
                said.update(x.lower() for x in _WORDS.findall(v))
        node = Node(tag, tuple(int(bool(said & c)) for c in _CLUE), self.at)
        self.begun(node, attrs)
        self.at.children.append(node)
        self.at.items.append(node)
        self.nodes.append(node)
        self.at = node

    def begun(self, node: Node, attrs: list) -> None:
        """For pages that say more of their elements."""

    def _up(self, node: Node) -> None:
        self.at, self.anchor = node, 0

    def end(self, tag: str) -> None:
        if self.loose and (tag in _IS_BLOCK or tag in _SKIP or tag == "datalist"):
            self._unskip()
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
            elif tag == "body" or tag == "html":
                self.skipping.clear()
            return
        if tag == "a":
            self.anchor = 0
        if tag not in _IS_BLOCK:
            return
        n = self.at
        while n is not None and n.tag != tag:
            if n.tag in ("body", "table", "article") and tag == "p":
                return
            n = n.parent
        if n is not None and n.parent is not None:
            self._up(n.parent)

    def data(self, data: str) -> None:
        if self.skipping and self.skipping[-1] == "head" and data.strip():
            self._unskip()
        if self.skipping:
            return
        n = len(data.strip())
        self.at.items.append(data)
        self.at.own += n
        if self.anchor:
            self.at.linked += n


class _Labelled(_Tree):
    """A page laid out for training, which says of each element whether it is main text."""

    def begun(self, node: Node, attrs: list) -> None:
        node.label = int(dict(attrs)["data-label"])


def parse(html: str | None, kind: type[_Tree] = _Tree) -> list[Node]:
    """The nodes of a page in document order; the first is the root."""
    page = _Events()
    page.feed(html or "")
    page.close()
    tree = kind()
    tree.read(page.events)
    for i, n in enumerate(tree.nodes):
        n.index = i
    return tree.nodes


_TAGS = {t: i for i, t in enumerate(_BLOCK)}
_GROUPS = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("div", "section", "center"), ("article", "main"), ("nav",), ("aside",), ("header", "hgroup"), ("footer",), ("form", "fieldset", "label", "legend"), ("table", "thead", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html"))
_GROUP = {t: i for i, g in enumerate(_GROUPS) for t in g}


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node."""
    n = len(nodes)
    parent = np.array([-1 if x.parent is None else x.parent.index for x in nodes])
    own = np.array([x.own for x in nodes], float)
    base = np.stack([own, [x.linked for x in nodes], [x.links for x in nodes], [x.inputs for x in nodes], np.ones(n), [sum(t.count(".") + t.count(",") for t in x.items if isinstance(t, str)) for x in nodes], [x.tag == "p" for x in nodes], own * [x.tag == "p" for x in nodes]], axis=1)
    total = base.copy()
    depth = np.zeros(n)
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    clues = np.array([x.clues for x in nodes], float)
    group = np.zeros((n, len(_GROUPS)))
    for i, x in enumerate(nodes):
        if x.tag in _GROUP:
            group[i, _GROUP[x.tag]] = 1
    above = np.zeros((n, clues.shape[1] + len(_GROUPS)))
    mine = np.concatenate([clues, group], axis=1)
    for i in range(1, n):
        depth[i] = min(depth[parent[i]] + 1, MAX_DEPTH)
        above[i] = np.maximum(above[parent[i]], mine[parent[i]])
    place = np.zeros((n, 6))
    for x in nodes:
        k = len(x.children)
        if not k:
            continue
        at = [c.index for c in x.children]
        sizes = total[at, 0]
        mean, most, whole = sizes.mean(), sizes.max(), max(total[x.index, 0], 1)
        same: dict[str, int] = {}
        for c in x.children:
            same[c.tag] = same.get(c.tag, 0) + 1
        for j, c in enumerate(x.children):
            place[c.index] = (j, k - 1 - j, sizes[j] / (mean + 1), sizes[j] / (most + 1), sizes[j] / whole, same[c.tag] / k)
    page = max(total[0, 0], 1)
    upto = np.cumsum(own) / page
    text = np.maximum(total[:, 0], 1)
    dense = np.stack([total[:, 0], own, total[:, 1] / text, total[:, 2], total[:, 3], total[:, 4], total[:, 0] / total[:, 4], 100 * total[:, 5] / text, total[:, 6], total[:, 7] / text, total[:, 0] / page, upto, np.arange(n) / n], axis=1)
    up = np.maximum(parent, 0)
    return np.concatenate([mine, above, depth[:, None], place, dense, dense[up][:, [0, 2, 6, 9, 10]]], axis=1)


class Boosted:
    """Gradient-boosted regression trees on logistic loss, grown level by level on 32 quantile bins."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = 32) -> None:
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(q, c, "right") for q, c in zip(cuts, x.T, strict=True)], axis=1)
        rows, width = code.shape
        score = np.zeros(rows)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            where = np.zeros(rows, np.int64)
            size = 1 << self.depth
            feature, cut = np.zeros(size, np.int64), np.full(size, np.inf)
            for level in range(self.depth):
                first, k = 1 << level, 1 << level
                best = np.full(k, 1e-9)
                choice, at = np.zeros(k, np.int64), np.full(k, self.bins)
                for f in range(width):
                    key = where * self.bins + code[:, f]
                    g = np.bincount(key, grad, k * self.bins).reshape(k, self.bins).cumsum(axis=1)
                    h = np.bincount(key, hess, k * self.bins).reshape(k, self.bins).cumsum(axis=1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    gain[(h < 1) | (ht - h < 1)] = 0
                    j = gain.argmax(axis=1)
                    top = gain[np.arange(k), j]
                    better = top > best
                    best[better], choice[better], at[better] = top[better], f, j[better]
                for node in range(k):
                    feature[first + node] = choice[node]
                    q = cuts[choice[node]]
                    cut[first + node] = q[at[node]] if at[node] < len(q) else np.inf
                where = where * 2 + (code[np.arange(rows), choice[where]] > at[where])
            g = np.bincount(where, grad, size)
            h = np.bincount(where, hess, size)
            leaf = self.rate * g / (h + 1)
            score += leaf[where]
            self.trees.append((feature, cut, leaf))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = at * 2 + (x[rows, feature[at]] >= cut[at])
            out += leaf[at - (1 << self.depth)]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> None:
    """Set ``kept``: the most likely labelling in which nothing is kept below a node that isn't."""
    run = [0] * len(nodes)  # wrappers around one another count as little more than one, however many there are
    for i, n in enumerate(nodes[1:], 1):
        if not n.own and not n.parent.own and len(n.parent.children) == 1:
            run[i] = run[n.parent.index] + 1
    weight = [1.0 / (1 + r) ** 2 + min(n.own, 400) / 100 for n, r in zip(nodes, run, strict=True)]
    keep = [w * -float(np.logaddexp(0, -o)) for w, o in zip(weight, odds, strict=True)]
    drop = [w * -float(np.logaddexp(0, o)) for w, o in zip(weight, odds, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent.index
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    for i, n in enumerate(nodes):
        n.kept = (n.parent is None or n.parent.kept) and (keep[i] > drop[i] or i == 0)


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the kept blocks in page order."""
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(piece)).strip()
        piece.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    while stack:
        node, at = stack.pop()
        if at == 0:
            flush()
        if at == len(node.items):
            flush()
            continue
        stack.append((node, at + 1))
        item = node.items[at]
        if isinstance(item, str):
            piece.append(item)
        elif item.kept:
            stack.append((item, 0))
        else:
            flush()
    return out


def _layout(rng: random.Random, lines: list[str], junk: list[str], sparse: bool = False) -> str:
    """One page with labelled nodes: an article of ``lines`` in the midst of other parts made of ``junk``; ``sparse``: with few or none around it, and seldom marked."""
    plain = not sparse and rng.random() < 0.25  # no telling tags or attributes

    def some(lo: int, hi: int) -> str:
        words = rng.choice(junk).split() or ["x"]
        k = rng.randint(lo, hi)
        at = rng.randrange(max(1, len(words) - k))
        return " ".join(words[at : at + k])

    def tag(name: str, inside: str, label: int, clue: str = "") -> str:
        if plain and name not in ("p", "li", "ul", "ol", "h1", "h2", "h3", "form", "blockquote", "table", "tr", "td"):
            name = "div"
        said = ""
        if clue and not plain and rng.random() < 0.9:
            word = rng.choice(clue.split())
            said = rng.choice(("class", "class", "id")) + f'="{rng.choice((word, word, f"{word}-{rng.choice(("box", "wrap", "inner", "area"))}", f"site-{word}"))}"'
            said = " " + said
        elif rng.random() < 0.3:
            said = f' class="{rng.choice(("c1", "row", "col", "box", "wrap", "x7f", "container", "inner"))}"'
        return f'<{name}{said} data-label="{label}">{inside}</{name}>'

    def links(k: int) -> str:
        return "".join(tag("li", f'<a href="/x">{some(1, 3)}</a>', 0) for _ in range(k))

    def nav() -> str:
        return tag(rng.choice(("nav", "nav", "div")), tag("ul", links(rng.randint(3, 9)), 0), 0, "nav menu navbar breadcrumb toolbar")

    def para(text: str, label: int) -> str:
        return tag(rng.choice(("p", "p", "p", "div")), text, label)

    def header() -> str:
        return tag(rng.choice(("header", "div")), rng.choice(("", nav())) + rng.choice((tag("div", some(1, 3), 0, "logo branding"), para(some(2, 6), 0), tag("h2", some(1, 3), 0))), 0, "header masthead top banner")

    def advert() -> str:
        return tag(rng.choice(("div", "aside", "section")), rng.choice((some(3, 14), para(some(3, 14), 0), para(some(4, 25), 0) + f'<a href="/buy">{some(1, 3)}</a>')), 0, "ad ads advert sponsored promo advertisement")

    def notice() -> str:
        return tag(rng.choice(("div", "section")), para(some(6, 30), 0) + rng.choice(("", "<button>OK</button>", f'<a href="/p">{some(1, 2)}</a>')), 0, "cookie consent notice alert gdpr popup")

    def form() -> str:
        return tag("form", rng.choice(("", para(some(3, 15), 0))) + tag("label", some(1, 2), 0) + '<input name="q">' + rng.choice(("", "<textarea>x</textarea>")), 0, "form newsletter subscribe search login")

    def side() -> str:
        return tag(rng.choice(("aside", "div")), "".join(rng.choice((lambda: tag("h3", some(1, 3), 0) + tag("ul", links(rng.randint(2, 7)), 0), lambda: para(some(5, 30), 0), advert, form))() for _ in range(rng.randint(1, 3))), 0, "sidebar side rail widget")

    def comments() -> str:
        each = lambda: tag(rng.choice(("div", "li", "article")), rng.choice(("", tag("div", some(1, 3), 0, "author meta byline"))) + "".join(para(some(4, 60), 0) for _ in range(rng.randint(1, 3))), 0, "comment reply")
        return tag(rng.choice(("section", "div", "ol", "ul")), rng.choice(("", tag("h3", some(1, 3), 0))) + "".join(each() for _ in range(rng.randint(1, 6))), 0, "comments discussion respond replies commentlist")

    def related() -> str:
        return tag(rng.choice(("section", "div", "aside")), tag("h3", some(1, 3), 0) + tag("ul", links(rng.randint(2, 6)), 0), 0, "related share more recommended social")

    def footer() -> str:
        return tag(rng.choice(("footer", "footer", "div")), rng.choice(("", nav())) + rng.choice((f"&copy; {some(3, 12)}", para(f"&copy; {some(3, 15)}", 0), para(some(3, 20), 0))), 0, "footer bottom copyright legal")

    def body_line(text: str) -> str:
        kind = rng.random()
        if kind < 0.72:
            return para(text, 1)
        if kind < 0.8:
            return tag(rng.choice(("h2", "h3")), " ".join(text.split()[:6]), 1)
        if kind < 0.88:
            words = text.split()
            return tag(rng.choice(("ul", "ol")), "".join(tag("li", " ".join(words[i : i + 9]), 1) for i in range(0, len(words), 9)), 1)
        if kind < 0.94:
            return tag("blockquote", para(text, 1), 1)
        words = text.split()
        return tag("table", tag("tr", "".join(tag("td", " ".join(words[i : i + 5]), 1) for i in range(0, len(words), 5)), 1), 1)

    inside = [body_line(x) for x in lines]
    if sparse:
        if rng.random() < 0.5:  # as most short pages are: paragraphs only
            inside = [tag("p", x, 1) for x in lines]
        if rng.random() < 0.3:
            inside.insert(0, tag(rng.choice(("h1", "h2")), some(2, 10), 1))
        if rng.random() < 0.3:
            inside.append(rng.choice((lambda: tag("pre", some(1, 9), 1), lambda: tag("figure", tag("figcaption", some(1, 6), 1), 1), lambda: tag("figure", "", 1), lambda: tag("h3", some(1, 4), 1)))())
        article = "".join(inside)
        if rng.random() < 0.8:
            article = tag(rng.choice(("article", "main", "div", "div", "div", "section")), article, 1, rng.choice(("", "", "article content post entry story main")))
        for _ in range(rng.choice((0, 0, 1, 2))):
            article = tag("div", article, 1, rng.choice(("", "content main wrap page")))
        before = [f() for f in (header, nav) if rng.random() < 0.4]
        after = [f() for f in (footer,) if rng.random() < 0.5]
        if rng.random() < 0.25:
            rng.choice((before, after)).append(rng.choice((advert, notice, form, side, related, comments))())
        return f'<html data-label="1"><body data-label="1">{"".join(before)}{article}{"".join(after)}</body></html>'
    if rng.random() < 0.3:
        inside.insert(rng.randrange(len(inside) + 1), rng.choice((advert, related, form))())
    if rng.random() < 0.7:
        inside.insert(0, tag("h1", some(2, 10), 1))
    if rng.random() < 0.1:
        inside = [" ".join(lines)]
    article = tag(rng.choice(("article", "article", "main", "div", "section")), "".join(inside) + (comments() if rng.random() < 0.12 else ""), 1, "article content post entry story main")
    for _ in range(rng.choice((0, 0, 1, 2))):
        article = tag(rng.choice(("div", "section", "main")), rng.choice(("", notice())) * (rng.random() < 0.2) + article + (side() if rng.random() < 0.2 else "") + (comments() if rng.random() < 0.2 else ""), 1, "content main wrap page")
    before = [f() for f in (header, nav, advert, notice, side, form) if rng.random() < 0.45]
    after = [f() for f in (related, comments, side, advert, form, notice, footer, nav) if rng.random() < 0.4]
    rng.shuffle(before)
    rng.shuffle(after)
    return f'<html data-label="1"><body data-label="1">{"".join(before)}{article}{"".join(after)}</body></html>'


_PARTS = frozenset(("nav", "aside", "header", "footer", "form"))


def _marked(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that has one article element, or else one main element; None if it has not."""
    heads = [n for n in nodes if n.tag == "article"] or [n for n in nodes if n.tag == "main"]
    if len(heads) != 1:
        return None
    label = [0] * len(nodes)
    for n in nodes:
        up = n.parent
        inside = n is heads[0] or (up is not None and label[up.index] == 1 and _below(n, heads[0]))
        label[n.index] = int(inside and n.tag not in _PARTS and not any(n.clues[1:]))
    n = heads[0].parent
    while n is not None:
        label[n.index] = 1
        n = n.parent
    return label


def _below(node: Node | None, head: Node) -> bool:
    while node is not None and node is not head:
        node = node.parent
    return node is head


def _weights(nodes: list[Node]) -> np.ndarray:
    """Of a page's nodes, by their text; a short page weighs less than a long one only by the root of its size."""
    own = np.array([1.0 + min(n.own, 400) / 100 for n in nodes])
    return own * np.sqrt(PAGE_WEIGHT / own.sum())


def train(samples: list[str], layouts: int = TRAIN_LAYOUTS, seed: int = 17) -> Boosted:
    """Fit the trees on ``layouts`` pages made of the visible text of ``samples``."""
    lines = []
    for html in samples:
        lines += [x.replace("<", " ").replace("&", " ") for x in blocks(parse(html)) if len(x) > 20]
    lines = lines or ["no text was given, so these words stand for it, one after another, until the end of the line."]
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for html in samples:
        nodes = parse(html)
        label = _marked(nodes)
        if label is not None:
            xs.append(features(nodes))
            ys.append(label)
            ws.append(_weights(nodes))
    for i in range(layouts):
        sparse = i % 2 == 1
        k = rng.choice((1, 1, 2, 2, 3, 4, 8) if sparse else (1, 2, 3, 5, 8, 12))
        page = [rng.choice(lines) for _ in range(k)]
        if rng.random() < 0.3:
            page = [" ".join(x.split()[: rng.randint(1, 12)]) for x in page]
        page = [" ".join(x.split()[: rng.randint(1, 4)]) if rng.random() < 0.2 else x for x in page]
        nodes = parse(_layout(rng, page, lines, sparse), _Labelled)
        xs.append(features(nodes))
        ys.append([1 if n.label is None else n.label for n in nodes])
        ws.append(_weights(nodes))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    odds = model.log_odds(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for t in trees:
        decode(t, odds[at : at + len(t)])
        at += len(t)
        out.append("\n".join(blocks(t)))
    return out


def extract_main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None, train_pages: int = TRAIN_PAGES, model: Boosted | None = None) -> DataFrame:
    """``keep`` (page_id, url), text and n_chars of each row; trains on at most ``train_pages`` rows if no ``model`` is given."""
    keep = ["page_id", "url"] if keep is None else keep
    if model is None:
        fit = pages.where(F.length(html) <= TRAIN_CHARS).select(F.xxhash64("page_id", html).alias("h"), F.col(html).alias("html"))
        least = [r["h"] for r in fit.select("h").distinct().orderBy("h").limit(train_pages).collect()]  # numbers first, so that tasks send no pages that aren't taken
        sample = fit.where(F.col("h") <= (max(least) if least else 0)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h")
        model = train([r["html"] for r in sample.collect()])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed number of trees of fixed depth

    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html_texts in parts:
            pages = html_texts.tolist()
            yield pd.Series([t for at in range(0, len(pages), 500) for t in main_texts(pages[at : at + 500], shared.value)], dtype=object)

    extracted.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = F.pandas_udf(extracted, "string")(html)
    return small_batches(pages).select(*keep, text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
