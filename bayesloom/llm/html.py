"""Main text of web pages: gradient-boosted trees over DOM-node features, hierarchical decoding.

A small tolerant parser builds the tree of elements of a page. Every block-level element is
described by its tag, the tokens of its class, id and role, its depth, the amount, link share
and tag density of its subtree, and its place among its siblings. Boosted trees, fitted to
invented pages whose elements are labelled, give the chance that an element holds main text. The
best labelling in which nothing below a rejected element is kept is found from the leaves up, so
that ancestors and descendants never contradict each other.

Cases: an element that nothing closes ends where its parent does; quotes inside text or inside the
other quotes open no value; null or empty html gives an empty text; text outside any element belongs to the page; repeated rows are each answered; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released

# Fixed values of the HTML standard: elements without content, with raw text, and of block level.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title select option iframe svg button canvas object".split())
NESTED, ENDS_ITSELF = frozenset("svg object template canvas".split()), frozenset("button select option".split())
#: The block of text that belongs to no block.
DROPPED = -1
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset(["html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"])
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table html body div article section aside nav main form".split())

TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "li", "table", "h1", "h2", "blockquote", "figure", "pre", "body", "dialog")
TOKENS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager topbar skip",
    "head": "header head masthead logo banner branding top",
    "foot": "footer foot copyright colophon bottom legal imprint",
    "side": "sidebar side aside widget rail secondary related recommended trending tags more",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion affiliate outbrain taboola",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr banner warning paywall announcement",
    "form": "form newsletter subscribe signup login search contact register",
    "comment": "comment comments reply replies discussion disqus respond thread feedback reviews",
    "share": "share sharing social follow twitter facebook like meta byline author date",
    "content": "content article post entry story main body text maincontent articlebody postcontent page prose copy",
}
LEXICON = {w: g for g, words in TOKENS.items() for w in words.split()}
GROUPS = tuple(TOKENS)
SPLIT = re.compile(r"[^a-z]+")
#: Attributes that name what an element is, and a style that hides it.
NAMING, HIDING = frozenset(("class", "id", "role")), re.compile(r"display:\s*none", re.IGNORECASE)
#: One attribute with what stands before it: its name, and its value in either quotes or without.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
BEFORE_END = re.compile(r"[\s/]*")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")


class Node(NamedTuple):
    tag: str
    parent: int
    depth: int
    groups: frozenset
    children: list
    parts: list  # (position, text, in a link) of the block's own text


def scan_tag(html: str, at: int) -> tuple[int, list[tuple[str, str]], bool]:
    """Where the tag ends (its ``>``, or the page's end) whose name ends at ``at``, its attributes, and whether a slash of its own closes it.

    Quotes count only where a value begins, so an apostrophe inside the other quotes, or in a
    later text, is none. A quote that is never closed within its own tag begins no quoted value.
    """
    found = []
    while True:
        before, at = at, BEFORE_END.match(html, at).end()
        if at >= len(html) or html[at] == ">":
            return at, found, at > before and html[at - 1] == "/"
        m = ATTRIBUTE.match(html, at)
        value, end = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "", m.end()
        if m[4] is None and "<" in value and html[end : end + 1].strip(" \t\r\n/>"):
            end = min((k for k in (html.find(">", at), len(html)) if k >= 0))  # the quote belongs to what follows
            value = html[at:end]
        found.append((m[1].lower(), value))
        at = end


def _tag_end(html: str, at: int) -> int:
    """The end of the markup that begins at ``at``: of a tag by its attributes, of anything else its first ``>``."""
    m = NAME.match(html, at)
    if m:
        return scan_tag(html, m.end())[0]
    end = html.find(">", at)
    return len(html) if end < 0 else end


def _raw_end(html: str, tag: str, at: int) -> int:
    """Where the closing tag of an element begins that is open at ``at``, or -1."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b", re.IGNORECASE).finditer(html, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.start()
        elif tag in ENDS_ITSELF:
            return -1
        elif tag in NESTED and not scan_tag(html, m.end())[2]:
            depth += 1
    return -1


def parse(html: str) -> list[Node]:
    """Block-level elements in page order, the page itself first; inline text goes to its block."""
    nodes = [Node("page", -1, 0, frozenset(), [], [])]
    stack: list[tuple[str, int]] = [("page", 0)]  # open elements, each with its block
    open_: Counter = Counter()  # how many of each are open
    place, at = 0, 0
    never: set[str] = set()  # elements that nothing closes any more

    def text(t: str) -> None:
        nonlocal place
        if t and stack[-1][1] != DROPPED:
            nodes[stack[-1][1]].parts.append((place, unescape(t), open_["a"] > 0))
            place += 1

    def close(k: int) -> None:
        """Close the element at ``k`` of the stack and all within it."""
        open_.subtract(t for t, _ in stack[k:])
        del stack[k:]

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = len(html) if end < 0 else end + 3
            continue
        m = NAME.match(html, lt)
        if not m:
            if html[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = _tag_end(html, lt) + 1
            else:
                text("<")
                at = lt + 1
            continue
        tag = m[1].lower()
        end, attributes, closed = scan_tag(html, m.end())
        at = end + 1
        if html[lt + 1] == "/":
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            if tag not in ("script", "style") and closed:
                continue
            shut = -1 if tag in never else _raw_end(html, tag, at)
            if shut >= 0:
                at = _tag_end(html, shut) + 1
            elif tag in ("script", "style"):
                at = len(html)
            else:  # nothing closes it: what follows is dropped up to the next block or the parent's end
                if tag not in never and not re.compile(f"</{tag}", re.IGNORECASE).search(html, at):
                    never.add(tag)
                stack.append((tag, DROPPED))
                open_[tag] += 1
            continue
        if tag == "br":
            text(" ")
        if tag in BLOCK or tag == "hr":
            while stack[-1][1] == DROPPED:
                close(len(stack) - 1)
        if tag in VOID:
            if tag == "hr":
                nodes.append(Node("hr", stack[-1][1], 0, frozenset(), [], []))
                place += 1
            continue
        ends = SAME.get(tag, ("p",) if tag in CLOSES_P else ())
        for k in range(len(stack) - 1, 0, -1) if any(open_[t] for t in ends) else ():
            if stack[k][0] in ends:
                close(k)
                break
            if stack[k][0] in SCOPE:
                break
        block = stack[-1][1]
        if tag in BLOCK:
            words = {w for a, v in attributes if a in NAMING for w in SPLIT.split(v.lower())}
            groups = {g for w in words if (g := LEXICON.get(w))}
            if any(a == "hidden" or a == "style" and HIDING.search(v) for a, v in attributes):
                groups.add("hidden")
            nodes[block].children.append(len(nodes))
            nodes.append(Node(tag, block, nodes[block].depth + 1, frozenset(groups), [], []))
            block = len(nodes) - 1
            place += 1
        elif closed:
            continue
        stack.append((tag, block))
        open_[tag] += 1
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node."""
    n = len(nodes)
    chars, linked, tags, paras, links, stops = (np.zeros(n) for _ in range(6))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        for _, t, in_link in node.parts:
            size = len(t.strip())
            chars[i] += size
            linked[i] += size * in_link
            links[i] += in_link
            stops[i] += t.count(".") + t.count(",")
        tags[i] += 1
        paras[i] += node.tag == "p"
        if node.parent >= 0:
            for x in (chars, linked, tags, paras, links, stops):
                x[node.parent] += x[i]
    total = max(chars[0], 1)
    position = np.zeros(n, np.int64)
    for node in nodes:
        position[node.children] = np.arange(len(node.children))
    rows = np.zeros((n, len(TAGS) + 2 * len(GROUPS) + 14))
    for i, node in enumerate(nodes):
        siblings = nodes[node.parent].children if node.parent >= 0 else [i]
        k = int(position[i])
        up = nodes[node.parent].groups if node.parent >= 0 else frozenset()
        c = max(chars[i], 1)
        rows[i] = [
            *[float(node.tag == t) for t in TAGS],
            *[float(g in node.groups) for g in GROUPS],
            *[float(g in up) for g in GROUPS],
            float("hidden" in node.groups), node.depth, math.log1p(chars[i]), chars[i] / total, linked[i] / c, tags[i] / c * 100, math.log1p(tags[i]),
            paras[i], links[i], stops[i] / c * 100, len(siblings), k / max(1, len(siblings) - 1), float(k == 0), float(nodes[node.parent].tag in ("nav", "aside", "footer", "form")) if node.parent >= 0 else 0.0,
        ]
    return rows


class Trees(NamedTuple):
    """Boosted regression trees of equal depth: features, thresholds and leaf values by level order."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        depth = int(math.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            z += v[node - (len(v) - 1)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 2.0) -> Trees:
    """Second-order gradient boosting of logistic loss on quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    start = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    z, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        inner = 2**depth - 1
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        cut_bin = np.full(inner, bins + 1)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * (bins + 1) + binned[:, j]
                gs, hs = (np.bincount(cell, v, width * (bins + 1)).reshape(width, bins + 1).cumsum(axis=1) for v in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                k = gain[:, : len(e)].argmax(axis=1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best):
                    best[w], feature[first + w], threshold[first + w], cut_bin[first + w] = top[w], j, e[k[w]], k[w]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut_bin[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        z += value[leaf]
        out.append((feature, threshold, value))
    return Trees(*(np.stack(v) for v in zip(*out, strict=True)), start)


def invented_page(rng: random.Random) -> str:
    """A page whose elements say by a ``data-main`` attribute whether they hold main text."""

    def words(lo: int, hi: int) -> str:
        said = ["".join(rng.choice("aeiourstlnmdkp") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi))]
        return " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in said).capitalize() + "."

    def el(tag: str, inner: str, group: str | None = None, main: int = 0, named: float = 0.8) -> str:
        name = f' {rng.choice(["class", "id"])}="{rng.choice(["", "js-", "x "])}{rng.choice(TOKENS[group].split())}{rng.choice(["", "-box", " col2"])}"' if group and rng.random() < named else ""
        return f'<{tag}{name} data-main="{main}">{inner}</{tag}>'

    def link_list(main: int = 0) -> str:
        items = "".join(el("li", f'<a href="/">{words(1, 3)}</a>', main=main) for _ in range(rng.randint(3, 9)))
        return el("ul", items, main=main)

    def para(main: int = 1) -> str:
        inner = words(1, rng.choice([2, 6, 20, 90, 90]))
        if rng.random() < 0.3:
            inner += f' <a href="/x">{words(1, 4)}</a> <b>{words(1, 6)}</b>'
        if rng.random() < 0.25:
            inner = f"<b>{inner}<br>"
        return el("p", inner, main=main)

    def advert() -> str:
        return el(rng.choice(["div", "div", "aside", "section"]), rng.choice([words(3, 30), el("p", words(3, 30))]), "advert", named=0.97)

    def comments() -> str:
        return el(rng.choice(["section", "div", "ol"]), el("h2", words(1, 3)) + "".join(el(rng.choice(["div", "li", "article"]), el("p", words(3, 40)), "comment") for _ in range(rng.randint(1, 6))), "comment", named=0.97)

    extra = [
        lambda: advert(), comments,
        lambda: el(rng.choice(["aside", "div"]), el("h2", words(1, 3)) + rng.choice([link_list(), el("p", words(5, 40))]), "side"),
        lambda: el(rng.choice(["div", "aside", "dialog", "section"]), el("p", words(4, 30)), "notice", named=0.97),
        lambda: el("form", el("p", words(1, 8)) + "<input>", "form"),
        lambda: el("div", link_list(), "share"),
    ]
    body = [el(rng.choice(["h1", "h1", "h2"]), words(2, 12), main=1)] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 14)):
        roll = rng.random()
        body.append(para() if roll < 0.8 else el("ul", "".join(el("li", words(2, 20), main=1) for _ in range(rng.randint(2, 6))), main=1) if roll < 0.85 else el("blockquote", para(), main=1) if roll < 0.9 else el("h2", words(1, 6), main=1) if roll < 0.96 else el("table", el("tr", el("td", words(1, 5), main=1) + el("td", words(1, 5), main=1), main=1), main=1))
        if rng.random() < 0.06:
            body.append(rng.choice([extra[0], extra[3], extra[5]])())
    text = "".join(body)
    if rng.random() < 0.3:
        text = el("div", text, "content", 1)
    story = el(rng.choice(["article", "article", "main", "div", "section"]), text, "content", 1, named=0.6) if rng.random() < 0.9 else text
    before = [el(rng.choice(["nav", "nav", "div"]), link_list(), "menu")] if rng.random() < 0.85 else []
    if rng.random() < 0.5:
        before.insert(0, el(rng.choice(["header", "div"]), words(1, 6) + rng.choice(["", link_list()]), "head"))
    before += [x() for x in rng.sample(extra, rng.randint(0, 2))]
    after = [x() for x in rng.sample(extra, rng.randint(0, 3))]
    if rng.random() < 0.85:
        after.append(el(rng.choice(["footer", "footer", "div"]), words(2, 25) + rng.choice(["", link_list()]), "foot", named=0.9))
    return el("html", el("body", "".join([*before, story, *after]), main=1), main=1)


@lru_cache(maxsize=1)
def fit(pages: int = 700, seed: int = 11) -> Trees:
    """Trees for the elements of invented pages; an element is main if it holds main text. Fitted once in a session."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        html = invented_page(rng)
        nodes = parse(html)
        said = [1, *map(int, re.findall(r'<(?:html|body|[a-z0-9]+)[^>]*data-main="([01])"', html))]
        if len(said) == len(nodes):
            x.append(features(nodes))
            y += said
    return boost(np.concatenate(x), np.array(y, float))


def decode(nodes: list[Node], chance: np.ndarray) -> np.ndarray:
    """The likeliest choice in which nothing below a rejected node is kept."""
    p = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    keep[0] = 0.0
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag != "hr":
            keep[nodes[i].parent] += max(keep[i], drop[i])
            drop[nodes[i].parent] += drop[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and nodes[i].tag != "hr" and keep[i] >= drop[i]
    return kept


def kept_text(nodes: list[Node], kept: np.ndarray) -> str:
    """The text of the kept nodes: a line for each run of one block's text without another block inside."""
    runs: list[tuple[int, int, list[str]]] = []
    for place, i, t in sorted((place, i, t) for i, node in enumerate(nodes) if kept[i] for place, t, _ in node.parts):
        if runs and runs[-1][1] == i and place == runs[-1][0] + 1:
            runs[-1] = (place, i, [*runs[-1][2], t])
        else:
            runs.append((place, i, [t]))
    blocks = [" ".join("".join(r[2]).split()) for r in runs]
    return "\n".join(b for b in blocks if b)


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; the trees see the elements of all pages at once."""
    parsed = [parse(h or "") for h in pages]
    chance = trees.chance(np.concatenate([features(n) for n in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes in parsed:
        out.append(kept_text(nodes, decode(nodes, chance[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (``page_id``, ``url``, ``html``)."""

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = main_texts(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(task, "page_id long, url string, text string")
