"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements are the nodes of a tree; each is content or not. A node's own
evidence is a log odds learned over its tag, its class and id words, its link
share and text length; parent and child are tied by a learned potential. Sum-product messages pass upward from the
leaves and downward from the root, which on a tree gives exact marginals, and
the text of nodes whose marginal is at least one half is the page's main text.

It is trained from labelled pages: a bounded sample of pages that mark their
article themselves, and a few labelled page forms below for parts that such
pages lack. After training, the article element is one feature among others, and
pages without one are read by the same marginals.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.textops import first_by_hash

#: Pages that the model learns from, at most.
MAX_TRAIN = 120

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.DOTALL)
_NAME = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
#: Passed over with all they hold where they are closed; where they are not, only their tag is. Those of the second list can't stand inside themselves.
PASSED, SINGLE = frozenset("noscript template svg math select button".split()), frozenset("noscript select button".split())
BLOCK = frozenset(
    "html head body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend "
    "blockquote pre figure figcaption details summary dialog address hgroup center menu search".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_NO_P = BLOCK - {"html", "head", "body"}

# Labelled page forms: y="1" marks what is content, y="0" what is not; both hold for everything inside.
FORMS = (
    '<body><header><div class="logo">Daily</div><nav class="menu"><ul><li><a>Home</a></li><li><a>World</a></li></ul></nav></header><main y="1"><h1>A title of a story</h1><p>First paragraph, with a few sentences. It goes on.</p><p>Second paragraph with <a>one link</a> in a long sentence, and more.</p></main><aside class="sidebar"><h3>Related</h3><ul><li><a>More news</a></li></ul></aside><footer><p>Copyright notice, all rights reserved.</p></footer></body>',
    '<body><div class="cookie-notice banner"><p>We use cookies on this site.</p></div><div id="content" y="1"><h1>Title here</h1><div class="post"><p>Text of the post, a sentence long enough to count.</p><p>And more text follows it here.</p></div><div class="comments" id="comments" y="0"><h3>Comments</h3><div class="comment"><p>I agree with this, what a story.</p></div><form class="comment-form"><p>Leave a reply</p></form></div></div><div class="footer">Imprint and contact</div></body>',
    '<body><div class="ad">Buy this now, cheap.</div><div class="article-body" y="1"><p>Some words of the story, told in a sentence.</p><div class="ad advert" y="0">Offer of the day, click here.</div><p>The story goes on in this paragraph.</p><blockquote><p>Quoted words in the story.</p></blockquote><ul><li>a point made</li><li>another point, longer</li></ul></div><div class="newsletter signup"><form><p>Subscribe to our newsletter</p></form></div></body>',
    '<body><nav><a>One</a><a>Two</a></nav><article y="1"><header><h1>Heading of the article</h1></header><section><h2>Part</h2><p>Body of the part in words, some more of them.</p><table><tr><td>cell one</td><td>cell two</td></tr></table><pre>code of the article</pre></section><aside class="related" y="0"><p>Read also this and that.</p></aside><section class="comments" y="0"><h2>Reader comments</h2><p>A reader says something here, at length.</p></section><footer y="0"><p>Share this, filed under news.</p></footer></article><section class="promo sponsored"><p>Sponsored content of a partner, read it.</p></section></body>',
    '<body><div class="header"><div class="breadcrumb"><a>Home</a> <a>Section</a></div></div><div class="main"><div class="content" y="1"><h2>Story</h2><p>Plain words of the text, and a second sentence.</p><figure><figcaption>What the picture shows</figcaption></figure></div><div class="sidebar widget"><p>Most read this week</p><ul><li><a>Popular one</a></li></ul></div></div><div class="popup modal notice"><p>Please accept the terms.</p></div><div class="footer copyright"><p>Address and terms of use</p></div></body>',
    '<body><article y="1"><h1>Heading</h1><p>Words of a paragraph that go on for a while.</p><div class="share social" y="0"><a>Share</a></div><nav class="toc" y="0"><ul><li><a>Chapter</a></li></ul></nav><form y="0"><p>Search the site</p></form><dl><dt>Term</dt><dd>What the term means here</dd></dl></article><div class="reader-comments"><p>Nice article, thanks for this.</p></div></body>',
)


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    fixed: int | None = None
    chars: int = 0
    linked: int = 0


def _closed(page: str, tag: str) -> dict[int, int]:
    """Where each element of this tag that is closed starts and ends: one pass, whatever is left open."""
    ends, open_ = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>", page, re.IGNORECASE):
        if m[1]:
            if open_:
                ends[open_.pop()] = m.end()
        elif not m[0].endswith("/>"):
            if tag in SINGLE:
                open_.clear()
            open_.append(m.start())
    return ends


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes in page order, text blocks with the number of their node). The root is node 0; parents come before children."""
    page = page or ""
    nodes, blocks, piece = [Node("#root", -1)], [], []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones carry the node that they are in
    links, at = 0, 0
    closed: dict[str, dict[int, int]] = {}

    def flush() -> None:
        if piece:
            text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
            piece.clear()
            if text:
                blocks.append((stack[-1][1], text))

    def words(raw: str) -> None:
        if raw:
            piece.append(raw)
            n = len(raw) - raw.count(" ")
            nodes[stack[-1][1]].chars += n
            if links:
                nodes[stack[-1][1]].linked += n

    def pop(to: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[to:])
        if any(t in BLOCK for t, _ in stack[to:]):
            flush()
        del stack[to:]

    def close(tags: set[str], fence: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                pop(i)
                return
            if stack[i][0] in fence:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in PASSED:
            if tag not in closed:
                closed[tag] = _closed(page, tag)
            at = closed[tag].get(m.start(), at)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            piece.append(" ") if tag != "hr" else flush()
            continue
        if tag in _NO_P:
            close({"p"}, {"table", "td", "th", "li", "div", "article", "section", "blockquote"})
        if tag in _CLOSES:
            close(_CLOSES[tag], _FENCE.get(tag, set()))
        if tag in BLOCK:
            flush()
            attrs = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
            names = _NAME.findall(" ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""))).lower())
            nodes.append(Node(tag, stack[-1][1], tuple(dict.fromkeys(names)), int(attrs["y"]) if attrs.get("y") in ("0", "1") else None))
            stack.append((tag, len(nodes) - 1))
        else:
            if tag == "a":
                links += 1
            stack.append((tag, stack[-1][1]))
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> list[list[str]]:
    out = []
    for node in nodes:
        share = node.linked / node.chars if node.chars else 0
        out.append([f"tag={node.tag}", f"link={int(2 * share)}", f"text={min(2, node.chars // 40)}", *(f"name={n}" for n in node.names)])
    return out


@dataclass
class Model:
    """weights: evidence of features in log odds; pair: log potentials of (parent, child) labels."""

    weights: dict[str, float] = field(default_factory=dict)
    pair: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def messages(self, nodes: list[Node], own: list[float]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of content by one upward and one downward pass of sum-product messages.

        (beliefs, what each node says upward of itself and all below it, what its parent says without it).
        """
        (p00, p01), (p10, p11) = self.pair
        inward, message = own[:], [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            # Each label of the parent sums over the labels of the child.
            message[i] = _add(p10, p11 + inward[i]) - _add(p00, p01 + inward[i])
            inward[nodes[i].parent] += message[i]
        belief, rest = inward[:], [0.0] * len(nodes)
        for i in range(1, len(nodes)):
            rest[i] = belief[nodes[i].parent] - message[i]
            belief[i] = inward[i] + _add(p01, p11 + rest[i]) - _add(p00, p10 + rest[i])
        return belief, inward, rest

    def evidence(self, nodes: list[Node]) -> list[float]:
        return [sum(self.weights.get(f, 0.0) for f in fs) for fs in features(nodes)]

    def marginals(self, nodes: list[Node]) -> list[float]:
        return self.messages(nodes, self.evidence(nodes))[0]


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that marks them, or whose article element is its main text; None for other pages."""
    marked = any(n.fixed is not None for n in nodes)
    if not marked and sum(n.tag == "article" for n in nodes) != 1:
        return None
    out: list[int] = []
    for n in nodes:
        above = out[n.parent] if n.parent >= 0 else 0
        if marked:
            out.append(n.fixed if n.fixed is not None else above)
        else:
            out.append(1 if n.tag == "article" else 0 if n.tag in ("nav", "aside", "footer", "form") else above)
    return out


def train(pages: list[str], steps: int = 60) -> Model:
    """Maximum likelihood over the labelled pages and the forms, by exact gradients.

    The gradient of a feature is the labels it has less the marginals it gets;
    that of a pair of labels, the edges that have it less the edges expected to.
    """
    trees = []
    for page, times in [*((p, 1.0) for p in pages), *((f, 1.0 + len(pages) / len(FORMS)) for f in FORMS)]:
        nodes, _ = parse(page)
        y = labels(nodes)
        if y is not None:
            trees.append((nodes, features(nodes), y, times))
    names = {f: i for i, f in enumerate(sorted({f for _, fs, _, _ in trees for r in fs for f in r}))}
    flat = [(np.repeat(np.arange(len(fs)), [len(r) for r in fs]), np.array([names[f] for r in fs for f in r])) for _, fs, _, _ in trees]
    total = sum(t[3] for t in trees)
    w, cross = np.zeros(len(names)), np.array([-1.0, -1.0])
    speed, cross_speed = np.full(len(names), 1e-4), np.full(2, 1e-4)
    for _ in range(steps):
        grad, pull = -2e-4 * w, np.zeros(2)
        model = Model({}, ((0.0, float(cross[0])), (float(cross[1]), 0.0)))
        for (nodes, _, y, times), (at, col) in zip(trees, flat, strict=True):
            own = np.bincount(at, w[col], len(nodes))
            belief, inward, rest = (np.array(x) for x in model.messages(nodes, own.tolist()))
            miss = times / total * (np.array(y) - 1 / (1 + np.exp(-np.clip(belief, -40, 40))))
            grad = grad + np.bincount(col, miss[at], len(names))
            up = np.array([y[n.parent] for n in nodes[1:]])
            here, a, b = np.array(y[1:]), np.clip(inward[1:], -40, 40), np.clip(rest[1:], -40, 40)
            odd = np.exp(np.stack([cross[0] + a, cross[1] + b]))
            odd = odd / (1 + np.exp(a + b) + odd.sum(axis=0))
            pull += times / total * np.array([((up < here) - odd[0]).sum(), ((up > here) - odd[1]).sum()])
        speed += grad * grad
        cross_speed += pull * pull
        w += 0.6 * grad / np.sqrt(speed)
        cross = np.minimum(0.0, cross + 0.6 * pull / np.sqrt(cross_speed))
    return Model({f: float(w[i]) for f, i in names.items()}, ((0.0, float(cross[0])), (float(cross[1]), 0.0)))


def main_text(model: Model, page: str | None) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    odds = model.marginals(nodes)
    head = {i for i, n in enumerate(nodes) if n.tag == "head"}
    return "\n".join(text for i, text in blocks if odds[i] >= 0 and i not in head)


def learn(pages: DataFrame, html_col: str = "html", max_train: int = MAX_TRAIN) -> Model:
    """Train on at most max_train distinct pages, the first by a hash of their text; with none, on the page forms alone."""
    sample = first_by_hash(pages.select(F.col(html_col).alias("page")), "page", max_train)
    return train([r["page"] for r in sorted(sample.collect(), key=lambda r: (r["h"], r["n"]))])


def extractor(model: Model):
    """A column function: html -> main text; null and empty pages give an empty text.

    Each row is read by itself: repeated rows fare alike, other columns play no
    part, and an empty table gives an empty result.
    """

    @F.pandas_udf(T.StringType())
    def extract(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(model, p) for p in page], index=page.index, dtype=object)

    return extract
