"""Main text of web pages.

A page is parsed into a tree of elements. Each element gets features of itself
(tag, attribute words, depth), of its subtree (text, link and punctuation
density, blocks) and of its siblings; boosted regression trees give the log-odds
that it belongs to the article. Decoding is hierarchical: an element is kept
only below kept ancestors, and the kept set has the largest sum of log-odds that
this allows, so no choice of a descendant contradicts an ancestor's.

The trees are learned when first needed, with numpy, from pages that a generator
with a fixed seed writes (templates of articles with menus, headers, footers,
sidebars, notices, adverts, forms and comments, in several markups), of which it
knows which elements are the article's. No table is read.

Scripts, styles and other elements without visible text never count. White space
inside a block becomes one space; blocks are joined by a newline.

Defined cases: null and empty pages and pages without an article have empty
text; text outside of any element is kept, so a page without tags is its text;
markup that is never closed ends with its parent; a quote within an unquoted value,
or one that is never closed, is a character like any other; repeated rows each get a
row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by how they are parsed or shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title".split())
HIDDEN = RAW | frozenset("head select option button audio video map datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend".split())
#: An opening tag ends these open ones, up to the nearest of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset(["tr", "table"])),
    "th": (frozenset("td th".split()), frozenset(["tr", "table"])),
    "tbody": (frozenset("tr td th thead tbody tfoot".split()), frozenset(["table"])),
    "thead": (frozenset("tr td th thead tbody tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("tr td th thead tbody tfoot".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Words of class, id, role and similar attributes, by what they hint at.
HINTS = (
    ("good", frozenset("article content main post story entry body text prose markdown".split())),
    ("menu", frozenset("nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar topbar".split())),
    ("edge", frozenset("header masthead footer foot copyright legal colophon banner sidebar side aside rail widget".split())),
    ("sale", frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola".split())),
    ("ask", frozenset("cookie cookies consent gdpr notice alert modal popup overlay dialog newsletter subscribe subscription signup login form search".split())),
    ("talk", frozenset("comment comments commentlist reply replies respond discussion disqus thread reader".split())),
    ("more", frozenset("related recommended recommendations popular trending share sharing social tags meta byline author more".split())),
)
TAGS = ("article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "blockquote", "pre", "a", "h1", "h2", "h3", "figure", "span", "body")

#: A quote opens a value only after an equals sign, and only if it is closed later on.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PUNCTUATION = re.compile(r"[.,;:!?。、،]")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    parent: "Node | None" = None
    children: list = field(default_factory=list)  # Nodes and strings
    number: int = 0


def parse(page: str) -> Node:
    """The tree of a page; text keeps its character references."""
    root = Node("#root")
    open_, at = root, 0

    def close(tags, until) -> Node:
        n = open_
        while n.parent is not None and n.tag not in until:
            if n.tag in tags:
                out = n.parent
                # an earlier one of the set can be open further up
                m = out
                while m.parent is not None and m.tag not in until:
                    if m.tag in tags:
                        out = m.parent
                    m = m.parent
                return out
            n = n.parent
        return open_

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            open_.children.append(page[at:])
            break
        if m.start() > at:
            open_.children.append(page[at : m.start()])
        at = max(m.end(), at + 1)
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            n = open_
            while n.parent is not None and n.tag != name:
                n = n.parent
            if n.parent is not None:
                open_ = n.parent
            elif name == "p":
                open_.children.append(Node("p", "", open_))
            continue
        if name in CLOSES_P:
            n = open_
            while n.parent is not None and n.tag != "p" and n.tag not in BLOCK:
                n = n.parent
            if n.tag == "p":
                open_ = n.parent
        if name in ENDS:
            open_ = close(*ENDS[name])
        node = Node(name, m.group(3) or "", open_)
        open_.children.append(node)
        if name in VOID or node.attributes.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        open_ = node
    return root


def elements(root: Node) -> list[Node]:
    """All elements that can show text, parents first."""
    out: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        n.number = len(out)
        out.append(n)
        stack.extend(c for c in reversed(n.children) if type(c) is Node and c.tag not in HIDDEN and c.tag not in VOID)
    return out


WIDTH = len(TAGS) + 2 * len(HINTS) + 14


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    parent = np.array([-1 if x.parent is None else x.parent.number for x in nodes])
    text, link, marks, blocks, inner = (np.zeros(n) for _ in range(5))
    hints = np.zeros((n, len(HINTS)))
    hidden = np.zeros(n)
    depth = np.zeros(n)
    above = np.zeros((n, len(HINTS)))
    in_link = np.zeros(n, bool)
    in_edge = np.zeros(n)
    index = np.zeros(n)
    for i, x in enumerate(nodes):
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            in_link[i] = in_link[p] or x.tag == "a"
            in_edge[i] = in_edge[p] or x.tag in ("nav", "header", "footer", "aside", "form")
            above[i] = np.maximum(above[p], hints[p])
        if x.attributes and x.attributes != "/":
            found: set[str] = set()
            for m in NAMED.finditer(x.attributes):
                key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
                if key == "hidden" or key == "style" and INVISIBLE.search(value):
                    hidden[i] = 1
                elif key != "style":
                    found.update(WORD.findall(value))
            for k, (_, words) in enumerate(HINTS):
                hints[i, k] = not words.isdisjoint(found)
        for c in x.children:
            if type(c) is str:
                size = len(c) - c.count(" ") if c.strip() else 0
                text[i] += size
                marks[i] += len(PUNCTUATION.findall(c)) if size else 0
                link[i] += size if in_link[i] else 0
        blocks[i] = x.tag in BLOCK
        inner[i] = x.tag == "p"
    own = text.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (text, link, marks, blocks, inner):
            a[p] += a[i]
    size, links = np.zeros(n), np.zeros(n)
    kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n, int)
    seen = np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        index[i] = seen[p]
        seen[p] += 1
    total = max(1.0, text[0])
    up = np.maximum(parent, 0)
    around = text[up] - text
    size[:], links[:] = np.log1p(text), link / np.maximum(1, text)
    tags = np.zeros((n, len(TAGS)))
    for i, x in enumerate(nodes):
        if x.tag in TAGS:
            tags[i, TAGS.index(x.tag)] = 1
    rest = [
        size, links, marks / np.maximum(1, text), np.log1p(blocks), np.log1p(inner), text / total, np.log1p(own), depth,
        text / np.maximum(1, text[up]), np.log1p(np.maximum(0, around)), index / np.maximum(1, kids[up] - 1), np.log1p(kids[up]), in_edge, hidden,
    ]
    return np.column_stack([tags, hints, above, *rest])


@dataclass
class Boosted:
    """Oblivious regression trees: of tree t, level d tests feature[t, d] > cut[t, d]."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bits = x[:, self.feature] > self.cut
        at = bits @ (1 << np.arange(self.feature.shape[1]))
        return self.base + self.leaf[np.arange(len(self.leaf)), at].sum(axis=1)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 32, depth: int = 4, rate: float = 0.3) -> Boosted:
    """Gradient boosting of the logistic loss by Newton steps."""
    cuts = [np.unique(np.quantile(c, np.linspace(0.05, 0.95, 19))) for c in x.T]
    cuts = [np.unique(np.append(k, 0.5)) if set(np.unique(c)) <= {0.0, 1.0} else k for k, c in zip(cuts, x.T, strict=True)]
    tests = [(j, c) for j, k in enumerate(cuts) for c in k.tolist() if 0 < (x[:, j] > c).sum() < len(x)]
    bits = np.stack([x[:, j] > c for j, c in tests], axis=1).astype(np.float64)
    share = np.average(y, weights=weight)
    base = float(np.log(share / (1 - share)))
    z = np.full(len(x), base)
    feature, cut, leaf = np.zeros((trees, depth), int), np.zeros((trees, depth)), np.zeros((trees, 1 << depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        at = np.zeros(len(x), int)
        for d in range(depth):
            gain = np.zeros(len(tests))
            for k in range(1 << d):
                here = at == k
                if here.any():
                    g1, h1 = g[here] @ bits[here], h[here] @ bits[here]
                    g0, h0 = g[here].sum() - g1, h[here].sum() - h1
                    gain += g1**2 / (h1 + 1) + g0**2 / (h0 + 1)
            best = int(gain.argmax())
            feature[t, d], cut[t, d] = tests[best]
            at += (bits[:, best] > 0).astype(int) << d
        leaf[t] = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + 1)
        z += leaf[t][at]
    return Boosted(base, feature, cut, leaf)


def example(rng: random.Random) -> str:
    """A page whose article elements carry the attribute data-keep."""
    letters = rng.choice(["abcdefghijklmnoprstuvw", "àbcdéfghijkòlmnöprstüv", "абвгдежзиклмнопрсту", "αβγδεζηικλμνοπρστυ"])
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    end = lambda: rng.choice([".", ".", ".", "!", "?", "%%%", ""])
    text = lambda a, b: ". ".join(words(3, 14).capitalize() for _ in range(rng.randint(a, b))) + end()
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b))) + "</ul>"
    pick = lambda *names: rng.choice(names)
    k = " data-keep"
    tag = lambda opening, content: f"<{opening}>{content}</{opening.split()[0]}>"

    def paragraph() -> str:
        kind = rng.random()
        body = text(1, 7) if rng.random() < 0.85 else words(1, 4)
        if kind < 0.12:
            body = f"<b{k}>{words(1, 5)}</b> {body}"
        elif kind < 0.22:
            body = f'{words(2, 6)} <a href="/{word()}"{k}>{words(1, 3)}</a> {body}'
        elif kind < 0.3:
            body = f"<b{k}>{words(1, 8)}<br><p{k}>{body}"
        return f"<p{k}>{body}</p>" if rng.random() < 0.9 else f"<div{k}>{body}</div>"

    def block() -> str:
        kind = rng.random()
        if kind < 0.78:
            return paragraph()
        if kind < 0.84:
            return tag(f"h{rng.randint(2, 4)}{k}", words(1, 7))
        if kind < 0.89:
            return f"<ul{k}>" + "".join(f"<li{k}>{words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote{k}><p{k}>{text(1, 3)}</p></blockquote>"
        if kind < 0.97:
            return f"<table{k}>" + "".join(f"<tr{k}><td{k}>{words(1, 3)}</td><td{k}>{words(1, 5)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        return f"<pre{k}>{words(3, 20)}</pre>"

    def comments() -> str:
        one = lambda: tag(f'{pick("li", "div", "article")} class="{pick("comment", "reply", "comment depth-1")}"', tag(pick("b", "cite", "span"), words(1, 2)) + f"<p>{text(1, 4)}</p>")
        name = pick('class="comments"', 'id="comments"', 'class="comment-list"', 'id="disqus_thread"', 'class="discussion"', 'class="reader-comments"')
        return tag(f"{pick('section', 'div')} {name}", f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 7))))

    junk = {
        "menu": lambda: tag(pick("nav", "nav", "div class=menu", "nav class=navbar", "div id=nav", "div role=navigation"), links(2, 9)),
        "ad": lambda: tag(f'{pick("div", "aside", "section")} class="{pick("ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot")}"', text(1, 3) + (link() if rng.random() < 0.4 else "")),
        "side": lambda: tag(pick("aside", "aside", "div class=sidebar", "aside class=widget", "div id=sidebar"), f"<h3>{words(1, 3)}</h3>" + (links(2, 6) if rng.random() < 0.6 else f"<p>{text(1, 4)}</p>")),
        "ask": lambda: f'<div {pick("class=cookie", "id=cookie-banner", "class=notice", "class=consent", "class=newsletter", "role=alert", "class=modal", "class=popup")}><p>{text(1, 3)}</p>{"<button>" + word() + "</button>" if rng.random() < 0.6 else ""}</div>',
        "form": lambda: f'<form action="/{word()}"><label>{words(1, 6)}</label><input name=q><p>{words(2, 9)}</p><button>{word()}</button></form>',
        "more": lambda: f'<div class="{pick("related", "recommended", "share", "social", "tags", "popular")}">{links(2, 6)}</div>',
        "crumbs": lambda: tag(f'{pick("div", "ol")} class="{pick("breadcrumb", "breadcrumbs")}"', f"{link()} {link()}"),
    }
    some = lambda n: "".join(junk[rng.choice(list(junk))]() for _ in range(rng.randint(0, n)))
    inside = [block() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12, 20]))]
    if rng.random() < 0.35 and inside:
        inside.insert(rng.randint(0, len(inside)), junk[pick("ad", "ad", "more", "ask", "form", "side")]())
    if rng.random() < 0.2:
        inside.append(comments())
    title = f"<h1{k}>{words(1, 9)}</h1>" if rng.random() < 0.9 or not inside else ""
    if rng.random() < 0.15:
        title = f"<header{k}>{title}</header>"
    wrap = rng.choice(
        ["<article{k}>{x}</article>"] * 4 + ["<main{k}><article{k}>{x}</article>{y}</main>", "<main{k}>{x}</main>", '<div class="content"{k}>{x}</div>', '<div id="main"{k}><div class="post"{k}>{x}</div>{y}</div>', "<section{k}><div{k}>{x}</div></section>", '<div class="article-body"{k}>{x}</div>', "<div{k}>{x}</div>"]
    )
    after = comments() if rng.random() < 0.35 else ""
    core = wrap.format(k=k, x=title + "".join(inside), y=after)
    head = f"<header>{'<h1>' + words(1, 3) + '</h1>' if rng.random() < 0.4 else '<p>' + words(1, 6) + '</p>'}{junk['menu']() if rng.random() < 0.5 else ''}</header>" if rng.random() < 0.5 else ""
    foot = tag(pick("footer", "footer", "div class=footer", "div id=footer"), pick("&copy; ", "") + f"{words(1, 6)} {text(0, 3)} {links(1, 4) if rng.random() < 0.4 else ''}") if rng.random() < 0.85 else ""
    body = f"{head}{junk['menu']() if rng.random() < 0.7 else ''}{some(3)}{core}{after if '{y}' not in wrap and rng.random() < 0.5 else ''}{some(3)}{foot}"
    if rng.random() < 0.2:
        body = f'<div class="wrapper"{k}>{body}</div>'
    return f"<html{k}><head><title>{words(1, 5)}</title></head><body{k}>{body}</body></html>"


_model: list[Boosted] = []


def model(pages: int = 450, seed: int = 11) -> Boosted:
    """The trees, learned once per process."""
    if not _model:
        rng = random.Random(seed)
        xs, ys = [], []
        for _ in range(pages):
            nodes = elements(parse(example(rng)))
            xs.append(features(nodes)[1:])
            ys.append(np.array([" data-keep" in n.attributes for n in nodes[1:]], float))
        x, y = np.concatenate(xs), np.concatenate(ys)
        _model.append(boost(x, y, np.ones(len(y))))
    return _model[0]


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which elements to keep: those of the best set that is closed under parents.

    Each element counts with the text it holds itself, so that a long block
    outweighs a doubtful wrapper; the root is always kept.
    """
    weight = np.array([1 + sum(len(c) for c in n.children if type(c) is str) ** 0.5 for n in nodes])
    best = np.clip(odds, -6, 6) * weight
    best[0] = 0
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent.number] += best[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent.number] and best[i] > 0
    return keep


SPACE = re.compile(r"\s+")


def blocks(nodes: list[Node], keep: np.ndarray) -> list[str]:
    """Visible text of the kept elements, by block."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(text)

    stack: list = [nodes[0]]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif type(n) is str:
            parts.append(n)
        elif n.tag in VOID:
            if n.tag == "br":
                parts.append(" ")
            elif n.tag == "hr":
                flush()
        elif n.tag in HIDDEN or not keep[n.number]:
            if n.tag in BLOCK:
                flush()
        else:
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(n.children))
    flush()
    return out


def main_text(page: str, trees: Boosted | None = None) -> str:
    nodes = elements(parse(page))
    return "\n".join(blocks(nodes, decode(nodes, (trees or model())(features(nodes)))))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of (page_id, url, html): page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, shared.value) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
