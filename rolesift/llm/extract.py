"""Main-text extraction: boosted trees over DOM nodes, decoded down the tree.

Every element of a page gets features: text and link density of its subtree,
depth, place among its siblings, tag and attribute words, and the same of its
parent. Boosted trees give the probability that it belongs to the article or
leads to it, given that its parent does. Decoding goes down the tree with these
conditional probabilities, so a dropped element never has a kept descendant nor a
kept one a dropped ancestor; the text of the kept elements is the result. (The
jointly likeliest labelling would charge long articles for their many elements.)

Training pages are made from a bounded sample of the pages: the part under an
``article`` or ``main`` element, or else the densest block, is set into new
frames with menus, headers, notices, adverts, forms, sidebars, comments and
footers under changing tags and class names, or none; their labels are known
because the frames are made here.

Defined results: null and empty pages have empty text; script, style and similar
elements and comments never count, a self-closed svg ends at once; text outside
any element is text of the body; an open head ends at text or at an element that
cannot stand in it; repeated rows are extracted each; a sample without pages gives
a model that keeps all that is no boilerplate by its tag. Other columns are not
read. Pages are parsed whole, in Arrow batches, with nothing shuffled.
"""

from __future__ import annotations

import bisect
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<svg(?=[\s/>])(?:[^>"']++|"[^"]*"|'[^']*')*+(?<=/)>"""
    r"|<(script|style|noscript|template|iframe|svg|textarea|select)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements that can stand in head; any other ends it.
IN_HEAD = set("base basefont bgsound head link meta noframes title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others end a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag closes if it stands open in the same parent.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select", "datalist"}}
#: Words of class, id and role attributes, each a feature of its own group.
GOOD = set("article articlebody body content entry main post story text prose page".split())
BAD = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc tabs pager pagination links".split(),
    "frame": "header footer masthead banner top bottom copyright legal head foot".split(),
    "side": "sidebar aside rail widget related recommended trending popular more side".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion".split(),
    "note": "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup gdpr paywall message".split(),
    "talk": "comment comments discussion disqus reply replies respond thread reader responses".split(),
    "act": "form login search share sharing social tools button buttons toolbar actions meta byline".split(),
}
BAD_OF = {w: k for k, ws in enumerate(BAD.values()) for w in ws}
TAGS = ["article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "ul", "li", "a", "table", "h1", "h2", "blockquote", "pre", "figure", "head", "title", "button"]
NEVER = {"head", "title", "nav", "footer", "aside", "form", "button", "dialog", "menu"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "text", "links", "size", "n_kids", "paras", "depth")

    def __init__(self, tag: str, attrs: str, parent: int, depth: int):
        self.tag, self.attrs, self.parent, self.depth = tag, attrs, parent, depth
        self.kids: list = []  # child numbers and texts in order
        self.text = self.links = self.size = self.n_kids = self.paras = 0


class Open:
    """The open elements, with the places of each tag and of the blocks among them: no step walks the stack."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.at, self.blocks = nodes, [0], {}, []

    def top(self) -> int:
        return self.stack[-1]

    def push(self, number: int) -> None:
        tag = self.nodes[number].tag
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(number)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all above it."""
        while len(self.stack) > place:
            tag = self.nodes[self.stack.pop()].tag
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag closes the nearest element of its name; one of a line's elements reaches over no block."""
        places = self.at.get(tag)
        if places and not (tag in INLINE and self.blocks and self.blocks[-1] > places[-1]):
            self.cut(places[-1])

    def make_room(self, tag: str) -> None:
        """What a new block ends: an open paragraph, or the item before it in the same list."""
        if tag not in CLOSES:
            if self.blocks and self.nodes[self.stack[self.blocks[-1]]].tag == "p":
                self.cut(self.blocks[-1])
            return
        floor = max((self.at[t][-1] for t in HOLDS.get(tag, ()) if self.at.get(t)), default=0)
        ended = []
        for t in {"p", *CLOSES[tag]}:
            places = self.at.get(t, [])
            k = bisect.bisect_right(places, floor)
            ended += places[k : k + 1]
        if ended:
            self.cut(min(ended))


def parse(page: str) -> list[Node]:
    """Elements in page order, parents first; number 0 is the root."""
    nodes = [Node("html", "", -1, 0)]
    open_ = Open(nodes)
    at = 0

    def text(s: str) -> None:
        if s:
            if nodes[open_.top()].tag == "head" and not s.isspace():
                open_.cut(len(open_.stack) - 1)
            nodes[open_.top()].kids.append(html.unescape(s) if "&" in s else s)

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            open_.close(tag)
            continue
        if tag == "html":
            nodes[0].attrs += m[4] or ""
            continue
        if tag not in INLINE and tag not in VOID:
            open_.make_room(tag)
        if nodes[open_.top()].tag == "head" and tag not in IN_HEAD:
            open_.cut(len(open_.stack) - 1)
        parent = open_.top()
        nodes.append(Node(tag, m[4] or "", parent, nodes[parent].depth + 1))
        nodes[parent].kids.append(len(nodes) - 1)
        if tag not in VOID and not (m[4] or "").endswith("/"):
            open_.push(len(nodes) - 1)
    text(page[at:])
    return nodes


def _words(attrs: str) -> list[str]:
    out = []
    for k, a, b, c in ATTRIBUTE.findall(attrs):
        if k.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            out += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features for each element."""
    n = len(nodes)
    for k in range(n - 1, -1, -1):
        x = nodes[k]
        for kid in x.kids:
            if isinstance(kid, str):
                x.text += len(kid.strip())
            else:
                y = nodes[kid]
                x.text += y.text
                x.links += y.text if y.tag == "a" else y.links
                x.size += y.size + 1
                x.paras += y.paras + (y.tag == "p" and y.text > 60)
                x.n_kids += 1
    total = max(1, nodes[0].text)
    words = [_words(x.attrs) if x.attrs else [] for x in nodes]
    bad = np.zeros((n, len(BAD) + 1))
    for k, ws in enumerate(words):
        for w in ws:
            if w in BAD_OF:
                bad[k, BAD_OF[w]] = 1
            elif w in GOOD:
                bad[k, -1] = 1
    place, before = np.zeros(n), np.zeros(n)
    seen = 0
    for k, x in enumerate(nodes):
        before[k] = seen / total
        seen += sum(len(s.strip()) for s in x.kids if isinstance(s, str))
        i = 0
        for kid in x.kids:
            if not isinstance(kid, str):
                place[kid] = i / max(1, x.n_kids)
                i += 1
    one = np.array(
        [
            [np.log1p(x.text), x.text / total, x.links / max(1, x.text), np.log1p(x.size), x.text / (x.size + 1), x.n_kids, x.paras, x.depth, TAGS.index(x.tag) if x.tag in TAGS else -1, x.tag in NEVER, x.tag in ("article", "main"),
             x.tag in INLINE, x.tag == "p", x.tag in ("header", "h1", "h2", "h3")]
            for x in nodes
        ],
        float,
    )
    parent = np.array([max(0, x.parent) for x in nodes])
    # Whether the element or one above it has a telling tag or word.
    above = np.zeros((n, 3))
    for k, x in enumerate(nodes):
        own = [x.tag in NEVER, bad[k, :-1].any(), x.tag in ("article", "main") or bad[k, -1] > 0]
        above[k] = own if x.parent < 0 else np.maximum(own, above[x.parent])
    return np.column_stack([one, bad, place, before, above, one[parent][:, [0, 1, 2, 5, 6, 8]], bad[parent].max(axis=1)])


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Labels down the tree: kept if the parent is, and likelier than not given that (``p``)."""
    out = np.zeros(len(nodes), bool)
    out[0] = True
    for k in range(1, len(nodes)):
        out[k] = out[nodes[k].parent] and p[k] > 0.5
    return out


def rendered(nodes: list[Node], kept: np.ndarray) -> str:
    """Text of the kept elements in page order, white space in and between blocks as one space."""
    out: list[str] = []
    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        k, i = stack.pop()
        x = nodes[k]
        if i == 0 and x.tag not in INLINE:
            out.append("\n")
        while i < len(x.kids):
            kid = x.kids[i]
            i += 1
            if isinstance(kid, str):
                out.append(kid)
            elif kept[kid]:
                stack += [(k, i), (kid, 0)]
                break
            else:
                out.append("\n")
        else:
            if x.tag not in INLINE:
                out.append("\n")
    return " ".join("".join(out).split())


def forbidden(nodes: list[Node]) -> np.ndarray:
    """Elements that are no page content whatever the model says, head and its parts."""
    return np.array([x.tag in ("head", "title", "meta", "link") for x in nodes])


# --- training pages -----------------------------------------------------------

HOSTS = ['<article>{}</article>', '<main>{}</main>', '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post-body">{}</div>',
         '<section class="story">{}</section>', '<div class="entry-content">{}</div>', '<div>{}</div>', '<div class="c1"><div class="c2">{}</div></div>',
         '<main><article>{}</article></main>', '<td>{}</td>']
FRAMES = [
    '<nav><ul>{links}</ul></nav>', '<div class="menu">{links}</div>', '<ul class="nav">{links}</ul>', '<div><ul>{links}</ul></div>',
    '<header><a href="/">{few}</a><p>{few}</p></header>', '<div id="header"><h2>{few}</h2></div>', '<div class="ad">{some}</div>', '<div class="sponsored"><p>{some}</p></div>',
    '<aside><h3>{few}</h3><p>{some}</p></aside>', '<div class="sidebar"><h3>{few}</h3><ul>{links}</ul><p>{some}</p></div>', '<div class="related"><ul>{links}</ul></div>',
    '<div class="cookie-notice"><p>{some}</p><button>{few}</button></div>', '<div role="alert">{some}</div>', '<div class="notice">{some}</div>',
    '<form action="/s"><label>{few}</label><input name="q"><button>{few}</button></form>', '<div class="newsletter"><p>{some}</p><form><input></form></div>',
    '<section class="comments"><h3>{few}</h3><div class="comment"><p>{long}</p></div><div class="comment"><p>{some}</p></div></section>',
    '<div id="comments"><ol><li><p>{long}</p></li><li><p>{some}</p></li></ol></div>', '<footer>&copy; {some}</footer>', '<footer><p>{few}</p><ul>{links}</ul></footer>',
    '<div class="footer"><p>{some}</p></div>', '<div class="share">{links}</div>', '<div class="breadcrumb">{links}</div>',
]


def article_of(page: str) -> list[str]:
    """Paragraph texts of the marked article, or of the block with most paragraph text."""
    nodes = parse(page)
    features(nodes)
    best = max(range(len(nodes)), key=lambda k: (nodes[k].tag in ("article", "main") and nodes[k].text > 0, nodes[k].paras, nodes[k].depth))
    inside = [False] * len(nodes)
    out = []
    for k, x in enumerate(nodes):
        inside[k] = k == best or (x.parent >= 0 and inside[x.parent])
        if inside[k] and x.tag in ("p", "h1", "h2", "li"):
            s = " ".join(" ".join(t for t in x.kids if isinstance(t, str)).split())
            if s:
                out.append(s)
    return out


def made_page(paragraphs: list[str], others: list[str], rng: random.Random) -> str:
    """A page with the paragraphs as its article; elements of it carry the attribute ``data-keep``."""
    words = [w for p in others for w in p.split()] or ["word"]

    def some(lo: int, hi: int) -> str:
        at = rng.randrange(len(words))
        return html.escape(" ".join(words[at : at + rng.randint(lo, hi)]))

    def frame() -> str:
        f = rng.choice(FRAMES)
        links = "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(rng.randint(2, 8)))
        return f.format(links=links, few=some(1, 4), some=some(5, 25), long=some(20, 90))

    body = "".join(
        f"<{t} data-keep>{'<b data-keep>' if rng.random() < 0.15 else ''}{html.escape(p)}</{t}>"
        if rng.random() > 0.1
        else f"<ul data-keep><li data-keep>{html.escape(p)}</li></ul>"
        for p, t in ((p, "h1" if k == 0 and rng.random() < 0.6 else "h2" if len(p) < 50 and rng.random() < 0.3 else "p") for k, p in enumerate(paragraphs))
    )
    if rng.random() < 0.3:
        body += frame()
    host = re.sub(r"<(\w+)", r"<\1 data-keep", rng.choice(HOSTS)).format(body)
    if host.startswith("<td"):
        host = f"<table data-keep><tr data-keep><td>{frame()}</td>{host}</tr></table>"
    if rng.random() < 0.3:
        host = f'<div data-keep class="{rng.choice(["wrapper", "container", "page", "layout", "row"])}">{host}{frame()}</div>'
    above = "".join(frame() for _ in range(rng.randint(1, 4)))
    below = "".join(frame() for _ in range(rng.randint(1, 4)))
    return f"<html><head><title>{some(2, 9)}</title></head><body data-keep>{above}{host}{below}</body></html>"


def examples(pages: DataFrame, sample_pages: int = 300, versions: int = 3, seed: int = 5) -> DataFrame:
    """features and label of the elements of made pages, from about ``sample_pages`` pages picked by a hash."""
    n = pages.count()
    part = min(1.0, sample_pages / n) if n else 1.0
    picked = pages.where(F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(1 << 20)) < int(part * (1 << 20))).select("page_id", "html")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article_of(x.as_py() or "") for x in batch.column(1)]
            rows, labels = [], []
            for k, paragraphs in enumerate(texts):
                if not paragraphs:
                    continue
                rng = random.Random(f"{seed}-{batch.column(0)[k].as_py()}")
                others = texts[rng.randrange(len(texts))] or paragraphs
                for v in range(versions):
                    some = paragraphs if v == 0 else paragraphs[: rng.randint(1, len(paragraphs))]
                    nodes = parse(made_page(some, others, rng))
                    keep = [k == 0 or "data-keep" in x.attrs for k, x in enumerate(nodes)]
                    for x in nodes:
                        x.attrs = x.attrs.replace("data-keep", "")
                    # Only where the parent is kept is there anything to decide.
                    asked = [k for k, x in enumerate(nodes) if k and keep[x.parent] and x.tag != "head"]
                    rows += features(nodes)[asked].tolist()
                    labels += [int(keep[k]) for k in asked]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["features", "label"])

    return written(picked.mapInArrow(make, "features array<double>, label int"))


def train(pages: DataFrame, sample_pages: int = 300, n_trees: int = 20, depth: int = 5) -> list | None:
    """Forest tables; None without examples."""
    model = trees.fit(examples(pages, sample_pages), n_trees, depth)
    return trees.tables(model, pages.sparkSession) if model is not None else None


def text_of(pages: list[str], forest: list | None) -> list[str]:
    """Main text of each page."""
    parsed = [parse(p) for p in pages]
    rows = [features(n) for n in parsed]
    if forest is None:
        probs = [np.where([x.tag in NEVER for x in n], 0.05, 0.95) for n in parsed]
    else:
        p = np.clip(1 / (1 + np.exp(-2 * trees.margin(np.concatenate(rows), forest))), 1e-4, 1 - 1e-4)
        probs = np.split(p, np.cumsum([len(r) for r in rows])[:-1])
    out = []
    for nodes, p in zip(parsed, probs, strict=True):
        out.append(rendered(nodes, decode(nodes, np.where(forbidden(nodes), 1e-9, p))))
    return out


def extract(pages: DataFrame, forest: list | None, together: int = 64) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                part = batch.slice(at, together)
                texts = text_of([x.as_py() or "" for x in part.column(2)], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
