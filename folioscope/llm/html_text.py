"""Main text of web pages: boosted trees over features of DOM nodes, decoded down the tree.

Each block element of a page is a node. The trees give the log-odds that it belongs to the article; the decoder then picks the
best set of nodes in which no node is kept below one that is dropped. The kept blocks' texts are the result.
The trees are trained on labelled pages that are generated here in many layouts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import by_bytes

#: Bytes of pages held at a time, and generated pages that the trees are trained on.
BLOCK, TRAINING_PAGES = 4 << 20, 1000

# Elements by how they are read.
RAW = "script style noscript template textarea title iframe svg object xmp noembed noframes".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = (
    "html body p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main nav header footer aside form fieldset table caption "
    "thead tbody tfoot tr td th blockquote pre figure figcaption details summary address dialog menu search hgroup select option button label center head"
).split()
KINDS = {
    "text": "p blockquote pre dd dt",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "item": "li",
    "list": "ul ol dl",
    "box": "div section center",
    "article": "article",
    "main": "main",
    "nav": "nav menu",
    "header": "header",
    "footer": "footer address",
    "aside": "aside dialog details summary",
    "form": "form fieldset select option button label search",
    "table": "table caption thead tbody tfoot tr td th",
    "figure": "figure figcaption",
    "top": "html body head",
    "stray": "#text",
}
# Words in class, id and role that tell what a box is for.
WORDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs topbar",
    "ad": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner teaser",
    "foot": "footer foot copyright colophon legal bottom imprint",
    "head": "header masthead head top logo branding",
    "side": "sidebar side aside widget widgets related recommended rail secondary complementary more",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe gdpr privacy dialog toast",
    "comment": "comment comments reply replies disqus respond discussion responses feedback",
    "social": "share social sharing follow buttons tags meta byline",
    "form": "form search login signup contact register input",
    "content": "content article post entry main story text body page single hentry articlebody prose",
}
BLOCK_SET = set(BLOCKS)
STRAY = "#text"
CLOSES_P = BLOCK_SET - {"option", "label", "button", "select", "summary"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KIND_OF = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags.split()}
WORD_OF = {w: i for i, ws in enumerate(WORDS.values()) for w in ws.split()}

#: What isn't text: comments, tags, and a tag that the page's end cuts. A tag that doesn't end, as a quote in it stays open, is ``torn``.
TOKEN = re.compile(
    r"<!--(?P<note>.*?)(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|(?P<torn><(?=/?[a-z]))|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
#: The same from the first torn tag on, where quotes mean nothing.
UNQUOTED = re.compile(r"<!--(?P<note>.*?)(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>[^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.I | re.S)
CUT = re.compile(r"<[a-z][^<>]*+\Z", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LABEL = re.compile(r"data-label=.?(\d)")
SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """Block nodes in page order, node 0 being the page itself, and its stretches of text with their owners.

    A stretch of text that lies in no block element has a node of its own, so that it is judged like any other.
    """

    tags: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    words: list[int] = field(default_factory=lambda: [0])
    labels: list[int] = field(default_factory=lambda: [1])
    owners: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)


def word_flags(attrs: str) -> int:
    """The groups of words that class, id and role name, as bits."""
    flags = 0
    for m in NAMES.finditer(attrs):
        for part in PARTS.findall(m[1] or m[2] or m[3] or ""):
            if (k := WORD_OF.get(part.lower())) is not None:
                flags |= 1 << k
    return flags


def tokens(source: str) -> Iterator[tuple[int, int, re.Match]]:
    """Comments and tags with where they begin and end; raw elements end with their end tags, or with the page."""
    last = source.rfind(">") + 1  # no tag ends after it
    pattern, at = TOKEN, 0
    while True:
        for m in pattern.finditer(source, at, last):
            at = m.end()
            if pattern is TOKEN and m["torn"]:
                pattern, at = UNQUOTED, m.start()
                break
            tag = (m["tag"] or "").lower()
            if tag in RAW_END and not m["end"] and not (tag == "svg" and m["attrs"].endswith("/")):
                end = RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
                yield m.start(), at, m
                break
            yield m.start(), at, m
        else:
            return


class Stack:
    """Open elements, the node that each lies in, and where the last one of each name stands; node 0 is the page."""

    def __init__(self):
        self.open: list[tuple[str, int]] = [("", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK_SET:
            self.blocks.append(len(self.open))
        self.open.append((tag, node))

    def last(self, tags) -> int:
        """The place of the last open element of these names, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, k: int) -> bool:
        """Closes the element at a place and all in it; whether a block is among them."""
        block = self.blocks[-1] >= k
        while len(self.open) > k:
            tag, _ = self.open.pop()
            self.places[tag].pop()
        while self.blocks[-1] >= k:
            self.blocks.pop()
        return block


def parse(source: str) -> Page:
    """Reads a page forgivingly: unknown, unclosed and misplaced tags are mended as browsers do, comments and raw elements go.

    Text between two block boundaries is one stretch, whatever inline elements it runs through; ``br`` counts as white space.
    The time is in proportion to the page's size, however its elements nest.
    """
    page = Page()
    stack = Stack()
    pieces: list[str] = []
    links = tags = stray = 0

    def node(tag: str, words: int, label: int) -> int:
        page.tags.append(tag)
        page.parents.append(stack.open[-1][1] if tag != STRAY else 0)
        page.depths.append(page.depths[page.parents[-1]] + 1)
        page.words.append(words)
        page.labels.append(label)
        return len(page.tags) - 1

    def flush() -> None:
        nonlocal links, tags
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                page.owners.append(stack.open[-1][1] or node(STRAY, 0, stray))
                page.texts.append(text)
                page.linked.append(min(links, len(text)))
                page.inline.append(tags)
            pieces.clear()
        links = tags = 0

    def close(k: int) -> None:
        if stack.blocks[-1] >= k:
            flush()
        stack.close(k)

    at = in_link = 0
    for start, end, m in tokens(source):
        if start > at:
            piece = source[at:start]
            pieces.append(piece)
            if in_link:
                links += len(piece)
        at = end
        if not (tag := m["tag"]):
            if (m["note"] or "").startswith("stray-label="):  # of generated pages
                flush()
                stray = int(m["note"][-1])
            continue
        tag = tag.lower()
        if tag in RAW_END:
            continue
        if m["end"]:
            if tag == "a":
                in_link = 0
            k = stack.last((tag,))
            if k and (tag in BLOCK_SET or k > stack.blocks[-1]):
                close(k)
            continue
        if tag not in BLOCK_SET:
            tags += 1
            if tag in ("br", "hr", "img"):
                pieces.append(" ")
            if tag == "a":
                in_link = 1
            if tag not in VOID and not m["attrs"].endswith("/"):
                stack.push(tag, stack.open[-1][1])
            continue
        in_link = 0
        if tag in CLOSES_P and stack.open[stack.blocks[-1]][0] == "p":
            close(stack.blocks[-1])
        if tag in ENDS:
            ends, stops = ENDS[tag]
            while (k := stack.last(ends)) > stack.last(stops):
                close(k)
                if tag != "tr":
                    break
        flush()
        if tag in ("html", "body"):
            continue
        if tag != "head" and len(stack.open) > 1 and stack.open[-1][0] == "head":
            close(len(stack.open) - 1)
        attrs = m["attrs"]
        stack.push(tag, node(tag, word_flags(attrs) if attrs else 0, int(x[1]) if (x := LABEL.search(attrs)) else 0))
    pieces.append(CUT.sub("", source[at:]))
    flush()
    return page


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of some pages, their parents and their depths."""
    counts = np.array([len(p.tags) for p in pages], np.int64)
    base = np.cumsum(counts) - counts
    n = int(counts.sum())
    first = np.repeat(base, counts)
    parent = np.concatenate([np.array(p.parents, np.int64) for p in pages]) + first
    parent[base] = base
    kind = np.array([KIND_OF.get(t, len(KINDS)) for p in pages for t in p.tags], np.int64)
    words = np.array([w for p in pages for w in p.words], np.int64)
    owner = np.concatenate([np.array(p.owners, np.int64) + b for p, b in zip(pages, base, strict=True)])
    sizes = np.array([len(t) for p in pages for t in p.texts], float)
    marks = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for p in pages for t in p.texts], float)
    sums = lambda values: np.bincount(owner, values, n) if len(owner) else np.zeros(n)
    own = [sums(sizes), sums(np.array([x for p in pages for x in p.linked], float)), sums(marks), sums(np.array([x for p in pages for x in p.inline], float)), np.ones(n), (kind == KIND_OF["p"]).astype(float)]
    depth = np.array([d for p in pages for d in p.depths], np.int64)
    top = parent == np.arange(n)
    deep = np.argsort(-depth, kind="stable")
    levels = np.split(deep, np.flatnonzero(np.diff(depth[deep])) + 1)
    subtree = np.stack(own)
    for level in levels[:-1] if len(levels) > 1 else []:
        for row in subtree:
            np.add.at(row, parent[level], row[level])
    bits = (words[:, None] >> np.arange(len(WORDS))) & 1
    around = np.zeros((n, len(WORDS) + len(KINDS) + 1))  # of all elements above
    one = np.eye(len(KINDS) + 1)[kind]
    for level in levels[::-1][1:]:
        p = parent[level]
        around[level] = np.maximum(around[p], np.concatenate([bits[p], one[p]], axis=1))
    children = np.bincount(parent[~top], minlength=n)
    order = np.lexsort((np.arange(n), parent))
    place = np.zeros(n)
    starts = np.flatnonzero(np.concatenate([[True], parent[order][1:] != parent[order][:-1]]))
    place[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    like = np.unique(parent * 32 + kind, return_inverse=True)[1]
    alike = np.bincount(like)[like]
    chars, linked, marks, inline, nodes, paragraphs = subtree
    page_chars = np.maximum(chars[first], 1)
    siblings = children[parent]
    numbers = [
        np.minimum(depth, 20), np.minimum(place, 50), np.minimum(siblings, 50), np.minimum(children, 50), place / np.maximum(siblings, 1), alike / np.maximum(siblings, 1),
        np.log1p(chars), np.log1p(own[0]), linked / np.maximum(chars, 1), chars / nodes, marks / np.maximum(chars, 1), np.log1p(paragraphs), inline / np.maximum(chars, 1), chars / page_chars, chars / np.maximum(chars[parent], 1), np.log1p(chars[parent]),
    ]
    return np.concatenate([one, bits, around, np.stack(numbers, axis=1)], axis=1), parent, depth


def decode(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which nodes to keep so that the sum of their log-odds is greatest and every kept node lies in a kept one.

    From the leaves up, a subtree is worth its node's odds and the best of its children, or nothing; from the page
    down, a subtree that is worth something is kept if its parent is. The page itself is always kept.
    """
    worth = np.clip(odds, -6, 6).astype(float)
    deep = np.argsort(-depth, kind="stable")
    levels = np.split(deep, np.flatnonzero(np.diff(depth[deep])) + 1)
    for level in levels[:-1]:
        np.add.at(worth, parent[level], np.maximum(worth[level], 0))
    kept = np.zeros(len(odds), bool)
    kept[levels[-1]] = True
    for level in levels[::-1][1:]:
        kept[level] = kept[parent[level]] & (worth[level] > 0)
    return kept


class Writer:
    """Generates a labelled page: elements of the article carry data-label=1, others 0."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.loose = rng.random() < 0.3  # leaves out end tags that may be left out

    def pick(self, *xs):
        return xs[int(self.rng.integers(len(xs)))]

    def some(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        out = ["".join(self.pick("an", "re", "to", "li", "sha", "con", "ver", "é", "mu", "st", "ing") for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        text = "".join(w + (", " if self.some(0.08) else ". " if self.some(0.08) else " ") for w in out).strip()
        return text.capitalize() + self.pick(".", ".", ".", "", "!")

    def tag(self, name: str, label: int, inner: str, names: str = "", end: bool = True) -> str:
        attrs = f' {self.pick("class", "class", "id")}="{names}"' if names else ""
        return f'<{name} data-label="{label}"{attrs}>{inner}' + (f"</{name}>" if end else "")

    def named(self, group: str) -> str:
        name = self.pick(*WORDS[group].split())
        return self.pick(name, f"{name}-{self.pick('box', 'wrap', '1', 'area', 'inner')}", f"site-{name}", f"{name} clearfix")

    def link(self) -> str:
        return f'<a href="/{int(self.rng.integers(1000))}">{self.words(1, 3)}</a>'

    def links(self, label: int = 0) -> str:
        items = [self.tag("li", label, self.link(), end=not self.loose) for _ in range(int(self.rng.integers(2, 9)))]
        return self.pick(self.tag("ul", label, "".join(items)), self.tag("p", label, self.pick(" | ", " ").join(self.link() for _ in range(4))))

    def paragraph(self, label: int, low: int = 3, high: int = 120) -> str:
        text = self.words(low, high)
        if self.some(0.3):
            text = self.pick(f"<b>{self.words(1, 8)}</b><br>{text}", f"<b>{self.words(1, 8)}<br>{text}", f"<b>{text}<br>")
        if self.some(0.15):
            text += f" {self.link()} {self.words(2, 20)}"
        return self.tag("p", label, text, end=not self.loose and self.some(0.95))

    def article(self) -> str:
        parts = [self.tag(self.pick("h1", "h1", "h2"), 1, self.words(2, 10))] if self.some(0.85) else []
        if parts and self.some(0.12):
            parts = [self.tag("header", 1, parts[0])]
        for _ in range(int(self.rng.integers(1, 3 if self.some(0.5) else 25))):
            kind = self.rng.random()
            if kind < 0.8:
                parts.append(self.paragraph(1, 1, self.pick(2, 30, 120, 120)))
            elif kind < 0.86:
                parts.append(self.tag(self.pick("h2", "h3"), 1, self.words(1, 7)))
            elif kind < 0.9:
                parts.append(self.tag(self.pick("ul", "ol"), 1, "".join(self.tag("li", 1, self.words(3, 20), end=not self.loose) for _ in range(4))))
            elif kind < 0.93:
                parts.append(self.tag("blockquote", 1, self.pick(self.words(5, 40), self.paragraph(1))))
            elif kind < 0.95:
                parts.append(self.tag("table", 1, "".join(self.tag("tr", 1, "".join(self.tag("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(3))))
            else:
                parts.append(self.pick(self.advert, self.related, self.share)())
        return "".join(parts)

    def advert(self) -> str:
        return self.tag(self.pick("div", "div", "aside", "section"), 0, self.pick(self.words(3, 40), self.paragraph(0, 3, 40), self.words(2, 10) + self.link()), self.named("ad"))

    def related(self) -> str:
        head = self.tag(self.pick("h3", "h4", "p"), 0, self.words(1, 3))
        return self.tag(self.pick("aside", "div", "section"), 0, head + self.pick(self.links(), self.paragraph(0, 5, 60) + self.links(), self.paragraph(0, 5, 60)), self.named("side"))

    def share(self) -> str:
        return self.tag("div", 0, " ".join(self.link() for _ in range(3)), self.named("social"))

    def menu(self) -> str:
        return self.pick(self.tag("nav", 0, self.links()), self.tag(self.pick("div", "nav", "ul"), 0, self.links(), self.named("nav")))

    def head(self) -> str:
        inner = self.pick(self.tag("div", 0, self.words(1, 4), "logo"), self.tag("h1", 0, self.words(1, 3)), self.tag("p", 0, self.words(2, 8))) + (self.menu() if self.some(0.6) else "")
        return self.pick(self.tag("header", 0, inner), self.tag("div", 0, inner, self.named("head")))

    def foot(self) -> str:
        inner = "&copy; " + self.words(1, 12)
        inner = self.pick(inner, self.tag("p", 0, inner), self.links() + self.tag("p", 0, inner))
        return self.pick(self.tag("footer", 0, inner), self.tag("footer", 0, inner), self.tag("div", 0, inner, self.named("foot")))

    def notice(self) -> str:
        return self.tag(self.pick("div", "section", "aside"), 0, self.paragraph(0, 5, 40) + self.tag("button", 0, "OK"), self.named("notice"))

    def form(self) -> str:
        return self.tag("form", 0, self.tag("label", 0, self.words(1, 3)) + "<input name=q>" + self.tag("button", 0, self.words(1, 2)) + (self.tag("p", 0, self.words(3, 20)) if self.some(0.4) else ""), self.named("form") if self.some(0.5) else "")

    def comments(self) -> str:
        one = lambda: self.tag(self.pick("div", "li", "article"), 0, self.tag(self.pick("p", "div", "h4"), 0, self.words(1, 3)) + self.paragraph(0, 3, 80), self.named("comment"))
        return self.tag(self.pick("section", "div", "ol", "aside"), 0, self.tag("h3", 0, self.words(1, 3)) + "".join(one() for _ in range(int(self.rng.integers(1, 6)))), self.named("comment"))

    def stray(self, label: int, inner: str) -> str:
        """Text in no block; the note before it labels it."""
        return f"<!--stray-label={label}-->{inner}<!--stray-label=0-->"

    def bare(self) -> str:
        """Text without any block."""
        return self.stray(1, self.words(1, self.pick(6, 60)) + self.pick("", "<br>" + self.words(3, 40)))

    def page(self) -> str:
        if self.some(0.04):
            return self.bare()
        inner = self.article()
        if self.some(0.25):
            inner += self.pick(self.comments, self.share, self.related, self.form)()
        main = self.pick(
            lambda: self.tag("article", 1, inner), lambda: self.tag("article", 1, inner, self.named("content")), lambda: self.tag("main", 1, inner), lambda: self.tag("main", 1, self.tag("article", 1, inner)),
            lambda: self.tag("div", 1, inner, self.named("content")), lambda: self.tag("div", 1, self.tag("div", 1, inner, self.named("content")), self.pick("wrapper", "container", "")), lambda: self.tag("section", 1, inner, self.named("content")), lambda: self.tag("div", 1, inner),
        )()
        before = [f() for f, p in ((self.head, 0.5), (self.menu, 0.6), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.2), (self.related, 0.15)) if self.some(p)]
        after = [f() for f, p in ((self.advert, 0.3), (self.comments, 0.35), (self.related, 0.4), (self.form, 0.2), (self.notice, 0.15), (self.menu, 0.2), (self.foot, 0.8)) if self.some(p)]
        if self.some(0.12):
            before, after = [], []
        if self.some(0.25):
            before.append(self.stray(0, self.pick(self.words(1, 5), self.link(), f"{self.link()} | {self.link()}", "&nbsp;")))
        if self.some(0.1):
            after.insert(0, self.stray(0, self.pick(self.words(1, 8), self.link())))
        if self.some(0.12):  # the article's text lies in the page itself
            lines = [self.pick("<br><br>", "<p>", "<hr>").join(self.words(12, 90) for _ in range(int(self.rng.integers(1, 6))))]
            main = (self.tag("h1", 1, self.words(2, 9)) if self.some(0.6) else "") + self.stray(1, "".join(lines).replace("<p>", '<p data-label="1">'))
        self.rng.shuffle(before)
        script = "<script>var a='<p>x</p>';</script><!-- c -->" if self.some(0.5) else ""
        body = "".join([*before, script, main, *after])
        if self.some(0.2) and "stray-label" not in body:
            body = self.tag("div", 1, body, self.pick("wrapper", "container", "site"))
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>"


@lru_cache(maxsize=2)
def train(pages: int = TRAINING_PAGES, seed: int = 5) -> Boosted:
    """The trees, from generated labelled pages: the result is the same each time, and a process trains once."""
    rng = np.random.default_rng(seed)
    parsed = [parse(Writer(rng).page()) for _ in range(pages)]
    x, _, depth = features(parsed)
    y = np.array([v for p in parsed for v in p.labels], float)
    return Boosted(trees=80).fit(x[depth > 0], y[depth > 0])


def main_texts(model: Boosted, sources: list[str | None]) -> list[str]:
    """The main text of each page: its kept blocks in page order, joined by line ends."""
    pages = [parse(s or "") for s in sources]
    x, parent, depth = features(pages)
    kept = decode(model.predict(x), parent, depth)
    out, base = [], 0
    for p in pages:
        # what stands in a head is never shown
        out.append("\n".join(t for o, t in zip(p.owners, p.texts, strict=True) if kept[base + o] and p.tags[o] not in ("head", "body")))
        base += len(p.tags)
    return out


def extract(pages: DataFrame, model: Boosted, key: str = "page_id", source: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of each whole page: the key, the columns in ``keep``, text and n_chars, its code points.

    Null and empty pages have an empty text, as have pages without any; text outside all block elements is judged stretch by stretch. Repeated rows are
    read each; an empty table gives none; other columns aren't read. No row moves.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)
    names = {f"keep_{i}": c for i, c in enumerate(keep)}
    own = pages.select(F.col(source).alias("source"), F.col(key).alias("key"), *(F.col(c).alias(n) for n, c in names.items()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "source", BLOCK):
            texts = main_texts(held.value, batch.column("source").to_pylist())
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            del columns["source"]
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "source"]
    found = own.mapInArrow(read, ", ".join([*kinds, "text string", "n_chars long"]))
    return found.select(F.col("key").alias(key), *(F.col(n).alias(c) for n, c in names.items()), "text", "n_chars")
