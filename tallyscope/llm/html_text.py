"""Main-text extraction by minimum-cut labelling.

A page becomes a sequence of text blocks with their DOM paths. A classifier turns each
block's features (tags and names on its path, link density, length, sentence marks) into a
log-odds cost, which becomes the capacity of the block's edge to the content or to the
boilerplate terminal. Neighbouring blocks and blocks of one container are tied by smoothness
edges, stronger the more of the DOM path they share. The minimum cut (max-flow) labels the
blocks; content blocks are joined in page order by one line feed.

Pages are read from left to right once, whatever markup they hold: a tag ends at the first ">"
outside closed quotes, one without any is text, and elements know their parent, so neither
broken tags nor deep nesting cost more than their length. Names count as whole attribute
values of class, id, role and itemprop; what they say against an element does not count where
it holds the page itself (html, body, main, the first heading, or nearly all text).

Null html counts as empty: empty text, 0 code points. One row out per row in, whole pages,
no shuffle; only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.ragged import row_slices

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is not text of the page.
RAW_TAGS = "script|style|noscript|template|textarea|title|svg|iframe|object|canvas|math|select|button"
#: Open elements that an opening block closes (their end tags may be left out).
IMPLIED_END = {
    **dict.fromkeys("li dd dt tr td th option".split(), frozenset()),
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
RAW = frozenset(RAW_TAGS.split("|"))
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
#: A tag whose quoted values hold neither "<" nor ">"; it is looked for up to the next of them only.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/><]*+)")
_TAG_MARK = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
NAMED = frozenset(["class", "id", "role", "itemprop"])
#: First words that take the sense of a name away (has-sidebar, no-comments).
ABOUT = frozenset("has no not is with without show hide enable disable js".split())
_NAME = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")

#: Evidence of each tag on the path, in log-odds of content.
TAG_COST = {
    "nav": -6.0, "footer": -6.0, "aside": -5.0, "form": -5.0, "header": -3.0, "menu": -5.0, "dialog": -5.0, "fieldset": -3.0, "search": -6.0,
    "article": 3.5, "main": 2.5,
}
#: Evidence of words in class, id and role names.
NAME_COST = {
    **dict.fromkeys(
        "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
        "alert popup modal overlay newsletter subscribe subscription signup login sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs "
        "footer copyright share sharing social related recommended recommendations widget pagination pager toolbar comment comments commentlist "
        "respond reply disqus discussion feedback skip search searchbox tags tagcloud contentinfo complementary masthead topbar".split(),
        -6.0,
    ),
    "header": -3.0,
    **dict.fromkeys("article articlebody content entry post story main body text".split(), 1.5),
}
BIAS = -0.2
TIE = 0.8


class Element:
    """An open or closed element; ``path`` and ``steps`` run over block elements only."""

    __slots__ = ("tag", "parent", "home", "steps", "tag_cost", "name_cost", "hidden", "size", "holds_page", "cost", "inside")

    def __init__(self, tag: str, parent: Element | None, attrs: str) -> None:
        self.tag, self.parent = tag, parent
        self.home: Element | None = None if parent is None else parent if parent.tag in BLOCK_TAGS else parent.home  # nearest block element around it
        self.steps = 0 if self.home is None else self.home.steps + 1
        self.tag_cost, self.name_cost, self.hidden = TAG_COST.get(tag, 0.0), 0.0, False
        if attrs and not attrs.isspace():
            names, self.hidden = _names(attrs)
            # the strongest name counts, a bad one over a good one
            self.name_cost = min(names) if names and min(names) < 0 else max(names, default=0.0)
        self.size, self.holds_page, self.cost, self.inside = 0, tag in ("html", "body", "main"), 0.0, tag in ("article", "main")


class Block(NamedTuple):
    text: str
    element: Element
    own: float  # evidence of its own text

    @property
    def cost(self) -> float:
        return self.element.cost + self.own


def _names(attrs: str) -> tuple[list[float], bool]:
    """Evidence of the words of class, id, role and itemprop, and whether the element is hidden."""
    found, hidden = [], False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style":
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        elif key in NAMED:
            for token in value.split():
                words = _NAME.findall(token)
                if len(words) < 2 or words[0] not in ABOUT:
                    found += [NAME_COST[w] for w in words if w in NAME_COST]
    return found, hidden


def judge(elements: list[Element], total: int) -> None:
    """Costs of all elements (parents first): a boilerplate element outweighs the content elements around and inside it."""
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.size += e.size
            e.parent.holds_page = e.parent.holds_page or e.holds_page
    for e in elements:
        name = e.name_cost
        if name < 0 and (e.holds_page or 5 * e.size > 4 * total):
            name = 0.0
        own = e.tag_cost + name - 8.0 * e.hidden
        cost, inside = (e.parent.cost, e.parent.inside) if e.parent is not None else (0.0, False)
        e.inside = inside or e.inside
        if e.inside and e.tag == "header":  # of the article itself
            own = 0.0
        if own < 0:
            cost = min(cost, 0.0) + own
        elif cost >= 0:
            cost = min(cost + own, 4.0)
        e.cost = cost


def _text_cost(text: str, linked: int, tag: str) -> float:
    """Evidence of the block's own text."""
    cost = BIAS
    n = len(text)
    words = text.count(" ") + 1
    density = linked / n
    cost += -3.0 * density + (0.8 if words >= 12 else 0.0 if words >= 5 else -0.4)
    if text[-1] in ".!?:…\"'”»)":
        cost += 0.5
    if tag in ("p", "pre", "blockquote"):
        cost += 0.8
    elif tag in ("h1", "h2", "h3"):
        cost += 0.6
    if re.match(r"(?:©|\(c\)|copyright\b)", text, re.IGNORECASE):
        cost -= 3.0
    return cost


class _Finder:
    """``str.find`` that remembers what does not come any more."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, set()

    def __call__(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k


def _tag_end(page: str, at: int, find: _Finder) -> int:
    """The place of the ">" that ends the tag at ``at``, outside closed quotes; -1 if there is none."""
    k = at
    while m := _TAG_MARK.search(page, k):
        if m[0] == ">":
            return m.start()
        # a quote begins a value only after a sign of equality
        value = page[m.start() - 1] == "=" or page[at : m.start()].rstrip()[-1:] == "=" if m.start() - at < 64 else page[m.start() - 1] == "="
        close = find(m[0], m.end()) if value else -1
        k = close + 1 if close >= 0 else m.end()
    return -1


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, is an end tag) of all markup; comments and the like have an empty name."""
    find, at, plain = _Finder(page), 0, False
    while (at := find("<", at)) >= 0:
        start = at
        m = _PLAIN_TAG.match(page, at)
        if m:
            name, attrs, closes, at = m[2].lower(), m[3], bool(m[1]), m.end()
        elif page.startswith("<!--", at):
            at = find("-->", at + 4) + 3
            yield start, at if at > 2 else len(page), "", "", False
            at = at if at > 2 else len(page)
            continue
        elif page.startswith("<![CDATA[", at):
            at = find("]]>", at) + 3
            yield start, at if at > 2 else len(page), "", "", False
            at = at if at > 2 else len(page)
            continue
        elif page[at + 1 : at + 2] in ("!", "?", "/") and not _TAG_NAME.match(page, at):
            end = find(">", at)
            at = end + 1 if end >= 0 else at + 1
            if end >= 0:
                yield start, at, "", "", False
            continue
        elif named := _TAG_NAME.match(page, at):
            end = -1 if plain else _tag_end(page, named.end(), find)
            if end < 0:  # every ">" is in quotes: from here on the first one ends a tag
                plain = True
                end = find(">", named.end())
            if end < 0:
                at += 1
                continue
            name, attrs, closes, at = named[1].lower(), page[named.end() : end], page[at + 1] == "/", end + 1
        else:
            at += 1
            continue
        yield start, at, name, attrs, closes
        if name in RAW and not closes and not (name in ("svg", "math") and attrs.endswith("/")):
            # the content is no text of the page
            end = _RAW_END[name].search(page, at)
            stop = find(">", end.end()) + 1 if end else 0
            stop = stop or len(page)
            yield at, stop, "", "", False
            at = stop


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in page order."""
    out: list[Block] = []
    elements = [Element("", None, "")]
    stack = [elements[0]]
    places: dict[str, list[int]] = {}  # where open elements of a tag stand in the stack
    block_at = [0]  # where open block elements stand
    parts: list[str] = []
    linked, in_head, headed, total = 0, False, False, 0

    def flush() -> None:
        nonlocal linked, total, headed
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                inner = stack[block_at[-1]]
                stack[-1].size += len(text)
                total += len(text)
                if inner.tag == "h1" and not headed:
                    headed = inner.holds_page = True
                out.append(Block(text, stack[-1], _text_cost(text, min(linked, len(text)), inner.tag)))
        linked = 0

    def close(to: int) -> None:
        for e in stack[to:]:
            places[e.tag].pop()
            if e.tag in BLOCK_TAGS:
                block_at.pop()
        del stack[to:]

    def text_run(run: str) -> None:
        nonlocal linked
        if run and not in_head:
            parts.append(run)
            linked += len(run.strip()) if places.get("a") else 0

    at = 0
    for start, end, tag, attrs, closes in tags(page):
        text_run(page[at:start])
        at = end
        if tag in RAW or not tag:
            continue
        if tag == "head":
            in_head = not closes
            continue
        if tag == "body" and not closes:
            in_head = False
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if tag == "br":
            text_run(" ")
        open_ = places.get(tag)
        if closes:
            # an inline end tag does not reach past the block that it stands in
            if open_ and (block or open_[-1] > block_at[-1]):
                close(open_[-1])
            continue
        if tag in VOID_TAGS or attrs.endswith("/") and not block:
            continue
        if block:
            if places.get("p"):  # a paragraph ends where a block begins
                close(places["p"][0])
            ends = IMPLIED_END.get(tag)
            if ends and stack[-1].tag in ends:
                close(len(stack) - 1)
        e = Element(tag, stack[-1], attrs)
        elements.append(e)
        places.setdefault(tag, []).append(len(stack))
        if block:
            block_at.append(len(stack))
        stack.append(e)
    text_run(page[at:])
    flush()
    judge(elements, total)
    return out


class FlowNet:
    """Max-flow (blocking flows on level graphs) over a small graph with arc lists."""

    def __init__(self, n: int) -> None:
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.arcs[a]:
                b = self.to[e]
                if level[b] < 0 and self.room[e] > 1e-9:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def run(self, source: int, sink: int) -> list[bool]:
        """Saturate; True for the nodes on the source side of the minimum cut."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            nxt = [0] * len(self.arcs)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                arcs = self.arcs[a]
                while nxt[a] < len(arcs) and not (self.room[arcs[nxt[a]]] > 1e-9 and level[self.to[arcs[nxt[a]]]] == level[a] + 1):
                    nxt[a] += 1
                if nxt[a] < len(arcs):
                    path.append(arcs[nxt[a]])
                    a = self.to[arcs[nxt[a]]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break


def _around(b: Block) -> Element | None:
    """The block element around the one that a block stands in."""
    e = b.element if b.element.tag in BLOCK_TAGS else b.element.home
    return None if e is None else e.home


def _steps(e: Element | None) -> int:
    return 0 if e is None else e.steps + 1


def smoothness(a: Block, b: Block) -> float:
    """Tie of two blocks: the share of the longer path that they have in common, without their own elements.

    From neighbour to neighbour each element is left and entered once, so all walks together are linear.
    """
    x, y = _around(a), _around(b)
    longest = max(_steps(x), _steps(y), 1)
    while x is not y:
        if _steps(x) >= _steps(y):
            x = x.home
        else:
            y = y.home
    return TIE * _steps(x) / longest


def label_blocks(blocks: list[Block]) -> list[bool]:
    """Content (True) or boilerplate for each block, by a minimum cut."""
    n = len(blocks)
    cost = [b.cost for b in blocks]
    if not any(c > 0 for c in cost):
        return [False] * n
    net = FlowNet(n + 2)
    last: dict[Element | None, int] = {}
    for i, b in enumerate(blocks):
        if cost[i] > 0:
            net.edge(n, i, cost[i])
        else:
            net.edge(i, n + 1, -cost[i])
        if i:
            tie = smoothness(blocks[i - 1], b)
            if tie:
                net.edge(i - 1, i, tie, tie)
        # the block before it in the same container, where that is not the neighbour
        home = _around(b)
        before = last.get(home, i)
        if before < i - 1 and home is not None:
            net.edge(before, i, TIE, TIE)
        last[home] = i
    return net.run(n, n + 1)[:n]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches, "html"):
            texts = [main_text(p or "") for p in rb.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("page_id"), rb.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [picked.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return picked.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
