"""Main text of web pages by wrapper induction.

The pages of a host are aligned as trees by simple tree matching: labels must agree, children match in order, and the
largest matching wins. The aligned pages make one template per host. At each of its nodes all pages and texts are
counted: a text that most pages have there is template, the rest varies. The region of the host's articles is where
varying text gathers: from the root down, the child that holds most of it. A page's main text is what varies in its
region. Tags, classes and roles only break ties: which of the nested nodes that hold the same text is the region, which
of its varying parts are menus, notices, adverts, forms or comments, and everything for a host of too few pages.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, parallelism, texts

#: Elements whose content is no text of the page, elements that make blocks, elements without an end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg math object canvas audio video select datalist".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption "
    "header footer nav aside form fieldset legend address details summary hr center dialog menu hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a tag's start closes if they are open, and those that keep them open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body main td th aside nav form".split())
CLOSES_P = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
#: Elements, roles and words of classes or ids that mark what isn't the article.
ASIDE_TAGS = frozenset("nav footer aside form dialog menu button search fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adslot adsense sponsor sponsored sponsors promo promoted promotion banner sidebar aside rail widget widgets menu menus nav navbar navigation topnav subnav "
    "breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing "
    "comment comments commentlist disqus respond pagination pager toolbar skip".split()
)
#: Words that mark what isn't the article only if the pages agree (see Template.decide).
WEAK_WORDS = frozenset("notice notices alert social related recommended recommendations reply replies discussion search".split())
MAIN_WORDS = frozenset("article content post entry story main body".split())
#: Elements that may stand beside the region and belong to it.
HEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
PLAIN, WEAK, ASIDE = 0, 1, 2
#: A text is template where this share of a node's pages has it, of at least so many different pages.
CONSTANT, PAGES = 0.6, 4
#: The child that holds this share of a node's varying text is where the region lies; marked children are looked at
#: only where the others hold less than the second share. A part of weak mark goes if this share of the region's pages
#: has it, or of its words is in links.
MOST, SOME, COMMON, LINKED = 0.5, 0.1, 0.3, 0.5
#: Bytes of all hosts' templates that are sent to every executor; beyond, pages go to their host's template instead.
SENT = 32_000_000
#: Pages of a host that share one task then.
TOGETHER = 2000

#: Markup from "<" on: comment, declaration, or tag (closing?, name); what follows the name of a tag, with quotes or without.
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORDS = re.compile(r"[a-z]+")


class Node:
    """A block element. items: text pieces and child nodes in order; kids: runs of children of one shape; links: words in links."""

    __slots__ = ("label", "items", "aside", "main", "texts", "kids", "shape", "links")

    def __init__(self, label: str, aside: int = PLAIN, main: int = 0):
        self.label, self.items, self.aside, self.main = label, [], aside, main
        self.kids: list[list[Node]] = []
        self.texts: list[str] = []
        self.shape = ""
        self.links = 0


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[str, int, int]:
    """Label, how surely it is beside the article, and how surely it is the article (3 article, 2 main, 1 by name)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
    names = (found.get("class", "") + " " + found.get("id", "")).lower()
    role = found.get("role", "").lower()
    words = set(_WORDS.findall(names))
    hidden = "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)))
    aside = ASIDE if tag in ASIDE_TAGS or tag == "header" and not in_article or role in ASIDE_ROLES or hidden else PLAIN
    # A body, article or main whose class speaks of, say, its sidebar is still what it is; an article's own head is part of it.
    if not aside and tag not in ("body", "html", "main") and not (tag == "article" and not words & {"comment", "comments", "reply"}):
        marks = words & (ASIDE_WORDS | WEAK_WORDS) - ({"header", "head"} if in_article else set())
        aside = ASIDE if marks & ASIDE_WORDS else WEAK if marks else PLAIN
    main = 0 if aside else 3 if tag == "article" or role == "article" else 2 if tag == "main" or role == "main" else 1 if words & MAIN_WORDS and tag in ("div", "section", "td") else 0
    return f"{tag}.{'.'.join(sorted(words))}" if words else tag, aside, main


class _Stack:
    """Open elements, the root first. at: where those of each tag are, so that nothing is looked for."""

    def __init__(self, root: Node):
        self.open: list[tuple[str, Node]] = [("html", root)]
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.articles = 0

    @property
    def top(self) -> Node:
        return self.open[-1][1]

    def push(self, tag: str, node: Node) -> None:
        self.at[tag].append(len(self.open))
        self.open.append((tag, node))
        self.articles += node.main == 3

    def last(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self.at[t])), default=0)

    def close(self, tags: tuple[str, ...], kept_by) -> bool:
        """Closes the innermost element of these tags and all in it, unless one that keeps it open is in it."""
        i = self.last(tags)
        if not i or self.last(kept_by) > i:
            return False
        for tag, node in self.open[i:]:
            self.at[tag].pop()
            self.articles -= node.main == 3
        del self.open[i:]
        return True


def _tokens(html: str) -> Iterator[tuple[str, bool, str]]:
    """("", False, text) for text; tag, whether it closes, and attributes for tags. In time linear in html.

    A tag whose quotes don't end is one up to the next ">", and from then on quotes mean nothing.
    """
    at, n, quotes = 0, len(html), True
    last = html.rfind(">")
    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield "", False, html[at:start]
        if start == n:
            return
        m = _MARKUP.match(html, start)
        if not m:
            yield "", False, "<"
            at = start + 1
            continue
        if not m[2]:
            at = m.end()
            continue
        if m.end() > last:  # no tag ends any more
            at = html.find("<!", start + 1)
            at = n if at < 0 else at
            yield "", False, html[start:at]
            continue
        inner = _QUOTED.match(html, m.end()) if quotes else None
        if inner is None:
            quotes = False
            end = html.index(">", m.end())
            attrs, at = html[m.end() : end], end + 1
        else:
            attrs, at = inner[1], inner.end()
        tag = m[2].lower()
        yield tag, bool(m[1]), attrs
        if tag in RAW and not m[1] and (not attrs.endswith("/") or tag in ("script", "style", "textarea", "title")):
            end = re.compile(rf"</{re.escape(tag)}", re.I).search(html, at)
            at = html.find(">", end.end()) + 1 if end else 0
            if not at:  # its text never ends
                return


def parse(html: str) -> Node:
    """The page's blocks as a tree; end tags that HTML lets out, or authors forget, are put in."""
    root = Node("html")
    stack = _Stack(root)
    inline: list[str] = []  # open inline elements that are beside the article
    link = False
    for tag, closing, attrs in _tokens(html):
        if not tag:
            if not inline:
                stack.top.items.append(attrs)
                if link:
                    stack.top.links += len(attrs.split())
        elif closing:
            if tag == "a":
                link = False
            if inline and inline[-1] == tag:
                inline.pop()
            elif tag in BLOCKS:
                link = False
                if stack.close((tag,), ("article", "body") if tag == "p" else ()):
                    inline.clear()
                elif tag == "p":
                    stack.top.items.append(None)
        elif tag in RAW:
            continue
        elif tag == "br":
            if not inline:
                stack.top.items.append(" ")
        elif tag in VOID and tag != "hr":
            continue
        elif tag not in BLOCKS:
            link = link or tag == "a"
            if not attrs.endswith("/") and (tag == "button" or attrs and _marks(tag, attrs, stack.articles > 0)[1] == ASIDE):
                inline.append(tag)
            elif inline and inline[-1] == tag:
                inline.append(tag)
        elif tag != "html" and not (tag == "body" and stack.at["body"]):
            inline.clear()
            if tag in CLOSES_P:
                stack.close(("p",), SCOPES)
            if tag in CLOSES:
                stack.close(CLOSES[tag], SCOPES - {"td", "th"} if tag in ("tr", "td", "th") else SCOPES)
            node = Node(*_marks(tag, attrs, stack.articles > 0))
            stack.top.items.append(node)
            if tag != "hr":
                stack.push(tag, node)
    _finish(root)
    return root


def _finish(root: Node) -> None:
    """Joins text pieces to blocks, and gathers children of one shape that follow each other. Without recursion: pages may be deep."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.items if isinstance(x, Node)]
    for node in reversed(order):
        items: list = []
        piece: list[str] = []
        for x in [*node.items, None]:
            if isinstance(x, str):
                piece.append(x)
                continue
            raw = "".join(piece)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            piece = []
            if text:
                items.append(text)
                node.texts.append(text)
            if x is not None:
                items.append(x)
                if node.kids and node.kids[-1][0].shape == x.shape:
                    node.kids[-1].append(x)
                else:
                    node.kids.append([x])
        node.items = items
        shape = node.label + "(" + ",".join(k[0].shape for k in node.kids) + ")" if node.kids else node.label
        node.shape = shape if len(shape) < 200 else f"{node.label}#{xxhash.xxh64_hexdigest(shape.encode('utf-8', 'surrogatepass'))}"


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Slot:
    """A node of a skeleton (a page without its texts) or of a template."""

    __slots__ = ("label", "aside", "main", "kids")

    def __init__(self, label: str, aside: int = PLAIN, main: int = 0):
        self.label, self.aside, self.main = label, aside, main
        self.kids: list[Slot] = []

    def preorder(self) -> list[Slot]:
        out, todo = [], [self]
        while todo:
            out.append(todo.pop())
            todo += reversed(out[-1].kids)
        return out

    def packed(self) -> str:
        """The tree as JSON, flat, however deep it is."""
        return json.dumps([[s.label, s.aside, s.main, len(s.kids)] for s in self.preorder()])

    @staticmethod
    def unpacked(text: str) -> Slot:
        root, open_ = None, []
        for label, aside, main, many in json.loads(text):
            slot = Slot(label, aside, main)
            if open_:
                open_[-1][0].kids.append(slot)
                open_[-1][1] -= 1
            else:
                root = slot
            open_.append([slot, many])
            while open_ and not open_[-1][1]:
                open_.pop()
        return root


def runs(root: Node) -> list[list[Node]]:
    """The page in preorder, with the nodes of one shape that follow each other (and theirs in turn) as one."""
    out: list[list[Node]] = []
    todo = [[root]]
    while todo:
        members = todo.pop()
        out.append(members)
        first = members[0].kids
        todo += [[x for m in members for x in m.kids[i]] if len(members) > 1 else first[i] for i in reversed(range(len(first)))]
    return out


def skeleton(root: Node) -> Slot:
    """A slot for each of runs(root)."""
    out = Slot(root.label, root.aside, root.main)
    todo = [(root, out)]
    while todo:
        node, slot = todo.pop()
        for run in node.kids:
            slot.kids.append(Slot(run[0].label, run[0].aside, run[0].main))
            todo.append((run[0], slot.kids[-1]))
    return out


class Matching:
    """Simple tree matching between two trees; what was found for two nodes is remembered."""

    def __init__(self) -> None:
        self.most: dict[tuple[int, int], int] = {}

    def size(self, x: Slot, y: Slot) -> int:
        """How many nodes below x and y the largest matching pairs, without recursion: trees may be deep."""
        todo = [(x, y)]
        while todo:
            a, b = todo[-1]
            if (id(a), id(b)) in self.most:
                todo.pop()
                continue
            inner: dict[str, list[Slot]] = {}
            for v in b.kids:
                if v.kids:
                    inner.setdefault(v.label, []).append(v)
            missing = [(u, v) for u in a.kids if u.kids for v in inner.get(u.label, ()) if (id(u), id(v)) not in self.most]
            if missing:
                todo += missing
                continue
            row = np.zeros(len(b.kids) + 1, np.int32)
            for u in a.kids if b.kids else ():
                row = self._following(row, self._weights(u, b.kids))
            self.most[id(a), id(b)] = int(row[-1])
            todo.pop()
        return self.most[id(x), id(y)]

    def _weights(self, u: Slot, kids: list[Slot]) -> np.ndarray:
        """What pairing u with each of kids is worth."""
        return np.array([0 if v.label != u.label else 1 + (self.most[id(u), id(v)] if u.kids and v.kids else 0) for v in kids], np.int32)

    @staticmethod
    def _following(row: np.ndarray, w: np.ndarray) -> np.ndarray:
        best = row.copy()
        best[1:] = np.maximum(best[1:], np.where(w > 0, row[:-1] + w, 0))
        return np.maximum.accumulate(best)

    def pairs(self, x: Slot, y: Slot) -> list[tuple[int, int]]:
        """Which kids of x and y the largest matching pairs. Of its table every so many-th row is kept, the others are made again on the way back."""
        self.size(x, y)
        a, b = x.kids, y.kids
        n, m = len(a), len(b)
        if not n or not m:
            return []
        step = math.isqrt(n - 1) + 1
        row = np.zeros(m + 1, np.int32)
        marks = []
        for i in range(n):
            if i % step == 0:
                marks.append(row)
            row = self._following(row, self._weights(a[i], b))
        out, i, j = [], n, m
        while i and j:
            low = (i - 1) // step * step
            rows, own = [marks[low // step]], []
            for k in range(low, i):
                own.append(self._weights(a[k], b))
                rows.append(self._following(rows[-1], own[-1]))
            while i > low and j:
                w = own[i - 1 - low][j - 1]
                if w and rows[i - low][j] == rows[i - 1 - low][j - 1] + w:
                    out.append((i - 1, j - 1))
                    i, j = i - 1, j - 1
                elif rows[i - low][j] == rows[i - 1 - low][j]:
                    i -= 1
                else:
                    j -= 1
        return out[::-1]


def align(template: Slot, page: Slot, grow: bool) -> list[Slot | None]:
    """The template's slot of each slot of page, in preorder; with grow, the template gets what it lacks."""
    matching, out = Matching(), []
    todo: list[tuple[Slot | None, Slot]] = [(template, page)]
    while todo:
        slot, own = todo.pop()
        out.append(slot)
        to: dict[int, Slot] = {}
        if slot is not None and own.kids:
            place = {j: i for i, j in matching.pairs(slot, own)}
            to = {j: slot.kids[i] for j, i in place.items()}
            if grow:
                new, at = [], 0
                for j, kid in enumerate(own.kids):
                    if j in place:
                        new += slot.kids[at : place[j] + 1]
                        at = place[j] + 1
                    else:
                        to[j] = Slot(kid.label, kid.aside, kid.main)
                        new.append(to[j])
                slot.kids = new + slot.kids[at:]
        todo += [(to.get(j), kid) for j, kid in reversed(list(enumerate(own.kids)))]
    return out


def induce(skeletons: list[tuple[int, int, str]]) -> tuple[Slot, list[list[int]]]:
    """The template of a host from (shape, pages, skeleton) of its pages' shapes, and each shape's slots by number (-1: none).

    Shapes are aligned in one order, those of most pages first, so the template does not depend on how pages are dealt.
    """
    template = Slot("html")
    order = sorted(range(len(skeletons)), key=lambda i: (-skeletons[i][1], skeletons[i][0]))
    pages = [Slot.unpacked(x[2]) for x in skeletons]
    for i in order:
        align(template, pages[i], True)
    number = {id(s): i for i, s in enumerate(template.preorder())}
    return template, [[-1 if s is None else number[id(s)] for s in align(template, page, False)] for page in pages]


class Template:
    """What a host's pages have in common: the aligned tree, each slot's template texts, the region and what isn't content in it."""

    def __init__(self, tree: Slot, constant: dict[int, set[int]], region: int | None, beside: set[int]):
        self.tree, self.constant, self.region, self.beside = tree, constant, region, beside
        self.number = {id(s): i for i, s in enumerate(tree.preorder())}
        self.known: dict[str, list[int]] = {}

    @staticmethod
    def decide(tree: Slot, stats: list[tuple[int, int, int, int, int, list[int]]]) -> Template:
        """From (slot, pages that have it, pages that have it more than once, words that vary, those in links, template texts)."""
        slots = tree.preorder()
        n = len(slots)
        pages, several, own, links, constant = [0] * n, [0] * n, [0] * n, [0] * n, {}
        for i, a, b, c, d, texts_ in stats:
            pages[i], several[i], own[i], links[i] = a, b, c, d
            if texts_:
                constant[i] = set(texts_)
        number = {id(s): i for i, s in enumerate(slots)}
        weight, linked = own[:], links[:]
        for i in range(n - 1, -1, -1):
            for kid in slots[i].kids:
                weight[i] += weight[number[id(kid)]]
                linked[i] += linked[number[id(kid)]]
        region, beside = None, set()
        if n and pages[0] >= PAGES and weight[0]:
            chain = [0]
            while True:
                i = chain[-1]
                kids = [number[id(k)] for k in slots[i].kids]
                plain = [k for k in kids if slots[k].aside == PLAIN]
                pool = plain if own[i] + sum(weight[k] for k in plain) >= SOME * weight[i] else kids
                best = max(pool, key=lambda k: (weight[k], -k), default=None)
                if best is None or not slots[best].kids or 2 * several[best] > pages[best] or weight[best] < MOST * (own[i] + sum(weight[k] for k in pool)):
                    break
                chain.append(best)
            marked = max(slots[i].main for i in chain)
            if marked:
                region = next(i for i in chain if slots[i].main == marked)
            else:
                at = len(chain) - 1
                # Up, as long as what varies beside it is headings and paragraphs.
                while at and not own[chain[at - 1]] and all(k == chain[at] or not weight[k] or not slots[k].kids and slots[k].label.partition(".")[0] in HEADS for k in (number[id(x)] for x in slots[chain[at - 1]].kids)):
                    at -= 1
                region = chain[at]
            for i in range(n):
                if slots[i].aside == WEAK and (pages[i] >= COMMON * pages[region] or 2 * linked[i] >= weight[i] * 2 * LINKED):
                    beside.add(i)
        return Template(tree, constant, region, beside)

    def packed(self) -> str:
        return json.dumps([self.tree.packed(), {i: sorted(x) for i, x in self.constant.items()}, self.region, sorted(self.beside)])

    @staticmethod
    def unpacked(text: str) -> Template:
        tree, constant, region, beside = json.loads(text)
        return Template(Slot.unpacked(tree), {int(i): set(x) for i, x in constant.items()}, region, set(beside))

    def places(self, page: Node) -> dict[int, int]:
        """The number of the slot of each of the page's nodes, by its id."""
        if page.shape not in self.known:
            if len(self.known) > 5000:  # forgetting costs time only
                self.known.clear()
            self.known[page.shape] = [-1 if s is None else self.number[id(s)] for s in align(self.tree, skeleton(page), False)]
        return {id(x): i for i, members in zip(self.known[page.shape], runs(page)) if i >= 0 for x in members}


def main_text(page: Node, template: Template | None = None) -> str:
    """What varies in the template's region; without one, or on a page that lacks it, what the marks leave of the article."""
    place = template.places(page) if template else {}
    inside_, best, todo = False, 0, [page]
    while todo:
        node = todo.pop()
        inside_ = inside_ or template is not None and template.region is not None and place.get(id(node)) == template.region
        if node.aside == PLAIN:
            best = max(best, node.main)
        todo += [x for x in node.items if isinstance(x, Node)]
    if not inside_:
        best = _best(page)
    out: list[str] = []
    todo2: list[tuple] = [(page, not inside_ and best == 0)]
    while todo2:
        x, inside = todo2.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        i = place.get(id(x), -1)
        if inside_:
            start = not inside and i == template.region
            if inside and (x.aside == ASIDE or i in template.beside):
                continue
            inside = inside or start
        else:
            if x.aside != PLAIN:
                continue
            inside = inside or x.main == best
        drop = template.constant.get(i, ()) if template else ()
        for item in reversed(x.items):
            if isinstance(item, Node) or inside and not (drop and _hash(item) in drop):
                todo2.append((item, inside))
    return "\n\n".join(out)


def _best(page: Node) -> int:
    """The surest mark of an article outside what is marked as beside it."""
    best, todo = 0, [page]
    while todo:
        node = todo.pop()
        if node.aside == PLAIN:
            best = max(best, node.main)
            todo += [x for x in node.items if isinstance(x, Node)]
    return best


SURVEY = "host long, shape long, skeleton string, page long, at array<int>, text array<long>, words array<int>, links array<int>, several array<int>"


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page of a task that isn't a copy there: shape and texts. A row for each shape of a host, once per task: its skeleton."""
    sent: set[tuple[int, str]] = set()
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        rows: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), texts(batch.column("html"))):
            page = parse(html)
            own = runs(page)
            key = _hash(main_text(page) or "\n".join(t for members in own for m in members for t in m.texts))
            if (host, key) in seen:
                continue
            seen.add((host, key))
            shape = _hash(page.shape)
            if (host, page.shape) not in sent:
                sent.add((host, page.shape))
                rows.append((host, shape, skeleton(page).packed(), None, None, None, None, None, None))
            cells: dict[tuple[int, int], list[int]] = {}
            several = []
            for i, members in enumerate(own):
                if len(members) > 1:
                    several.append(i)
                links, all_ = sum(m.links for m in members), max(1, sum(len(t.split()) for m in members for t in m.texts))
                for m in members:
                    for t in m.texts:
                        cell = cells.setdefault((i, _hash(t)), [0, 0])
                        words = len(t.split())
                        cell[0] += words
                        cell[1] += words * min(links, all_) // all_
            at, text = zip(*cells) if cells else ((), ())
            words, links = zip(*cells.values()) if cells else ((), ())
            rows.append((host, shape, None, key, at, text, words, links, several))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        cols = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SURVEY.split(", ")])


def _induced(group: pa.Table) -> pa.Table:
    """Of a host's shapes: the template, in a row of its own, and each shape's slots."""
    host, shapes = group.column("host")[0].as_py(), group.column("shape").to_pylist()
    tree, slots = induce(list(zip(shapes, group.column("pages").to_pylist(), group.column("skeleton").to_pylist())))
    n = len(shapes)
    cols = [pa.array([host] * (n + 1), pa.int64()), pa.array([None, *shapes], pa.int64()), pa.array([tree.packed(), *[None] * n], pa.string()), pa.array([None, *slots], pa.list_(pa.int32()))]
    return pa.Table.from_arrays(cols, ["host", "shape", "tree", "slots"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, stats in zip(batch.column("tree").to_pylist(), batch.column("stats").to_pylist()):
            own = [(x["slot"], x["pages"], x["several"] or 0, x["words"] or 0, x["links"] or 0, x["constant"] or []) for x in stats or ()]
            out.append(Template.decide(Slot.unpacked(tree), own).packed())
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """host, template (see Template.packed) of every host of pages(host, html). Every count is of all pages, each article of a host once."""
    survey = durable(pages.select("host", "html").mapInArrow(_surveyed, SURVEY))
    first = F.min(F.struct("shape", "at", "text", "words", "links", "several")).alias("p")
    own = durable(survey.where("skeleton is null").groupBy("host", "page").agg(first).select("host", "p.*"))
    per_shape = own.groupBy("host", "shape").agg(F.count("*").alias("pages"))
    shapes = survey.where("skeleton is not null").groupBy("host", "shape").agg(F.first("skeleton").alias("skeleton")).join(per_shape, ["host", "shape"])
    induced = durable(shapes.select("host", "shape", "pages", "skeleton").groupBy("host").applyInArrow(_induced, "host long, shape long, tree string, slots array<int>"))
    # A row per shape; from here on all is counted by Spark, texts and slots of all hosts alike.
    slots = induced.where("shape is not null").select("host", "shape", "slots")

    def slot(at):
        return F.element_at("slots", at + 1)

    have = per_shape.join(slots, ["host", "shape"]).select("host", F.explode(F.array_distinct("slots")).alias("slot"), "pages").groupBy("host", "slot").agg(F.sum("pages").alias("pages"))
    named = own.join(slots, ["host", "shape"])
    several = named.select("host", F.explode(F.array_distinct(F.transform("several", slot))).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("several"))
    cell = F.explode(F.arrays_zip("at", "text", "words", "links")).alias("c")
    # Two runs of a page may share a slot only if they are one run of the template, so a text of a page and slot is one cell.
    cells = named.select("host", "slots", cell).select("host", slot(F.col("c.at")).alias("slot"), "c.text", "c.words", "c.links")
    texts_ = cells.where("slot >= 0").groupBy("host", "slot", "text").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("links").alias("links"))
    fixed = (F.col("pages") >= PAGES) & (F.col("n") >= F.lit(CONSTANT) * F.col("pages"))
    per_slot = texts_.join(have, ["host", "slot"]).groupBy("host", "slot").agg(
        F.sum(F.when(~fixed, F.col("words"))).alias("words"), F.sum(F.when(~fixed, F.col("links"))).alias("links"), F.collect_list(F.when(fixed, F.col("text"))).alias("constant")
    )
    whole = have.where("slot >= 0").join(per_slot, ["host", "slot"], "left").join(several, ["host", "slot"], "left")
    stats = whole.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "several", "words", "links", "constant")).alias("stats"))
    trees = induced.where("shape is null").select("host", "tree")
    return trees.join(stats, "host", "left").select("host", "tree", "stats").mapInArrow(_decided, "host long, template string")


RESULT = "page_id long, url string, text string, n_chars long"


def _result(page_id: list, url: list, html: list, template: list[Template | None]) -> pa.RecordBatch:
    out = [main_text(parse(x or ""), t) for x, t in zip(html, template)]
    return pa.RecordBatch.from_arrays([pa.array(page_id, pa.int64()), pa.array(url, pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    Null html is empty; a page without an article is taken from its main element, or else from its body; repeated rows
    each give a row; a null url is a host of its own; columns of other names, and an empty table, do no harm. Pages of
    equal text count once in their host's template, so copies of an article don't turn it into one. Deep and long pages
    are worked on without recursion, in linear time. What comes out depends on the host's pages, not on how they are dealt.
    """
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit("")))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    found = durable(templates(pages))
    if (found.agg(F.sum(F.octet_length("template"))).first()[0] or 0) <= SENT:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.template for r in found.collect()})

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, Template] = {}
            for batch in batches:
                hosts = batch.column("host").to_pylist()
                for x in set(hosts) - known.keys():
                    known[x] = Template.unpacked(shared.value[x])
                yield _result(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), [known[x] for x in hosts])

        return pages.mapInArrow(here, RESULT)
    # Each host's template goes before its pages, to as many tasks as they need.
    salts = pages.groupBy("host").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
    sent = found.join(salts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "template")
    dealt = pages.join(salts, "host").select("host", F.pmod(F.xxhash64("page_id", "url"), "salts").cast("int").alias("salt"), "page_id", "url", "html", F.lit(True).alias("is_page"))
    rows = sent.withColumn("is_page", F.lit(False)).unionByName(dealt, True)
    rows = rows.repartition(parallelism(pages.sparkSession), "host", "salt").sortWithinPartitions("host", "salt", "is_page")

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = None
        for batch in batches:
            held: list[tuple] = []
            for is_page, text, *own in zip(*(batch.column(c).to_pylist() for c in ("is_page", "template", "page_id", "url", "html"))):
                if is_page:
                    held.append((*own, template))
                else:
                    template = Template.unpacked(text)
            if held:
                yield _result(*zip(*held))

    return rows.mapInArrow(there, RESULT)


def query(spark, pages: DataFrame) -> DataFrame:
    return extract(pages)
