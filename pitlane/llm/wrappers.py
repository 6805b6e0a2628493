"""HTML extraction by union-free regular expressions, inferred from the pages of a host.

A page becomes a stream of tokens: start and end tags of the elements that make up its layout, and
text slots. Inline elements and their text are part of a slot. A wrapper is a list of nodes over such
tokens: a tag, a slot, an optional part ``(...)?`` or a repeated part ``(...)+``. Pages are added one
by one. Where the wrapper and a page part ways, a side that repeats what stands before it becomes a
repeated part; otherwise the shorter way to a common tag makes the skipped side an optional part.
There are no alternatives between parts, hence "union-free".

Inference is a fold, so that no host's pages meet in one task: each partition of pages folds what it
has of a host, then about FAN_IN of those results fold in a task, in as many rounds as it takes; what
meets is wrappers, which are as large as a template, not as its pages. Pages
then join their host's wrapper and are parsed where they lie.

Parsing aligns each text with a slot of the wrapper. A text that stands in one slot on most of the
different pages that fill it is template, whatever its tags. Texts are counted by hash in the whole
table, as a repeated part has many in one slot. So hosts of fewer than LEAST_PAGES different pages have
no template text.

Wrapper and tags decide together. What lies in an element that is layout by its name, role, class or
id (navigation, header, footer, aside, form, advert, notice, comments ...) is none of the main text. An
article or main element outside of those is the page's main block if its text is at least as long as
the mismatching text beside it; then all of the block is main text, also what other pages of the host
have too (a byline, a body that several pages carry). On other pages the main text is all that is neither
layout, nor a list of links alone, nor template; but template in the same element as mismatching text
belongs to it, as the paragraphs of a body that several pages carry under titles of their own.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, stored

#: Levels of up to so many pairs of trees are aligned by a table, larger ones in halves by bits; both are exact.
TABLE_PAIRS = 4_096
#: Elements nested deeper than this lend their text to the slots of the last level, so that no page is too deep.
DEPTH = 150
#: Wrappers of a host that meet in a task.
FAN_IN = 16
#: Text is template if so many different pages, and more than half of those that fill its slot, have it there.
LEAST_PAGES = 3

#: Elements by their part in a page.
INLINE = frozenset("math mrow mi mn mo mtext mfrac msup msub msubsup msqrt mroot mover munder mspace semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg canvas audio video select textarea button head title".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
LAYOUT = frozenset("nav header footer aside form menu dialog fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN = frozenset("article main".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsors sponsored promo promos promotion promotions nav navs navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar aside header masthead footer cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal newsletter subscribe signup login form forms search searchbox share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies widget widgets toolbar pagination pager skip hidden".split())
#: What a name may have beside those: "site-header", "related-posts", "ad-slot-2", but not "related-work".
BESIDE = frozenset("a and area article articles bar block bottom box button buttons center column container content cookie desktop fixed float for global google group head icons inner item items label left link links list main medium mega mobile module more news outer page panel pages post posts primary rail right row secondary section site slot small stories sticky text thread title to top unit us user users wrap wrapper zone".split())

#: Names that don't make an element of the main block layout, as its text has them too; and those that make an article one.
TEXT_NAMES = frozenset("alert alerts disclaimer form forms header".split())
OTHER_ARTICLES = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion comment comments commentlist reply replies related recommended".split())

_PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BARE = re.compile(r"(?:^|\s)hidden(?:\s|/|$)", re.I)
#: Attributes without any of these make no element layout.
_TELLING = re.compile(r"class|id|role|hidden", re.I)
SLOT = "#"


def is_layout_name(names: str, of: frozenset[str] = NAMES) -> bool:
    """Whether a class or id says that its element is layout: a word of ``of``, alone or beside others of NAMES, of BESIDE, numbers and words of one or two letters ("js-ad", "ad_300x250")."""
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if not of.isdisjoint(parts) and all(p in NAMES or p in BESIDE or len(p) < 3 for p in parts):
            return True
    return False


class Place(NamedTuple):
    """What stands around a slot: whether an article or main element that isn't inside layout, how many layout elements, and how many of these are headers inside the former."""

    main: bool = False
    layout: int = 0
    inner: int = 0

    def within(self, element: str) -> Place:
        layout = element.endswith("!") or element in LAYOUT
        return Place(self.main or element in MAIN and self.layout == self.inner, self.layout + layout, self.inner + (self.main and element == "header"))


class Page:
    """tokens: "<name" or "<name!" (layout by its attributes), "</name", "#". texts: of the slots, decoded. inside: of each slot, its place. links: whether a slot is a list of links alone. within: the number of the element that holds the slot's paragraph."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.texts: list[str] = []
        self.inside: list[Place] = []
        self.links: list[bool] = []
        self.open: list[str] = []
        self.within: list[int] = []
        self._places = [Place()]
        self._numbers, self._count = [0], 0
        self._silent = 0
        self._text: list[str] = []
        self._anchors, self._in_link, self._bare = 0, False, False
        self._read(source)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text.clear()
        if text and not self._silent:
            self.tokens.append(SLOT)
            self.texts.append(text)
            self.inside.append(self._places[-1])
            self.within.append(self._numbers[-1 - (self.open[-1:] != [] and self.open[-1].rstrip("!") in PARAGRAPHS)])
            self.links.append(not self._bare and self._anchors > ("li" not in self.open[-1:]))
        self._anchors, self._bare = int(self._in_link), False

    def _close(self, to: int) -> None:
        self._flush()
        while len(self.open) > to:
            name = self.open.pop().rstrip("!")
            self._places.pop()
            self._numbers.pop()
            self._silent -= name in SILENT
            if name not in INLINE and len(self.open) < DEPTH:
                self.tokens.append("</" + name)

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name in VOID:
            if name == "hr":
                self._flush()
            return
        marked = bool(_TELLING.search(attributes)) and self._marked(name, attributes)
        if name == "a":
            self._anchors, self._in_link = self._anchors + 1, True
        if name in INLINE and not marked:
            return
        self._flush()
        if name in CLOSES_P or name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._implied(name)
        if name == "svg" and attributes.rstrip().endswith("/"):
            return
        if len(self.open) < DEPTH and name not in INLINE:
            self.tokens.append(f"<{name}{'!' * marked}")
        self.open.append(name + "!" * marked)
        self._places.append(self._places[-1].within(self.open[-1]))
        self._count += 1
        self._numbers.append(self._count)
        self._silent += name in SILENT

    def _marked(self, name: str, attributes: str) -> bool:
        """Whether an element's class, id or role makes it layout, or it is hidden."""
        given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        of = frozenset() if name in ("html", "body", "main") else OTHER_ARTICLES if name == "article" else NAMES - TEXT_NAMES if self._places[-1].main else NAMES
        named = is_layout_name(" ".join(given.get(k, "") for k in ("class", "id")), of)
        return named or given.get("role", "").lower() in ROLES or given.get("aria-hidden") == "true" or bool(_BARE.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))

    def _implied(self, name: str) -> None:
        """Closes a paragraph, list item or cell that a new one ends."""
        ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ("p",))
        bounds = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(name, ("div", "article", "section", "body", "td", "li", "main", "blockquote"))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].rstrip("!") in ends:
                self._close(i)
                if name != "tr":
                    return
            elif self.open[i].rstrip("!") in bounds:
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = _PIECE.search(source, at)
            text = source[at : found.start() if found else n]
            self._text.append(text)
            self._bare = self._bare or not self._in_link and bool(text.strip())
            if not found:
                break
            at = found.end()
            if found[1]:
                name = found[1].lower()
                self._in_link = self._in_link and name != "a"
                if name in ("p", "br"):
                    self._text.append(" ")
                held = [i for i, t in enumerate(self.open) if t.rstrip("!") == name]
                if held:
                    self._close(held[-1])
            elif found[2]:
                name = found[2].lower()
                self._start(name, found[3] or "")
                if name in RAW:
                    end = re.compile(rf"</{name}\s*[^>]*>|\Z", re.I).search(source, at)
                    if name not in VOID and self.open and self.open[-1].rstrip("!") == name:
                        self._text.clear()
                        self._close(len(self.open) - 1)
                    at = end.end()
        self._close(0)


#: Paths by the one above and the tag, of which layouts have few; more than so many are forgotten at once.
_PATHS: dict[tuple[int, str], int] = {}
MOST_PATHS = 100_000


# A wrapper is a list of nodes: a token, or ["?", nodes] or ["+", nodes].


def _first(node) -> str:
    return node if isinstance(node, str) else _first(node[1][0])


def _end_of(nodes: list, i: int) -> int:
    """After the element that starts at nodes[i], or after that one node."""
    if not isinstance(nodes[i], str) or not nodes[i].startswith("<") or nodes[i].startswith("</"):
        return i + 1
    depth = 0
    for j in range(i, len(nodes)):
        if isinstance(nodes[j], str) and nodes[j] != SLOT:
            depth += -1 if nodes[j].startswith("</") else 1
            if not depth:
                return j + 1
    return len(nodes)


def _trees(nodes: list) -> list[list]:
    """The nodes cut into elements and single nodes."""
    out, i = [], 0
    while i < len(nodes):
        j = _end_of(nodes, i)
        out.append(nodes[i:j])
        i = j
    return out


def _kind(tree: list) -> str:
    """What a tree can be aligned by: its tag, or a slot; parts go by what they hold."""
    return _kind(tree[0][1]) if not isinstance(tree[0], str) else tree[0]


def _bare(tree: list) -> list:
    """The tree without an optional or repeated part around it."""
    return tree[0][1] if not isinstance(tree[0], str) else tree


def _mark(tree: list) -> str:
    """"?" or "+" or "*" (both) or "" around the tree."""
    if isinstance(tree[0], str):
        return ""
    inner = _mark(tree[0][1])
    return "*" if {tree[0][0], inner} >= {"?", "+"} or inner == "*" else tree[0][0]


def _core(tree: list) -> list:
    while not isinstance(tree[0], str):
        tree = tree[0][1]
    return tree


def _wrapped(core: list, repeated: bool, optional: bool) -> list:
    out = [["+", core]] if repeated else core
    return [["?", out]] if optional else out


def _folded(trees: list[list]) -> list[list]:
    """Neighbouring trees of one kind as one repeated part."""
    out: list[list] = []
    for t in trees:
        if out and _kind(out[-1]) == _kind(t):
            both = _mark(out[-1]) in ("?", "*") and _mark(t) in ("?", "*")
            out[-1] = _wrapped(_same(_core(out[-1]), _core(t)), True, both)
        else:
            out.append(t)
    return out


def _same(a: list, b: list) -> list:
    """The union-free expression over two trees of one kind."""
    if a == b or a[0] == SLOT:
        return a
    ends = a[-1:] if isinstance(a[-1], str) and a[-1].startswith("</") else b[-1:]
    inner = [x[1:-1] if len(x) > 1 and isinstance(x[-1], str) and x[-1].startswith("</") else x[1:] for x in (a, b)]
    return [a[0], *aligned(*inner), *ends]


def aligned(a: list, b: list) -> list:
    """The union-free expression over two lists of nodes: their common trees in order, the rest optional, neighbours of one kind repeated."""
    if a == b:
        return a
    xs, ys = _folded(_trees(a)), _folded(_trees(b))
    out: list[list] = []
    i = j = 0
    for x, y in [*_common([_kind(t) for t in xs], [_kind(t) for t in ys]), (len(xs), len(ys))]:
        out += [_wrapped(_core(t), _mark(t) in ("+", "*"), True) for t in (*xs[i:x], *ys[j:y])]
        if x < len(xs):
            marks = _mark(xs[x]) + _mark(ys[y])
            out.append(_wrapped(_same(_core(xs[x]), _core(ys[y])), "+" in marks or "*" in marks, "?" in marks or "*" in marks))
        i, j = x + 1, y + 1
    return [node for tree in _folded(out) for node in tree]


def _common(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence, in order."""
    head = next((i for i, (x, y) in enumerate(zip(xs, ys, strict=False)) if x != y), min(len(xs), len(ys)))
    return [(i, i) for i in range(head)] + _longest(xs, ys, head, len(xs), head, len(ys))


def _longest(xs: list[str], ys: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """_common() of xs[a:b] and ys[c:d]. Beyond TABLE_PAIRS the first side is halved, and the other where both halves together have the longest sequence."""
    if a == b or c == d:
        return []
    if b - a > 1 and (b - a) * (d - c) > TABLE_PAIRS:
        middle = (a + b) // 2
        before = _lengths(xs[a:middle], ys[c:d])
        after = _lengths(xs[middle:b][::-1], ys[c:d][::-1])[::-1]
        cut_at = c + int((before + after).argmax())
        return _longest(xs, ys, a, middle, c, cut_at) + _longest(xs, ys, middle, b, cut_at, d)
    n, m = b - a, d - c
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if xs[a + i] == ys[c + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if xs[a + i] == ys[c + j]:
            out.append((a + i, c + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """Of the first 0, 1, ... of ys, how long their longest common sequence with xs is: the zeros in a number that holds a row of the usual table as bits."""
    where: dict[str, int] = {}
    for j, y in enumerate(ys):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(ys)) - 1
    row = full
    for x in xs:
        if x in where:
            met = row & where[x]
            row = (row + met | row - met) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(ys) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(ys)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def joined(a: list | None, b: list) -> list:
    """The wrapper of what both stand for."""
    return reduced(b) if a is None else aligned(a, reduced(b))


def reduced(nodes: list) -> list:
    """The nodes with neighbouring trees of one kind folded, at every depth."""
    out = []
    for t in _trees(nodes):
        if isinstance(t[0], str) and t[0].startswith("<") and len(t) > 1:
            closed = isinstance(t[-1], str) and t[-1].startswith("</")
            t = [t[0], *reduced(t[1:-1] if closed else t[1:]), *(t[-1:] if closed else [])]
        out.append(t)
    return [node for tree in _folded(out) for node in tree]


def _below(path: int, tag: str) -> int:
    """The path of what stands in an element, as a hash."""
    return _hash(f"{path} {tag}")


def slots_of(tokens: list[str]) -> list[int]:
    """Of each text of a page the path of tags to it, which is its slot's number in every wrapper that knows it."""
    out, path, around = [], 0, []
    if len(_PATHS) > MOST_PATHS:
        _PATHS.clear()
    for t in tokens:
        if t == SLOT:
            out.append(path)
        elif t.startswith("</"):
            path = around.pop()[1] if around else 0
        else:
            around.append((t, path))
            path = _PATHS.get((path, t)) or _PATHS.setdefault((path, t), _below(path, t))
    return out


def compiled(wrapper: list) -> list[tuple]:
    """(kind, number of the slot or None, what the element holds) of each tree, marks aside. Slots below the same tags have the same number, as an optional part between two of them may part what is one."""

    def of(nodes: list, path: int) -> list[tuple]:
        out = []
        for tree in _trees(nodes):
            core = _core(tree)
            if core[0] == SLOT:
                out.append((SLOT, path, None))
            else:
                closed = len(core) > 1 and isinstance(core[-1], str) and core[-1].startswith("</")
                out.append((core[0], None, of(core[1:-1] if closed else core[1:], _below(path, core[0]))))
        return out

    return of(wrapper, 0)


def aligned_slots(tokens: list[str], wrapper: list[tuple]) -> list[int | None]:
    """Of each text of a page, the slot of its host's wrapper that it fills; None where the wrapper doesn't know the way to it."""
    out: list[int | None] = []
    name, level, at = "", wrapper, 0
    around: list[tuple] = []
    for t in tokens:
        if t.startswith("</"):
            if any(x[0] == t[2:] for x in around) or name == t[2:]:
                while around:
                    left, (name, level, at) = name, around.pop()
                    if left == t[2:]:
                        break
            continue
        i = next((i for i in range(at, len(level)) if level[i][0] == t), None)
        at = at if i is None else i
        if t == SLOT:
            out.append(None if i is None else level[i][1])
        else:
            around.append((name, level, at))
            name, level, at = t[1:].rstrip("!"), [] if i is None else level[i][2], 0
    return out


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def extract(source: str | None, wrapper: list[tuple], template: set[tuple[int, int]]) -> str:
    """Main text of a page: its main fields in page order, joined by one space. template: slots and hashes of text that most pages of the host have there."""
    page = Page(source or "")
    slots = aligned_slots(page.tokens, wrapper)
    free = [p.layout == p.inner for p in page.inside]  # a header of the article itself holds its title
    block = [p.main and f for p, f in zip(page.inside, free, strict=True)]
    beside = [f and not b and not links for f, b, links in zip(free, block, page.links, strict=True)]
    constant = [s is not None and (s, _hash(t)) in template for s, t in zip(slots, page.texts, strict=True)] if template else [False] * len(slots)
    chars = lambda *flags: sum(len(t) for t, *which in zip(page.texts, *flags, strict=True) if all(which))
    varied = [not c for c in constant]
    if any(block) and chars(block) >= chars(beside, varied):
        kept = block
    else:
        text = [x or y for x, y in zip(block, beside, strict=True)]
        own = {within for within, x, y in zip(page.within, text, varied, strict=True) if x and y}
        kept = [x and (y or within in own) for x, y, within in zip(text, block, page.within, strict=True)]
    return " ".join(t for t, k in zip(page.texts, kept, strict=True) if k)


def _parsed(pages: DataFrame) -> DataFrame:
    """Of pages (host, html): rows (host, w), a wrapper for each partition's pages of a host; and rows (host, slot, text, page) of hashes of the texts, with a null text once for each slot that a page fills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list | None, set[int]]] = {}
        for b in batches:
            found: set[tuple] = set()
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                w, seen = held.get(host, (None, set()))
                page = Page(source or "")
                stream = reduced(page.tokens)
                if (h := hash(json.dumps(stream))) not in seen:
                    w = joined(w, stream)
                    if len(seen) < 1_000:  # streams that the wrapper knows need no alignment
                        seen.add(h)
                held[host] = w, seen
                key = _hash("\0".join(page.texts))
                for text, slot in zip(page.texts, slots_of(page.tokens), strict=True):
                    found.add((host, slot, _hash(text), key))
                    found.add((host, slot, None, key))
            if len(held) > 10_000:
                yield _mixed_rows(held, set())
                held = {}
            yield _mixed_rows({}, found)
        yield _mixed_rows(held, set())

    return pages.mapInArrow(run, "host string, w string, slot long, text long, page long")


def _mixed_rows(held: dict, found: set[tuple]) -> pa.RecordBatch:
    n, m = len(held), len(found)
    hosts, slots, texts, keys = zip(*found, strict=True) if found else [()] * 4
    columns = [[*held, *hosts], [*(json.dumps(w) for w, _ in held.values()), *[None] * m], [*[None] * n, *slots], [*[None] * n, *texts], [*[None] * n, *keys]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), *[pa.int64()] * 3), strict=True)], names=["host", "w", "slot", "text", "page"])


def _rows(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w, _ in held.values()], pa.string())], names=["host", "w"])


def _merged(parts: DataFrame, *by: str) -> DataFrame:
    """Folds the wrappers of each group, which come sorted, a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = None, None
        for b in batches:
            for key, text in zip(zip(*(b.column(c).to_pylist() for c in by), strict=True), b.column("w").to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        yield _rows({at[0]: (w, None)})
                    at, w = key, None
                w = joined(w, json.loads(text))
        if at is not None:
            yield _rows({at[0]: (w, None)})

    return parts.repartition(*by).sortWithinPartitions(*by, "w").select(*by, "w").mapInArrow(run, "host string, w string")


def infer(parts: DataFrame) -> DataFrame:
    """host, w: the wrapper of each host, as JSON, of those of its partitions."""
    meet, step = parts.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], 0
    while meet > 1:
        meet, step = -(-meet // FAN_IN), step + 1
        parts = _merged(parts.withColumn("salt", F.pmod(F.xxhash64("w", F.lit(step)), F.lit(meet)).cast("int")), "host", "salt")
    return parts


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)).alias("host")


def _with_wrapper(rows: DataFrame, wrappers: DataFrame, size: int, columns: list[str]) -> DataFrame:
    return rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left").select(*columns)


def _size(wrappers: DataFrame) -> int:
    return wrappers.agg(F.coalesce(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in wrappers.columns), F.lit(64))), F.lit(0))).first()[0]


class _Known:
    """Wrappers by their JSON, so that each is compiled once."""

    def __init__(self):
        self.held: dict = {}

    def __call__(self, w: str | None, template: str | None = None) -> tuple[list, set]:
        if (w, template) not in self.held:
            if len(self.held) > 1_000:
                self.held.clear()
            self.held[w, template] = compiled(json.loads(w)) if w else [], {tuple(x) for x in json.loads(template)} if template else set()
        return self.held[w, template]


def templates(texts: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, w, template: with each wrapper the (slot, hash) of text that is template, as JSON, or null. A slot has one text at most that is in more than half of its pages, for each time that a page fills it."""
    met = texts.distinct()  # copies of a page count once
    counts = cut(met.groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES))
    whole = counts.where("text is null").select("host", "slot", F.col("n").alias("pages"))
    same = counts.where("text is not null").join(whole, ["host", "slot"]).where(F.col("n") * 2 > F.col("pages"))
    found = same.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array("slot", "text")))).alias("template"))
    return wrappers.join(found, "host", "left").select("host", "w", "template")


def main_texts(pages: DataFrame, keep: list[str], url: str = "url", source: str = "html") -> DataFrame:
    """Columns ``keep``, and text: the main text of each page.

    A null or empty page has an empty text; so has one without any main field. Repeated rows stay.
    Pages of any length, depth or variety are read whole. Of alignments that are equally long, that
    which goes on with the wrapper's side is taken. An empty table gives an empty one. Columns outside
    ``keep`` are dropped, so their names can't clash.
    """
    plain = pages.select(_host(url), F.col(source).cast("string").alias("html"))
    parsed, _ = stored(_parsed(plain))
    found = infer(parsed.where("w is not null").select("host", "w"))
    wrappers = cut(templates(parsed.where("w is null").select("host", "slot", "text", "page"), found))
    names = [f"k{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], _host(url), F.col(source).cast("string").alias("html"))
    rows = _with_wrapper(rows, wrappers, _size(wrappers), [*names, "html", "w", "template"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for b in batches:
            pages = zip(*(b.column(c).to_pylist() for c in ("html", "w", "template")), strict=True)
            texts = [extract(page, *known(w, template)) for page, w, template in pages]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(texts, pa.string())], names=[*names, "text"])

    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    out = rows.mapInArrow(run, f"{kinds}text string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text")
