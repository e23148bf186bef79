"""Main text of web pages by wrapper induction.

Pages of a host that have one layout share a template. One of them, the
exemplar, is aligned with every other distinct page by simple tree matching, and
over all of them it is measured, for each node of the exemplar, how much text
its partners hold, how much of that is in links, and how often it stays the
same. Nodes that stay constant are template, slots that vary are content: from
the root the wrapper goes down to the slot that holds most of the varying text
that is no link, keeps headings and large slots beside the way, and leaves out
constant nodes and menus inside. It does not look at element names or classes
for this, they only tell which nodes can be partners. Each page is then aligned
with its exemplar and gives the text of the partners of those slots.

Layouts of hosts with few pages are pooled over hosts. Pages without enough
others of their layout fall back on element names, roles and class names; within
a content slot these take out forms, adverts and reader comments, as such text
varies too.

Only skeletons (tags, lengths, hashes) are compared; pages never gather by host,
and a host with a third of all pages is measured in parts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize

#: A node is template if this share of its partners has its text, on so many distinct pages at least.
CONSTANT, LEAST_PAGES = 0.8, 4
#: A slot is gone into if it holds this share of the varying text, and kept beside the way from that share on.
MAIN, BESIDE = 0.5, 0.2
#: A slot with this share of its text in links is a menu.
LINKED = 0.6
#: Up to so many wrappers (some kilobytes each), their table is broadcast.
BROADCAST_WRAPPERS = 5_000
#: Up to so many pairs of children, plain loops are faster than arrays.
FEW_PAIRS = 128
#: Elements below the document's root by which layouts are told apart.
LAYOUT_DEPTH = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in _RAW}
#: Elements within a line: they don't end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr picture source area map".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt td th tr tbody thead tfoot".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}
_SKIP = frozenset("nav aside form script style noscript template head title button select textarea iframe svg math object embed canvas audio video dialog menu input option fieldset".split())
_EDGES = frozenset({"header", "footer"})
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_MARK = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|"
    r"newsletters?|subscri\w*|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus\w*|respond|replies|reply|pagination|pager|login|sign-?up|search|widgets?|toolbar|hidden|skip-?link)(?=$|[\s_-])",
    re.IGNORECASE,
)
_NEVER_MARKED = frozenset({"html", "body", "article", "main"})
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"})
#: In a name, this tells a node that name, role or class mark as not of the article.
_OUT = "!"


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def boilerplate(tag: str, a: dict[str, str], in_article: bool) -> bool:
    """Whether an element is known not to be of the article by its name, role or class."""
    if tag in _SKIP or tag in _EDGES and (not in_article or tag == "footer"):
        return True
    if not a:
        return False
    if a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.IGNORECASE):
        return True
    return tag not in _NEVER_MARKED and bool(_MARK.search(f"{a.get('class', '')} {a.get('id', '')}"))


def name_of(tag: str, attrs: str, in_article: bool) -> str:
    """By what a node finds its partners: element name and class, the latter without parts that hold digits."""
    if not attrs or attrs.isspace():
        return tag + _OUT if boilerplate(tag, {}, in_article) else tag
    a = attributes(attrs)
    classes = " ".join(c for c in a.get("class", "").lower().split() if not any(map(str.isdigit, c)))
    return (f"{tag}.{classes}" if classes else tag) + (_OUT if boilerplate(tag, a, in_article) else "")


@dataclass(slots=True)
class Page:
    """Nodes in page order with their parents (-1 for the root), and the blocks below each, from lo up to hi.

    A block is the text between two block boundaries. Neighbouring blocks of one
    element name, or with none of their own, make one node, a run; its name ends
    with #.
    """

    names: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    digests: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    #: A matching that knows the page, the children of its nodes and their shapes.
    met: tuple | None = None

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.names]
        for i, p in enumerate(self.parent):
            if p >= 0:
                out[p].append(i)
        return out

    def tag(self, i: int) -> str:
        return self.names[i].rstrip("#").rstrip(_OUT).partition(".")[0]

    def out(self, i: int) -> bool:
        return self.names[i].rstrip("#").endswith(_OUT)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def parse(page: str | None) -> Page:
    """The tree of block elements and its blocks.

    Ends that are left out are filled in as browsers do for paragraphs, list
    items and table cells; elements within a line leave no trace but the
    characters in links. Nesting may be of any depth.
    """
    page = page or ""
    # an element: [name, tag, hash of the way to it, children]; a block: its number
    root: list = ["#root", "#", 0, []]
    stack = [root]
    text_blocks, digests, chars, links = [], [], [], []
    run: list[str] = []
    linked = articles = open_p = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1][3].append(len(text_blocks))
                text_blocks.append(text)
                digests.append(signed(xxh64_intdigest(text.encode("utf-8", "replace"), stack[-1][2])))
                chars.append(len(text))
                links.append(min(linked, len(text)))
            linked = 0

    def pop() -> None:
        nonlocal articles, open_p
        flush()
        tag = stack.pop()[1]
        articles -= tag == "article"
        open_p -= tag == "p"

    def close_to(names, stops) -> None:
        """Close the innermost element of names, unless one of stops lies within reach first."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][1] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][1] in stops:
                return

    def write(text: str) -> None:
        nonlocal linked
        run.append(text)
        if in_link:
            linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            write(page[at:])
            break
        if m.start() > at:
            write(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing, attrs = m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if tag in _INLINE and not (tag == "span" and attrs and not closing and boilerplate(tag, attributes(attrs), articles > 0)):
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = not closing
            continue
        if closing:
            if tag == "p" and not open_p:
                flush()
            elif tag not in _VOID:
                close_to({tag}, frozenset())
            continue
        if tag in _RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            flush()
            continue
        if tag in _VOID:
            flush()
            continue
        if tag in _CLOSES_P and open_p:
            close_to({"p"}, _CLOSES_P - {"p"} | {"button", "object"})
        if tag in _SIBLINGS:
            close_to(*_SIBLINGS[tag])
        flush()
        name = name_of(tag, attrs, articles > 0)
        node = [name, tag, xxh64_intdigest(name.encode("utf-8", "replace"), stack[-1][2]), []]
        stack[-1][3].append(node)
        if attrs.rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        stack.append(node)
        articles += tag == "article"
        open_p += tag == "p"
    while len(stack) > 1:
        pop()
    flush()
    return _numbered(root, text_blocks, digests, chars, links)


def _numbered(root: list, blocks: list[str], digests: list[int], chars: list[int], links: list[int]) -> Page:
    out = Page(blocks=blocks, digests=digests, chars=chars, links=links)
    done = 0
    # to open: (element, parent); to close: (None, its number)
    todo: list[tuple] = [(root, -1)]
    last_run: dict[int, int] = {}  # parent -> its last child if that is a run

    def add_run(name: str, parent: int, n: int) -> None:
        nonlocal done
        i = last_run.get(parent, -1)
        if i >= 0 and out.names[i] == name:
            out.hi[i] += n
        else:
            out.names.append(name)
            out.parent.append(parent)
            out.lo.append(done)
            out.hi.append(done + n)
            last_run[parent] = len(out.names) - 1
        done += n

    while todo:
        node, at = todo.pop()
        if node is None:
            out.hi[at] = done
            continue
        if isinstance(node, int):
            add_run("#", at, 1)
        elif len(node[3]) == 1 and isinstance(node[3][0], int) and at >= 0:
            add_run(node[0] + "#", at, 1)
        else:
            last_run.pop(at, None)
            out.names.append(node[0])
            out.parent.append(at)
            out.lo.append(done)
            out.hi.append(done)
            me = len(out.names) - 1
            todo.append((None, me))
            todo.extend((c, me) for c in reversed(node[3]))
    return out


def by_names(page: Page) -> list[int]:
    """The blocks that can be of the article by names alone: those in article, else main, else anywhere, without boilerplate."""
    n = len(page.blocks)
    shut, article, main = (np.zeros(n, bool) for _ in range(3))
    for i in range(len(page.names)):
        lo, hi = page.lo[i], page.hi[i]
        if page.out(i):
            shut[lo:hi] = True
        elif page.tag(i) == "article":
            article[lo:hi] = True
        elif page.tag(i) == "main":
            main[lo:hi] = True
    for choice in (article & ~shut, main & ~shut):
        if choice.any():
            return np.flatnonzero(choice).tolist()
    return np.flatnonzero(~shut).tolist()


def layout(page: Page, depth: int = LAYOUT_DEPTH) -> int:
    """A hash of the ways to the elements down to a depth, in order, each way once; runs of blocks do not count."""
    ways: dict[int, tuple[int, int]] = {}
    seen: dict[int, None] = {}
    for i, name in enumerate(page.names):
        above = ways.get(page.parent[i], (0, 0) if page.parent[i] < 0 else None)
        if above is not None and above[1] <= depth and not name.endswith("#"):
            h = xxh64_intdigest(name.encode("utf-8", "replace"), above[0])
            ways[i] = h, above[1] + 1
            seen[h] = None
    return signed(xxh64_intdigest(np.array(list(seen), np.uint64).tobytes()))


# Simple tree matching


class Matching:
    """The largest number of node pairs of two trees that keep order and ancestry, with roots paired.

    The number for two subtrees depends on their shapes alone, so it is computed
    once for each pair of shapes. Children are aligned a row at a time; the
    pairs are found by halving, in memory of the order of the children. Nothing
    recurs, so depth and breadth are not bounded.
    """

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.about: list[tuple[str, int, tuple[int, ...]]] = []  # name, blocks of a run, shapes of children
        self.value: dict[tuple[int, int], int] = {}

    def shapes_of(self, page: Page, children: list[list[int]]) -> list[int]:
        out = [0] * len(page.names)
        for i in range(len(page.names) - 1, -1, -1):
            name = page.names[i]
            key = name, page.hi[i] - page.lo[i] if name.endswith("#") else 0, tuple(out[c] for c in children[i])
            if (s := self.shapes.get(key)) is None:
                s = self.shapes[key] = len(self.about)
                self.about.append(key)
            out[i] = s
        return out

    def weight(self, a: int, b: int) -> int:
        """The number for two shapes; 0 if their roots have different names."""
        todo = [(a, b)]
        while todo:
            p = todo[-1]
            if p in self.value:
                todo.pop()
                continue
            (name, n, x), (other, m, y) = self.about[p[0]], self.about[p[1]]
            if name != other:
                self.value[p] = 0
            elif not x or not y:
                self.value[p] = min(n, m) if name.endswith("#") else 1
            else:
                missing = [(i, j) for i in dict.fromkeys(x) for j in dict.fromkeys(y) if (i, j) not in self.value]
                if missing:
                    todo += missing
                    continue
                self.value[p] = 1 + int(self.last_row(x, y)[-1])
            todo.pop()
        return self.value[a, b]

    def last_row(self, x: Sequence[int], y: Sequence[int]) -> np.ndarray:
        """The numbers of x against each prefix of y."""
        if len(x) * len(y) <= FEW_PAIRS:
            row = [0] * (len(y) + 1)
            for i in x:
                before = 0  # of one row up and one place to the left
                for k, j in enumerate(y, 1):
                    before, up = row[k], before + self.value[i, j]
                    row[k] = max(before, up, row[k - 1])
            return np.array(row)
        distinct, index = np.unique(np.array(y), return_inverse=True)
        rows: dict[int, np.ndarray] = {}
        best = np.zeros(len(y) + 1, np.int64)
        for i in x:
            w = rows.get(i)
            if w is None:
                w = rows[i] = np.array([self.value[i, j] for j in distinct.tolist()], np.int64)[index]
            now = best.copy()
            np.maximum(now[1:], best[:-1] + w, out=now[1:])
            best = np.maximum.accumulate(now)
        return best

    def align_children(self, x: Sequence[int], y: Sequence[int]) -> Iterator[tuple[int, int]]:
        """The places of paired children, by halving the first list."""
        todo = [(0, len(x), 0, len(y))]
        while todo:
            a, b, c, d = todo.pop()
            if a >= b or c >= d:
                continue
            if b - a == 1:
                w = [self.value[x[a], y[j]] for j in range(c, d)]
                if max(w) > 0:
                    yield a, c + w.index(max(w))
                continue
            mid = (a + b) // 2
            ahead = self.last_row(x[a:mid], y[c:d])
            behind = self.last_row(x[mid:b][::-1], y[c:d][::-1])[::-1]
            cut = c + int((ahead + behind).argmax())
            todo += [(a, mid, c, cut), (mid, b, cut, d)]

    def known(self, page: Page) -> tuple[list[list[int]], list[int]]:
        if page.met is None or page.met[0] is not self:
            children = page.children()
            page.met = self, children, self.shapes_of(page, children)
        return page.met[1:]

    def partners(self, a: Page, b: Page) -> dict[int, int]:
        """For each node of a its partner in b, if it has one."""
        (ac, sa), (bc, sb) = self.known(a), self.known(b)
        out: dict[int, int] = {}
        todo = [(0, 0)] if a.names and b.names and self.weight(sa[0], sb[0]) else []
        while todo:
            i, j = todo.pop()
            out[i] = j
            x, y = ac[i], bc[j]
            if x and y:
                wx, wy = [sa[k] for k in x], [sb[k] for k in y]
                if wx == wy:
                    todo += zip(x, y, strict=True)
                    continue
                for p in dict.fromkeys(wx):
                    for q in dict.fromkeys(wy):
                        self.weight(p, q)
                todo += [(x[p], y[q]) for p, q in self.align_children(wx, wy)]
        return out


# Induction


@dataclass(slots=True)
class Wrapper:
    """What is kept of pages like the exemplar: slots, without the nodes and the constant blocks to leave out."""

    exemplar: Page
    keep: list[int]
    drop: list[int]
    constant: frozenset[int]

    def blocks(self, page: Page, matching: Matching) -> list[int] | None:
        """The blocks of a page that are content; None if it has none of the slots."""
        partner = matching.partners(self.exemplar, page)
        roots = [partner[i] for i in self.keep if i in partner]
        taken = np.zeros(len(page.blocks), bool)
        for j in roots:
            taken[page.lo[j] : page.hi[j]] = True
        if not taken.any():
            return None
        for j in (partner[i] for i in self.drop if i in partner):
            taken[page.lo[j] : page.hi[j]] = False
        inside = np.zeros(len(page.names), bool)
        for j in range(len(page.names)):
            p = page.parent[j]
            inside[j] = p >= 0 and (inside[p] or p in roots)
            if inside[j] and page.out(j):
                taken[page.lo[j] : page.hi[j]] = False
        return [k for k in np.flatnonzero(taken).tolist() if page.digests[k] not in self.constant]


def measure(exemplar: Page, page: Page, matching: Matching, nodes: np.ndarray, blocks: dict[int, list[int]]) -> None:
    """Add a page to the figures of the exemplar's nodes (pages, characters, in links, same text) and blocks (partners, same text)."""
    up_to = lambda x: np.concatenate([[0], np.cumsum(x)])
    chars, links = up_to(page.chars), up_to(page.links)
    for i, j in matching.partners(exemplar, page).items():
        lo, hi, a, b = page.lo[j], page.hi[j], exemplar.lo[i], exemplar.hi[i]
        same = exemplar.digests[a:b] == page.digests[lo:hi]
        nodes[i] += (1, chars[hi] - chars[lo], links[hi] - links[lo], same)
        if exemplar.names[i].endswith("#"):
            n, m = b - a, hi - lo
            for k in range(n):
                # a block's partner is the one as far from the start, or from the end
                around = {page.digests[lo + x] for x in (k, m - n + k) if 0 <= x < m}
                if around:
                    digest = exemplar.digests[a + k]
                    c = blocks.setdefault(digest, [0, 0])
                    c[0] += 1
                    c[1] += digest in around


def induce(exemplar: Page, nodes: np.ndarray, blocks: dict[int, list[int]], constant: float = CONSTANT, least_pages: int = LEAST_PAGES) -> Wrapper | None:
    """The wrapper that the figures tell; None if nothing varies."""
    n, chars, links, same = nodes.T.astype(float)
    seen = np.maximum(n, 1)
    is_constant = (n >= least_pages - 1) & (same >= constant * n)
    is_menu = (n > 0) & (links >= LINKED * chars) & (chars > 0)
    # what varies of a node's text, as a mean over its partners
    varying = (chars - links) / seen * (1 - same / seen)
    children = exemplar.children()
    often = n >= 0.5 * n.max(initial=1)
    keep: list[int] = []
    at = 0
    if not varying[at] > 0:
        return None
    while True:
        inner = [c for c in children[at] if often[c] and not exemplar.names[c].endswith("#")]
        top = max(inner, key=lambda c: varying[c], default=-1)
        if top < 0 or varying[top] < MAIN * varying[at]:
            break
        for c in children[at]:
            beside = varying[c] >= BESIDE * varying[at] or c < top and exemplar.tag(c) in _HEADINGS and not exemplar.names[c].rstrip("#").endswith(_OUT)
            if c != top and beside and not is_constant[c] and not is_menu[c]:
                keep.append(c)
        at = top
    keep.append(at)
    inside = [False] * len(exemplar.names)
    for i, p in enumerate(exemplar.parent):
        inside[i] = p >= 0 and (inside[p] or p in keep)
    steady = frozenset(d for d, (partners, times) in blocks.items() if partners >= least_pages - 1 and times >= constant * partners)
    # where most of the exemplar's content is constant its pages are copies of each other, and that is no template
    own = [k for i in keep for k in range(exemplar.lo[i], exemplar.hi[i])]
    copies = sum(exemplar.chars[k] for k in own if exemplar.digests[k] in steady) > 0.5 * sum(exemplar.chars[k] for k in own)
    if copies:
        steady = frozenset()
    drop = [i for i in range(len(exemplar.names)) if inside[i] and (is_menu[i] and often[i] and not exemplar.names[i].endswith("#") or is_constant[i] and not copies)]
    return Wrapper(exemplar, sorted(keep), drop, steady)


# Tables


def host(url) -> F.Column:
    """The host of a URL column in small letters; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


_TREE = "names array<string>, parent array<int>, lo array<int>, hi array<int>, digests array<long>, chars array<int>, links array<int>"
_TREE_TYPES = [("names", pa.list_(pa.string())), ("parent", pa.list_(pa.int32())), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("digests", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))]
_TREE_NAMES = [n for n, _ in _TREE_TYPES]


def page_of(row: dict) -> Page:
    return Page(**{n: row[n] for n in _TREE_NAMES}, blocks=row.get("blocks") or [""] * len(row["digests"]))


def trees(pages: DataFrame, with_text: bool) -> DataFrame:
    """Per row the host, the layout, the tree and a hash of it; with page_id, url and the blocks if wanted."""
    first = [("page_id", pa.int64()), ("url", pa.string())] if with_text else []
    last = [("blocks", pa.list_(pa.string()))] if with_text else []
    schema = pa.schema([*first, ("host", pa.string()), *_TREE_TYPES, ("layout", pa.int64()), ("whole", pa.int64()), *last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [parse(x.as_py()) for x in part.column("html")]
                columns = {n: [getattr(p, n) for p in found] for n in _TREE_NAMES}
                columns["layout"] = [layout(p) for p in found]
                columns["whole"] = [signed(xxh64_intdigest(repr((p.names, p.parent, p.digests)).encode("utf-8", "replace"))) for p in found]
                columns["blocks"] = [p.blocks for p in found] if with_text else None
                yield pa.RecordBatch.from_arrays([part.column(f.name) if f.name in part.schema.names else pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    if not with_text:
        rows = rows.select("host", "html")
    return rows.mapInArrow(run, ("page_id long, url string, " if with_text else "") + f"host string, {_TREE}, layout long, whole long" + (", blocks array<string>" if with_text else ""))


_FIGURES = "pool string, layout long, node int, digest long, n long, chars long, links long, same long"
_FIGURE_TYPES = [("pool", pa.string()), ("layout", pa.int64()), ("node", pa.int32()), ("digest", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("same", pa.int64())]
_WRAPPER = f"pool string, layout long, {_TREE}, keep array<int>, `drop` array<int>, constant array<long>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of pages against their exemplars, added up over a batch."""
    for b in batches:
        matching = Matching()
        found: dict[tuple, tuple[Page, np.ndarray, dict]] = {}
        keys = list(zip(b.column("pool").to_pylist(), b.column("layout").to_pylist(), strict=True))
        columns = {n: b.column(n) for n in _TREE_NAMES}
        for i, key in enumerate(keys):
            if key not in found:
                exemplar = page_of(b.column("exemplar")[i].as_py())
                found[key] = exemplar, np.zeros((len(exemplar.names), 4), np.int64), {}
            measure(found[key][0], page_of({n: c[i].as_py() for n, c in columns.items()}), matching, *found[key][1:])
        out = []
        for key, (_, nodes, blocks) in found.items():
            out += [(*key, i, None, *x) for i, x in enumerate(nodes.tolist()) if x[0]]
            out += [(*key, None, d, partners, 0, 0, times) for d, (partners, times) in blocks.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _FIGURE_TYPES, strict=True)], names=[n for n, _ in _FIGURE_TYPES])


def wrappers(pages: DataFrame, constant: float = CONSTANT, least_pages: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """The wrappers by (pool, layout), and the layouts of hosts that have one of their own.

    pool is a host, or empty for the layouts of all hosts that have fewer than
    least_pages distinct pages of them.
    """
    distinct = materialize(trees(pages, False).dropDuplicates(["host", "whole"]))
    sizes = distinct.where("host <> ''").groupBy("host", "layout").count()
    own = materialize(sizes.where(F.col("count") >= least_pages).select("host", "layout"))
    small = own.count() <= BROADCAST_WRAPPERS
    pooled = distinct.join(with_pool(own, small), ["host", "layout"], "left").withColumn("pool", F.coalesce("pool", F.lit("")))
    tree = F.struct(*_TREE_NAMES)
    exemplar = pooled.groupBy("pool", "layout").agg(F.min_by(tree, F.struct("whole", "host")).alias("exemplar"), F.min(F.struct("whole", "host")).alias("first"), F.count("*").alias("n"))
    exemplar = materialize(exemplar.where(F.col("n") >= least_pages))
    few = exemplar.count() <= BROADCAST_WRAPPERS
    # a few exemplars go to every task; more are met by key, where adaptive execution splits a large one
    pairs = pooled.join(F.broadcast(exemplar) if few else exemplar, ["pool", "layout"]).where("struct(whole, host) <> first").select("pool", "layout", *_TREE_NAMES, "exemplar")
    sums = pairs.mapInArrow(_measured, _FIGURES).groupBy("pool", "layout", "node", "digest").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links", "same")])
    # one row for each node or block of an exemplar at most: no more than that page holds
    figures = sums.groupBy("pool", "layout").agg(F.collect_list(F.struct("node", "digest", "n", "chars", "links", "same")).alias("figures"))
    schema = pa.schema([("pool", pa.string()), ("layout", pa.int64()), *_TREE_TYPES, ("keep", pa.list_(pa.int32())), ("drop", pa.list_(pa.int32())), ("constant", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                page = page_of(row["exemplar"])
                nodes, blocks = np.zeros((len(page.names), 4), np.int64), {}
                for x in row["figures"]:
                    if x["node"] is None:
                        blocks[x["digest"]] = [x["n"], x["same"]]
                    else:
                        nodes[x["node"]] = x["n"], x["chars"], x["links"], x["same"]
                w = induce(page, nodes, blocks, constant, least_pages)
                if w:
                    out.append((row["pool"], row["layout"], *[getattr(page, n) for n in _TREE_NAMES], w.keep, w.drop, sorted(w.constant)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return exemplar.join(F.broadcast(figures) if few else figures, ["pool", "layout"]).select("pool", "layout", "exemplar", "figures").mapInArrow(run, _WRAPPER), own


def with_pool(own: DataFrame, small: bool) -> DataFrame:
    named = own.withColumn("pool", F.col("host"))
    return F.broadcast(named) if small else named


def extract(pages: DataFrame, constant: float = CONSTANT, least_pages: int = LEAST_PAGES, induced: bool = True) -> DataFrame:
    """Per row: page_id, url, text, n_chars, wrapped.

    text holds the blocks of the content, one per line; it is empty for a null
    or empty page and where nothing is left. wrapped tells whether a wrapper
    gave it; else names did, as for pages with too few of their layout, and for
    all pages with induced=False. Repeated rows each get a row but count once
    for the template. Pages of any length and depth are taken whole. An empty
    table gives no rows. Other columns, whatever their names, are ignored.
    """
    rows = trees(pages, True)
    if induced:
        found, own = wrappers(pages, constant, least_pages)
        found = materialize(found)
        small = own.count() <= BROADCAST_WRAPPERS
        rows = rows.join(with_pool(own, small), ["host", "layout"], "left").withColumn("pool", F.coalesce("pool", F.lit("")))
        ways = found.select("pool", "layout", F.struct(*_TREE_NAMES, "keep", "`drop`", "constant").alias("wrapper"))
        rows = rows.join(F.broadcast(ways) if found.count() <= BROADCAST_WRAPPERS else ways, ["pool", "layout"], "left")
        rows = rows.select("page_id", "url", "pool", "layout", *_TREE_NAMES, "blocks", F.when(F.col("wrapper").isNotNull(), F.struct("wrapper.*")).alias("wrapper"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("wrapped", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matching = Matching()
            known: dict[tuple, Wrapper | None] = {}
            texts, wrapped = [], []
            columns = {n: b.column(n) for n in [*_TREE_NAMES, "blocks"]}
            for i in range(b.num_rows):
                page = Page(**{n: c[i].as_py() for n, c in columns.items()})
                w = None
                if induced:
                    key = b.column("pool")[i].as_py(), b.column("layout")[i].as_py()
                    if key not in known:
                        x = b.column("wrapper")[i].as_py()
                        known[key] = x and Wrapper(page_of(x), x["keep"], x["drop"], frozenset(x["constant"]))
                    w = known[key]
                at = w.blocks(page, matching) if w else None
                wrapped.append(at is not None)
                texts.append("\n".join(page.blocks[k] for k in (by_names(page) if at is None else at)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(wrapped)], schema=schema)

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, wrapped boolean")
