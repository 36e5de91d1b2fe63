"""Main text of web pages by wrapper induction over the pages of each host."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_chunks
from .url_filters import url_host

#: Share of a host's pages with a slot that must hold a text for it to be template, and the least number of different pages: in general, and inside an article or main element.
TEMPLATE_SHARE, LEAST_PAGES, LEAST_INSIDE = 0.9, 3, 12
#: Layouts of a host (its most frequent ones) whose seeds a page is aligned with.
SEEDS = 4
#: Brothers of one label are aligned when their ranks among such brothers differ by this much at most.
BAND = 4
#: Pairs of subtrees that an exact matching of two trees may weigh, and the hashes of labels that bounds are counted by beyond it.
WORK, BUCKETS = 20_000, 16

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>")
_ATTR = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
#: Elements whose text ends only at their own end tag, and elements that hold no text of the page.
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in "script style textarea title iframe xmp noembed noframes".split()}
_DROPPED = frozenset("noscript template svg math select option optgroup datalist button object canvas audio video".split())
_SPACED = frozenset("textarea iframe select option button td th br input".split())
_NOT_CONTENT = frozenset("nav footer aside form menu dialog search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Names of classes and ids that hint at what is not content, outside articles; a name counts only if all its parts are among these and those that say nothing.
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription widget widgets pagination pager toolbar login signup search".split())
_PLAIN_NAMES = frozenset("site page main top bottom left right box list bar container wrapper wrap inner outer block area section global primary secondary item items links link unit slot content js reader readers user users visitor visitors buttons form posts stories message".split())
#: Of these, the ones that also count inside articles: on an element that only groups others, adverts on paragraphs too; the last ones not as the id of a section, which is an anchor.
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsored".split())
_INSIDE_NAMES = _ADVERTS | frozenset("comment comments commentlist replies respond disqus".split())
_ASIDES = frozenset("banner cookie cookies consent gdpr notice notices popup modal overlay sidebar breadcrumb breadcrumbs sharing share social related recommended recommendations newsletter subscribe subscription pagination pager promo sponsor".split())
_GROUPS = frozenset("div section ul ol dl ins".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: An element of these that opens ends open ones of the second set, as far as the third.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"})}


def attributes(raw: str) -> dict[str, str]:
    """Class, id, role, style and the marks of hidden elements; the first of a name counts."""
    out: dict[str, str] = {}
    low = raw.lower()
    if any(x in low for x in ("class", "id", "role", "style")):
        for name, a, b, c in _ATTR.findall(raw):
            if (n := name.lower()) in ("class", "id", "role", "style", "hidden", "aria-hidden"):
                out.setdefault(n, a or b or c)
    return out


@lru_cache(maxsize=20_000)
def _hints(names: str, of: frozenset[str] = _NAMES) -> bool:
    """Whether a class or id has one of these names, and nothing but names and what says nothing."""
    for token in names.split():
        parts = [x.lower() for x in _PART.findall(token)]
        if any(x in of for x in parts) and all(x in _NAMES or x in _PLAIN_NAMES for x in parts):
            return True
    return False


def _hints_inside(tag: str, classes: str, ids: str) -> bool:
    """Whether an element inside an article is named as something that is not the article."""
    if tag in ("p", "figure"):
        return _hints(f"{classes} {ids}", _ADVERTS)
    return tag in _GROUPS and (_hints(f"{classes} {ids}", _INSIDE_NAMES) or _hints(classes if tag == "section" else f"{classes} {ids}", _ASIDES))


@lru_cache(maxsize=20_000)
def _label(tag: str, names: str) -> str:
    """A node's label: its element and the letters of its class, so that numbers in names make no difference."""
    return tag + "".join("." + x for x in sorted({"".join(c for c in t if c.isalpha() or c in "-_") for t in names.lower().split()}) if x)


class Page:
    """A page's tree of block elements and its blocks outside menus, forms and the like.

    ``blocks`` holds (node, in an article, hinted at as not content, text); ``labels`` and ``parents`` the tree in page order.
    """

    def __init__(self, html: str):
        self.labels, self.parents = ["#"], [-1]
        self.blocks: list[tuple[int, bool, bool, str]] = []
        # tag, node, no content, in an article, hinted, place of the nearest block
        self.stack: list[tuple[str, int, bool, bool, bool, int]] = [("#", 0, False, False, False, 0)]
        self.open: Counter = Counter()
        self.text: list[str] = []
        self._read(html)
        self._end_block()

    def _end_block(self) -> None:
        if self.text:
            if t := " ".join(unescape("".join(self.text)).split()):
                _, node, noise, inside, hint, _ = self.stack[self.stack[-1][5]]
                if not noise:
                    self.blocks.append((node, inside, hint, t))
            self.text.clear()

    def _read(self, html: str) -> None:
        """One pass; a tag that the page's end cuts off is dropped, as are comments and raw text without an end."""
        at, low, last = 0, "", {}
        while True:
            p = html.find("<", at)
            if p < 0 or p + 1 >= len(html):
                self._add(html[at:])
                return
            c = html[p + 1]
            if c == "!" or c == "?":
                self._add(html[at:p])
                if html.startswith("<!--", p):
                    end = p + 4 if html.startswith(">", p + 4) else html.find("-->", p + 2)
                    at = end + (1 if end == p + 4 else 3)
                else:
                    end = html.find(">", p)
                    at = end + 1
                if end < 0:
                    return
                continue
            name = html[p + 2 : p + 3] if c == "/" else c
            if not (name.isascii() and name.isalpha()):
                if c == "/" and name:  # a bogus comment
                    self._add(html[at:p])
                    at = html.find(">", p) + 1
                    if not at:
                        return
                else:
                    self._add(html[at : p + 1])
                    at = p + 1
                continue
            self._add(html[at:p])
            m = _TAG.match(html, p)
            if not m:
                return
            at, tag = m.end(), m[2].lower()
            if tag in _SPACED and self.stack:
                self.text.append(" ")
            if m[1]:
                self._close(tag)
            elif tag in _RAW:
                end = _RAW[tag].search(html, at)
                if not end:
                    return
                at = html.find(">", end.end()) + 1
                if not at:
                    return
            elif tag not in _VOID:
                own = m[3].rstrip().endswith("/")
                if tag in _DROPPED:
                    if own and tag in ("svg", "math"):
                        continue
                    if tag not in ("option", "optgroup"):
                        low = low or html.lower()
                        if tag not in last:
                            last[tag] = low.rfind(f"</{tag}")
                        if last[tag] < at:  # never closed: it holds nothing
                            continue
                self._open(tag, m[3], own)
            elif tag == "hr":
                self._end_block()

    def _add(self, text: str) -> None:
        if text and not self.stack[-1][2]:
            self.text.append(text)

    def _cut(self, k: int) -> None:
        """Close the open elements from place ``k`` on."""
        for x in self.stack[k:]:
            self.open[x[0]] -= 1
        del self.stack[k:]

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end_block()
        if not self.open[tag]:
            return
        deep = tag in _BLOCK or tag in _DROPPED or tag in ("td", "th")
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._cut(i)
                return
            if not deep and self.stack[i][0] in _BLOCK:
                return  # an inline end does not close blocks

    def _open(self, tag: str, raw: str, own: bool) -> None:
        stack = self.stack
        if tag in _BLOCK:
            self._end_block()
            near = stack[-1][5]
            if stack[near][0] == "p":  # an open paragraph or option ends where a block begins
                self._cut(near)
            elif self.open["option"] and (k := next((i for i in range(near + 1, len(stack)) if stack[i][0] == "option"), 0)):
                self._cut(k)
        if tag in _ENDS:
            ends, limit = _ENDS[tag]
            if any(self.open[x] for x in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        self._cut(i)
                        break
                    if stack[i][0] in limit:
                        break
        _, node, noise, inside, hint, near = stack[-1]
        a = attributes(raw) if raw else {}
        names = f"{a.get('class', '')} {a.get('id', '')}"
        noise = noise or tag in _DROPPED or tag in _NOT_CONTENT or (tag == "header" and not inside) or (tag == "article" and inside and self.open["article"] > 0)  # an article in an article is a reader's comment
        noise = noise or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in _ROLES or bool(_HIDDEN.search(a.get("style", "")))
        if names != " ":
            if inside:
                noise = noise or _hints_inside(tag, a.get("class", ""), a.get("id", ""))
            elif not hint and tag not in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
                hint = _hints(names)
        inside = inside or (tag in ("article", "main") and not noise and not hint)
        if tag in _BLOCK:
            self.labels.append(_label(tag, names))
            self.parents.append(node)
            node = len(self.labels) - 1
        if not own or tag in _BLOCK:
            self.open[tag] += 1
            stack.append((tag, node, noise, inside, hint, len(stack) if tag in _BLOCK else near))


class Tree:
    """A skeleton in page order: labels and children of its nodes, sizes and prints of their subtrees."""

    def __init__(self, labels: list[str], parents: list[int]):
        n = len(labels)
        self.labels, self.parents, self.kids = labels, parents, [[] for _ in range(n)]
        for i in range(1, n):
            self.kids[parents[i]].append(i)
        self.size, self.print = [1] * n, [0] * n
        for i in range(n - 1, -1, -1):
            self.size[i] += sum(self.size[k] for k in self.kids[i])
            self.print[i] = hash((labels[i], *(self.print[k] for k in self.kids[i])))

    @cached_property
    def bags(self) -> np.ndarray:
        """How often labels of each of :data:`BUCKETS` hashes occur in the subtree of each node."""
        out = np.zeros((len(self.labels), BUCKETS), np.int32)
        out[np.arange(len(self.labels)), [hash(x) % BUCKETS for x in self.labels]] = 1
        for i in range(len(self.labels) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out


def skeleton(labels: list[str], parents: list[int]) -> tuple[list[str], list[int], list[int]]:
    """The tree with brothers in a row that are alike (label and all below) made one node, a list slot.

    Returns labels and parents in page order, and for each node of the page its node there.
    """
    tree = Tree(labels, parents)
    shape = [0] * len(labels)  # as the print, but runs of like children count once
    for i in range(len(labels) - 1, -1, -1):
        kids = [shape[k] for k in tree.kids[i]]
        shape[i] = hash((labels[i], *(x for j, x in enumerate(kids) if not j or x != kids[j - 1])))
    kids: list[list[int]] = [[]]
    names, place = [labels[0]], [0] * len(labels)
    for i in range(len(labels)):
        k, before = -1, None
        for c in tree.kids[i]:
            if shape[c] != before:
                k, before = k + 1, shape[c]
            own = kids[place[i]]
            if k == len(own):
                own.append(len(names))
                names.append(labels[c])
                kids.append([])
            place[c] = own[k]
    order, up, new = [], [], {}
    todo = [(0, -1)]
    while todo:  # number them in page order
        x, parent = todo.pop()
        new[x] = len(order)
        order.append(names[x])
        up.append(parent)
        todo += [(c, new[x]) for c in reversed(kids[x])]
    return order, up, [new[x] for x in place]


class _TooMuch(Exception):
    """Exact matching would weigh more than :data:`WORK` pairs."""


class _Match:
    """One matching of two trees. A part is (x, y, chain), where a chain links (chain before, child of x, child of y, part)."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.left = a, b, WORK
        self.known: dict[tuple[int, int], tuple[int, tuple]] = {}

    def alike(self, x: int, y: int) -> bool:
        return self.a.print[x] == self.b.print[y] and self.a.size[x] == self.b.size[y]

    def chain(self, x: int, y: int, weigh) -> tuple[int, tuple | None]:
        """The heaviest pairs of children in order, those of one label whose ranks differ by :data:`BAND` at most."""
        a, b = self.a, self.b
        ranks: dict[str, list[int]] = {}
        for i, u in enumerate(a.kids[x]):
            ranks.setdefault(a.labels[u], []).append(i)
        seen: dict[str, int] = {}
        best: list[int] = [0] * (len(a.kids[x]) + 1)  # a Fenwick tree of the best chain that ends at a child of x or before
        last: list[tuple | None] = [None] * (len(a.kids[x]) + 1)

        def until(k: int) -> tuple[int, tuple | None]:
            top, chain = 0, None
            while k:
                if best[k] > top:
                    top, chain = best[k], last[k]
                k -= k & -k
            return top, chain

        for v in b.kids[y]:
            label = b.labels[v]
            r = seen[label] = seen.get(label, -1) + 1
            near = ranks.get(label, ())[max(0, r - BAND) : r + BAND + 1]
            found = []
            for i, (score, part) in zip(near, weigh([a.kids[x][i] for i in near], v)):
                top, chain = until(i)
                found.append((i, top + score, (chain, a.kids[x][i], v, part)))
            for i, score, chain in found:
                k = i + 1
                while k < len(best):
                    if score > best[k]:
                        best[k], last[k] = score, chain
                    k += k & -k
        return until(len(best) - 1)

    def exact(self, x: int, y: int) -> tuple[int, tuple]:
        """The best match of the subtrees of two nodes of one label; equal pairs of subtrees are matched once."""
        key = self.a.print[x], self.b.print[y]
        if key not in self.known:
            if self.alike(x, y):
                return self.a.size[x], (x, y, None)
            self.left -= 1
            if self.left < 0:
                raise _TooMuch
            top, chain = self.chain(x, y, lambda us, v: [self.exact(u, v) for u in us])
            self.known[key] = top + 1, (x, y, chain)
        return self.known[key]

    def bounded(self) -> tuple[int, tuple]:
        """Matched from the root down, each node once: children are chosen by an upper bound, the labels that their subtrees share."""
        a, b = self.a, self.b
        chains: dict[int, tuple | None] = {}  # by node of a, in order from the root

        def weigh(us: list[int], v: int) -> list[tuple[int, None]]:
            return list(zip(np.minimum(a.bags[us], b.bags[v]).sum(axis=1).tolist(), [None] * len(us))) if us else []

        todo, order = [(0, 0)], []
        while todo:
            x, y = todo.pop()
            order.append((x, y))
            if not self.alike(x, y):
                link = chains[x] = self.chain(x, y, weigh)[1]
                while link:
                    todo.append(link[1:3])
                    link = link[0]
        done: dict[int, tuple[int, tuple]] = {}
        for x, y in reversed(order):
            if self.alike(x, y):
                done[x] = a.size[x], (x, y, None)
                continue
            score, chain, link = 1, None, chains[x]
            while link:
                s, part = done.pop(link[1])
                score, chain, link = score + s, (chain, *link[1:3], part), link[0]
            done[x] = score, (x, y, chain)
        return done[0]

    def pairs(self, part: tuple) -> list[tuple[int, int]]:
        """(node of b, node of a) of a part; one that was matched at other, equal subtrees is moved to these."""
        out, todo = [], [(part, 0, 0)]
        while todo:
            (x, y, link), dx, dy = todo.pop()
            if self.alike(x, y):
                out += [(y + dy + k, x + dx + k) for k in range(self.a.size[x])]
                continue
            out.append((y + dy, x + dx))
            while link:
                link, u, v, own = link
                todo.append((own, u + dx - own[0], v + dy - own[1]))
        return out


def tree_match(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most pairs of nodes with equal labels, order and parents kept; (pairs, [(node of b, node of a)]).

    Children of one label pair up when their ranks among such brothers differ by :data:`BAND` at most; of these
    pairs the heaviest chain in order is taken. Trees whose sizes multiply to :data:`WORK` or less are always matched
    so; where more than :data:`WORK` pairs of differing subtrees would be weighed, children are weighed by the labels
    that their subtrees share instead, and the time is linear in the trees.
    """
    if a.labels[0] != b.labels[0]:
        return 0, []
    m = _Match(a, b)
    try:
        score, part = m.exact(0, 0)
    except _TooMuch:
        score, part = m.bounded()
    return score, m.pairs(part)


def _written(labels: list[str], parents: list[int]) -> str:
    return "\n".join(f"{p}\t{x}" for p, x in zip(parents, labels))


@lru_cache(maxsize=256)
def _tree(written: str) -> Tree:
    rows = [x.split("\t", 1) for x in written.split("\n")]
    return Tree([x[1] for x in rows], [int(x[0]) for x in rows])


@lru_cache(maxsize=2_048)
def _aligned(seeds: tuple[str, ...], page: str) -> tuple[int, dict[int, int]]:
    """Which seed the page matches best, and the seed's node for each of its nodes that has one."""
    own, best = _tree(page), (0, 0, [])
    for k, s in enumerate(seeds):
        score, pairs = tree_match(_tree(s), own)
        best = max(best, (score, -k, pairs), key=lambda x: x[:2])
    return -best[1], dict(best[2])


def _paths(labels: list[str], parents: list[int]) -> list[int]:
    """For each node a hash of the labels from the root to it."""
    out: list[int] = []
    for x, p in zip(labels, parents):
        out.append(xxhash.xxh64_intdigest(x, seed=out[p] if p >= 0 else 0))
    return out


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, layout (the labels of the upper three levels) and skeleton of each page."""
    sys.setrecursionlimit(1_000_000)
    for b in text_chunks(batches, 1):
        layouts, trees = [], []
        for html in b.column(1).to_pylist():
            page = Page(html or "")
            labels, parents, _ = skeleton(page.labels, page.parents)
            depth = [0] * len(labels)
            for i in range(1, len(labels)):
                depth[i] = depth[parents[i]] + 1
            layouts.append(xxhash.xxh64_intdigest("\n".join(sorted({x for x, d in zip(labels, depth) if d <= 3}))) >> 1)
            trees.append(_written(labels, parents))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(layouts, pa.int64()), pa.array(trees, pa.string())], names=["host", "layout", "tree"])


_BLOCKS = "array<struct<slot:bigint,inside:boolean,hint:boolean,text:string>>"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each page with their slots: a node of the seed that the page matches best, or the path of a node that it lacks."""
    sys.setrecursionlimit(1_000_000)
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("inside", pa.bool_()), ("hint", pa.bool_()), ("text", pa.string())]))
    for b in text_chunks(batches, 1):
        out = []
        for html, seeds in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            page = Page(html or "")
            labels, parents, place = skeleton(page.labels, page.parents)
            which, slot = _aligned(tuple(seeds), _written(labels, parents)) if seeds else (0, {})
            paths = None
            rows = []
            for node, inside, hint, text in page.blocks:
                s = slot.get(place[node])
                if s is None:
                    paths = paths or _paths(labels, parents)
                    s = -(paths[place[node]] >> 1) - 1
                else:
                    s = s * SEEDS + which
                rows.append({"slot": s, "inside": inside, "hint": hint, "text": text})
            out.append(rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(out, kind)], names=["row", "host", "blocks"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (blocks in page order, one line each), n_chars (code points) and n_template (blocks that induction took away).

    1. Each page is parsed, in one pass over its markup, into a tree of its block elements; brothers in a row that are
       alike become one list slot. Menus, footers, asides, forms, hidden elements, scripts and styles go by element and role.
    2. Wrapper induction: pages of a host with the same upper levels form a layout; of its :data:`SEEDS` most frequent
       layouts one page each is a seed. Simple tree matching aligns every page with these seeds, and the best gives each
       block its slot (a node that the seed lacks has its path for a slot).
    3. A text that stands in the same slot of :data:`TEMPLATE_SHARE` of the host's pages with that slot is constant, a
       template node, and leaves all of them; what varies is content. Different pages are counted, at least
       :data:`LEAST_PAGES`; inside an article or main element, which the page itself calls content, :data:`LEAST_INSIDE`.
    4. Of what is left, blocks in an article or main element are taken where a page has any. Elsewhere class names and
       ids that hint at adverts, menus or comments decide, unless nothing else is left; inside an article only groups named
       as adverts, notices, readers' comments, newsletters, shared or related links go, paragraphs named as adverts (and
       articles in it, which are comments by the standard).

    Aligning two pages takes a bounded time (see :func:`tree_match`); elements may nest to any depth.
    Only seeds' skeletons (labels of elements) are joined by host, broadcast where Spark finds them small. The counts of
    constant texts cover all pages; a hot host's are summed in parts. Within a block white space becomes one space,
    character references are decoded; ``br`` is white space. Null or empty html gives an empty text, null URLs form one
    host, broken markup is read as far as it goes (end tags may be missing; a tag cut off at the end is dropped).
    Repeated rows keep a row each (and count once for the template).
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", url_host(F.col("url")))
    layouts = p.where(F.col("html").isNotNull()).select("host", "html").mapInArrow(_layouts, "host string, layout long, tree string").groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("tree").alias("tree"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), "layout")
    most = stage(layouts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SEEDS), "layouts")
    seeds = stage(most.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "tree"))), lambda x: x["tree"]).alias("seeds")), "seeds")

    row = f"struct<id:{dict(p.dtypes)['id']},url:string>"
    blocks = stage(p.join(seeds, "host", "left").select(F.struct("id", "url").alias("row"), "html", "seeds", "host").mapInArrow(_slots, f"row {row}, host string, blocks {_BLOCKS}"), "blocks")
    key = lambda b: F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("key"))
    whole = blocks.select("host", F.xxhash64("blocks").alias("page"), F.array_distinct(F.transform("blocks", lambda b: F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("key"), b["inside"].alias("inside")))).alias("kinds")).distinct()
    each = whole.select("host", F.explode("kinds").alias("k")).groupBy("host", "k.slot", "k.key").agg(F.count("*").alias("n"), F.max("k.inside").alias("inside")).where(F.col("n") >= F.when(F.col("inside"), LEAST_INSIDE).otherwise(LEAST_PAGES))
    slots = whole.select("host", F.explode(F.array_distinct(F.transform("kinds", lambda k: k["slot"]))).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    fixed = each.join(slots, ["host", "slot"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    template = stage(fixed.groupBy("host").agg(F.collect_set(F.struct("slot", "key")).alias("template")), "template")

    left = F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains(F.col("template"), key(b))))
    out = blocks.join(template, "host", "left").select("row", F.size("blocks").alias("n"), left.alias("left"))
    main, plain = F.filter("left", lambda b: b["inside"]), F.filter("left", lambda b: ~b["hint"])
    taken = F.when(F.size(main) > 0, main).when(F.size(plain) > 0, plain).otherwise(F.col("left"))
    text = F.array_join(F.transform(taken, lambda b: b["text"]), "\n")
    out = out.select("row.id", "row.url", text.alias("text"), (F.col("n") - F.size("left")).cast("long").alias("n_template"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_template")
