"""Main text of web pages by wrapper induction.

The pages of a host's layout are aligned with one page of that layout (of its
most common structure) by simple tree matching: two nodes match if their elements
are equal, and children are matched in order so that as many nodes as possible
match. A layout is a set of paths of block elements down to ``LAYOUT_DEPTH``; pages of
a layout with fewer than ``MIN_PAGES`` distinct pages are aligned with the host's most
common one. A node whose text is the same on nearly all pages that have it is part
of the layout's template; a node whose text varies is a slot. The article is read
from the slots: those in ``article`` elements, and the ``h1`` titles of the
``main`` around them, where a page has such, else those in ``main``, else all. Menus,
footers, adverts and the like vary from page to page too, so slots in elements
of such kinds (by element, role or class) are no content.

Every page is parsed once and stored as nodes. Only skeletons (elements and text
hashes) are compared, and copies of a page vote once; the votes are sums, so a host with
a third of all pages is no single task.

Nulls and edge cases: a null or empty html gives an empty text. A null url is a
host of its own. A host with fewer than ``MIN_PAGES`` distinct pages has no
template, and its pages are read by element, role and class alone. Repeated
pages come back as often. Extra columns are ignored. Broken markup is closed as
browsers do for paragraphs, list items and cells. Elements may nest to any
depth; below ``MAX_DEPTH`` they are matched as if side by side. Lists of children with
over ``MAX_CELLS`` pairs are matched as well as shorter ones, in halves, so that no table
grows beyond that.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts
from .dom import BLOCK, TEXT, Dom

MIN_PAGES, MIN_SHARE, MAX_CELLS = 5, 0.9, 1_000_000
LAYOUT_DEPTH = 4  # html is at depth 1
MAX_DEPTH = 150  # for matching, deeper nodes are children of their ancestor above this depth


class Tree:
    """Elements of a page for matching: ``tag``, ``children`` and ``print``, the hash of a text (0: an element)."""

    def __init__(self, tag: list[str], parent: list[int], prints: list[int]) -> None:
        self.tag, self.parent, self.print = tag, parent, prints
        self.children: list[list[int]] = [[] for _ in tag]
        for i, p in enumerate(parent[1:], 1):
            self.children[p].append(i)

    @staticmethod
    def of(dom: Dom) -> tuple[Tree, list[int]]:
        """The tree without blank texts, and the node of the page behind each of its nodes."""
        keep = [i for i, t in enumerate(dom.tag) if t != TEXT or dom.text[i].strip()]
        new = {i: k for k, i in enumerate(keep)}
        prints = [_print(dom.text[i]) if dom.tag[i] == TEXT else 0 for i in keep]
        above, depth = [-1] * len(dom.tag), [0] * len(dom.tag)
        for i, p in enumerate(dom.parent[1:], 1):
            depth[i] = depth[p] + 1
            above[i] = p if depth[p] < MAX_DEPTH else above[p]
        return Tree([dom.tag[i] for i in keep], [new.get(above[i], -1) for i in keep], prints), keep

    def dumps(self) -> str:
        return json.dumps([self.tag, self.parent, self.print])

    def shape(self) -> int:
        """A hash of the structure in which a run of like siblings counts once."""
        parts = [b""] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            kids = [parts[c] for c in self.children[i]]
            runs = [k for n, k in enumerate(kids) if not n or k != kids[n - 1]]
            parts[i] = xxhash.xxh64_digest(self.tag[i].encode() + b"(" + b"".join(runs))
        return int.from_bytes(parts[0], "big", signed=True)


@lru_cache(256)
def _loads(skeleton: str) -> Tree:
    return Tree(*json.loads(skeleton))


def _print(text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass")) >> 1


class Matching:
    """Simple tree matching of two trees. Nodes are in page order, so a subtree
    is a range of nodes, and two subtrees of one shape match node by node."""

    def __init__(self, a: Tree, b: Tree) -> None:
        self._a, self._b = a, b
        shapes: dict[tuple, int] = {}
        self._shape_a, self._size_a = self._shapes(a, shapes)
        self._shape_b, _ = self._shapes(b, shapes)
        self._known: dict[tuple[int, int], int] = {}
        self.pairs: list[tuple[int, int]] = []
        todo = [(0, 0)] if a.tag[0] == b.tag[0] else []
        while todo:
            x, y = todo.pop()
            if self._shape_a[x] == self._shape_b[y]:
                size = self._size_a[x]
                self.pairs += zip(range(x, x + size), range(y, y + size))
            else:
                self.pairs.append((x, y))
                todo += self._aligned(a.children[x], b.children[y])

    @staticmethod
    def _shapes(tree: Tree, shapes: dict[tuple, int]) -> tuple[list[int], list[int]]:
        shape, size = [0] * len(tree.tag), [1] * len(tree.tag)
        for i in range(len(tree.tag) - 1, -1, -1):
            kids = tree.children[i]
            if kids:
                key = (tree.tag[i], *[shape[c] for c in kids])
                size[i] += sum([size[c] for c in kids])
            else:
                key = (tree.tag[i],)
            shape[i] = shapes.setdefault(key, len(shapes))
        return shape, size

    def _weight(self, x: int, y: int) -> int:
        """How many nodes of the trees at x and y match."""
        if self._a.tag[x] != self._b.tag[y]:
            return 0
        key = (self._shape_a[x], self._shape_b[y])
        if key[0] == key[1]:
            return self._size_a[x]
        if key not in self._known:
            self._known[key] = 1 + sum(self._weight(p, q) for p, q in self._aligned(self._a.children[x], self._b.children[y]))
        return self._known[key]

    def _aligned(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """The matched pairs of two lists of children, in order."""
        lead = 0
        while lead < min(len(xs), len(ys)) and self._shape_a[xs[lead]] == self._shape_b[ys[lead]]:
            lead += 1
        pairs = list(zip(xs[:lead], ys[:lead]))
        xs, ys = xs[lead:], ys[lead:]
        tail = 0
        while tail < min(len(xs), len(ys)) and self._shape_a[xs[-1 - tail]] == self._shape_b[ys[-1 - tail]]:
            tail += 1
        if tail:
            pairs += zip(xs[-tail:], ys[-tail:])
            xs, ys = xs[:-tail], ys[:-tail]
        if not xs or not ys:
            return pairs
        if len(xs) * len(ys) > MAX_CELLS:
            return pairs + self._halved(xs, ys)
        return pairs + [(xs[i], ys[j]) for i, j in _traced(np.array([[self._weight(x, y) for y in ys] for x in xs], np.int32))]

    def _halved(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """As heavy a matching of two long lists: ``xs`` is halved and ``ys`` cut where both halves weigh most together,
        until a table is small. Like children have like weights, which are looked up by their shapes."""
        kind_x, kind_y = ([shape[i] for i in nodes] for shape, nodes in ((self._shape_a, xs), (self._shape_b, ys)))
        first_x, first_y = ({k: i for k, i in zip(kinds, nodes)} for kinds, nodes in ((kind_x, xs), (kind_y, ys)))
        weights = np.array([[self._weight(x, y) for y in first_y.values()] for x in first_x.values()], np.int32)
        at_x, at_y = ({k: n for n, k in enumerate(first)} for first in (first_x, first_y))
        rows, columns = np.array([at_x[k] for k in kind_x]), np.array([at_y[k] for k in kind_y])
        pairs, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            a, b, c, d = todo.pop()
            if a == b or c == d:
                continue
            if (b - a) * (d - c) <= MAX_CELLS or b - a == 1:
                pairs += [(xs[a + i], ys[c + j]) for i, j in _traced(weights[np.ix_(rows[a:b], columns[c:d])])]
                continue
            half = (a + b) // 2
            before = _last_row(weights, rows[a:half], columns[c:d])
            after = _last_row(weights, rows[half:b][::-1], columns[c:d][::-1])
            cut = c + int(np.argmax(before + after[::-1]))
            todo += [(a, half, c, cut), (half, b, cut, d)]
        return pairs


def _traced(weights: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column), ascending in both, of greatest total weight."""
    n, m = weights.shape
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        best[i, 1:] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], best[i - 1, :-1] + weights[i - 1]))
    pairs, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs


def _last_row(weights: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The last row of the table of :func:`_traced`, in the memory of one row."""
    best = np.zeros(len(columns) + 1, np.int32)
    for r in rows:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weights[r, columns]))
    return best


class Nodes(Dom):
    """A parsed page read back: its nodes, and which of them lie outside the article."""

    def __init__(self, dumped: str) -> None:
        self.tag, self.parent, self.text, *self._outside = json.loads(dumped)

    @staticmethod
    def dumps(dom: Dom, named: list[bool]) -> str:
        return json.dumps([dom.tag, dom.parent, dom.text,
                           *("".join("01"[x] for x in flags) for flags in (named, dom.outside(False)))])

    def outside(self, named: bool = True) -> list[bool]:
        return [x == "1" for x in self._outside[0 if named else 1]]


def layout(dom: Dom) -> int:
    """A hash of the page's set of paths of block elements down to ``LAYOUT_DEPTH``."""
    paths: list[str | None] = [""] + [None] * (len(dom.tag) - 1)
    depth = [0] * len(dom.tag)
    for i in range(1, len(dom.tag)):
        above = dom.parent[i]
        if paths[above] is not None and depth[above] < LAYOUT_DEPTH and dom.tag[i] in BLOCK:
            paths[i], depth[i] = f"{paths[above]}/{dom.tag[i]}", depth[above] + 1
    return xxhash.xxh64_intdigest("\n".join(sorted({p for p in paths if p}))) - (1 << 63)


def article(dom: Dom | Nodes, template: set[int], named: bool = True) -> list[str]:
    """The blocks of a page's article. ``template``: its nodes that belong to the layout's template.
    Where nothing is left, class and id names are disregarded (``named``)."""
    skip = dom.outside(named)
    for i in template:
        skip[i] = True
    regions = [i for i, t in enumerate(dom.tag) if t == "article" and not skip[i]]
    if regions:  # and the title that stands above them
        in_main = [False] * len(dom.tag)
        for i in range(1, len(dom.tag)):
            in_main[i] = in_main[dom.parent[i]] or dom.tag[i] == "main"
        regions += [i for i, t in enumerate(dom.tag) if t == "h1" and in_main[i] and not skip[i]]
    regions = regions or [i for i, t in enumerate(dom.tag) if t == "main" and not skip[i]]
    found = dom.blocks(regions, skip) or dom.blocks([0], skip)
    return found if found or not named else article(dom, template, False)


PARSED = "host string, layout long, content long, shape long, skeleton string, nodes string"


def _parsed(batches):
    for batch in slices(batches, "html"):
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), texts(batch, "html")):
            dom = Dom(html)
            tree, nodes = Tree.of(dom)
            outside = dom.outside()
            seen = xxhash.xxh64()  # copies of an article under other menus are one page
            for k, i in enumerate(nodes):
                if tree.print[k] and not outside[i]:
                    seen.update(tree.print[k].to_bytes(8, "big"))
            rows.append((host, layout(dom), seen.intdigest() - (1 << 63), tree.shape(), tree.dumps(), Nodes.dumps(dom, outside)))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
            ["page_id", "url", "host", "layout", "content", "shape", "skeleton", "nodes"])


def _votes(batches):
    for batch in batches:
        votes: dict[tuple[str, int, int], list[int]] = {}
        for host, chosen, skeleton, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "model", "skeleton", "reference"))):
            page, model = Tree(*json.loads(skeleton)), _loads(reference)
            for x, y in Matching(page, model).pairs:
                if model.print[y]:
                    vote = votes.setdefault((host, chosen, y), [0, 0])
                    vote[0] += 1
                    vote[1] += page.print[x] == model.print[y]
        rows = [(*k, *v) for k, v in votes.items()]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                                         ["host", "model", "node", "pages", "same"])


def _host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url and the columns of ``PARSED`` of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html", _host().alias("host")).mapInArrow(
        _parsed, f"page_id {kind}, url string, {PARSED}")


def templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, layout, reference, constant) of :func:`parsed` pages: the skeleton of the reference page their layout is
    aligned with, and its nodes of constant text."""
    distinct = stored(found.groupBy("host", "content").agg(F.min("layout").alias("layout"), F.min("shape").alias("shape"),
                                                           F.min("skeleton").alias("skeleton")), "skeletons")
    layouts = (distinct.groupBy("host", "layout", "shape").agg(F.count("*").alias("n"), F.min("content").alias("content"))
               .groupBy("host", "layout").agg(F.sum("n").alias("n"), F.max(F.struct("n", "content")).alias("top")))
    usual = layouts.groupBy("host").agg(F.max(F.struct("n", "layout", F.col("top.content").alias("content"))).alias("usual"))
    own = F.col("n") >= min_pages
    chosen = stored(layouts.join(usual, "host").select(
        "host", "layout", F.when(own, F.col("layout")).otherwise(F.col("usual.layout")).alias("model"),
        F.when(own, F.col("top.content")).otherwise(F.col("usual.content")).alias("content")), "layouts")
    reference = chosen.select("host", "model", "content").distinct().join(distinct, ["host", "content"]).select(
        "host", "model", F.col("skeleton").alias("reference"))
    votes = (distinct.select("host", "layout", "skeleton").join(chosen.select("host", "layout", "model"), ["host", "layout"])
             .join(reference, ["host", "model"])
             .mapInArrow(_votes, "host string, model long, node int, pages long, same long")
             .groupBy("host", "model", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same")))
    constant = (votes.where((F.col("pages") >= min_pages) & (F.col("same") >= min_share * F.col("pages")))
                .groupBy("host", "model").agg(F.sort_array(F.collect_list("node")).alias("constant")))
    return (chosen.select("host", "layout", "model").join(reference, ["host", "model"]).join(constant, ["host", "model"])
            .select("host", "layout", "reference", "constant"))


def _articles(batches):
    for batch in slices(batches, "nodes"):
        out = []
        for nodes, skeleton, reference, constant in zip(
                *(batch.column(c).to_pylist() for c in ("nodes", "skeleton", "reference", "constant"))):
            dom = Nodes(nodes)
            template: set[int] = set()
            if reference:
                tree, model, fixed = Tree(*json.loads(skeleton)), _loads(reference), set(constant)
                keep = [i for i, t in enumerate(dom.tag) if t != TEXT or dom.text[i].strip()]
                template = {keep[x] for x, y in Matching(tree, model).pairs if y in fixed and tree.print[x] == model.print[y]}
            out.append("\n".join(article(dom, template)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())],
                                         ["page_id", "url", "text"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url and the main ``text`` of every page."""
    found = stored(parsed(pages), "parsed")
    model = stored(templates(found, min_pages, min_share), "templates")
    kind = pages.schema["page_id"].dataType.simpleString()
    return (found.join(model, ["host", "layout"], "left").select("page_id", "url", "nodes", "skeleton", "reference", "constant")
            .mapInArrow(_articles, f"page_id {kind}, url string, text string"))
