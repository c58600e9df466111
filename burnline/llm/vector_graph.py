"""Near-duplicates of embeddings by a flat, robust-pruned graph over overlapping cluster shards.

Vectors are compared only within a space: equal label and length. Equal ones are
one node with a number of copies.

Shards. A space of over ``shard_size`` nodes is dealt to the nearest of a sample
of its own nodes (pivots), again and again until all shards fit. Each node has
one home, and at each level its home gives a copy to the second nearest pivot,
so neighbouring shards overlap. Large shards are dealt in chunks, so no task
holds more than a chunk and the pivots of its shard.

Graph. In each shard the adjacency list of a node is its nearest members and
some random ones, both pruned robustly (a neighbour goes if a kept one is closer
to it by the factor ``alpha``), with links back, and every node is reachable
from the medoid. The lists of a node are united over its shards.

Search. Every node looks for its neighbours in each of its shards: best first
from the medoid, ``beam`` expansions; then the range is expanded, from every
node met with cosine ``threshold - margin`` or more, until nothing new is met.
Where it finds a node whose home is another shard, it goes on there, along that
node's united list, and so on. All pairs found are verified in double precision;
only counts and forests leave a task. A pair that shares shards counts in the
least of them, another one at the home of the neighbour, so nothing counts twice.

Audit. The links of a bounded sample of nodes (``audit_nodes``, by hash) are
counted by brute force over all nodes of their spaces; if the search found under ``recall`` of
them, it is done again with a beam four times as wide.

Nulls and edge cases: rows of a null label, or whose vector is null, empty, zero
or holds null or non-finite components, link with nothing, not even equal rows.
Rows with a null ``vec_id`` take part and name a component only if no other id
is reachable. Repeated rows come back as often as they came, linked with each
other. Ties need no rule, as every neighbour in range counts. Extra columns are
ignored. An empty table gives no rows.

Counting the links of a group of g near copies takes time in proportion to g * g,
in bounded tasks: they are found, not listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected

THRESHOLD, MARGIN, ALPHA = 0.98, 0.03, 1.2
SHARD, CHUNK, FAN = 1024, 8192, 256
NEAR, FAR, POOL, BEAM = 20, 8, 64, 48
_NODE = "node long, copies long, vec array<double>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length."""
    flat = pa.chunked_array([c.flatten() for c in column.chunks]).to_numpy()
    return flat.reshape(len(column), -1)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after the other, and the row of each."""
    rows = column.to_pylist()
    sizes = np.array([len(x) for x in rows], np.int64)
    return np.fromiter((v for x in rows for v in x), np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes)


# Nodes -----------------------------------------------------------------------
def unit(vectors: pa.Array) -> pa.Array:
    """The vectors scaled to length one, in double precision; null if they have no direction."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False) + 0.0
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    largest = np.zeros(n)
    np.maximum.at(largest, owner, np.abs(flat))  # scaled by it first, so that no square leaves the range
    sound = (np.bincount(owner, ~np.isfinite(flat), n) == 0) & (largest > 0)
    flat = np.where(sound[owner], flat, 1.0) / np.where(sound, largest, 1.0)[owner]
    flat /= np.sqrt(np.bincount(owner, flat * flat, n))[owner]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~sound))


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, space, vec, h1, h2) of all rows; a vector is known by two hashes. Without a space: compared with nothing."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), unit(b.column("embedding"))], ["vec_id", "label", "vec"])

    source = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    rows = source.mapInArrow(run, f"vec_id {source.schema['vec_id'].dataType.simpleString()}, label string, vec array<double>")
    space = F.when(F.col("vec").isNotNull() & F.col("label").isNotNull(), F.concat_ws(":", F.size("vec"), "label"))
    return rows.select("vec_id", space.alias("space"), "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.col("vec")).alias("h2"))


# Shards ----------------------------------------------------------------------
def _deal(members: pa.Table, pivots: pa.Table) -> pa.Table:
    """One chunk of a shard, to its nearest pivots."""
    home = members.column("home").to_numpy(zero_copy_only=False).astype(bool)
    shard = members.column("shard")[0].as_py()
    if pivots.num_rows == 0:
        return members.select(["node", "copies", "vec", "shard", "home"])
    nodes, x, p = members.column("node").to_numpy(), _matrix(members.column("vec")), _matrix(pivots.column("pivot"))
    nearness = x @ p.T
    # Equal nearness is decided by chance, lest vectors of almost one direction stay together for ever.
    chance = (nodes.astype(np.uint64)[:, None] + np.uint64(1)) * (np.arange(len(p), dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    chance ^= chance >> np.uint64(29)
    nearness += ((chance * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.float64) * 1e-16
    first = nearness.argmax(1)
    rows, to = [np.arange(len(x))], [first]
    if len(p) > 1:
        nearness[rows[0], first] = -np.inf
        rows.append(np.flatnonzero(home))
        to.append(nearness.argmax(1)[home])
    take = np.concatenate(rows)
    is_home = np.concatenate([home, np.zeros(len(take) - len(x), bool)])
    names = pa.array([f"{k}/{shard}" for k in np.concatenate(to).tolist()], pa.string())
    out = members.select(["node", "copies", "vec"]).take(pa.array(take))
    return out.append_column("shard", names).append_column("home", pa.array(is_home))


def shards(nodes: DataFrame, shard_size: int = SHARD, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(node, copies, vec, shard, home) of all nodes in all their shards, of which one is the home."""
    done, level = [], 0
    members = nodes.select("node", "copies", "vec", F.col("space").alias("shard"), F.lit(True).alias("home"))
    while True:
        counts = members.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
        sized = stored(members.join(counts, "shard"), "graph-shards")
        done.append(sized.where(F.col("size") <= shard_size).drop("size"))
        large = sized.where(F.col("size") > shard_size)
        if large.isEmpty():
            break
        level += 1
        wanted = F.least(F.ceil(F.col("size") * 3 / shard_size), F.lit(fan))
        pivots = large.where(F.pmod(F.xxhash64("node", F.lit(level)), "size") < wanted)
        chunks = F.ceil(F.col("size") / chunk)
        dealt = large.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(-level)), chunks))
        sent = pivots.select(F.col("shard").alias("shard"), F.col("vec").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
        members = (dealt.groupBy("shard", "chunk").cogroup(sent.groupBy("shard", "chunk"))
                   .applyInArrow(_deal, f"{_NODE}, shard string, home boolean"))
    every = reduce(DataFrame.unionByName, [d.select("node", "copies", "vec", "shard", "home") for d in done])
    ids = stored(every.select("shard").distinct().withColumn("sid", F.monotonically_increasing_id()), "graph-ids")
    return stored(every.join(ids, "shard").drop("shard"), "graph-members")


# Graph -----------------------------------------------------------------------
def _prune(x: np.ndarray, owner: np.ndarray, pool: np.ndarray, nearness: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: of each row of ``pool`` (candidates of ``owner``, nearest first, -1 for none) up to ``degree`` stay, else -1."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * nearness))
    alive, out = pool >= 0, np.full((len(pool), degree), -1, np.int64)
    rows = np.arange(len(pool))
    for k in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        chosen = np.where(some, pool[rows, pick], -1)
        out[:, k] = chosen
        between = np.einsum("ij,ikj->ik", x[chosen], x[pool])
        alive &= ~(some[:, None] & (ALPHA * np.sqrt(np.maximum(0, 2 - 2 * between)) <= apart))
        alive[rows, pick] = False
    return out


def _nearest_first(pool: np.ndarray, nearness: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-nearness, 1, kind="stable")
    return np.take_along_axis(pool, order, 1), np.take_along_axis(nearness, order, 1)


def _padded(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Rows of values by owner (sorted by it), padded with -1."""
    size = np.bincount(owner, minlength=n)
    out = np.full((n, max(int(size.max(initial=0)), 1)), -1, np.int64)
    out[owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner]] = value
    return out


def _medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def adjacency(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The graph of a shard: rows of neighbours, padded with -1."""
    n, rng, blocks = len(x), np.random.default_rng(seed), []
    for at in range(0, n, 256):
        own = np.arange(at, min(at + 256, n))
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -np.inf
        pool = np.argpartition(-near, min(POOL, n - 1) - 1, 1)[:, :min(POOL, n - 1)] if n > 1 else np.full((1, 1), -1)
        pool, nearness = _nearest_first(pool, np.take_along_axis(near, pool, 1) if n > 1 else np.full((1, 1), -np.inf))
        some = rng.integers(0, n, (len(own), 4 * FAR))
        some[some == own[:, None]] = -1
        far, away = _nearest_first(some, np.where(some >= 0, np.take_along_axis(near, some, 1), -np.inf))
        blocks.append(np.hstack([_prune(x, own, pool, nearness, NEAR), _prune(x, own, far, away, FAR)]))
    out = np.vstack(blocks)
    # Links back; a list that grows too long is pruned again, but a node's nearest one always links back to it.
    a, k = np.nonzero(out >= 0)
    edges = np.unique(np.r_[a * n + out[a, k], out[a, k] * n + a])
    rows = _padded(edges // n, edges % n, n)
    long = np.flatnonzero((rows >= 0).sum(1) > NEAR + FAR)
    keep = [np.delete(edges, np.flatnonzero(np.isin(edges // n, long)))]
    for at in range(0, len(long), 64):
        own = long[at:at + 64]
        near = np.where(rows[own] >= 0, np.einsum("ij,ikj->ik", x[own], x[rows[own]]), -np.inf)
        left = _prune(x, own, *_nearest_first(rows[own], near), NEAR + FAR)
        b, k = np.nonzero(left >= 0)
        keep.append(own[b] * n + left[b, k])
    nearest = np.flatnonzero(out[:, 0] >= 0)
    edges = np.unique(np.concatenate([*keep, out[nearest, 0] * n + nearest, nearest * n + out[nearest, 0]]))
    return _reachable(x, edges // n, edges % n)


def _reachable(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The graph of the edges (a, b), with an edge more for each part that the medoid did not reach."""
    n, seen = len(x), np.zeros(len(x), bool)
    rows, front, extra = _padded(a, b, n), np.array([_medoid(x)]), []
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(rows[front])
            front = front[(front >= 0) & ~seen[front]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        near = x[lost[0]] @ x.T
        extra.append((int(np.where(seen, near, -np.inf).argmax()), int(lost[0])))
        front = lost[:1]
    if extra:
        edges = np.unique(np.r_[a * n + b, [p * n + q for p, q in extra]].astype(np.int64))
        rows = _padded(edges // n, edges % n, n)
    return rows


def _build(table: pa.Table) -> pa.Table:
    nodes, x = table.column("node").to_numpy(), _matrix(table.column("vec"))
    rows = adjacency(x, int(table.column("sid")[0].as_py()))
    return pa.table({"node": nodes, "near": pa.array([nodes[r[r >= 0]].tolist() for r in rows], pa.list_(pa.int64()))})


def united(members: DataFrame) -> DataFrame:
    """(node, near, of, base): the united list, the shards and the home of each node."""
    lists = members.groupBy("sid").applyInArrow(_build, "node long, near array<long>")
    near = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    places = members.groupBy("node").agg(F.collect_list("sid").alias("of"), F.max(F.when(F.col("home"), F.col("sid"))).alias("base"))
    return near.join(places, "node")


# Search ----------------------------------------------------------------------
class Region:
    """The part of the graph in one shard: the lists of its nodes, as far as they stay in it."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table.column("node").to_numpy())
        table = table.take(pa.array(order))
        self.node, self.copies, self.base = (table.column(c).to_numpy() for c in ("node", "copies", "base"))
        self.x = _matrix(table.column("vec"))
        to, owner = _lists(table.column("near"))
        at = np.minimum(np.searchsorted(self.node, to), len(self.node) - 1)
        here = self.node[at] == to
        self.near = _padded(owner[here], at[here], len(self.node))
        sid, owner = _lists(table.column("of"))
        self.of = _padded(owner, sid, len(self.node))
        self.rough = self.x.astype(np.float32)

    def search(self, queries: np.ndarray, starts: np.ndarray, beam: int, floor: float) -> np.ndarray:
        """The cosines of the members that the queries met, -2 for all others: best first
        from the start, ``beam`` expansions, then all that are met at ``floor`` or above."""
        score = np.full((len(queries), len(self.node)), -2, np.float32)
        open_ = np.zeros(score.shape, bool)
        rows = np.arange(len(queries))

        def meet(q: np.ndarray, u: np.ndarray) -> None:
            score[q, u] = np.einsum("ij,ij->i", queries[q], self.rough[u])
            open_[q, u] = True

        def expand(q: np.ndarray, u: np.ndarray) -> None:
            open_[q, u] = False
            for at in range(0, len(q), 65536):
                v = self.near[u[at:at + 65536]]
                cell = (q[at:at + 65536, None] * len(self.node) + v)[v >= 0]
                cell = cell[score.ravel()[cell] == -2]
                if len(cell):
                    score.ravel()[cell] = -1.5  # met once, however often it is named
                    first = np.flatnonzero(score.ravel() == -1.5) if len(cell) > score.size // 8 else np.unique(cell)
                    meet(*np.divmod(first, len(self.node)))

        meet(rows, starts)
        for _ in range(beam):
            best = np.where(open_, score, -3).argmax(1)
            live = open_[rows, best]
            if not live.any():
                break
            expand(rows[live], best[live])
        while len((q_u := np.nonzero(open_ & (score >= floor)))[0]):
            expand(*q_u)
        return score

    def links(self, x: np.ndarray, met: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (query, member) met that are links in double precision."""
        q, u = np.nonzero(met >= threshold - 1e-4)
        true = [np.einsum("ij,ij->i", x[q[i:i + 65536]], self.x[u[i:i + 65536]]) >= threshold for i in range(0, len(q), 65536)]
        keep = np.concatenate(true) if true else np.zeros(0, bool)
        return q[keep], u[keep]


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least shard that both rows of shards hold, -1 if none."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out = np.minimum(out, np.where((a[:, i] == b[:, j]) & (a[:, i] >= 0), a[:, i], none))
    return np.where(out == none, -1, out)


_FOUND = "node long, links long, root long, sid long, entry long"


def _found(node: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray, to: tuple[np.ndarray, ...]) -> pa.Table:
    """What leaves a task: counts of links, a forest of them (node, root), and where nodes go on (node, sid, entry)."""
    some = np.flatnonzero(links)
    low, high = _forest(np.minimum(a, b), np.maximum(a, b))
    nodes = [node[some], high, to[0]]
    empty = [np.zeros(0, np.int64)] * 3

    def column(*parts) -> pa.Array:
        values = np.concatenate([p if len(p) else np.zeros(len(n), np.int64) for p, n in zip(parts, nodes)])
        given = np.concatenate([np.full(len(n), len(p) > 0) for p, n in zip(parts, nodes)])
        return pa.array(values.astype(np.int64), mask=~given)

    none = empty[0]
    return pa.table({"node": pa.array(np.concatenate(nodes).astype(np.int64)), "links": column(links[some], none, none),
                     "root": column(none, low, none), "sid": column(none, none, to[1]), "entry": column(none, none, to[2])})


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for the nodes of the links (a, b) that are not their own root."""
    names, ends = np.unique(np.r_[a, b], return_inverse=True)
    p, q = ends[:len(a)], ends[len(a):]
    root = np.arange(len(names))
    while True:
        low, new = np.minimum(root[p], root[q]), root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[root[other]], names[other]


def _onward(q: np.ndarray, base: np.ndarray, of: np.ndarray, nodes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, sid, entry): the homes of neighbours found, if the finder ``nodes[q]`` is in none of them."""
    out = ~(of[q] == base[:, None]).any(1)
    pairs, first = np.unique(np.stack([nodes[q[out]], base[out]], 1), axis=0, return_index=True)
    return pairs[:, 0], pairs[:, 1], entry[out][first]


def _search_own(threshold: float, beam: int, margin: float):
    """Search of all members of a shard in it."""

    def run(table: pa.Table) -> pa.Table:
        sid, region = table.column("sid")[0].as_py(), Region(table)
        n = len(region.node)
        met = np.zeros((n, n), bool)
        start = np.full(256, _medoid(region.x))
        for at in range(0, n, 256):
            mine = region.rough[at:at + 256]
            score = region.search(mine, start[:len(mine)], beam, threshold - margin)
            q, u = region.links(region.x[at:at + 256], score, threshold)
            met[at + q, u] = True
        met |= met.T
        np.fill_diagonal(met, False)
        a, b = np.nonzero(met)
        own = _shared(region.of[a], region.of[b]) == sid
        links = np.bincount(a[own], region.copies[b[own]], n).astype(np.int64)
        return _found(region.node, links, region.node[a], region.node[b], _onward(a, region.base[b], region.of, region.node, region.node[b]))

    return run


def _search_visit(threshold: float, beam: int, margin: float):
    """Search of nodes of other shards, from members in range on."""

    def run(table: pa.Table, visits: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not table.num_rows or not visits.num_rows:
            return _found(none, none, none, none, (none, none, none))
        sid, region = table.column("sid")[0].as_py(), Region(table)
        nodes, x = visits.column("node").to_numpy(), _matrix(visits.column("vec"))
        shard, owner = _lists(visits.column("of"))
        of = _padded(owner, shard, len(nodes))
        links, pairs = np.zeros(len(nodes), np.int64), [(none, none, none)]
        onward = [(none, none, none)]
        starts = np.minimum(np.searchsorted(region.node, visits.column("entry").to_numpy()), len(region.node) - 1)
        for at in range(0, len(nodes), 256):
            mine = x[at:at + 256]
            score = region.search(mine.astype(np.float32), starts[at:at + 256], 1, threshold - margin)
            q, u = region.links(mine, score, threshold)
            q = q + at
            counts = (region.base[u] == sid) & (_shared(of[q], region.of[u]) < 0)
            links += np.bincount(q[counts], region.copies[u[counts]], len(nodes)).astype(np.int64)
            pairs.append((nodes[q], region.node[u], none))
            onward.append(_onward(q, region.base[u], np.hstack([of, np.full((len(of), 1), sid)]), nodes, region.node[u]))
        a, b, _ = (np.concatenate(z) for z in zip(*pairs))
        return _found(nodes, links, a, b, tuple(np.concatenate(z) for z in zip(*onward)))

    return run


def search(members: DataFrame, lists: DataFrame, threshold: float = THRESHOLD, beam: int = BEAM, margin: float = MARGIN) -> DataFrame:
    """What all nodes found: rows with ``links`` are counts to add up, those with ``root`` links of a forest."""
    graph = stored(members.select("node", "copies", "vec", "sid").join(lists, "node"), "graph")
    first = graph.groupBy("sid").applyInArrow(_search_own(threshold, beam, margin), _FOUND)
    found = [stored(first, "graph-found")]
    seen = None
    homes = graph.where("sid = base").select("node", "vec", "of")
    while True:
        new = found[-1].where("sid IS NOT NULL").groupBy("node", "sid").agg(F.min("entry").alias("entry"))
        if seen is not None:
            new = new.join(seen, ["node", "sid"], "left_anti")
        new = stored(new, "graph-visits")
        if new.isEmpty():
            return reduce(DataFrame.union, found).select("node", "links", "root")
        seen = new.select("node", "sid") if seen is None else stored(seen.union(new.select("node", "sid")), "graph-seen")
        # Visitors of a shard come in chunks, each with the shard's part of the graph.
        sizes = new.groupBy("sid").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("chunks"))
        visits = new.join(homes, "node").join(sizes, "sid").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
        visits = visits.select(*(F.col(c).alias(c) for c in ("node", "vec", "of", "sid", "entry", "chunk")))
        hosts = graph.join(sizes, "sid").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        went = (hosts.groupBy("sid", "chunk").cogroup(visits.groupBy("sid", "chunk"))
                .applyInArrow(_search_visit(threshold, beam, margin), _FOUND))
        found.append(stored(went, "graph-found"))


# Audit and result --------------------------------------------------------------
def audit(nodes: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, sample: int = 1000) -> tuple[int, int]:
    """The links of about ``sample`` nodes: those found, and all by brute force over all nodes."""
    total = nodes.count()
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(0)), F.lit(max(total, 1))) < sample)
    asked = [(r["node"], r["space"], np.array(r["vec"])) for r in picked.select("node", "space", "vec").collect()]  # bounded by ``sample``
    spaces = {s: ([n for n, t, _ in asked if t == s], np.array([v for _, t, v in asked if t == s])) for s in {t for _, t, _ in asked}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = np.array(batch.column("space").to_pylist(), object)
            for s in dict.fromkeys(space):
                if s not in spaces:
                    continue
                here = pa.table([batch.column(c).filter(pa.array(space == s)) for c in ("node", "copies", "vec")], ["node", "copies", "vec"])
                names, vectors = spaces[s]
                near = (vectors @ _matrix(here.column("vec")).T >= threshold) & (np.array(names)[:, None] != here.column("node").to_numpy())
                n = near @ here.column("copies").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n.astype(np.int64))], ["node", "true"])

    exact = nodes.select("space", "node", "copies", "vec").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    both = exact.join(counts, "node", "left").agg(F.sum(F.least("true", F.coalesce("links", F.lit(0)))), F.sum("true")).first()
    return int(both[0] or 0), int(both[1] or 0)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_size: int = SHARD, beam: int = BEAM,
                    recall: float = 0.95, audit_nodes: int = 1000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = _rows(vectors)
    grouped = rows.where("space IS NOT NULL").groupBy("space", "vec").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "graph-nodes")
    members = shards(nodes, shard_size)
    lists = stored(united(members), "graph-lists")
    while True:
        found = search(members, lists, threshold, beam)
        counts = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
        got, true = audit(nodes, counts, threshold, audit_nodes)
        if got >= recall * true or beam >= 4 * shard_size:
            break
        beam *= 4
    roots = connected(found.where("root IS NOT NULL").select(F.col("root").alias("a"), F.col("node").alias("b")))
    named = (nodes.select("node", "space", "h1", "h2", "copies", "first_id").join(counts, "node", "left").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    linked = named.join(least, "root").select("space", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    out = rows.select("vec_id", "space", "h1", "h2").join(linked, ["space", "h1", "h2"], "left")
    own = F.when(F.col("space").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
