"""A Merkle manifest of a dataset: a postorder append log of digests, proofs and their verification.

A row of the table is a leaf. The leaves of a source, in the order of
``doc_id``, are hashed in runs of three into the source's tree; the roots of
the sources, in their order, form one more tree of the same kind.

Builders are aligned: each takes ``3 ** STOREY`` successive nodes, a whole
subtree, and appends its nodes in the order in which they are complete, which
is postorder, so the builder's part of the log is one stretch of the whole log.
The roots of the builders are the nodes of the next storey, until a tree is one
builder's. Where a node stands in the log follows from the sizes of the
subtrees before it (:func:`position`), so no index is kept: proofs address the
siblings of a leaf by position.

Places within a source come from one sort by range and the counts of its
partitions, so a source with a third of all rows is spread like any other; a
task of the builders holds 2 187 nodes.

Nulls and edge cases: a null field is hashed as ``-``, an empty one as ``0:``.
A null ``source`` is a source of its own, the first one; null ``doc_id`` come
first in their source and their rows are never tampered with. Rows of one
``doc_id`` are ordered by digest; repeated rows are leaves each, alike in all
but their proofs. An empty table has no root and gives no rows. Very long texts
are hashed in the JVM, row by row. Extra columns are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ARITY, STOREY = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENT = "tree string, block long, n long, nodes binary"
_PATH = "array<struct<left: string, right: string>>"
_IN_PARTITION = (1 << 33) - 1  # the place within a partition, of a monotonically increasing id


def digest(*parts: bytes) -> bytes:
    """H: the lowercase hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(n: int) -> int:
    """The level of the root over ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def position(level: int, index: np.ndarray | int, n: int) -> np.ndarray | int:
    """The place in postorder of node ``index`` of a ``level``, in a tree over ``n``
    leaves: the nodes complete before its first leaf, and its own subtree's."""
    first = index * ARITY ** level
    leaves = np.minimum(ARITY ** level, n - first)
    before, width = 0 * first, 1
    while width <= n:
        before, width = before + first // width, width * ARITY
    return before + sum(-(-leaves // ARITY ** t) for t in range(level + 1)) - 1


def postorder(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes of the tree of ``levels`` levels over the leaves, each appended once it is complete."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(levels + 1)]
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        waiting[0].append(leaf)
        for level in range(levels):
            if len(waiting[level]) < ARITY and i + 1 < len(leaves):
                break
            log.append(digest(*waiting[level]))
            waiting[level].clear()
            waiting[level + 1].append(log[-1])
    return log


def _levels(nodes: list[bytes], count: int, levels: int) -> list[list[bytes]]:
    """The nodes of a builder by level, read off its part of the log by their positions."""
    return [[nodes[p] for p in position(level, np.arange(-(-count // ARITY ** level)), count).tolist()]
            for level in range(levels + 1)]


def _siblings(row: list[bytes], i: int) -> tuple[bytes, bytes]:
    start = i - i % ARITY
    return b"".join(row[start:i]), b"".join(row[i + 1:start + ARITY])


def _split(nodes: bytes) -> list[bytes]:
    return [nodes[at:at + 64] for at in range(0, len(nodes), 64)]


def _children(block: int, n: int, storey: int) -> tuple[int, int]:
    """How many nodes a builder has taken, and how many levels it has built."""
    size = ARITY ** storey
    return min(size, n - block * size), storey if n > size else height(n)


# The log ---------------------------------------------------------------------
def _field(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered) of each row. ``tampered``: the leaf after the
    line ends of the text are lost, where that was done and changed it."""
    def leaf(fields: dict[str, Column]) -> Column:
        return F.sha2(F.concat(*(fields[c] for c in FIELDS)), 256)

    fields = {c: _field(c) for c in FIELDS}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    lost = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    after = {**fields, "text": F.concat(F.octet_length(lost).cast("string"), F.lit(":"), lost)}
    return docs.select("doc_id", "source", leaf(fields).alias("leaf"), F.when(hit, leaf(after)).alias("tampered"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The stored ``rows`` with ``index``, their place in their group in the order of ``order``,
    and ``n``, the rows of the group. Rows that tie in all of it are spread by their place in the input."""
    spread = (rows.withColumn("salt", F.monotonically_increasing_id())
              .repartitionByRange(F.col(group), *map(F.col, order), F.col("salt")).sortWithinPartitions(group, *order, "salt"))
    place = F.monotonically_increasing_id()
    placed = stored(spread.drop("salt").withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND(F.lit(_IN_PARTITION))}),
                    "merkle-order")
    counts = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    every = Window.partitionBy(group)  # of one row per partition
    starts = counts.withColumns({"before": F.sum("rows").over(every.orderBy("part")) - F.col("rows"), "n": F.sum("rows").over(every)})
    return (placed.join(starts.drop("rows"), [group, "part"]).withColumn("index", F.expr("before + place - first"))
            .drop("part", "place", "before", "first"))


def _builder(storey: int):
    """A builder: its nodes in the order in which they are complete."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        tree, block, n = (table.column(c)[0].as_py() for c in ("tree", "block", "n"))
        nodes = postorder([x.encode() for x in table.column("digest").to_pylist()], _children(block, n, storey)[1])
        return pa.Table.from_pylist([{"tree": tree, "block": block, "n": n, "nodes": b"".join(nodes)}], schema)

    return run


def build(nodes: DataFrame, storey: int = STOREY) -> list[DataFrame]:
    """The log over ``nodes`` (tree, index, n, digest): one table of the builders' parts for each storey."""
    log: list[DataFrame] = []
    size = ARITY ** storey
    while True:
        here = nodes.withColumn("block", F.expr(f"index div {size}"))
        log.append(stored(here.groupBy("tree", "block").applyInArrow(_builder(storey), _SEGMENT), "merkle-log"))
        nodes = log[-1].where(F.col("n") > size).select(
            "tree", F.col("block").alias("index"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), _root().alias("digest"))
        if nodes.isEmpty():
            return log


def _root() -> Column:
    """The last node of a part is its root."""
    return F.expr("substring(nodes, -64, 64)").cast("string")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def roots(log: list[DataFrame], storey: int = STOREY) -> DataFrame:
    """(tree, digest) of the trees: the roots of those that one builder finished."""
    return reduce(DataFrame.union, [t.where(F.col("n") <= ARITY ** storey) for t in log]).select("tree", _root().alias("digest"))


# Proofs ----------------------------------------------------------------------
def paths(parts: DataFrame, storey: int = STOREY) -> DataFrame:
    """(tree, index, path) of all nodes that builders took: the siblings on the way to the top.
    ``parts``: parts of a log, with the path from the root of each."""
    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    schema = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("path", pa.list_(step))])

    def run(batches):
        for batch in batches:
            for tree, block, n, nodes, path in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "nodes", "path"))):
                count, levels = _children(block, n, storey)
                rows = _levels(_split(nodes), count, levels)
                out = []
                for i in range(count):
                    steps = [_siblings(rows[t], i // ARITY ** t) for t in range(levels)]
                    out.append({"tree": tree, "index": block * ARITY ** storey + i,
                                "path": [{"left": a.decode(), "right": b.decode()} for a, b in steps] + path})
                yield pa.RecordBatch.from_pylist(out, schema)

    return parts.mapInArrow(run, f"tree string, index long, path {_PATH}")


def with_paths(log: list[DataFrame], above: DataFrame, storey: int = STOREY) -> DataFrame:
    """The lowest storey of a log, each part with the path from its root to the top.
    ``above``: (tree, path) from the root of each tree."""
    table, size = None, ARITY ** storey
    for parts in reversed(log):
        found = parts.where(F.col("n") <= size).join(above, "tree")
        if table is not None:
            higher = paths(table, storey).withColumnRenamed("index", "block")
            found = found.unionByName(parts.where(F.col("n") > size).join(higher, ["tree", "block"]))
        table = stored(found.select("tree", "block", "n", "nodes", "path"), "merkle-paths")
    return table


def _prover(storey: int):
    """Proof and verification of the leaves of one part of the log."""

    def run(rows: pa.Table, part: pa.Table) -> pa.Table:
        block, n, nodes, path, subroot, root = (part.column(c)[0].as_py() for c in ("block", "n", "nodes", "path", "subroot", "root"))
        count, levels = _children(block, n, storey)
        tree = _levels(_split(nodes), count, levels)
        steps = [[_siblings(tree[t], i) for i in range(len(tree[t]))] for t in range(levels)]
        above = [(s["left"].encode(), s["right"].encode()) for s in path]
        tails = [b"".join(a + b for a, b in above)] * len(tree[levels])
        for t in range(levels - 1, -1, -1):
            tails = [a + b + tails[i // ARITY] for i, (a, b) in enumerate(steps[t])]
        known: dict[tuple[int, int], bytes] = {}  # of nodes of the log, which many leaves meet

        def fold(t: int, i: int, node: bytes) -> bytes:
            """The root of the whole log, from the digest of a node and the siblings on its way."""
            of_log = tree[t][i] == node
            if of_log and (t, i) in known:
                return known[t, i]
            if t < levels:
                left, right = steps[t][i]
                found = fold(t + 1, i // ARITY, digest(left, node, right))
            else:
                found = reduce(lambda d, s: digest(s[0], d, s[1]), above, node)
            if of_log:
                known[t, i] = found
            return found

        at = (rows.column("index").to_numpy() - block * ARITY ** storey).tolist()
        had = [tree[0][i] for i in at]
        now = [x.encode() if x is not None else y for x, y in zip(rows.column("tampered").to_pylist(), had)]
        alike = [pa.array([x] * len(at), pa.string()) for x in (subroot, root)]
        new = [[x.decode() for x in had], [hashlib.sha256(tails[i]).hexdigest() for i in at],
               [fold(0, i, x).decode() for i, x in zip(at, now)]]
        leaf, proof, folded = (pa.array(x, pa.string()) for x in new)
        return pa.table([rows.column("doc_id"), rows.column("source"), leaf, *alike, proof, folded],
                        ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return run


def manifest(docs: DataFrame, storey: int = STOREY) -> tuple[DataFrame, DataFrame, list[DataFrame], list[DataFrame]]:
    """The leaves in their places, the sources' roots in theirs, the log of the sources' trees (a
    tree is named by its source, hashed as a field), and the log of the one tree above them."""
    found = stored(leaves(docs), "merkle-leaves").withColumn("tree", _field("source"))
    placed = stored(ranked(found, "tree", ["doc_id", "leaf"]), "merkle-leaves")
    log = build(placed.select("tree", "index", "n", F.col("leaf").alias("digest")), storey)
    named = roots(log, storey).join(placed.where("index = 0").select("tree", "source"), "tree")
    sources = stored(ranked(named.withColumn("top", F.lit("")), "top", ["source"]), "merkle-sources")
    top = build(sources.select(F.col("top").alias("tree"), "index", "n", "digest"), storey)
    return placed, sources.select("tree", "index", F.col("digest").alias("subroot")), log, top


def verify(docs: DataFrame, storey: int = STOREY) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``."""
    placed, sources, log, top = manifest(docs, storey)
    root = roots(top, storey)
    whole = next((r["digest"] for r in root.collect()), None)  # one row, or none for an empty table
    over = paths(with_paths(top, root.select("tree", F.array().cast(_PATH).alias("path")), storey), storey)
    above = stored(sources.join(over.select("index", "path"), "index"), "merkle-paths")
    parts = (with_paths(log, above.select("tree", "path"), storey).join(above.select("tree", "subroot"), "tree")
             .withColumn("root", F.lit(whole).cast("string")))
    doc_id, source = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    rows = placed.select("doc_id", "source", "tree", "index", "tampered", F.expr(f"index div {ARITY ** storey}").alias("block"))
    proven = (rows.groupBy("tree", "block").cogroup(parts.groupBy("tree", "block"))
              .applyInArrow(_prover(storey), f"doc_id {doc_id}, source {source}, leaf string, subroot string, root string, "
                                    "proof_sha256 string, folded_root string"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
