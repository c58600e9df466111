"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits of each other share at least one
64-bit value that lies within ``radius / 2`` bits of both. So every distinct
fingerprint stands for all values of its ball of half the radius, fingerprints
that meet in a value are linked, and the link is verified by its bit distance.

A ball of radius 2 has 2081 values, too many to send one by one. The exchange
is therefore by a slice of the value (its first ``slice_bits`` bits): a
fingerprint is sent once to each slice its ball reaches (79 of 4096), and
emits its values there, after the exchange. Within a slice, values that would
exceed ``max_values`` are split by the next bit until they fit, so memory is
bounded however many fingerprints are alike.

Nulls and edge cases: a null or empty text, or one of white space, has the
fingerprint zero and is linked like any other. Rows with equal fingerprints
are one vertex, so copies cost nothing. A null ``doc_id`` is carried along and
never names a component unless no other id is reachable (then it is null).
Repeated rows come back as often as they came. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, raw_texts, stored, word_blocks
from .components import connected

SEED = 42
BITS = 64


def fingerprint(text: bytes, shingle_words: int = 4) -> int:
    """The 64-bit SimHash of a text (UTF-8): bit i is set if it is set in over
    half of the hashes of the word shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    ones, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_blocks(text.lower()):
        words = tail + words
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle_words)))]
        tail = words[-(shingle_words - 1):] if shingle_words > 1 else []
        total += len(hashes)
        for at in range(0, len(hashes), 8192):
            block = np.array(hashes[at:at + 8192], "<u8")
            ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    if not total and tail:  # fewer words than a shingle has: the whole sequence
        return digest(b" ".join(tail), SEED)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carried, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    columns = ["doc_id", *carried]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle_words) for t in raw_texts(batch)], np.uint64)
        return pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(fps.view(np.int64))], [*columns, "fp"])

    source = docs.select(*columns, "text")
    types = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns]
    return source.mapInArrow(per_batch(make), ", ".join([*types, "fp long"]))


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of up to ``radius`` of the lowest ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _meet(owner: np.ndarray, low: np.ndarray, left: np.ndarray, bits: int,
          max_values: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (first owner, other owner) that share a value of their balls.

    ``low``: the lowest ``bits`` bits of each owner's fingerprint; ``left``: how
    many of them may still be flipped.
    """
    if len(owner) < 2:
        return
    masks = {int(r): ball(bits, int(r)) for r in np.unique(left)}
    if sum(len(masks[int(r)]) * int((left == r).sum()) for r in masks) > max_values and bits:
        top = (low >> np.uint64(bits - 1)) & np.uint64(1)
        rest = low & np.uint64((1 << (bits - 1)) - 1)
        for bit in (0, 1):
            cost = (top != bit).astype(left.dtype)
            keep = cost <= left
            yield from _meet(owner[keep], rest[keep], (left - cost)[keep], bits - 1, max_values)
        return
    values = np.concatenate([(low[left == r][:, None] ^ m[None, :]).ravel() for r, m in masks.items()])
    owners = np.concatenate([np.repeat(owner[left == r], len(m)) for r, m in masks.items()])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    fresh = np.r_[True, values[1:] != values[:-1]]
    if fresh.all():
        return
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
    yield owners[head[~fresh]], owners[~fresh]


def _forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index over the links (a, b), where ``root`` is
    that over earlier links."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def slice_bits_for(fingerprints: int, least: int = 12) -> int:
    """Bits of the slices of an exchange of so many distinct fingerprints: a group of it holds about five million
    of them at most, if they are spread evenly."""
    return max(least, least + math.ceil(math.log2(max(fingerprints, 1) / (1 << 28))))


def links(distinct: DataFrame, radius: int = 4, slice_bits: int = 12, max_values: int = 1 << 21) -> DataFrame:
    """Links (a, b), a != b, that connect all fingerprints of column ``fp``
    (distinct rows) as the pairs within ``radius`` bits do. The radius is even: fingerprints that meet in
    a value are linked with the first of them, from which an odd radius would leave some a bit too far."""
    if radius % 2:
        raise ValueError("the radius must be even")
    half, low_bits = (radius + 1) // 2, BITS - slice_bits
    reach = [int(m) for m in ball(slice_bits, half)]

    def meet(table: pa.Table) -> pa.Table:
        here = np.uint64(table.column("slice")[0].as_py())
        fps = np.sort(table.column("fp").to_numpy().view(np.uint64))
        left = half - np.bitwise_count((fps >> np.uint64(low_bits)) ^ here).astype(np.int64)
        root, near_a, near_b, waiting = np.arange(len(fps)), [], [], 0
        for a, b in _meet(np.arange(len(fps)), fps & np.uint64((1 << low_bits) - 1), left, low_bits, max_values):
            near = (np.bitwise_count(fps[a] ^ fps[b]) <= radius) & (root[a] != root[b])
            near_a.append(a[near])
            near_b.append(b[near])
            waiting += int(near.sum())
            if waiting > len(fps) + max_values // 16:  # pairs are held in proportion to the fingerprints only
                root = _forest(root, np.concatenate(near_a), np.concatenate(near_b))
                near_a, near_b, waiting = [], [], 0
        # A link less for every link that others imply: what leaves the task is a forest.
        if waiting:
            root = _forest(root, np.concatenate(near_a), np.concatenate(near_b))
        other = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[root[other]].view(np.int64), "b": fps[other].view(np.int64)})

    prefix = F.shiftrightunsigned("fp", low_bits).cast("int")
    sent = distinct.select("fp", F.explode(F.array(*(prefix.bitwiseXOR(F.lit(m)) for m in reach))).alias("slice"))
    return sent.groupBy("slice").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4, slice_bits: int | None = None,
                    carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carried, fp, component_id) of every row of ``docs``; ``carried`` are further columns of it.

    ``component_id`` is the smallest ``doc_id`` that links of up to ``radius``
    differing bits reach. The exchange has 2 ** ``slice_bits`` groups, by default
    as many as :func:`slice_bits_for` the number of distinct fingerprints says.
    """
    prints = stored(fingerprints(docs, shingle_words, carried), "simhash")
    vertex = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    if slice_bits is None:
        slice_bits = slice_bits_for(prints.select(F.approx_count_distinct("fp")).first()[0])
    roots = connected(stored(links(vertex.select("fp"), radius, slice_bits), "simhash-links"))
    labelled = (vertex.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", *carried, "fp", "component_id")
