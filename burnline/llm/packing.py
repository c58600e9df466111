"""Packing token pieces into windows, planned by non-negative least squares.

A document is cut into full windows and a rest. The lengths of the pieces make
a histogram of at most ``window`` bars, which alone reaches the driver. There
shallow combinations of lengths that fill a window are enumerated, their repeat
counts solved by non-negative least squares against the histogram and rounded
to what is there, and the residual bars are packed greedily. The plan says for
the r-th piece of each length which sequence and offset it has; Spark ranks the
pieces and reads that off.

Nulls and edge cases: a null text is empty and has the closing id only. Pieces
of repeated rows are pieces of their own. A null ``doc_id`` is carried along.
No documents give no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts
from .tokens import bpe

WINDOW = 2048
END_ID = 1
#: Entries of a generation of the encoder's cache, and bytes of text encoded at a time: encoding is most of the work
#: here, so it gets the memory.
CACHE_ENTRIES, SLICE_BYTES = 1_200_000, 4 << 20


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID,
           cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt) of the full windows and the rest of
    every document. ``salt`` tells rows without a ``doc_id`` apart; it is 0 for the others.
    ``cache_entries`` trades memory of the workers for time and changes no result."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]

    def run(batches):
        unnamed = 0
        for batch in slices(batches, max_bytes=SLICE_BYTES, keep_held=True):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe(path, cache_entries).ids(texts(batch))):
                ids += end
                n = len(ids) // 4
                unnamed += doc_id is None
                for start in range(0, n, window):
                    cut = ids[4 * start:4 * (start + window)]
                    rows.append((doc_id, start, len(cut) // 4, zlib.crc32(cut), n, unnamed if doc_id is None else 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def combinations(counts: np.ndarray, window: int, depth3: int = 24) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths that fill a window: the full length,
    all pairs, and for each length the ``depth3`` triples whose rarest other
    part is the most frequent. ``counts``: of pieces by length."""
    found = {(window,)} if counts[window] else set()
    lengths = np.flatnonzero(counts[:window])
    for a in lengths:
        if counts[window - a]:
            found.add(tuple(sorted((int(a), int(window - a)), reverse=True)))
        b = lengths[lengths <= (window - a) // 2]
        c = window - a - b
        b, c = b[c > 0], c[c > 0]
        common = np.minimum(counts[b], counts[c])
        for i in np.argsort(-common, kind="stable")[:depth3]:
            if common[i]:
                found.add(tuple(sorted((int(a), int(b[i]), int(c[i])), reverse=True)))
    return sorted(found, reverse=True)


def repeats(combos: list[tuple[int, ...]], counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 of the combinations that
    minimise |A x - counts|, by accelerated projected gradient descent."""
    if not combos:
        return np.zeros(0)
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.concatenate([np.array(c) for c in combos])
    size, target = len(counts), counts.astype(float)
    times = lambda x: np.bincount(row, x[column], size)
    back = lambda r: np.bincount(column, r[row], len(combos))
    z = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue, for the step
        z = back(times(z))
        z /= np.linalg.norm(z)
    step = 1 / (1.05 * np.linalg.norm(back(times(z))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - target))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


@dataclass
class Plan:
    """For each length: from which rank on its pieces go to which combination."""

    first: dict[int, np.ndarray]  # length: first rank of each run of pieces
    sequence: dict[int, np.ndarray]  # the sequence of the run's first piece; the next pieces have the next sequences
    offset: dict[int, np.ndarray]
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks (from 0)."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            here = length == n
            run = np.searchsorted(self.first[n], rank[here], "right") - 1
            sequence[here] = self.sequence[n][run] + rank[here] - self.first[n][run]
            offset[here] = self.offset[n][run]
        return sequence, offset


def plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for a histogram: ``counts[n]`` pieces of length n, 1 <= n <= window."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(window + 1, np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequences = 0

    def take(combo: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        at = 0
        for n in combo:
            runs.setdefault(n, []).append((int(used[n]), sequences, at))
            used[n] += times
            left[n] -= times
            at += n
        sequences += times

    def at_most(combo: tuple[int, ...]) -> int:
        return min(int(left[n]) // combo.count(n) for n in combo)

    combos = combinations(left, window)
    x = repeats(combos, left)
    for i in np.argsort(-x, kind="stable"):
        if (times := min(round(x[i]), at_most(combos[i]))) > 0:
            take(combos[i], times)
    # What rounding left over: the longest piece first, then each time the longest that still fits.
    while (there := np.flatnonzero(left)).size:
        combo, room, spare = [], window, left.copy()
        while (fits := there[(there <= room) & (spare[there] > 0)]).size:
            combo.append(int(fits[-1]))
            spare[combo[-1]] -= 1
            room -= combo[-1]
        take(tuple(combo), at_most(tuple(combo)))
    part = lambda k: {n: np.array([r[k] for r in rs], np.int64) for n, rs in runs.items()}
    return Plan(part(0), part(1), part(2), sequences)


def pack(cut: DataFrame, window: int = WINDOW, blocks: int = 1024) -> DataFrame:
    """The pieces (a stored table of :func:`pieces`) with ``sequence_id`` and ``offset``.

    Pieces of one length are ranked in ``blocks`` blocks by a hash of the piece,
    so that a length that a third of all documents share is no single task.
    """
    key = ["doc_id", "start", "ids_crc32", "doc_tokens", "salt"]
    spread = cut.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks)))
    sizes = spread.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for n, c in cut.groupBy("length").count().collect():  # at most ``window`` rows
        counts[n] = c
    by_length = Window.partitionBy("length").orderBy("block")
    before = sizes.select("length", "block", (F.sum("n").over(by_length) - F.col("n")).alias("before"))
    in_block = Window.partitionBy("length", "block").orderBy(*key)
    columns = [c for c in cut.columns if c != "salt"]
    ranked = (spread.withColumn("place", F.row_number().over(in_block) - 1).join(before, ["length", "block"])
              .select(*columns, (F.col("before") + F.col("place")).alias("rank")))
    where = plan(counts, window)

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            places = [pa.array(x, pa.int64()) for x in where.place(length, rank)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *places],
                                             [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"]))


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID,
                   cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    return pack(stored(pieces(docs, path, window, end_id, cache_entries), "pieces"), window)
