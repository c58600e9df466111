"""Exact duplicates by Grace hash deduplication.

Records are partitioned by a hash of their normalised text; a bucket that fits
in memory goes through an open-addressing table that compares complete texts.
A bucket that does not fit is written out and partitioned again by an
independent hash, until every bucket fits. Spark's exchange and the written
tables in the shared folder are the spill files.

Before each exchange, copies within an input task are combined, so a text that
makes up a third of all rows crosses the network once per task.

Nulls and edge cases: a null text counts as empty. Of equal texts the row with
the most code points, then the smallest ``doc_id`` stays (a null id comes
last). Rows that tie in both are repeated rows; exactly one of them is kept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import BLANKS, slices, stored, texts

_DELETE = BLANKS.encode()
TIED_ROWS = 4096  # rows of a block of tied rows
_RECORD = "digest binary, content binary, n long, best_chars long, best_id long, n_best long, done boolean, clash boolean"


def normalised(text: str) -> bytes:
    """The text without white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(None, _DELETE)


class ContentTable:
    """An open-addressing table of complete contents with linear probing."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.rows: list[list] = []  # digest, content, n, best_chars, best_id, n_best
        self.digests: set[bytes] = set()
        self.bytes = 0
        self._slots = array("q", [-1]) * 1024

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self._slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := self._slots[at]) >= 0 and not (self.rows[k][0] == digest and self.rows[k][1] == content):
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, n: int, chars: int, doc_id: int | None, n_best: int) -> None:
        at = self._slot(digest, content)
        if (k := self._slots[at]) < 0:
            self._slots[at] = len(self.rows)
            self.rows.append([digest, content, n, chars, doc_id, n_best])
            self.digests.add(digest)
            self.bytes += len(content) + 200
            if 2 * len(self.rows) > len(self._slots):
                self._slots = array("q", [-1]) * (2 * len(self._slots))
                for i, row in enumerate(self.rows):
                    self._slots[self._slot(row[0], row[1])] = i
            return
        row = self.rows[k]
        row[2] += n
        old, new = (-row[3], row[4] is None, row[4] or 0), (-chars, doc_id is None, doc_id or 0)
        if new < old:
            row[3:] = [chars, doc_id, n_best]
        elif new == old:
            row[5] += n_best

    def records(self, done: bool, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        """The entries, in batches; their contents only while they are not done.
        ``clash`` marks entries whose digest another content has too."""
        seen: dict[bytes, int] = {}
        if len(self.digests) < len(self.rows):
            for row in self.rows:
                seen[row[0]] = seen.get(row[0], 0) + 1
        at = 0
        while at < len(self.rows):
            part, held = [], 0
            while at < len(self.rows) and (not part or held < max_bytes):
                d, c, *rest = self.rows[at]
                clash = seen.get(d, 1) > 1
                part.append((d, None if done and not clash else c, *rest, done, clash))
                held += len(c) + 100
                at += 1
            yield _batch(part)


_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.bool_(), pa.bool_()]
_NAMES = ["digest", "content", "n", "best_chars", "best_id", "n_best", "done", "clash"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _read(docs: DataFrame, digest: Callable[[bytes], bytes], memory_bytes: int) -> DataFrame:
    """One record per distinct text of an input task (more if they exceed ``memory_bytes``)."""

    def run(batches):
        table = ContentTable()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                content = normalised(text)
                table.add(digest(content), content, 1, len(text), doc_id, 1)
            if table.bytes > memory_bytes:
                yield from table.records(False)
                table.clear()
        yield from table.records(False)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _RECORD)


def _resolve(memory_bytes: int):
    """Function for one bucket: its final records if it fits in memory, else all
    of it again, combined as far as memory allows."""

    def run(batches):
        table, fits = ContentTable(), True
        for batch in slices(batches, "content"):
            for row in zip(*(batch.column(n).to_pylist() for n in _NAMES[:6])):
                table.add(*row)
            if table.bytes > memory_bytes and len(table.digests) > 1:  # one digest alone can't be split further
                fits = False
                yield from table.records(False)
                table.clear()
        yield from table.records(fits)

    return run


def _sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def classes(docs: DataFrame, memory_bytes: int = 48 << 20, buckets: int | None = None, digest=_sha256) -> DataFrame:
    """One row per distinct text: digest, n, best_chars, best_id, n_best, clash
    (and its content where another text has the same digest)."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending, level, found = _read(docs, digest, memory_bytes // 2), 0, None
    while True:
        spread = pending.repartition(buckets, F.xxhash64("digest", F.lit(level)))
        out = stored(spread.mapInArrow(_resolve(memory_bytes), _RECORD), f"grace-{level}")
        done = out.where("done").drop("done")
        found = done if found is None else found.union(done)
        pending, level = out.where("not done"), level + 1
        if pending.isEmpty():
            return found


def _verdicts(docs: DataFrame, columns: list[str], memory_bytes: int, buckets: int | None,
              digest: Callable[[bytes], bytes]) -> tuple[DataFrame, bool]:
    """The ``columns`` of ``docs``, which have none of the new names, and the
    verdict of each row; whether rows tie for the place of the one that stays
    (``ties`` is how many)."""
    found = classes(docs, memory_bytes, buckets, digest)

    def keys(with_content: bool) -> DataFrame:
        source = docs.select(*dict.fromkeys([*columns, "doc_id", "text"]))
        kept = [c for c in source.columns if c != "text" or c in columns]
        add = {"digest": BinaryType(), "n_chars_": LongType(), **({"content": BinaryType()} if with_content else {})}
        schema = StructType([*(source.schema[c] for c in kept), *(StructField(k, t) for k, t in add.items())])

        def run(batches):
            for batch in slices(batches):
                whole = texts(batch)
                contents = [normalised(t) for t in whole]
                new = [pa.array([digest(c) for c in contents], pa.binary()), pa.array([len(t) for t in whole], pa.int64())]
                new += [pa.array(contents, pa.binary())] * with_content
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *add])

        return source.mapInArrow(run, schema)

    classed = found.select("digest", "content", F.col("n").alias("group_size"), F.col("best_id").alias("keep_id"),
                           F.col("best_chars").alias("best_chars_"), F.col("n_best").alias("n_best_"), "clash")
    out = keys(False).join(classed.where("not clash").drop("content"), "digest")
    if not found.where("clash").isEmpty():  # texts that share a digest: told apart by their contents
        out = out.unionByName(keys(True).join(classed.where("clash"), ["digest", "content"]).drop("content"))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars_") == F.col("best_chars_"))
    out = out.withColumn("kept", best).withColumn("ties", F.when(best, F.col("n_best_")).otherwise(0))
    return out.drop("n_chars_", "best_chars_", "n_best_", "clash"), not found.where("n_best > 1").isEmpty()


def exact_duplicates(docs: DataFrame, memory_bytes: int = 48 << 20, buckets: int | None = None,
                     digest: Callable[[bytes], bytes] = _sha256) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept, one row per row of ``docs``."""
    found, tied = _verdicts(docs.select("doc_id", "text"), ["doc_id"], memory_bytes, buckets, digest)
    key = ["doc_id", "digest", "keep_id", "group_size"]
    if not tied:
        return found.select(*key, "kept")
    # Repeated rows that tie: as many rows, the first of them kept. They are dealt in blocks, so that
    # a group of any size is no single task, nor an array of its rows.
    blocks = (found.where("ties > 1").groupBy(*key).agg(F.count("*").alias("n"))
              .select(*key, "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {TIED_ROWS}"))).alias("block"))
              .repartition("digest", "block"))
    first = F.col("block") * TIED_ROWS
    again = (blocks.select(*key, F.explode(F.sequence(first, F.least(F.col("n"), first + TIED_ROWS) - 1)).alias("i"))
             .select(*key, (F.col("i") == 0).alias("kept")))
    return found.where("ties <= 1").select(*key, "kept").union(again)


def first_of_equals(docs: DataFrame, memory_bytes: int = 48 << 20, buckets: int | None = None,
                    digest: Callable[[bytes], bytes] = _sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # names that cannot clash
    found, tied = _verdicts(docs.withColumnsRenamed(others), ["doc_id", "text", *others.values()], memory_bytes, buckets, digest)
    kept = found.where("kept")
    if tied:
        kept = kept.where("ties <= 1").union(kept.where("ties > 1").dropDuplicates(["doc_id", "digest"]))
    return kept.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))
