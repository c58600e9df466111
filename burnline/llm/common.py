"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Held = TypeVar("Held")
#: The word rule of the operators: runs of anything but space and U+0009-U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that rule leaves out.
BLANKS = " \t\n\x0b\f\r"
_BLANK_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a fresh folder is made if the session runs in a single
    process (tests); on a cluster that is an error, as a machine-local folder
    would be invisible to the other executors.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="burnline-shared-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage: a lost executor costs no more than the tasks that
    read this table. Files stay until the shared folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/burnline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores after it if a column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_held: dict = {}


def held(key: tuple, make: Callable[[], Held]) -> Held:
    """What ``make`` returns, made once in a worker process and kept for later
    tasks there, until another operator's work comes to the process."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20,
           keep_held: bool = False) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds about ``max_bytes`` each (one
    row at least). Unless ``keep_held``, what :func:`held` keeps is let go:
    Spark gives the same processes to one operator after the other."""
    if not keep_held:
        _held.clear()
    for batch in batches:
        sizes = [len(x) if x is not None else 0 for x in _buffers(batch.column(column))]
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def _buffers(array: pa.Array) -> Iterator[memoryview | None]:
    binary = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    for x in binary:
        yield x.as_buffer() if x.is_valid else None


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of the texts of a batch; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``size`` bytes, so that a very long
    text never becomes one list. ``bytes.split()`` splits at exactly the
    characters of ``BLANKS``."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > size:
            cut = _BLANK_BYTE.search(data, at + size)
            end = cut.start() if cut else end
        yield data[at:end].split()
        at = end


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text",
              max_bytes: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that applies ``make`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, max_bytes):
            yield make(part)

    return run
