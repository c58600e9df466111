"""Substring deduplication by hashing lines and their sentences.

A unit is a line of at least ``min_line`` words, a sentence of a line, or a
window of ``WINDOW`` words anywhere in the text. Units are normalised (lower
case, single spaces) and hashed to 128 bits. The digests are grouped globally:
the occurrence in the smallest ``doc_id``, and there the first, stays; every
other one is a repeat.

A repeated line goes. A run of repeated sentences goes if it has at least
``min_run`` words, so that a common short sentence by itself stays. A shorter
line, or a sentence of under ``min_unit`` words, goes only between repeats, and
only if it is one too: its digest includes that of the unit before it, so it
must follow the same unit there. Anything else ends a run.

Windows do not depend on how a copy is cut into lines and sentences. They start
where a hash of the next words is the least of ``WINDOW`` successive ones, so
any ``WINDOW`` successive places hold a start, the same one in every copy: of a
passage of at least ``2 * WINDOW - 1`` words that occurs again, all goes but up
to ``WINDOW - 1`` words at each end. A window repeats one of its own text only
if it does not overlap it.
``removed`` keeps the spans, in characters of the original text.

Nulls and edge cases: a null text stays null, an empty one empty, with no
spans. A null ``doc_id`` ranks last. Rows that share a ``doc_id`` have the same
rank: neither loses what only they share. Extra columns are carried along.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import fresh, slices, stored

MIN_LINE, MIN_UNIT, MIN_RUN, WINDOW = 5, 4, 12, 16
SAMPLE, SHARES = 64, 64  # one text in so many is looked at for hot digests, which go to so many tasks
LAST = (1 << 63) - 1  # the rank of a null doc_id
_LINE = re.compile(r"[^\n]+\n?")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?]+(?=\s)\s*|[^.!?\n]+(?:[.!?]+(?!\s)[^.!?\n]*)*(?:[.!?]+(?=\s)\s*)?\n?|[.!?]+\n?")
_BLANKS = re.compile(r"[^\S\n]*")
_IS_SPACE: list[np.ndarray] = []  # made once in each worker
Unit = tuple[int, int, int, bytes]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_hashes = _WordHashes()


def _digest(words: list[str], before: bytes = b"", seed: int = 0) -> bytes:
    return xxhash.xxh3_128_digest(before + " ".join(words).encode("utf-8", "surrogatepass"), seed)


def _lines(text: str, min_line: int, min_unit: int) -> Iterator[tuple[int, int, int, bytes, list[Unit]]]:
    """Start, end, words and digest of each line, and of each of its sentences
    (a line of one sentence, or of under ``min_line`` words, lists none)."""
    before = b""  # the digest of the unit before
    for m in _LINE.finditer(text):
        line = m.group()
        words = line.lower().split()
        if not words:
            continue
        if len(words) < min_line:
            before = _digest(words, before)
            yield m.start(), m.end(), len(words), before, []
            continue
        parts, at = [], m.start()
        for a, b in [x.span() for x in _SENTENCE.finditer(line)]:
            part = line[a:b].lower().split()
            before = _digest(part, b"" if len(part) >= min_unit else before)
            parts.append((at + a, at + b, len(part), before))
        if len(parts) == 1:
            yield m.start(), m.end(), len(words), before, []
        else:
            yield m.start(), m.end(), len(words), _digest(words), parts


def _sliding(values: np.ndarray, take: np.ufunc) -> np.ndarray:
    """``take`` over every ``WINDOW`` (a power of 2) successive values."""
    step = 1
    while step < WINDOW:
        values = take(values[:-step], values[step:])
        step *= 2
    return values


def _windows(text: str) -> list[tuple[int, bytes]]:
    """The first word, and the digest, of each window of a text."""
    words = text.lower().split()
    if len(words) < 2 * WINDOW - 1:
        return []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - WINDOW + 1
    mixed = h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[1:n + 1] * np.uint64(0xBF58476D1CE4E5B9) + h[2:n + 2] * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    least = np.zeros(n + WINDOW - 1, np.uint64)
    least[WINDOW - 1:n] = _sliding(mixed, np.minimum)
    return [(i, _digest(words[i:i + WINDOW], seed=1)) for i in np.flatnonzero(_sliding(least, np.maximum) == mixed).tolist()]


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends."""
    if not _IS_SPACE:
        _IS_SPACE.append(np.array([chr(i).isspace() for i in range(sys.maxunicode + 1)]))
    space = _IS_SPACE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return edges[::2], edges[1::2]


def _placed(text: str, windows: list[tuple[int, bytes]]) -> Iterator[Unit]:
    starts, ends = _places(text) if windows else ((), ())
    for i, digest in windows:
        yield int(starts[i]), _BLANKS.match(text, int(ends[i + WINDOW - 1])).end(), WINDOW, digest


def units(text: str, min_line: int = MIN_LINE, min_unit: int = MIN_UNIT) -> Iterator[tuple[int, int, int, bytes, list[Unit]]]:
    """Start, end, words and digest of each line, and of each of its sentences;
    then those of each window."""
    yield from _lines(text, min_line, min_unit)
    yield from ((*x, []) for x in _placed(text, _windows(text)))


def _digests(text: str) -> tuple[set[bytes], bool]:
    """The digests of the units of a text, and whether one of them comes twice."""
    found = [d for _, d in _windows(text)]
    for *_, line, parts in _lines(text, MIN_LINE, MIN_UNIT):
        found.append(line)
        found.extend([x[3] for x in parts])
    distinct = set(found)
    return distinct, len(distinct) < len(found)


def removed_spans(text: str, elsewhere: set[bytes], min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """The spans to remove: repeated lines, long enough runs of repeated sentences,
    and repeated windows. ``elsewhere``: digests whose first occurrence another text has."""
    seen: dict[bytes, int] = {}

    def again(start: int, end: int, digest: bytes) -> bool:
        return digest in elsewhere or start >= seen.setdefault(digest, end)

    spans: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []  # of repeated units; what lies between are repeats too short to be one
    count = 0

    def close() -> None:
        nonlocal count
        if run and count >= min_run:
            spans.append((run[0][0], run[-1][1]))
        run.clear()
        count = 0

    for start, end, n, digest, parts in _lines(text, MIN_LINE, MIN_UNIT):
        states = [again(a, b, d) for a, b, _, d in parts]
        if again(start, end, digest):
            if n >= MIN_LINE:
                run.append((start, end))
                count = max(count + n, min_run)  # a whole line is enough
            continue
        for (a, b, m, _), repeated in zip(parts, states):
            if not repeated:
                close()
            elif m >= MIN_UNIT:
                run.append((a, b))
                count += m
        if not parts:
            close()
    close()
    windows = _windows(text)
    times = Counter(d for _, d in windows)
    twice = [x for x in windows if times[x[1]] > 1 or x[1] in elsewhere]
    spans += [(a, b) for a, b, _, d in _placed(text, twice) if again(a, b, d)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            a, b = merged[-1][0], max(b, merged.pop()[1])
        merged.append((a, b))
    # Of a line that goes whole, its end goes too.
    return [(a, b + 1 if text[b:b + 1] == "\n" and text[a - 1:a] in ("", "\n") else b) for a, b in merged]


def _key() -> tuple[Column, Column]:
    """Rank of a row, and what tells rows of the last rank apart: a hash of the
    text, so that rows without a ``doc_id`` are no single group."""
    unnamed = F.col("doc_id").isNull()
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.when(unnamed, F.xxhash64("text")).otherwise(0)


def _found(docs: DataFrame, hot: frozenset[bytes] = frozenset()) -> DataFrame:
    """(rank, salt, h1, h2, share) of the units of each row, digests of a text once. ``share``: which part
    of the occurrences of a ``hot`` digest this is, else -1; -2 marks a text that repeats a unit of its own."""

    def run(batches):
        for batch in slices(batches):
            rows, parts, shares = [], [], []
            for rank, salt, text in zip(*(batch.column(c).to_pylist() for c in ("rank", "salt", "text"))):
                found, twice = _digests(text or "")
                rows.append((rank, salt, len(found) + twice))
                parts.extend(found)
                shares.extend([(rank + salt) % SHARES if d in hot else -1 for d in found] if hot else [-1] * len(found))
                if twice:
                    parts.append(xxhash.xxh3_128_digest(f"{rank} {salt}"))
                    shares.append(-2)
            ranks, salts, n = np.array(rows, np.int64).T
            halves = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
            columns = [np.repeat(ranks, n), np.repeat(salts, n), halves[:, 0].copy(), halves[:, 1].copy(), np.array(shares, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rank", "salt", "h1", "h2", "share"])

    rank, salt = _key()
    return docs.select(rank.alias("rank"), salt.alias("salt"), "text").mapInArrow(run, "rank long, salt long, h1 long, h2 long, share int")


def _hot(docs: DataFrame) -> frozenset[bytes]:
    """Digests that make up a thousandth of all or more, by a sample of the texts: a thousand at most.
    They only decide how the work is dealt."""
    sample = _found(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)).where("share = -1")
    counts = stored(sample.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), "line-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where((F.col("n") >= 20) & (F.col("n") * 1000 >= total)).collect()
    return frozenset(np.array([r["h1"], r["h2"]], "<i8").tobytes() for r in often)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of occurrences sorted by digest, share and rank: those of a larger rank than the first of their
    digest and share; and, of a hot digest, also those of the first rank (``open``)."""
    last, least = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rank, h1, h2, share = (batch.column(c).to_numpy() for c in ("rank", "h1", "h2", "share"))
        new = np.r_[last != (h1[0], h2[0], share[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (share[1:] != share[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        first = np.where(start >= 0, rank[start], least)
        last, least = (h1[-1], h2[-1], share[-1]), first[-1]
        later = rank > first
        keep = np.flatnonzero(later | (share != -1))
        out = batch.select(["rank", "salt", "h1", "h2"]).take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(~later[keep] & (share[keep] >= 0))], [*out.schema.names, "open"])


def repeats(docs: DataFrame) -> DataFrame:
    """(rank, salt, digests) of the units of a row whose first occurrence is in a document of smaller id.

    Every digest is sent once, to the task of its kind, which reads its
    occurrences in the order of their rank. A hot digest goes to ``SHARES``
    tasks, and the firsts of those are compared afterwards. A text that only
    repeats units of its own has a row too.
    """
    dealt = _found(docs, _hot(docs)).repartition("h1", "h2", "share").sortWithinPartitions("h1", "h2", "share", "rank")
    later = stored(dealt.mapInArrow(_later, "rank long, salt long, h1 long, h2 long, open boolean"), "line-repeats")
    firsts = later.where("open").groupBy("h1", "h2").agg(F.min("rank").alias("first"))  # of a thousand digests at most
    rest = later.where("open").join(F.broadcast(firsts), ["h1", "h2"]).where("rank > first")
    every = later.where("NOT open").select("rank", "salt", "h1", "h2").union(rest.select("rank", "salt", "h1", "h2"))
    return every.groupBy("rank", "salt").agg(F.collect_set(F.struct("h1", "h2")).alias("digests"))


def remove_repeats(docs: DataFrame, removed: str = "removed") -> DataFrame:
    """``docs`` with its texts cut, and the spans cut out in a column named ``removed``."""
    columns = docs.columns
    rank, salt, first, second = (fresh(columns, n) for n in ("rank", "salt", "h1", "h2"))
    found = repeats(docs).select(F.col("rank").alias(rank), F.col("salt").alias(salt),
                                 F.transform("digests", lambda d: d["h1"]).alias(first),
                                 F.transform("digests", lambda d: d["h2"]).alias(second))
    joined = docs.withColumns(dict(zip((rank, salt), _key()))).join(found, [rank, salt], "left").select(*columns, first, second)
    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    schema = StructType([*docs.schema.fields, StructField(removed, span)])

    def run(batches):
        for batch in slices(batches):
            cut, gone = [], []
            for text, h1, h2 in zip(*(batch.column(c) for c in ("text", first, second))):
                text = text.as_py()
                spans = []
                if text and h1.is_valid:  # else no unit of it is a repeat
                    pairs = np.stack([np.asarray(h1.values), np.asarray(h2.values)], 1).astype("<i8")
                    spans = removed_spans(text, {p.tobytes() for p in pairs})
                gone.append([{"start": a, "end": b} for a, b in spans])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                cut.append("".join([*kept, text[at:]]) if spans else text)
            new = {"text": pa.array(cut, pa.string()), removed: pa.array(gone, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in [*columns, removed]],
                                             [*columns, removed])

    return joined.mapInArrow(run, schema)
