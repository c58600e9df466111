"""Periodic runs of words, by minimizers at several scales, and texts with their runs collapsed.

A run is a stretch of words with a smallest period q (words q apart are equal)
of at least ``MIN_LENGTH`` words and ``MIN_TIMES`` periods that no neighbouring
word extends. Collapsing keeps the first q words of every run.

A scale covers the periods over P up to Q = 1.5 P. It hashes every Q words and
takes the hashes that are least in some window of 2 (P + 1) - Q + 1 successive
ones. Inside a run whole windows repeat one period on, and so do their minima;
Q words occur only once in a period, as a run's period is its smallest. So of a
run the next equal minimum always stands one period on: successive equal minima
at a distance the scale covers are all the seeds there are. A seed is extended
to both sides by comparing words, which also refutes equal hashes of different
words. Periods up to ``SHORT``, too short for a scale, are scanned directly, lag
by lag.

The texts of a block are one array, longest first, each closed by a symbol of
its own, which no run can cross; a scale looks at the texts only that are long
enough for it. Time is near-linear and memory linear in the words of a block.

Nulls and edge cases: a null or empty text has no words and no runs and
collapses to an empty text. Nothing is capped: a very long text is a block of
its own. Rows are judged each for themselves, so ties, repeated rows and null
``doc_id`` need no rule. Extra columns are ignored unless asked for. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, raw_texts, slices, word_blocks

MIN_LENGTH, MIN_TIMES, SHORT = 24, 3, 8
Run = tuple[int, int, int]
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes. It is not linear, so no regular text makes it collide."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sliding(values: np.ndarray, width: int, take: np.ufunc) -> np.ndarray:
    """``take`` over every ``width`` successive values."""
    step = 1
    while 2 * step <= width:
        values = take(values[:-step], values[step:])
        step *= 2
    return take(values[:len(values) - (width - step)], values[width - step:]) if width > step else values


def minimizers(values: np.ndarray, window: int) -> np.ndarray:
    """The places of values that are the least of some ``window`` successive ones."""
    if len(values) < window:
        return np.empty(0, np.int64)
    least = np.zeros(len(values) + window - 1, values.dtype)  # zero: no window
    least[window - 1:len(values)] = _sliding(values, window, np.minimum)
    return np.flatnonzero(_sliding(least, window, np.maximum) == values)


def _stretch(x: np.ndarray, at: int, lag: int, done: int) -> tuple[int, int]:
    """The largest range around [at, at + done) where words ``lag`` apart are equal."""
    right, size = at + done, 64
    while right < len(x) - lag:
        end = min(right + size, len(x) - lag)
        differ = np.flatnonzero(x[right:end] != x[right + lag:end + lag])
        if len(differ):
            right += int(differ[0])
            break
        right, size = end, 2 * size
    left, size = at, 64
    while left > 0:
        start = max(left - size, 0)
        differ = np.flatnonzero(x[start:left] != x[start + lag:left + lag])
        if len(differ):
            left = start + int(differ[-1]) + 1
            break
        left, size = start, 2 * size
    return left, right


def _is_smallest(x: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no smaller period holds in [start, end): one would divide ``period``, as three periods are there."""
    rest, p = period, 2
    while rest > 1:
        if rest % p:
            p = p + 1 if p * p < rest else rest
            continue
        while rest % p == 0:
            rest //= p
        smaller = period // p
        if (x[start:end - smaller] == x[start + smaller:end]).all():
            return False
    return True


def _lag_scan(x: np.ndarray, lag: int) -> Iterator[Run]:
    """The runs of one lag, by comparing all words that far apart."""
    least = max(MIN_LENGTH, MIN_TIMES * lag)
    if len(x) < least:
        return
    breaks = np.flatnonzero(np.r_[True, x[lag:] != x[:-lag], True]) - 1
    for k in np.flatnonzero(np.diff(breaks) - 1 + lag >= least).tolist():
        start, end = int(breaks[k]) + 1, int(breaks[k + 1]) + lag
        if _is_smallest(x, start, end, lag):
            yield start, end - start, lag


def _scale(x: np.ndarray, grams: np.ndarray, size: int, low: int, high: int) -> Iterator[Run]:
    """The runs of periods over ``low`` up to ``high``. ``grams``: hashes of ``size`` words, of which two cover ``high``."""
    n = len(x) - high + 1
    hashes = _mix(grams[:n], grams[high - size:high - size + n])
    places = minimizers(hashes, 2 * (low + 1) - high + 1)
    order = np.argsort(hashes[places], kind="stable")  # equal ones in the order of the text
    places = places[order]
    lags = np.diff(places)
    seeds = np.flatnonzero((hashes[places[1:]] == hashes[places[:-1]]) & (lags > low) & (lags <= high))
    found = np.stack([lags[seeds], places[seeds]], 1)
    reached: tuple[int, int] = (0, 0)  # the last stretch's lag and end
    for lag, at in found[np.lexsort((found[:, 1], found[:, 0]))].tolist():
        if reached[0] == lag and at < reached[1]:
            continue
        if not (x[at:at + high] == x[at + lag:at + lag + high]).all():
            continue
        left, right = _stretch(x, at, lag, high)
        reached = lag, right
        length = right - left + lag
        if length >= max(MIN_LENGTH, MIN_TIMES * lag) and _is_smallest(x, left, right + lag, lag):
            yield left, length, lag


def find_runs(x: np.ndarray, ends: np.ndarray) -> list[Run]:
    """The runs of an array of symbols. ``ends``: the ends of its texts, of which the longest comes
    first and the last symbol of each occurs nowhere else."""
    runs = [r for lag in range(1, SHORT + 1) for r in _lag_scan(x, lag)]
    sizes = np.diff(ends, prepend=0) - 1
    low, size = SHORT, 1
    grams = _mix(x.astype(np.uint64), np.full(1, 0x632BE59BD9B4E019, np.uint64))
    while (long := int(np.count_nonzero(sizes >= MIN_TIMES * (low + 1)))):
        x = x[:int(ends[long - 1])]
        high = low + low // 2
        grams = grams[:len(x) - size + 1]
        while 2 * size <= high and 2 * size <= len(x):
            grams = _mix(grams[:-size], grams[size:])
            size *= 2
        if len(x) > high:
            runs.extend(_scale(x, grams, size, low, high))
        low = high
    return runs


def _blocks(whole: list[bytes], most: int = 300_000) -> Iterator[tuple[list[int], list[np.ndarray], list[list[bytes]]]]:
    """Texts in blocks of about ``most`` words: their numbers, the symbols of their words, and the words by symbol."""
    rows, symbols, held = [], [], 0
    known: dict[bytes, int] = {}
    for i, text in enumerate(whole):
        parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in word_blocks(text)]
        rows.append(i)
        symbols.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
        held += len(symbols[-1])
        if held >= most:
            yield rows, symbols, [*known]
            rows, symbols, held, known = [], [], 0, {}
    if rows:
        yield rows, symbols, [*known]


def runs_of(symbols: list[np.ndarray], words: int) -> list[list[Run]]:
    """The runs of each text, by start, then period. ``symbols``: those of the words of each, under ``words``."""
    order = sorted(range(len(symbols)), key=lambda i: -len(symbols[i]))
    ends = np.cumsum([len(symbols[i]) + 1 for i in order])
    x = np.concatenate([np.r_[symbols[i], words + k] for k, i in enumerate(order)])
    out: list[list[Run]] = [[] for _ in symbols]
    for start, length, period in sorted(set(find_runs(x, ends))):
        k = int(np.searchsorted(ends, start, "right"))
        out[order[k]].append((start - (int(ends[k - 1]) if k else 0), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def _collapse(text: bytes, runs: list[Run], n: int) -> str:
    gone, at, parts = dropped(n, runs) if runs else None, 0, []
    for words in word_blocks(text):
        kept = words if gone is None else [w for w, g in zip(words, gone[at:at + len(words)].tolist()) if not g]
        at += len(words)
        if kept:
            parts.append(b" ".join(kept))
    return b" ".join(parts).decode("utf-8", "surrogatepass")


def collapse(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``columns`` of every row, with ``n_words``, ``runs`` and the ``collapsed`` text.
    A run is its start (the number of its first word), length and period, in words."""
    columns = list(columns)
    source = docs.select(*dict.fromkeys([*columns, "text"]))
    names = [fresh(columns, n) for n in ("n_words", "runs", "collapsed")]
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns),
                        f"{names[0]} bigint", f"{names[1]} {_RUNS}", f"{names[2]} string"])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make(batches):
        for batch in slices(batches):
            whole = raw_texts(batch)
            counts, runs, texts = [0] * len(whole), [[]] * len(whole), [""] * len(whole)
            for rows, symbols, words in _blocks(whole):
                for i, s, found in zip(rows, symbols, runs_of(symbols, len(words))):
                    counts[i], runs[i], texts[i] = len(s), found, _collapse(whole[i], found, len(s))
            spans = [[{"start": a, "length": n, "period": q} for a, n, q in found] for found in runs]
            new = [pa.array(counts, pa.int64()), pa.array(spans, run_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], [*columns, *names])

    return source.mapInArrow(make, schema)


def strongest(runs: str = "runs") -> Column:
    """The run of most periods, compared exactly; of equal ones that of smallest start, then period. Null without runs."""
    def better(best: Column, run: Column) -> Column:
        ahead = run["length"] * best["period"] > best["length"] * run["period"]  # runs come by start, then period
        return F.when(best.isNull() | ahead, run).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, better)
