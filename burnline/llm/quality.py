"""Quality rules on repetition, from a suffix array of the words of a text.

The suffix array of a block of texts is made by prefix doubling, of which only
the last ranks are kept; a separator of its own after each text keeps repeats
within it. The common prefixes of neighbours come from one scan in text order.
Neighbours in the array with a common prefix of at least a given length bound the intervals whose members
start with the same repeated words; per word, the longest such prefix is the
longest repeat that starts there. The union of those spans gives the share of
words covered, their maximum the longest repeat, and both are limited.

Nulls and edge cases: a null text has no words and fails the base rule. Words
are compared as they are. A text takes memory in proportion to its own words;
texts are handled whole, in blocks of bounded size. Repeated rows are judged
each for themselves. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANKS, slices, texts, word_blocks

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """The rules. Repeats count towards the covered share from ``min_repeat`` words on."""

    min_words: int = 50
    base_window: int = 3
    max_base_percent: int = 50
    min_repeat: int = 8
    max_covered: float = 0.3
    max_repeat: int = 40


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank of each suffix among all suffixes, by prefix doubling: ranks by the first 1, 2, 4, ... symbols,
    until all differ. The last symbol must be unique."""
    n = len(symbols)
    _, inverse, count = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[inverse].astype(np.int64)  # a group's rank is its first place in the array
    active, step = np.flatnonzero(count[inverse] > 1), 1
    while active.size:
        key = rank[active] * (n + 1) + rank[np.minimum(active + step, n - 1)]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        place = np.arange(len(active), dtype=np.int32)
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, old[1:] != old[:-1]]
        del key, order
        head = np.maximum.accumulate(np.where(fresh, place, 0))
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank[active] = old + head - start
        single = fresh & np.r_[fresh[1:], True]
        active, step = active[~single], 2 * step
    return rank


def common_prefixes(symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each suffix the length of the prefix it shares with the suffix ``before`` it in the suffix array (-1: none).
    A suffix shares at most one symbol less than the suffix one symbol longer does, so one scan in the order of the
    text needs steps in proportion to its length."""
    out = np.zeros(len(symbols), np.int32)
    at, prior, result = memoryview(symbols), memoryview(before), memoryview(out)
    common = 0
    for i in range(len(symbols) - 1):  # the last symbol, which is unique, ends every comparison
        j = prior[i]
        if j < 0:
            common = 0
            continue
        while at[i + common] == at[j + common]:
            common += 1
        if common:
            result[i] = common
            common -= 1
    return out


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each symbol the length of the longest sequence that starts there and
    occurs again. The last symbol must be unique."""
    rank = suffix_ranks(symbols)
    array = np.empty(len(symbols), np.int32)
    array[rank] = np.arange(len(symbols), dtype=np.int32)
    del rank
    before = np.full(len(symbols), -1, np.int32)
    before[array[1:]] = array[:-1]
    out = common_prefixes(np.ascontiguousarray(symbols, np.int32), before)
    out[array[:-1]] = np.maximum(out[array[:-1]], out[array[1:]])  # shared with the suffix after it
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which symbols lie in a repeat of at least ``least`` symbols: the union of the spans."""
    start = np.flatnonzero(longest >= least)
    step = np.zeros(len(longest) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + longest[start], -1)
    return np.cumsum(step[:-1]) > 0


def _word_blocks(whole: list[str], most: int = 300_000) -> Iterator[tuple[int, list[np.ndarray], int]]:
    """The words of the texts as numbers, in blocks of about ``most`` words: the block's first text, the words of
    each of its texts, and how many different ones there are. A long text never becomes a list of its words."""
    first, block, held, known = 0, [], 0, {}
    for i, text in enumerate(whole):
        if block and held > most:
            yield first, block, len(known)
            first, block, held, known = i, [], 0, {}
        parts = [np.array([known.setdefault(w, len(known)) for w in words], np.int32)
                 for words in word_blocks(text.encode("utf-8", "surrogatepass"))]
        block.append(np.concatenate([np.empty(0, np.int32), *parts]))
        held += len(block[-1])
    if block:
        yield first, block, len(known)


def repetition(whole: list[str], base: int, least: int) -> np.ndarray:
    """For each text: words, words in repeats of ``base`` and of ``least`` words at least, longest repeat."""
    out = np.zeros((len(whole), 4), np.int64)
    for first, block, different in _word_blocks(whole):
        sizes = np.array([len(w) for w in block])
        ends = np.cumsum(sizes + 1) - 1  # places of the separators
        symbols = np.zeros(int(ends[-1]) + 1, np.int64)
        is_word = np.ones(len(symbols), bool)
        is_word[ends] = False
        symbols[is_word] = np.concatenate(block)
        symbols[ends] = different + np.arange(len(block))
        owner = np.repeat(np.arange(len(block), dtype=np.int32), sizes + 1)
        longest = _within(symbols, owner, different)
        rows = slice(first, first + len(block))
        out[rows, 0] = sizes
        for column, m in ((1, base), (2, least)):
            out[rows, column] = np.bincount(owner, covered(longest, m), len(block))
        np.maximum.at(out[rows, 3], owner, longest)
    return out


def _within(symbols: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
    """Longest repeats within each text: a word counts as another symbol in each
    text, and separators occur once."""
    apart = np.where(symbols < words, owner * np.int64(words) + symbols, symbols[-1] * words + words + symbols)
    _, dense = np.unique(apart, return_inverse=True)
    return longest_repeats(dense)


def judge(docs: DataFrame, limits: Limits = Limits(), columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``columns`` with counts, the base rule and the verdict of every text."""
    columns = list(columns)
    source = docs.select(*dict.fromkeys([*columns, "text"]))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    types = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns)
    schema = types + "".join(f", {c} long" for c in counts) + ", base_failed boolean, kept boolean"

    def run(batches):
        for batch in slices(batches):
            whole = texts(batch)
            n, base, cover, longest = repetition(whole, limits.base_window, limits.min_repeat).T
            chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in whole], np.int64)
            symbols = np.array([sum(map(t.count, SYMBOLS)) for t in whole], np.int64)
            repeated = []
            for t in whole:
                lines = [x for x in t.split("\n") if x.strip(BLANKS)]
                repeated.append(len(lines) - len(set(lines)))
            failed = (n < limits.min_words) | (100 * base > limits.max_base_percent * n)
            kept = ~failed & (cover <= limits.max_covered * n) & (longest <= limits.max_repeat)
            new = [n, chars, symbols, np.array(repeated, np.int64), base, cover, longest, failed, kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, new)],
                                             [*columns, *counts, "base_failed", "kept"])

    return source.mapInArrow(run, schema)
