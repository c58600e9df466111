"""Token counts of a unigram model by dynamic programming over a trie.

The vocabulary is that of a public rank file; the token of rank r has the
log-probability -log(r + 1) up to the constant that makes them sum to one
(Zipf's law). The best segmentation of a pre-token is the one of the largest
sum; of equal sums the one with fewer tokens. Distinct pre-tokens share a trie:
the best score and count of a node hold for every pre-token that starts with
it, so they are computed once, from the nodes above it, and a terminal's count
is its node's.

A worker process keeps its trie, and the counts of the pre-tokens it met, between
texts, and starts anew before a pre-token when the trie has ``MAX_NODES`` nodes.
A pre-token of over ``SHARED_BYTES`` bytes (unbroken letters, as in scripts
without spaces) is counted by the same recurrence beside the trie, which keeps
only as many scores as the longest token has bytes. Nulls and edge cases: a null or empty text has no tokens.
Any text can be segmented, as all single bytes are tokens. Repeated rows are
counted each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held, slices, texts

MAX_NODES = 800_000
SHARED_BYTES = 512


class PrefixTrie:
    """Best unigram segmentation of every prefix of the inserted pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], max_nodes: int = MAX_NODES) -> None:
        total = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
        # Tokens by their bytes from the last to the first: a path that ends early needs no further look.
        self._tokens: dict = {}
        for token, rank in ranks.items():
            node = self._tokens
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = -math.log(rank + 1) - total
        self._max, self._longest = max_nodes, max(map(len, ranks), default=0)
        self.clear()

    def clear(self) -> None:
        self._words: dict[str, tuple[float, int]] = {}  # of the terminals
        self._child: list[dict[int, int]] = [{}]
        self._best: list[tuple[float, int]] = [(0.0, 0)]  # score, minus the number of tokens

    def __len__(self) -> int:
        return len(self._best)

    def terminals(self, words: set[str]) -> dict[str, tuple[float, int]]:
        """Score and number of tokens of at least these pre-tokens."""
        if len(self) > self._max:
            self.clear()
        found, apart = self._words, {}
        for w in words.difference(found):
            word = w.encode("utf-8", "surrogatepass")
            if len(word) > SHARED_BYTES:
                apart[w] = self.best_apart(word)
                continue
            if len(self) > self._max:
                found = dict(found) if found is self._words else found
                self.clear()
            found[w] = self._words[w] = self.best(word)
        return {**found, **apart} if apart else found

    def _ending(self, word: bytes, end: int, scores: list[tuple[float, int]]) -> tuple[float, int]:
        """The best segmentation of ``word[:end]``; that of ``word[:i]`` is ``scores[i % len(scores)]``."""
        top, tokens, at, ring = (-math.inf, 0), self._tokens, end, len(scores)
        while at and (tokens := tokens.get(word[at - 1])) is not None:
            at -= 1
            if (score := tokens.get(-1)) is not None:
                before = scores[at % ring]
                top = max(top, (before[0] + score, before[1] - 1))
        return top

    def best_apart(self, word: bytes) -> tuple[float, int]:
        """As :meth:`best`, without the trie, in memory that does not grow with the pre-token."""
        scores = [(0.0, 0)] * (self._longest + 1)
        for end in range(1, len(word) + 1):
            scores[end % len(scores)] = self._ending(word, end, scores)
        score, count = scores[len(word) % len(scores)]
        return score, -count

    def best(self, word: bytes) -> tuple[float, int]:
        """Score and number of tokens of the best segmentation of a pre-token."""
        child, best, node = self._child, self._best, 0
        path = [best[0]]  # of each prefix
        for end, byte in enumerate(word, 1):
            if (down := child[node].get(byte)) is None:
                down = child[node][byte] = len(best)
                child.append({})
                best.append(self._ending(word, end, path))
            node = down
            path.append(best[node])
        score, count = best[node]
        return score, -count


def _model(path: str) -> tuple[PrefixTrie, regex.Pattern]:
    import public_tokenizers
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return PrefixTrie(ranks), regex.compile(public_tokenizers.PATTERN)


def count_tokens(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``columns`` with the numbers of pre-tokens, distinct pre-tokens and tokens, and the score of every text."""
    columns = list(columns)
    source = docs.select(*dict.fromkeys([*columns, "text"]))
    types = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        trie, split = held(("trie", path), lambda: _model(path))
        for batch in slices(batches, max_bytes=8 << 20, keep_held=True):
            counted: list[Counter] = []
            for text in texts(batch):
                found = split.findall(text) if len(text) <= 1 << 20 else (m.group() for m in split.finditer(text))
                counted.append(Counter(found))
            known = trie.terminals(set().union(*counted))
            rows = []
            for c in counted:
                times, best = [*c.values()], [*map(known.__getitem__, c)]
                rows.append((sum(times), len(c), sum(k * n for k, (_, n) in zip(times, best)),
                             math.fsum(k * s for k, (s, _) in zip(times, best))))
            new = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.float64()])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new],
                                             [*columns, "n_pretokens", "n_distinct", "n_tokens", "score"])

    return source.mapInArrow(run, f"{types}, n_pretokens long, n_distinct long, n_tokens long, score double")
