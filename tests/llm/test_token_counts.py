import base64
import math

import pytest
import regex

from burnline.llm import token_counts
from burnline.llm.tokens import vocabulary

from .helpers import as_rows, clashing, docs, words

PATH = vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def viterbi(word, ranks, totals={}):
    if id(ranks) not in totals:
        totals[id(ranks)] = math.log(sum(1 / (r + 1) for r in ranks.values()))
    total = totals[id(ranks)]
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if (r := ranks.get(word[start:end])) is not None:
                best[end] = max(best[end], (best[start][0] - math.log(r + 1) - total, best[start][1] - 1))
    return best[-1][0], -best[-1][1]


WORDS = ["", "a", " the", " theory", " theories", "aaaaaaaaaaaaaaaa", "été", "\U0001f600", " " * 30, "'s", "\x00\xff", *words(300, 1)]


def test_trie_matches_plain_dynamic_programming(ranks):
    trie = token_counts.PrefixTrie(ranks, max_nodes=400)
    for w in WORDS * 2:
        score, n = trie.terminals({w})[w]
        expected = viterbi(w.encode(), ranks)
        assert n == expected[1] and score == pytest.approx(expected[0])
    assert len(trie) < 500


def test_prefixes_are_shared(ranks):
    trie = token_counts.PrefixTrie(ranks)
    trie.best(b" theory")
    nodes = len(trie)
    trie.best(b" the")
    assert len(trie) == nodes
    trie.best(b" theories")
    assert len(trie) == nodes + 3


def test_long_pretokens_are_counted_beside_the_trie(ranks):
    trie = token_counts.PrefixTrie(ranks, max_nodes=300)
    whole = ["".join(words(400, 3)), "x" * 700, "\u65e5\u672c" * 200, "short"]
    got = trie.terminals(set(whole))
    for w in whole:
        score, n = viterbi(w.encode(), ranks)
        assert got[w][1] == n and got[w][0] == pytest.approx(score)
    assert len(trie) < 20
    many = words(200, 4)
    assert set(many) <= set(trie.terminals(set(many))) and len(trie) < 320  # cleared between words


def test_a_long_pretoken_takes_no_memory_of_its_size(ranks):
    import tracemalloc
    trie = token_counts.PrefixTrie(ranks)
    word = b"acgt" * 100_000
    tracemalloc.start()
    trie.best_apart(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20


def test_documents(spark, ranks):
    import public_tokenizers
    rows = [(1, "the theory of the thing"), (2, None), (3, ""), (None, "the"), (1, "the theory of the thing"),
            (4, "é\n\n  x's \U0001f600"), (5, "word, " * 200_000)]
    got = as_rows(token_counts.count_tokens(clashing(spark, rows, ["score", "n_tokens"]), PATH))
    expected = []
    for i, t in rows:
        pre = regex.findall(public_tokenizers.PATTERN, t or "")
        known = {w: viterbi(w.encode(), ranks) for w in set(pre)}
        expected.append((i, len(pre), len(known), sum(known[w][1] for w in pre), sum(known[w][0] for w in pre)))
    key = lambda r: (r[0] is None, r)
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_empty_table(spark):
    assert token_counts.count_tokens(docs(spark, []), PATH).count() == 0
