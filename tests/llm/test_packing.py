import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burnline.llm import packing
from burnline.llm.tokens import vocabulary

from .helpers import clashing, docs, words


def lay_out(counts, window):
    """All pieces of a histogram as (sequence, offset, length)."""
    plan = packing.plan(counts, window)
    out = []
    for n in np.flatnonzero(counts):
        s, o = plan.place(np.full(counts[n], n), np.arange(counts[n]))
        out += zip(s.tolist(), o.tolist(), [int(n)] * int(counts[n]))
    return plan, sorted(out)


def check(laid, window):
    at = {}
    for s, o, n in laid:
        assert at.get(s, 0) == o
        at[s] = o + n
    assert sorted(at) == [*range(len(at))]
    assert max(at.values(), default=0) <= window


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 9), min_size=32, max_size=32))
def test_every_piece_has_a_place(bars):
    counts = np.array([0, *bars])
    plan, laid = lay_out(counts, 32)
    assert len(laid) == counts.sum()
    check(laid, 32)
    assert plan.sequences == len({s for s, *_ in laid})


def test_little_padding():
    counts = np.zeros(2049, np.int64)
    lengths, n = np.unique(np.random.default_rng(1).integers(1, 2048, 5000), return_counts=True)
    counts[lengths] = n
    plan, laid = lay_out(counts, 2048)
    check(laid, 2048)
    least = max(-(-sum(n for *_, n in laid) // 2048), int(counts[1025:].sum()))  # no two of the long ones fit together
    assert plan.sequences <= 1.015 * least


def test_repeats_solve_the_histogram():
    counts = np.zeros(11, np.int64)
    counts[[10, 6, 4, 3, 7]] = [5, 8, 8, 6, 6]
    combos = packing.combinations(counts, 10)
    x = packing.repeats(combos, counts)
    fitted = np.zeros(11)
    for c, k in zip(combos, x):
        for n in c:
            fitted[n] += k
    assert (x >= 0).all()
    assert np.abs(fitted - counts).max() < 0.05


def test_hot_length_and_many_blocks():
    counts = np.zeros(2049, np.int64)
    counts[[700, 1348, 2048, 5]] = [100_000, 99_990, 7, 1]
    _, laid = lay_out(counts, 2048)
    check(laid, 2048)


@pytest.mark.parametrize("window", [16, 2048])
def test_documents_round_trip(spark, window):
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "x"), (4, " ".join(words(900, 1))), (4, " ".join(words(900, 1))),
            (5, "<|endoftext|> 7 \n\n  é\U0001f600"), (6, "q" * 50_000), *((10 + i, "the same text") for i in range(40))]
    got = packing.pack_documents(clashing(spark, rows, ["length", "rank", "start", "_block", "offset"]), vocabulary(), window).collect()
    check(sorted((r["sequence_id"], r["offset"], r["length"]) for r in got), window)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    expected = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), window):
            cut = ids[start:start + window]
            expected.append((i, start, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)


def test_no_documents(spark):
    assert packing.pack_documents(docs(spark, []), vocabulary()).count() == 0
