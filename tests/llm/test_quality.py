import random
import re
from collections import Counter

import numpy as np

from burnline.llm import quality

from .helpers import as_rows, clashing, docs, words


def brute(text, limits=quality.Limits()):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def cover(m):
        n = Counter(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
        marked = set()
        for i in range(len(w) - m + 1):
            if n[tuple(w[i:i + m])] > 1:
                marked.update(range(i, i + m))
        return len(marked)

    longest = 0
    while len({tuple(w[i:i + longest + 1]) for i in range(len(w) - longest)}) < len(w) - longest:
        longest += 1
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base, far = cover(3), cover(limits.min_repeat)
    failed = len(w) < 50 or 100 * base > 50 * len(w)
    kept = not failed and far <= limits.max_covered * len(w) and longest <= limits.max_repeat
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), base, far,
            longest, failed, kept)


def cases():
    rng = random.Random(2)
    passage = " ".join(words(45, 8))
    out = [None, "", " \n\t", "one", "a a a a a a", "a b " * 400, "x\n\nx\n x\ny\x0bz q", "# * <b> $%&|", " ".join(words(80, 1)),
           " ".join(words(200, 2)) + "\n" + passage + "\n" + " ".join(words(100, 4)) + "\n" + passage, passage + " " + passage]
    out += [" ".join(rng.choices(["a", "b", "c"], k=rng.randint(1, 60))) for _ in range(60)]
    return out


def test_counts_match_brute_force(spark):
    rows = [*enumerate(cases()), (None, "a b"), (3, "again"), (3, "again")]
    frame = clashing(spark, rows, ["n_words", "kept", "longest"])
    got = Counter(as_rows(quality.judge(frame)))
    assert got == Counter((i, *brute(t)) for i, t in rows)
    assert any(r[-1] for r in got) and any(not r[-1] and not r[-2] for r in got)  # the method's verdict counts


def test_long_repetitive_text():
    whole = ["ab " * 200_000, " ".join(words(250_000, 1))]
    n, base, far, longest = quality.repetition(whole, 3, 8).T
    assert (n[0], base[0], far[0], longest[0]) == (200_000, 200_000, 200_000, 199_999)
    assert n[1] == 250_000 and longest[1] < 8


def test_suffix_ranks_sort_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        s = np.r_[rng.integers(0, 3, 50), 9]
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        ranks = quality.suffix_ranks(s)
        assert [int(np.flatnonzero(ranks == k)[0]) for k in range(len(s))] == order


def test_empty_table(spark):
    assert quality.judge(docs(spark, [])).count() == 0


def test_common_prefixes_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        s = np.r_[rng.integers(0, 3, 60), 9]
        got = quality.longest_repeats(s)
        text = s.tolist()
        for i in range(len(s)):
            best = 0
            for j in range(len(s)):
                k = 0
                while i != j and max(i, j) + k < len(s) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best
