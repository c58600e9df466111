import hashlib
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from burnline.llm import periodic, queries

from .helpers import SMALL, as_rows, clashing, docs, words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    """All stretches of each lag, longest possible, without a smaller period."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                part = w[i:j + q]
                if not any(all(part[t] == part[t + p] for t in range(len(part) - p)) for p in range(1, q)):
                    out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def cases():
    rng = random.Random(1)
    out = [None, "", " \n\t\x0b", "one", "a " * 23, "a " * 24, "a b " * 12, "x " + "a b c\n" * 9 + "y", "a b " * 200 + "c " + "a b " * 200]
    for q in (7, 8, 9, 12, 13, 18, 19, 27, 28, 60, 97):  # around the bounds of scales
        for extra in (-1, 0, 1, q):
            unit = [rng.choice("abcd") for _ in range(q - 1)] + ["z"]
            body = (unit * 5)[:3 * q + extra]
            out.append(" ".join(words(rng.randint(0, 40), q) + body + words(rng.randint(0, 40), q + 1)))
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 5)):
            unit = rng.choices("ab" if rng.random() < .5 else "abcdefgh", k=rng.choice([1, 2, 3, 5, 8, 13, 21, 34, 50]))
            text += unit * rng.randint(1, 8) + unit[:rng.randint(0, len(unit))] + rng.choices("abcxyz", k=rng.randint(0, 9))
        out.append(" ".join(text))
    fib = ["a", "b"]
    while len(fib[-1]) < 1500:  # many overlapping runs
        fib.append(fib[-1] + fib[-2])
    morse = "a"
    for _ in range(10):  # no word of it comes three times in a row; linear hashes collide on it
        morse += morse.translate(str.maketrans("ab", "ba"))
    block = "a" * 10 + "b"  # runs within the periods of a run
    return [*out, " ".join(fib[-1]), " ".join(morse * 3), " ".join((block * 3 + "c") * 4), " ".join(block * 30 + "q" + block * 9)]


def test_runs_match_brute_force(spark):
    rows = [*enumerate(cases()), (None, "a b " * 30), (3, "again " * 30), (3, "again " * 30)]
    frame = clashing(spark, rows, ["runs", "n_words", "start"])
    got = Counter((i, n, tuple(map(tuple, runs)), text) for i, n, runs, text in as_rows(periodic.collapse(frame)))
    want = []
    for i, t in rows:
        w = split(t)
        runs = brute_runs(w)
        want.append((i, len(w), tuple(runs), brute_collapse(w, runs)))
    assert got == Counter(want)
    assert sum(len(w[2]) for w in want) > 150 and max(q for w in want for _, _, q in w[2]) > 300


def test_texts_of_one_block_do_not_mix():
    texts = [np.array([0, 1, 2] * k) for k in (3, 8, 1, 50, 8)]
    assert periodic.runs_of(texts, 3) == [[], [(0, 24, 3)], [], [(0, 150, 3)], [(0, 24, 3)]]


def brute_query(doc_id, text):
    w, h = split(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    sha = lambda t: hashlib.sha256(t.encode("utf-8")).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(brute_collapse(w, runs)))


def test_query_matches_brute_force(spark, tmp_dir):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", " ", "one", *[" ".join(words(rng.randint(2, 300), i)) for _ in range(8)]])) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(cases())]
    docs(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    got = as_rows(queries.op11_periodic(spark, tmp_dir))
    assert Counter(got) == Counter(brute_query(i, t) for i, t in rows)
    assert sum(h[1] > 0 for h in got if h[0] < 300) > 10


def test_query_on_small_tables(spark):
    short = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    ids = {r[0]: r[1] for r in short.collect()}
    got = {r[0]: r for r in as_rows(queries.op11_periodic(spark, SMALL)) if r[0] in ids}
    assert len(got) == len(ids) and all(got[i] == brute_query(i, t) for i, t in ids.items())


def test_very_long_texts(spark):
    unit = words(5000, 7)
    rows = [(1, "ab " * 1_000_000), (2, " ".join(unit * 40)), (3, " ".join(words(200_000, 9, "abcdefghijklmnop")))]
    start = time.time()
    got = {r["doc_id"]: r for r in periodic.collapse(docs(spark, rows)).collect()}
    assert got[1]["collapsed"] == "ab" and [tuple(r) for r in got[1]["runs"]] == [(0, 1_000_000, 1)]
    assert got[2]["collapsed"] == " ".join(unit) and [tuple(r) for r in got[2]["runs"]] == [(0, 200_000, 5000)]
    assert got[3]["runs"] == [] and got[3]["collapsed"] == rows[2][1]
    assert time.time() - start < 60


def test_empty_table(spark):
    assert periodic.collapse(docs(spark, [])).count() == 0
