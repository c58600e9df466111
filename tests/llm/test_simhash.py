import random

import numpy as np
import pytest
import xxhash

from burnline.llm import components, simhash

from .helpers import as_rows, clashing, docs, words


def brute_print(text, k=4):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").replace("\f", " ")
         .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w] if len(w) < k else (w[i:i + k] for i in range(len(w) - k + 1)))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(prints, radius=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in ps}


def near(rng, p, bits):
    for b in rng.sample(range(64), bits):
        p ^= 1 << b
    return p


@pytest.mark.parametrize("text", ["", None, " \n\t", "One", "a b c", "A b\x0bC d", "The Cat sat ON the mat. The cat", "É é İ x y z",
                                  "x " * 50, "a b c d e f g h"])
def test_fingerprint_matches_brute_force(text):
    assert simhash.fingerprint((text or "").encode()) == brute_print(text)


def test_long_text_in_blocks():
    text = " ".join(words(250_000, 3))
    assert len(text) > 1 << 20
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def planted(n_far=60, n_groups=12, seed=1):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(n_far)}
    for _ in range(n_groups):
        p = rng.getrandbits(64)
        prints |= {p, *(near(rng, p, rng.randint(1, 6)) for _ in range(4))}
        prints.add(near(rng, near(rng, p, 4), 4))
    prints |= {0, 1, (1 << 64) - 1, (1 << 64) - 16}
    return prints


@pytest.mark.parametrize(("bits", "most"), [(12, 1 << 21), (3, 1 << 21), (4, 500)])
def test_links_connect_as_brute_force(spark, bits, most):
    prints = planted()
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    frame = spark.createDataFrame(signed, "fp long")
    found = components.connected(simhash.links(frame, 4, bits, most))
    got = {p: p for (p,) in signed}
    got.update({r["node"]: r["root"] for r in found.collect()})
    as_set = lambda roots: {frozenset(p for p in roots if roots[p] == r) for r in roots.values()}
    expected = {frozenset(int(np.uint64(p).astype(np.int64)) for p in g) for g in as_set(brute_roots(prints))}
    assert as_set(got) == expected


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    found = dict(as_rows(components.connected(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}


def test_documents_edge_cases(spark):
    base = " ".join(words(300, 5))
    rows = [(5, base), (9, base + " tail"), (3, base), (3, base), (7, None), (8, ""), (None, base), (11, "zebra " * 3),
            (12, " ".join(words(200, 9))), (20, "\n \t")]
    got = as_rows(simhash.near_duplicates(docs(spark, rows)))
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    expected = [(i, int(np.uint64(p).astype(np.int64)), least[roots[p]]) for (i, _), p in zip(rows, prints)]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_empty_table_and_clashing_columns(spark):
    assert as_rows(simhash.near_duplicates(docs(spark, []))) == []
    frame = clashing(spark, [(1, "a b c d e"), (2, "a b c d e")], ["fp", "component_id", "slice", "root", "first_id"])
    assert sorted(r[2] for r in as_rows(simhash.near_duplicates(frame))) == [1, 1]
