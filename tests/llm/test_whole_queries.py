"""Queries that SQL cannot express, whole, against plain versions of their own on the small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from burnline.llm import html_wrapper, langid, queries
from burnline.llm.tokens import vocabulary

from .helpers import SMALL, words
from .test_langid import brute_bundle
from .test_token_counts import ranks, viterbi  # noqa: F401


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def test_op2_packing(spark, documents):
    """The pieces are those of a plain cut, lie gapless in their sequences, and need hardly more than the least number."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    got = queries.op2_packing(spark, SMALL).collect()
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in documents}
    reached, total = Counter(), 0
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        cut = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["start"] == reached[r["doc_id"]] and len(cut) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(cut.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        reached[r["doc_id"]] += r["length"]
        total += r["length"]
    assert reached == {i: len(x) for i, x in ids.items()}
    filled = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and sorted(filled) == [*range(len(filled))]
    assert len(filled) <= 1.01 * math.ceil(total / 2048) + 1


def test_op3_language_id(spark, documents):
    """Prototypes, cosines, ties and scores by plain sums over the rows learned from."""
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, SMALL).collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in documents)
    vectors = {r["doc_id"]: brute_bundle(r["text"] or "", langid.DIM) for r in documents if len(r["text"] or "") < 3_000}
    rest = [r for r in documents if r["doc_id"] not in vectors]
    vectors |= dict(zip([r["doc_id"] for r in rest], langid.bundles([r["text"] for r in rest])[0]))
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in vectors}
    prototypes = {}
    for r in documents:
        if r["lang"] is not None and not held[r["doc_id"]]:
            prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + vectors[r["doc_id"]]
    for r in documents:
        row, v = got[r["doc_id"]], vectors[r["doc_id"]]
        assert row["held_out"] == held[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or "") or not v.any():
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in prototypes.items()}
        best = max(cosine.values())
        assert row["score"] == pytest.approx(min(max(best, 0), 1)) and cosine[row["lang_pred"]] == pytest.approx(best)


def test_op6_token_counts(spark, documents, ranks):  # noqa: F811
    """Every pre-token segmented by itself."""
    import public_tokenizers
    import regex
    known = {}
    got = {r["doc_id"]: r for r in queries.op6_token_counts(spark, SMALL).collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in documents)
    for r in documents:
        pre = Counter(regex.findall(public_tokenizers.PATTERN, r["text"] or ""))
        for w in pre:
            if w not in known:
                known[w] = viterbi(w.encode(), ranks)
        row = got[r["doc_id"]]
        assert (row["n_pretokens"], row["n_distinct"]) == (sum(pre.values()), len(pre))
        assert row["n_tokens"] == sum(n * known[w][1] for w, n in pre.items())
        assert row["score"] == pytest.approx(sum(n * known[w][0] for w, n in pre.items()))


def test_op9_pages_without_article_elements(spark):
    """Pages that are made from their texts: what is the same on all pages of a layout, and what a reader would not call
    the article, is not in the text; all else is, in order."""
    rng, rows, want = random.Random(11), [], {}
    for site in range(3):
        kicker = [" ".join(words(6, 7_000 + site)), " ".join(words(5, 8_000 + site))]
        for layout in range(2):
            for n in range(9):
                i = len(rows)
                blocks = [" ".join(words(rng.randint(4, 40), 100 * i + k)) for k in range(rng.randint(2, 7))]
                title, inner = f"Title {' '.join(words(4, 9_000 + i))}", "".join(f"<p>{b}</p>" for b in blocks)
                menu = "".join(f"<li><a href='#'>{w}</a></li>" for w in words(rng.randint(2, 5), 5_000 + i))
                advert = f"<div class='ad'>{' '.join(words(5, 6_000 + i))}</div>"
                html = (f"<div id='page'><ul class='menu'>{menu}</ul><h1>{title}</h1><div><em>{kicker[0]}</em></div>{advert}<div>{inner}</div>"
                        f"<footer>{i}</footer></div>" if layout == 0 else
                        f"<nav>{menu}</nav><table><tr><td><h2>{title}</h2><pre>{kicker[1]}</pre>{inner}</td></tr></table>{advert}")
                rows.append((i, f"https://site{site}.example/{i}", f"<html><head><title>x</title></head><body>{html}</body></html>"))
                want[i] = "\n".join([title, *blocks])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_wrapper.extract(frame).collect()} == want
