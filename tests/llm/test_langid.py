import zlib

import numpy as np

from burnline.llm import langid, queries

from .helpers import SMALL, docs

EN, DE = "the cat sat on the mat and the dog was there", "der hund und die katze sind nicht im schönen garten"


def brute_bundle(text, dim=128):
    letters = {}

    def vector(c):
        return letters.setdefault(c, langid.letter_vectors(np.array([ord(c)], np.uint32), dim)[0].astype(int))

    low, out = text.lower(), np.zeros(dim, int)
    clean = "".join(c if c.isalpha() else " " for c in low).split()
    for w in (f" {w} " for w in clean):
        for a, b, c in zip(w, w[1:], w[2:]):
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_bundles_match_brute_force_also_in_pieces():
    whole = [EN, "", "...", "A b!c", DE * 9, "İx ß 漢字", "x" * 300]
    for size in (1 << 20, 40):
        got, letters = langid.bundles(whole, 128, size)
        assert np.array_equal(got, [brute_bundle(t) for t in whole])
        assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in whole]


def test_predictions(spark):
    rows = [(i, t + f" {i}", lang, "s", 1) for i in range(40) for t, lang in ((EN, "en"), (DE, "de"))]
    rows += [(100, None, "en", "s", 0), (101, "12 !", None, "s", 0), (None, "der garten", "de", "s", 1), (102, "the mat " * 40_000, None, "s", 1)]
    frame = docs(spark, rows).selectExpr('*', '1 as vector', '2 as i')
    out = langid.identify(frame, langid.learn(frame), ["doc_id", "lang"]).collect()
    by = {r["doc_id"]: r for r in out}
    assert by[100]["lang_pred"] == by[101]["lang_pred"] == "und"
    assert by[102]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"
    assert all(r["lang_pred"] == r["lang"] for r in out if r["lang"] and r["doc_id"] != 100)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_nothing_learned_and_empty(spark):
    frame = docs(spark, [(1, EN, None, "s", 1)])
    assert langid.learn(frame) == {}
    assert [tuple(r)[-2:] for r in langid.identify(frame, {}).collect()] == [("und", 0.0)]
    assert langid.identify(docs(spark, []), langid.learn(docs(spark, []))).count() == 0


def test_held_out_accuracy(spark):
    rows = queries.op3_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.95
