"""The pipeline's stages against brute force, and the registered queries against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from burnline.llm import langid

from .helpers import SMALL, clashing, docs, words
from .test_exact_dedup import brute as brute_exact
from .test_line_dedup import PASSAGE, brute as brute_lines, sentence
from .test_packing import check as check_packed
from .test_simhash import brute_print, brute_roots

EN, DE = "the cat sat on the mat and the dog was there {}", "der hund und die katze sind nicht im garten {}"


def corpus():
    base = " ".join(words(400, 11))
    rows = [(i, EN.format(sentence(30, i)), "en", "s", 5) for i in range(0, 40)]
    rows += [(i, DE.format(sentence(30, i)), "de", "s", 5) for i in range(40, 80)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[3][1] + " ", "en", "s", 1), (2, rows[2][1], "en", "s", 1), (102, None, "en", "s", 0),
             (103, "1234 !!", None, "s", 0), (104, base, "en", "hot", 9), (105, base + " end", "en", "hot", 9), (106, base.replace("a", "A"), "en", "hot", 9),
             (None, EN.format("nobody"), "en", None, 3), (107, f"{EN.format('x')} {PASSAGE}", "en", "s", 7), (108, f"{DE.format('y')} {PASSAGE}", "de", "s", 7)]
    return rows


def bag(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_stages_match_brute_force(spark):
    names = ["lang_pred", "score", "digest", "kept", "removed", "rank", "fp", "h1"]
    frame = clashing(spark, corpus(), names)
    start = [tuple(r) for r in frame.collect()]

    got = P.language_id(spark, frame, "")
    assert got.columns == frame.columns
    protos = langid.learn(frame)
    unknown = [r[0] for r in langid.identify(docs(spark, corpus()), protos, ["doc_id"]).collect() if r["lang_pred"] == "und"]
    assert sorted(unknown) == [102, 103]
    rows = [r for r in start if r[0] not in (102, 103)]
    assert bag(got) == Counter(rows)

    got = P.exact(spark, got, "")
    assert got.columns == frame.columns
    kept = {(k[0], k[4]) for k in brute_exact([r[:2] for r in rows]) if k[3]}
    import hashlib
    import re
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    rows = [r for r in rows if (r[0], digest(r[1])) in kept]
    assert {(r[0], r[1]) for r in got.collect()} == {(r[0], r[1]) for r in rows}
    assert got.count() == len({digest(r[1]) for r in rows})
    rows = [tuple(r) for r in got.collect()]

    got = P.near_duplicates(spark, spark.createDataFrame(rows, frame.schema), "")
    assert got.columns == frame.columns
    prints = {r[1]: brute_print(r[1]) for r in rows}
    roots = brute_roots(set(prints.values()))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[roots[prints[r[1]]]] = min(least.get(roots[prints[r[1]]], r[0]), r[0])
    rows = [r for r in rows if r[0] is None or least[roots[prints[r[1]]]] == r[0]]
    assert bag(got) == Counter(rows)
    assert {r[0] for r in rows} & {104, 105, 106} == {104}

    got = P.substrings(spark, spark.createDataFrame(rows, frame.schema), "")
    assert got.columns == frame.columns
    expected = brute_lines([r[:2] for r in rows])
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == Counter((i, t, len(t)) for i, t, _ in expected)

    packed = P.packed(spark, got, "").collect()
    check_packed(sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed), 2048)
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows}


def test_stages_on_an_empty_table(spark):
    frame = docs(spark, [])
    for _, stage in P.STAGES:
        out = stage(spark, frame, "")
        assert out.count() == 0
        if stage is not P.packed:
            assert out.columns == frame.columns


def test_run_is_the_chain_of_its_stages(spark):
    got = P.run(spark, SMALL).collect()
    check_packed(sorted((r["sequence_id"], r["offset"], r["length"]) for r in got), 2048)
    source = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert 0 < len({r["doc_id"] for r in got}) < len(source)
    whole = {(r["doc_id"], r["doc_tokens"]) for r in got}
    assert sum(r["length"] for r in got) == sum(n for _, n in whole)


def test_noise_and_unlearned_languages_go_and_short_texts_stay(spark):
    en, es = "the {} sat on the mat and was there with all of them for the day", "el {} estaba en la casa y no quiso salir de ella por la tarde"
    rows = [(i, (en if i % 2 else es).format(" ".join(words(6, i))), "en" if i % 2 else "es", "s", 1) for i in range(400)]
    letters = words(60, 7, "bcdfghjklmnpqrstvwxz")
    rows += [(1000, " ".join(letters), "en", "s", 1), (1001, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059\u304c\u5b66\u7fd2" * 8, None, "s", 1),
             (1002, "on the mat", "en", "s", 1), (1003, "en la casa", None, "s", 1), (1004, en.format("cat"), None, "s", 1), (1005, "12 34", "en", "s", 1)]
    kept = {r["doc_id"] for r in P.language_id(spark, clashing(spark, rows, ["lang_pred", "n_letters"]), "").collect()}
    assert {i for i, *_ in rows} - kept == {1000, 1001, 1005}


def test_another_text_of_the_same_id_stays(spark):
    base, other = " ".join(words(300, 1)), " ".join(words(300, 2, "klmnopqr"))
    rows = [(1, base), (2, base + " end"), (2, other), (None, base), (3, other + " x"), (2, None)]
    got = P.near_duplicates(spark, clashing(spark, rows, ["text_key", "fp"]), "")
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, base), (2, other), (None, base), (2, None)])


def test_every_operator_has_a_query():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in E.queries()) == 1
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if n.startswith("op")])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    frame, cur = E.queries()[name](spark, SMALL), con.execute(E.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(c) for c in frame.columns]
    assert bag(frame) == Counter(tuple(r[i] for i in order) for r in cur.fetchall())


def test_simhash_query_matches_brute_force(spark):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in source.items()}
    roots = brute_roots(set(prints.values()))
    least = {}
    for i in sorted(source, reverse=True):
        least[roots[prints[i]]] = i
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in E.queries()["op1_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_documents_stay_if_no_language_was_learned(spark):
    rows = [(1, "Some words", None, "s", 10), (2, "12 34 !", None, "s", 7), (3, None, None, "s", 0), (4, "\u4f60\u597d", None, "s", 2)]
    assert sorted(r["doc_id"] for r in P.language_id(spark, docs(spark, rows), "").collect()) == [1, 4]
