import base64
import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from burnline.llm import queries, tokens

from .helpers import SMALL, clashing, docs, words

CASES = ["", " ", "a", "the  cat   sat\n\n on\tthe mat ", "it's 'S I'll 12345 x", "<|endoftext|> and <|endoftext|>", "é́ \U0001f600\U0001f44d‍",
         "\xa0\xa0a\xa0b \x85 \x1c y", " a", "a ", "\r\n\r\n b", "漢字かな  ", "x" * 500, "a \n b", "  q 　w", "1²½ ١", "Ered*** it's. word'' o'clock's! (x) -- a... é!?\nÀ.b", "\x00\x01 ﻿"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as p
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def ids(texts):
    import numpy as np
    return [np.frombuffer(b, "<u4").tolist() for b in tokens.bpe(tokens.vocabulary()).ids(texts)]


def back(some, block=1 << 20):
    import numpy as np
    return tokens.decoded(np.array(some, np.int64), tokens.vocabulary(), block)[0]


def test_byte_table_reverses_the_vocabulary(reference):
    data, start = tokens.byte_table(tokens.vocabulary())
    assert len(set(tokens.byte_chars().values())) == 256
    assert {data[a:b].tobytes(): i for i, (a, b) in enumerate(zip(start, start[1:]))} == reference[1]


def test_every_vocabulary_entry_as_tiktoken(reference):
    entries = []
    for b in reference[1]:
        try:
            entries.append(b.decode())
        except UnicodeDecodeError:
            pass
    assert ids(entries) == [reference[0].encode_ordinary(t) for t in entries]


def test_cases_as_tiktoken_and_back(reference):
    got = ids(CASES)
    assert got == [reference[0].encode_ordinary(t) for t in CASES]
    assert [back(x).decode() for x in got] == CASES


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x85\xa0ab'sSt1²é漢😀.,<|>_") | st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_any_text_as_tiktoken(reference, whole):
    assert ids(whole) == [reference[0].encode_ordinary(t) for t in whole]


def test_cache_is_bounded(reference):
    coder = tokens.ByteBpe(tokens.vocabulary(), 50)
    for seed in range(20):
        text = " ".join(words(60, seed)) + " " + "long" * 40
        assert b"".join(coder.ids([text])) == b"".join(i.to_bytes(4, "little") for i in reference[0].encode_ordinary(text))
    assert len(coder._known) <= 130


def test_long_text(reference):
    text = " ".join(words(300_000, 4)) + "  \n" + "é" * 10
    assert len(text) > 1 << 20
    assert ids([text, "  " + text]) == [reference[0].encode_ordinary(t) for t in (text, "  " + text)]


def test_offsets_cover_the_text(spark):
    rows = [(1, "the \U0001f600 cat"), (2, None), (3, "é x")]
    frame = clashing(spark, rows, ["starts_", "decoded"])
    for r in tokens.encode(frame, tokens.vocabulary(), ["doc_id", "text"], with_offsets=True).collect():
        text = r["text"] or ""
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        for i, a, b in zip(r["ids"], r["starts"], r["ends"]):
            assert back([i]) in text[a:b].encode()
        assert back(r["ids"], 2).decode() == text


def test_query_as_tiktoken(spark, reference):
    source = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op8_bpe(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(source)
    for r in got:
        expected = reference[0].encode_ordinary(source[r["doc_id"]])
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(source[r["doc_id"]].encode()).hexdigest()


def test_nulls_and_empty(spark):
    path = tokens.vocabulary()
    out = tokens.decode(tokens.encode(docs(spark, [(None, None), (1, "")]), path, ["doc_id"]), path, ["doc_id", "ids"]).collect()
    assert {(r["doc_id"], len(r["ids"]), bytes(r["decoded"])) for r in out} == {(None, 0, b""), (1, 0, b"")}
    assert tokens.encode(docs(spark, []), path).count() == 0
