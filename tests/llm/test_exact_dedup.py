import hashlib
import re
from collections import Counter, defaultdict

import pytest

from burnline.llm import exact_dedup, queries

from .helpers import as_rows, clashing, docs, words

ROWS = [(4, "a b c"), (2, "abc"), (9, "a\tb\x0bc "), (9, "a\tb\x0bc "), (1, None), (0, ""), (7, " \n"), (6, "x"), (None, "x"),
        (None, "q"), (8, "x"), (8, "x"), (30, "é"), (31, "é"), (32, "a b"), (33, "ab"),
        *((100 + i, " ".join(words(40, i % 7))) for i in range(40)), (500, "z" * 200_000), (501, "z " * 200_000)]


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(((-len(t or ""), i is None, i or 0), k))
    out = Counter()
    for text, members in groups.items():
        members.sort()
        for place, (_, k) in enumerate(members):
            out[(rows[k][0], rows[members[0][1]][0], len(members), place == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_query_matches_brute_force(spark, tmp_dir):
    path = f"{tmp_dir}/d"
    docs(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    assert Counter(as_rows(queries.op5_exact_dedup(spark, path))) == brute(ROWS)


@pytest.mark.parametrize(("memory", "buckets"), [(2_000, 2), (1 << 20, 1)])
def test_small_buckets_are_partitioned_again(spark, memory, buckets):
    got = exact_dedup.exact_duplicates(docs(spark, ROWS).repartition(3), memory_bytes=memory, buckets=buckets)
    sizes = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()}
    assert sizes == {(a, b, n) for a, b, n, *_ in brute(ROWS)}


def test_contents_decide_where_digests_are_equal(spark):
    weak = lambda content: bytes([len(content) % 3])
    rows = [(1, "ab"), (2, "cd"), (3, "a b"), (4, "xyzab"), (5, "c d"), (6, "q")]
    got = exact_dedup.exact_duplicates(docs(spark, rows).repartition(2), memory_bytes=600, buckets=2, digest=weak)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()) == [
        (1, 3, 2), (2, 5, 2), (3, 3, 2), (4, 4, 1), (5, 5, 2), (6, 6, 1)]


def test_open_addressing_table_grows_and_compares_contents():
    table = exact_dedup.ContentTable()
    for round_ in range(2):
        for i in range(3000):
            table.add(b"same-digest", str(i).encode(), 1, 5, i, 1)
            if i > 600 and round_:
                break
    assert len(table.rows) == 3000
    assert [r[2] for r in table.rows[:600]] == [2] * 600


def test_one_row_of_each_group_stays_with_its_columns(spark):
    names = ["digest", "kept", "ties", "content", "c0", "n_chars_", "clash", "level"]
    frame = clashing(spark, ROWS, names)
    got = exact_dedup.first_of_equals(frame)
    assert got.columns == frame.columns
    rows = got.collect()
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ROWS})
    assert all(r["clash"] == "x6" and r["source"] == "src" for r in rows)


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    assert exact_dedup.first_of_equals(docs(spark, [])).count() == 0


def test_many_tied_rows_without_an_id(spark):
    n = 20_000
    frame = spark.range(n).selectExpr("cast(null as long) as doc_id", "'' as text")
    got = exact_dedup.exact_duplicates(frame).groupBy("keep_id", "group_size", "kept").count().collect()
    assert sorted((r["kept"], r["count"]) for r in got) == [(False, n - 1), (True, 1)]
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(None, n)}
