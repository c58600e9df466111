from hypothesis import given, settings
from hypothesis import strategies as st

from burnline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "\\", "\\\\", "\n</turn>\n", "\n\\</turn>\n", "### user :\n", "\n<part>\n", " :\n", "a\\", "\n", "#<", "\\### Assistant: </turn> ok", "é😀\n<", "$1 \\1"]


def brute(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def formatted(spark, rows):
    return chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()


def check(spark, rows):
    expected = brute(rows)
    got = formatted(spark, rows)
    assert {r["conv_id"] for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        turns = expected[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss_texts"] == [t for role, t in turns if role == "assistant"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r["formatted"].count(chat.END) == blocks
        for s in r["loss_spans"]:
            assert 0 <= s["start"] and s["start"] + s["length"] <= len(r["formatted"])


def test_round_trip_of_nasty_texts(spark):
    rows = [(i, k, role, text) for i, text in enumerate(NASTY) for k, role in enumerate(["user", "assistant", "assistant", "user"])]
    rows += [(100 + i, 0, text, "x") for i, text in enumerate(NASTY)]
    check(spark, rows)


def test_nulls_ties_and_repeats(spark):
    check(spark, [(None, 1, "user", "a"), (None, 0, "assistant", None), (1, 0, None, None), (1, 1, "", "x"), (2, 5, "user", "b"), (2, 5, "user", "a"),
                  (2, 5, "user", "a"), (2, None, "assistant", "first"), (3, 0, "assistant", "x" * 100_000),
                  *((4, i, "assistant" if i % 3 else "user", str(i)) for i in range(600))])


@settings(deadline=None, max_examples=10)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.sampled_from(["user", "assistant", "a:\n#", "x :"]),
                          st.text("\\#<\n:/>turnpa é", max_size=20)), min_size=1, max_size=60))
def test_round_trip_of_any_text(spark, rows):
    check(spark, rows)


def test_template(spark):
    got = formatted(spark, [(1, 0, "user", "hi <b>"), (1, 1, "user", "#2"), (1, 2, "assistant", "ok")])
    assert got[0]["formatted"] == "### user :\nhi \\<b>\n<part>\n\\#2\n</turn>\n### assistant :\nok\n</turn>\n"
    assert [tuple(s) for s in got[0]["loss_spans"]] == [(got[0]["formatted"].index("ok"), 2)]


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_conversations(empty).count() == 0
    frame = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).selectExpr("*", "1 as ts", "2 as t", "3 as formatted")
    assert chat.format_conversations(frame).count() == 1
