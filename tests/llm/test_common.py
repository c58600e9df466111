import pyarrow as pa
import pytest

from burnline.llm import common

from .helpers import docs


def test_word_blocks_keep_every_word():
    data = ("ab\tc  d\x0b\x0c" * 5000 + "x" * 3000 + " é").encode()
    for size in (1, 7, 100, 1 << 20):
        assert [w for block in common.word_blocks(data, size) for w in block] == data.split()


def test_slices_hold_every_row_in_bounded_parts():
    texts = ["a" * n for n in (0, 5, 50, 5, 5, 500, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "text"])
    parts = [*common.slices([batch, batch.slice(0, 0)], max_bytes=60)]
    assert [x for p in parts for x in p.column("i").to_pylist()] == [*range(len(texts))]
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 60 for p in parts)


def test_fresh_names_ignore_case():
    assert common.fresh(["A", "b", "b_"], "a") == "a_"
    assert common.fresh(["A", "b", "b_"], "B") == "B__"


def test_stored_tables_lie_in_the_shared_folder(spark):
    frame = common.stored(docs(spark, [(1, "x"), (2, None)]), "t")
    assert frame.count() == 2
    assert all(common.shared_dir(spark).removeprefix("file:") in f for f in frame.inputFiles())


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_what_a_process_holds_is_let_go_by_other_work():
    made = []
    get = lambda key: common.held((key,), lambda: made.append(key) or object())
    assert get("a") is get("a") and get("b") is not get("a")
    batch = pa.RecordBatch.from_arrays([pa.array(["x"])], ["text"])
    kept = get("a")
    assert [*common.slices([batch], keep_held=True)] and get("a") is kept
    assert [*common.slices([batch])] and get("a") is not kept
    assert made == ["a", "b", "a", "a"]
