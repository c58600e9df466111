"""Small documents tables for the tests of burnline.llm."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def docs(spark, rows, schema=SCHEMA):
    """A documents table of (doc_id, text) pairs, or of whole rows."""
    full = [r if len(r) > 2 else (r[0], r[1], "en", "src", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def clashing(spark, rows, names):
    """A documents table with extra columns of the given names."""
    frame = docs(spark, rows)
    for i, n in enumerate(names):
        frame = frame.selectExpr("*", f"'x{i}' as `{n}`")
    return frame


def words(n, seed=0, letters="abcdefgh"):
    rng = random.Random(seed)
    return [("".join(rng.choices(letters, k=rng.randint(2, 7)))) for _ in range(n)]


def as_rows(frame):
    return [tuple(r) for r in frame.collect()]
