import numpy as np
import pyarrow as pa

from burnline.llm import queries, vector_graph

from .helpers import as_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    """Links and components of (vec_id, embedding, label) rows, all against all."""
    units = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        named = [x for x in least[find(i)] if x is not None]
        component = min(named) if named else None
        out.append((r[0], links[i], component, component is not None and component == r[0]))
    return out


def near(rng, centre, n, noise):
    return [(centre + rng.normal(size=len(centre)) * noise).astype(np.float32).tolist() for _ in range(n)]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=16).astype(np.float32).tolist() for _ in range(150)]
    for k in range(6):
        vectors += near(rng, rng.normal(size=16), 12, 0.1)
    one = near(rng, rng.normal(size=16), 1, 0)[0]
    vectors += [one, one, one, (2 * np.array(one)).tolist(), (np.array(one) * 3).astype(np.float32).tolist(), (-np.array(one)).tolist()]
    rows = [(i, v, int(i % 3 == 0)) for i, v in enumerate(vectors)]
    rows += [(500 + i, v, None if i % 2 else 7) for i, v in enumerate([None, None, [], [0.0] * 16, [-0.0, 0.0], [float("nan")] * 16, [None] + one[1:], [float("inf")] + one[1:], one])]
    rows += [(None, one, 0), (None, one, 9), (520, one, 1), (520, one, 1), (521, one[:8], 1), (522, one[:8], 1), (523, [1e-40, 0.0], 2), (524, [3e38, 0.0], 2)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", node string, links int")
    got = vector_graph.near_duplicates(frame, shard_size=24)
    assert sorted(map(repr, as_rows(got))) == sorted(map(repr, brute(rows)))


def test_hot_group_over_many_shards(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=32)
    vectors = near(rng, centre / np.linalg.norm(centre), 400, 0.017) + [rng.normal(size=32).tolist() for _ in range(800)]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    got = {r[0]: r for r in as_rows(vector_graph.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard_size=64))}
    want = brute(rows)
    found, true = sum(min(got[w[0]][1], w[1]) for w in want), sum(w[1] for w in want)
    assert 0 < true < 400 * 399 and found >= 0.99 * true
    assert all(got[w[0]][1] <= w[1] for w in want)
    assert np.mean([got[w[0]][2] == w[2] for w in want]) > 0.99


def test_vectors_of_one_direction_are_dealt(spark):
    base = np.array([1.0, 2.0, 3.0, 4.0])
    rows = [(i, (base * (1 + i / 7)).tolist(), 1) for i in range(300)]
    got = as_rows(vector_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_size=32))
    assert {r[2] for r in got} == {0} and {r[1] for r in got} == {299}


def test_graph_is_reachable_and_bounded():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(150, 12)), near(rng, rng.normal(size=12), 150, 0.01)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = vector_graph.adjacency(x)
    seen, front = set(), {vector_graph._medoid(x)}
    while front:
        seen |= front
        front = {int(v) for u in front for v in rows[u] if v >= 0} - seen
    assert len(seen) == 300 and not (rows == np.arange(300)[:, None]).any()
    assert (rows >= 0).sum(1).mean() <= vector_graph.NEAR + vector_graph.FAR


def test_unit_vectors():
    got = vector_graph.unit(pa.array([[3.0, 4.0], None, [], [0.0], [None, 1.0], [1e300, 1e300], [1e-310]]))
    assert got.is_null().to_pylist() == [False, True, True, True, True, False, False]
    assert got[0].as_py() == [0.6, 0.8] and abs(got[5].as_py()[0] - 0.5 ** 0.5) < 1e-15 and got[6].as_py() == [1.0]


def test_audit_counts_links_by_brute_force(spark):
    nodes = [(i, "2:1", [1.0, 0.0] if i < 3 else [0.0, 1.0], 1 + (i == 0)) for i in range(4)] + [(9, "2:2", [1.0, 0.0], 1)]
    frame = spark.createDataFrame(nodes, "node long, space string, vec array<double>, copies long")
    counts = spark.createDataFrame([(0, 2), (1, 1), (2, 9)], "node long, links long")
    assert vector_graph.audit(frame, counts) == (2 + 1 + 3, 2 + 3 + 3)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(as_rows(queries.op12_vector_graph(spark, "/root/testdata/sf0.001"))) == sorted(brute(rows))


def test_empty_table(spark):
    assert vector_graph.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
