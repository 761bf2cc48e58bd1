import math

import numpy as np
from pyspark.sql import functions as F

from tracewarden.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")


def brute(rows, queries, k):
    fine = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in fine:
            ranked = sorted((-float(np.dot(fine[q], v)), i) for i, v in fine.items() if i != q)
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def as_floats(x):
    return [float(np.float32(v)) for v in x]


def test_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 32)) * 0.6
    rows = [(i, as_floats(centres[i % 20] + rng.standard_normal(32))) for i in range(3000)]  # lengths differ
    want = brute(rows, range(0, 3000, 50), 20)
    got = results(ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=1000))
    assert set(got) == set(want)
    assert all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {(q, i): s for q, v in brute(rows, range(0, 3000, 50), 2999).items() for i, s in v}
    assert all(math.isclose(s, exact[(q, i)], rel_tol=1e-12, abs_tol=1e-12) for q, v in got.items() for i, s in v)


def test_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(1)
    same = as_floats(rng.standard_normal(8))
    rows = [(i, same if i % 3 == 0 else as_floats(rng.standard_normal(8))) for i in range(1200)]
    got = results(ann.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, k=10, shard_rows=100))
    want = brute(rows, range(0, 1200, 100), 10)
    for q in (0, 300, 600, 900):  # the ties of its copies go to the smaller ids
        best = [i for i, s in want[q] if s == want[q][0][1]]
        assert [i for i, _ in got[q]][: len(best)] == best


def test_few_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [-1.0, 0.25]), (0, [1.0, 0.0]), (None, [9.0, 9.0]), (8, [None, 1.0])]
    got = results(ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5), (7, -1.0)]}
    assert results(ann.nearest(frame(spark, []), F.col("vec_id") % 20 == 0)) == {}
    assert results(ann.nearest(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0)) == {}


def test_cells_are_visited_by_falling_probability():
    rng = np.random.default_rng(2)
    model = ann.Tables(rng.standard_normal((1, 5, 3)), rng.uniform(0, 1, (1, 3)), 1.0, 0.6, 0.9, 1.0)
    queries = model.lift_queries(rng.standard_normal((4, 4)))
    keys, visit = model.visits(queries, 0)
    assert (keys[:, 0] != 0).all() and visit[:, 0].all()
    assert (np.diff(visit.astype(int), axis=1) <= 0).all()  # a first stretch of the order
    assert all(k in row for k, row in zip(model.cells(queries, 0), keys))


def test_recall_outside_a_dense_cluster(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    raw = [centre + 0.3 * rng.standard_normal(32) if i % 3 == 0 else rng.standard_normal(32) for i in range(12000)]
    rows = [(i, as_floats(v / np.linalg.norm(v))) for i, v in enumerate(raw)]
    want = brute(rows, range(0, 12000, 200), 20)
    got = results(ann.nearest(frame(spark, rows), F.col("vec_id") % 200 == 0, shard_rows=4000))
    for outside in (True, False):
        asked = [q for q in want if (q % 3 > 0) == outside]
        assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in asked) / (20 * len(asked)) >= 0.9


def test_many_ties_at_the_cut_go_to_the_smaller_ids():
    points = np.concatenate([[[1.0, 1.0, 0.0]], np.column_stack([np.zeros((500, 2)), np.arange(1, 501)])])
    ids = [np.array([1000]), *[np.array([500 - i]) for i in range(500)]]
    got = list(ann._best(np.array([[1.0, 1.0, 0.0]]), [1000], None, points, ids, 20))
    assert got == [(1000, i, 0.0) for i in range(1, 21)]
