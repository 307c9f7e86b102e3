"""Batch k-NN with more ties at the cut than k."""

import tracemalloc

import numpy as np
import pytest

from korvex.operators.batch_knn import _nearest, batch_knn


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_equal_vectors(spark, metric):
    v = [0.3, -1.7, 0.9]
    rows = [(i, v) for i in range(100, 0, -1)] + [(i, [-x for x in v]) for i in range(200, 300)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(7, [0.3, -1.7, 0.9])], "query_id long, vector array<double>")
    got = batch_knn(vectors, queries, 5, metric).collect()
    assert [(r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 6)]


def test_close_rows():
    rng = np.random.default_rng(4)
    q = rng.normal(size=(3, 16)) * 1000
    x = np.concatenate([q[0] + rng.normal(size=(300, 16)) * 1e-6, rng.normal(size=(50, 16))])
    ids = rng.permutation(len(x))
    rows, near, d = _nearest("l2", x, ids, q, 10)
    for i in range(len(q)):
        exact = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
        want = np.lexsort((ids, exact))[:10]
        assert near[rows == i].tolist() == ids[want].tolist() and (d[rows == i] == exact[want]).all()


def test_many_queries_in_block_pairs(spark, monkeypatch):
    from korvex.operators import batch_knn as B

    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:60])], "query_id long, vector array<float>")
    whole = {m: sorted(map(tuple, B.batch_knn(rows, asked, 7, m).collect())) for m in ("l2", "ip", "cosine")}
    monkeypatch.setattr(B, "QUERY_BLOCK", 16)
    monkeypatch.setattr(B, "ROW_BLOCK", 40)
    for m, want in whole.items():
        assert sorted(map(tuple, B.batch_knn(rows, asked, 7, m).collect())) == want


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_memory_of_a_block(metric):
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(8192, 8)), rng.normal(size=(1500, 8))
    tracemalloc.start()
    rows, near, d = _nearest(metric, x, np.arange(len(x)), q, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.tolist() == np.repeat(np.arange(len(q)), 5).tolist()
    assert peak < len(x) * len(q) * 8 * 0.6  # not even one matrix of all distances


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_queries_pass_by_blocks_in_groups(spark, monkeypatch, metric):
    from korvex.operators import batch_knn as B

    rng = np.random.default_rng(9)
    x = rng.integers(-2, 3, (130, 3)).astype(float)
    rows = spark.createDataFrame([(i % 65, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:50])], "query_id long, vector array<double>")
    whole = sorted(map(tuple, B.batch_knn(rows, asked, 4, metric).collect()))
    for name, value in (("QUERY_BLOCK", 8), ("ROW_BLOCK", 30), ("QUERY_STREAM", 20), ("TILE", 64)):
        monkeypatch.setattr(B, name, value)
    assert sorted(map(tuple, B.batch_knn(rows, asked, 4, metric).collect())) == whole
    assert len(whole) == 200
    odd = asked.unionByName(spark.createDataFrame([(99, [1.0, 2.0])], "query_id long, vector array<double>"))
    with pytest.raises(Exception, match="another dimension"):
        B.batch_knn(rows, odd, 4, metric).collect()


def test_recall_reads_each_side_once(spark, sf):
    from korvex.operators.batch_knn import recall_at_k
    from korvex.queries import QUERIES

    plan = QUERIES["recall_at_k"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
    pairs = "query_id long, id long"
    want = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (1, 8), (2, 5)], pairs)
    got = spark.createDataFrame([(1, 8), (1, 8), (1, 5), (1, 9), (3, 5)], pairs)
    assert sorted(map(tuple, recall_at_k(want, got).collect())) == [(1, 0.5), (2, 0.0)]
