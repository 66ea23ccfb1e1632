"""Dense search through balls against the full product."""

from __future__ import annotations

import numpy as np
import pytest

from lumenfold.operators import dense, retrieval


def frames(spark, seed: int, clusters: int, spread: float, n: int = 1500, width: int = 12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[: n // 3] = x[0]  # a third are copies
    q = x[rng.integers(0, n, 40)] + 0.05 * rng.normal(size=(40, width))
    vectors = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)] + [(n, None, None)], "chunk_id long, vector array<double>, part string").repartition(4)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)] + [(99, None)], "query_id int, query_vector array<double>")
    return x, q, vectors, queries


@pytest.mark.parametrize(("spread", "k"), [(0.1, 8), (3.0, 40)])
def test_equals_the_full_product(spark, monkeypatch, spread, k):
    monkeypatch.setattr(dense, "PART_ROWS", 100)
    monkeypatch.setattr(dense, "BLOCK", 7)
    x, q, vectors, queries = frames(spark, 3, 20, spread)
    scores = np.round(q @ x.T, 12)
    want = {(n, int(i), r + 1) for n, s in enumerate(scores) for r, i in enumerate(np.lexsort((np.arange(len(s)), -s))[:k])}
    assert {(r["query_id"], r["chunk_id"], r["dense_rank"]) for r in retrieval.dense_pool(vectors, queries, k).collect()} == want


def test_balls_are_skipped(spark):
    x, q, vectors, queries = frames(spark, 4, 30, 0.1)
    found = dense.search_balls(dense.ball_index(vectors), queries, 8)
    formed = found.agg({"products": "sum"}).first()[0]
    assert 0 < formed < 0.5 * len(x) * len(q)


def test_fewer_vectors_than_asked_for(spark):
    _, _, vectors, queries = frames(spark, 5, 3, 0.1)
    assert retrieval.dense_pool(vectors.where("chunk_id < 5"), queries, 30).count() == 200
    assert retrieval.dense_pool(vectors.limit(0), queries, 3).count() == 0
    assert retrieval.dense_pool(vectors, queries.limit(0), 3).count() == 0
    named = vectors.selectExpr("concat('c', chunk_id) as chunk_id", "vector")
    assert retrieval.dense_pool(named, queries, 3).count() == 120
