"""Chains, judges, caches and throttles against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import chunking, judging, providers
from lumenfold.streaming import state as S


def test_retries():
    waits = []

    def fails(times, message):
        left = [times]

        def call(x):
            left[0] -= 1
            if left[0] >= 0:
                raise RuntimeError(message)
            return x

        return call

    run = lambda times, message: providers.retrying(fails(times, message), sleep=waits.append)(5)
    assert run(0, "") == (5, None, 1, 0.0)
    assert run(3, "HTTP 429") == (5, None, 4, 14.0) and waits == [2, 4, 8]
    assert run(9, "quota exceeded") == (None, "quota exceeded", 6, 62.0)
    assert run(1, "no such model") == (None, "no such model", 1, 0.0)


def test_job_states(spark):
    rows = [("a", None, None, True), ("b", 1, "security_scan", True), ("b", 2, "extract", False), ("b", 3, "chunk", True), ("c", 1, "extract", True), ("c", 2, "other", False)]
    rows += [("d", k, s, True) for k, s in enumerate(S.STAGES)] + [("e", 1, "security_scan", False)]
    frame = spark.createDataFrame(rows, "job_id string, seq long, stage string, ok boolean")
    found = {r["job_id"]: (r["state"], r["stage"]) for r in S.job_states(frame).collect()}
    assert found == {"a": ("queued", None), "b": ("failed", "extract"), "c": ("queued", None), "d": ("completed", "index"), "e": ("failed", "security_scan")}


def test_report_is_read_as_written(spark):
    odd = ["a | b", "back\\slash", "\\| \\\\|", "line\nend", "| x |", "", " | ", "\\n"]
    rows = [(k, q, k / 7, None if k % 2 else 3.0, None if k % 3 else "failed") for k, q in enumerate(odd)]
    frame = spark.createDataFrame(rows, "id long, question string, retriever_hit_at_k double, chunk_f1 double, status string")
    for c in judging.REPORT_CELLS:
        if c not in frame.columns:
            frame = frame.withColumn(c, F.lit(None).cast("double"))
    back = {int(r["id"]): r for r in judging.read_report(judging.report_markdown(frame).withColumnRenamed("line", "text")).collect()}
    assert {k: r["question"] for k, r in back.items()} == {k: q for k, q in enumerate(odd) if k % 3}
    assert all(r["retriever_hit_at_k"] == round(k / 7, 4) and r["faithfulness"] is None for k, r in back.items())


def test_packing_as_by_the_letter():
    """Children against a version that tries every tail."""

    def tails(units, most):
        return next(units[k:] for k in range(len(units) + 1) if k == len(units) or len("\n\n".join(units[k:])) <= most)

    rng = random.Random(2)
    for _ in range(300):
        units = ["x" * rng.randint(1, 60) for _ in range(rng.randint(0, 12))]
        size, overlap = rng.randint(20, 90), rng.choice([0, 5, 20, 40])
        out, now = [], []
        for u in units:
            if not now or len("\n\n".join([*now, u])) <= size:
                now = [*now, u]
                continue
            out.append("\n\n".join(now))
            last = (tails(now, overlap) or now[-1:]) if overlap > 0 else []
            now = [*tails(last, size - 2 - len(u)), u]
        assert chunking.packed(units, size, overlap) == (out + ["\n\n".join(now)] if now else out)


def test_configuration(spark, tmp_path):
    from lumenfold.schemas import EngineConfig

    assert EngineConfig.load(spark, f"{tmp_path}/none.json") == EngineConfig()
    (tmp_path / "bad.json").write_text("{oops")
    assert EngineConfig.load(spark, f"{tmp_path}/bad.json") == EngineConfig()
    (tmp_path / "good.json").write_text('{"chunk_size": 7, "other": 1}')
    assert EngineConfig.load(spark, f"{tmp_path}/good.json") == EngineConfig(chunk_size=7)


def test_unknown_labels_are_an_error(spark):
    from lumenfold.operators.metrics import join_labels

    truth = spark.createDataFrame([(1,), (2,)], "id long")
    assert join_labels(spark.createDataFrame([(1, 0)], "id long, y int"), truth).count() == 1
    with pytest.raises(ValueError):
        join_labels(spark.createDataFrame([(3, 0)], "id long, y int"), truth)


def test_dense_ties_and_partitions(spark):
    """Equal scores rank by id, in any partition; nulls and no queries give nothing."""
    from lumenfold.operators.retrieval import dense_pool

    vectors = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [0.6, 0.8]) for k in range(50)] + [(99, None)], "chunk_id long, vector array<float>").repartition(7)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None)], "query_id long, query_vector array<float>")
    found = dense_pool(vectors, queries, 30).collect()
    ranked = {q: [r["chunk_id"] for r in sorted(found, key=lambda r: r["dense_rank"]) if r["query_id"] == q] for q in (1, 2)}
    odd, even = list(range(1, 50, 2)), list(range(0, 50, 2))
    assert ranked == {1: [*odd, *even[:5]], 2: [*even, *odd[:5]]}
    assert dense_pool(vectors, queries.limit(0), 3).count() == 0
