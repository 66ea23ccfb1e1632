"""Block-max keyword retrieval against all matching pairs."""

from __future__ import annotations

import random

import pytest

from lumenfold.operators import keyword, retrieval


def frames(spark, n: int, seed: int = 1):
    """Texts with common, rare and hot words, of many lengths, copies and empty ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(n):
        size = rng.choice([0, 1, 3, 8, 20, 60, 150])
        texts.append(" ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(size)) + (" hot" if k % 3 else ""))
    texts += [texts[3]] * 30 + [None]
    asked = [" ".join(rng.choice(words[:300]) for _ in range(rng.randint(1, 12))) for _ in range(25)] + ["hot", "hot w1 w2 w3", "", "unknown words", "the of"]
    chunks = spark.createDataFrame([(k, k, t, "x") for k, t in enumerate(texts)], "chunk_id long, document_id long, chunk_text string, token string").repartition(5)
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(asked)], "query_id string, query_text string")
    return chunks, queries


@pytest.mark.parametrize("k", [1, 40])
def test_same_rows_as_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(keyword, "BLOCK", 16)
    chunks, queries = frames(spark, 900)
    want = retrieval.top_k(retrieval.bm25_scores(chunks, queries), "bm25_score", k)
    got = retrieval.retrieve_keyword(chunks, queries, k)
    rows = lambda f: sorted((r["query_id"], r["rank"], r["chunk_id"], r["bm25_score"]) for r in f.collect())
    assert rows(got) == rows(want)


def test_fewer_postings_than_pairs(spark, monkeypatch):
    monkeypatch.setattr(keyword, "BLOCK", 16)
    monkeypatch.setattr(keyword, "LEAST_SHARDS", 2)
    chunks, queries = frames(spark, 4000, 2)
    tokens = retrieval.token_index(chunks, queries)
    pairs = retrieval.bm25_matches(tokens, queries)
    n_pairs, n_postings = pairs.count(), pairs.agg({"n_common": "sum"}).first()[0]
    index = keyword.build_index(tokens)
    found = keyword.searched(index, retrieval.query_tokens(queries), 8)
    scored = found.agg({"scored": "sum"}).first()[0]
    assert scored < n_pairs < n_postings
    # lists hold every posting, blocks their least length
    stored = index.postings.where("token is not null")
    assert stored.selectExpr("sum(size(docs))").first()[0] == tokens.where("token is not null").count()
    assert stored.where("size(heads) <> ceil(size(docs) / 16)").count() == 0


def test_queries_split_over_tasks(spark, monkeypatch):
    chunks, queries = frames(spark, 15, 3)
    rows = lambda: sorted(tuple(r) for r in retrieval.retrieve_keyword(chunks, queries, 8).collect())
    before = rows()
    monkeypatch.setattr(keyword, "TASK_QUERIES", 7)
    monkeypatch.setattr(keyword, "LEAST_SHARDS", 25)
    assert rows() == before


def test_empty_tables(spark):
    chunks, queries = frames(spark, 20)
    assert retrieval.retrieve_keyword(chunks.limit(0), queries).count() == 0
    assert retrieval.retrieve_keyword(chunks, queries.limit(0)).count() == 0


def test_text_ids(spark):
    chunks, queries = frames(spark, 60)
    named = chunks.selectExpr("concat('c', chunk_id) as chunk_id", "document_id", "chunk_text")
    want = retrieval.top_k(retrieval.bm25_scores(named, queries), "bm25_score", 5)
    rows = lambda f: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in f.collect())
    assert rows(retrieval.retrieve_keyword(named, queries, 5)) == rows(want)
