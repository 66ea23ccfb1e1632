"""Registered queries over whole tables: no id subset of their input."""

from __future__ import annotations

import duckdb
import pytest

from lumenfold.operators import dense
from lumenfold.plans import catalog

RARE = {3: "alpha river", 17: "granite moss", 240: "copper lantern"}


@pytest.fixture
def searched(spark, tmp_path):
    """Three benchmark items, two of ids beyond nine, each with a text of its own to find."""
    docs = [(k, f"{text} among other things", "en", "s") for k, text in RARE.items()] + [(500, "nothing alike here", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(RARE.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = [(k, [1.0 if j == n else 0.0 for j in range(4)]) for n, k in enumerate([*RARE, 500])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["retrieve_keyword", "retrieve_hybrid", "retrieve_dense", "topk_dense", "agg_exact_chunk_metrics", "agg_retrieval_metrics", "rag_trace"])
def test_all_benchmark_items_are_searched(spark, searched, name):
    """As the SQL finds without its filter on item ids."""
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{searched}/{table}.parquet/*.parquet'")
    oracle = con.sql(catalog.ORACLE_SQL[name].replace(" WHERE b.item_id < 10", ""))
    frame = catalog.QUERIES[name](spark, searched)
    columns = sorted(frame.columns)
    at = [oracle.columns.index(c) for c in columns]
    plain = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in oracle.fetchall())
    assert {r["query_id"] for r in frame.collect()} == set(RARE)


def test_small_blocks_and_parts_of_balls(spark, searched, monkeypatch):
    before = sorted(map(tuple, catalog.QUERIES["topk_dense"](spark, searched).collect()))
    monkeypatch.setattr(dense, "PART_ROWS", 5)
    monkeypatch.setattr(dense, "BLOCK", 2)
    assert sorted(map(tuple, catalog.QUERIES["topk_dense"](spark, searched).collect())) == before


def test_all_images_are_compared(spark, tmp_path):
    """Images of any id, within their document."""
    docs = [(k, "text") for k in (0, 1, 37, 299, 300, 337, 374, 411, 740, 1000, 1037, 1480, 2220, 5000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("theta_hamming", "agg_decorative"):
        oracle = con.sql(catalog.ORACLE_SQL[name])
        frame = catalog.QUERIES[name](spark, str(tmp_path)).select(*oracle.columns)
        assert sorted(map(tuple, frame.collect())) == sorted(oracle.fetchall())
    assert {r["image_id"] for r in catalog.QUERIES["agg_decorative"](spark, str(tmp_path)).collect()} == {k for k, _ in docs}


IMAGE = "document_id string, image_id long, page_number long, phash long"


def test_a_hot_hash_makes_no_pairs_of_images(spark):
    """A hundred thousand images of one hash: their pairs would be five thousand million."""
    from lumenfold.operators import pages

    images = spark.range(100_000).selectExpr("'d' as document_id", "id as image_id", "id % 7 as page_number", "5L as phash")
    images = images.union(spark.createDataFrame([("d", 200_000, 9, 4), ("d", 200_001, 9, 1 << 40 | 0x3FF)], IMAGE))
    found = pages.decorative_images(images).groupBy("n_pages").count().collect()
    assert {r["n_pages"]: r["count"] for r in found} == {8: 100_001, 1: 1}
    found = pages.similar_images(images).groupBy("n_similar", "first_similar").count().collect()
    assert {(r["n_similar"], r["first_similar"]): r["count"] for r in found} == {(100_000, 0): 100_001, (0, 200_001): 1}


def test_images_without_hash_or_page(spark):
    from lumenfold.operators import pages

    rows = [("d", 1, 1, 5), ("d", 2, 2, 5), ("d", 3, None, 5), ("d", 4, 3, 4), ("d", 5, 1, None), ("d", 6, None, None)]
    images = spark.createDataFrame(rows, IMAGE)
    assert {r["image_id"]: r["n_pages"] for r in pages.decorative_images(images).collect()} == {1: 3, 2: 3, 3: 3, 4: 3, 5: 1, 6: 0}
    assert {r["image_id"]: (r["n_similar"], r["first_similar"]) for r in pages.similar_images(images).collect()} == {**{k: (3, 1) for k in (1, 2, 3, 4)}, 5: (0, 5), 6: (0, 6)}


def test_a_logo_of_two_documents_is_decorative_in_neither(spark):
    from lumenfold.operators import pages

    rows = [("d", 1, 1, 5), ("d", 2, 2, 4), ("e", 3, 3, 5), ("e", 4, 4, 5), ("f", 5, 1, 5), ("f", 6, 2, 7), ("f", 7, 3, 5)]
    found = pages.decorative_images(spark.createDataFrame(rows, IMAGE)).collect()
    assert {r["image_id"] for r in found if r["is_decorative"]} == {5, 6, 7}
