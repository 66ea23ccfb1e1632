"""The pipeline judges rows by their texts, whatever ids they share."""

from __future__ import annotations

import random


def test_rows_that_share_an_id(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = [" ".join(word() for _ in range(80)) for _ in range(9)]
    rows = [(1, text[0]), (1, text[1]), (1, "short"), (2, text[2]), (2, text[2]), (3, text[2]), (None, text[3]), (None, text[4]), (None, "short"), (None, text[4]), (None, text[0])]
    rows += [(4, text[5]), (4, text[6]), (5, text[6]), (None, None)]
    schema = "doc_id long, text string, lang string, source string, row_key string"
    spark.createDataFrame([(i, t, "en", "s", "own") for i, t in rows], schema).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    good = P.quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    found = sorted(((r["doc_id"], r["text"]) for r in good.collect()), key=key)
    assert found == sorted((r for r in rows if r[1] not in (None, "short")), key=key)
    good.write.parquet(f"{tmp_path}/good")
    left = P.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/good"), str(tmp_path))
    assert left.columns == docs.columns and {r["row_key"] for r in left.collect()} == {"own"}
    once = [(1, text[0]), (1, text[1]), (2, text[2]), (None, text[3]), (None, text[4]), (4, text[5]), (4, text[6])]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=key) == sorted(once, key=key)
