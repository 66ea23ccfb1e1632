from pyspark.sql import functions as F

from lumenfold.operators import retrieval


def test_tasks_are_numbered_by_matches(spark, monkeypatch):
    """A posting becomes a row for each query of its token, and so counts as many times."""
    monkeypatch.setattr(retrieval, "TASK_MATCHES", 500)
    chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.concat(F.lit("apple pear word"), F.col("id") % 7).alias("chunk_text"))
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.lit("apple pear").alias("query_text"))
    index = retrieval.token_index(chunks, queries)
    found = retrieval.bm25_matches(index, queries)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    # 200 chunks, two tokens, twenty queries: 8,000 rows in sixteen tasks
    assert found.rdd.getNumPartitions() == 16
    assert found.count() == 4_000
    assert retrieval.bm25_matches(index, queries.where("false")).count() == 0
