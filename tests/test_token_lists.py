"""A chunk's tokens travel as one row, are split in batches, and are never sorted as rows."""

from pyspark.sql import functions as F

from lumenfold.functions.text import lexical_tokens
from lumenfold.operators import keyword, retrieval

ODD = ["What is the Café-bar, bar?", "ﬁne ＡＢＣ１２ x² café ㎞", "İstanbul Kelvin ẞ Ⅷ ½", "a b\tc\x00d\x85e f\U0001f600g​h", "the of and", " \n", "", None, "x" * 5000 + " end", "End END énd 1 1 01"]


def frames(spark):
    chunks = spark.createDataFrame(list(enumerate(ODD)), "chunk_id long, chunk_text string")
    queries = spark.createDataFrame([(1, "bar End fine 01"), (2, "the"), (3, None), (4, "abc12 d istanbul kelvin")], "query_id long, query_text string")
    return chunks, queries


def rows_of(index):
    return sorted(map(repr, index.select("chunk_id", "length", "token").collect()))


def test_tokens_are_those_of_the_expression(spark, monkeypatch):
    chunks, queries = frames(spark)
    own = chunks.select("chunk_id", lexical_tokens(F.col("chunk_text")).alias("tokens"))
    every = own.select("chunk_id", F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("token"))
    wanted = retrieval.query_tokens(queries).select(F.explode("query_tokens").alias("token")).distinct()
    some = every.where("token is null").unionByName(every.join(wanted, "token", "left_semi"))
    assert some.count() > len(ODD) + 5
    assert rows_of(retrieval.token_index(chunks)) == rows_of(every)
    assert rows_of(retrieval.token_index(chunks, queries)) == rows_of(some)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert rows_of(retrieval.token_index(chunks, queries)) == rows_of(some)
    assert retrieval.token_index(chunks.limit(0), queries).count() == 0


def test_a_chunk_is_one_row_and_rows_are_not_sorted(spark, monkeypatch):
    chunks, queries = frames(spark)
    plans, write = [], keyword.materialize
    monkeypatch.setattr(keyword, "materialize", lambda df: plans.append(df) or write(df))
    tokens = retrieval.token_index(chunks, queries)
    assert tokens.lists.count() == len(ODD)
    keyword.build_index(tokens)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Sort" not in plan


def test_rows_and_lists_give_one_index(spark, monkeypatch):
    chunks, queries = frames(spark)
    rows = lambda index: sorted(map(repr, index.postings.collect()))
    tokens = retrieval.token_index(chunks)
    whole = rows(keyword.build_index(tokens))
    plain = tokens.select("*")
    assert not hasattr(plain, "lists")
    assert rows(keyword.build_index(plain.orderBy(F.desc("token"), "length"))) == whole
    monkeypatch.setattr(keyword, "POSTINGS_OUT", 2)
    assert rows(keyword.build_index(tokens)) == whole
    found = lambda: sorted(map(repr, retrieval.retrieve_keyword(chunks, queries, 3).collect()))
    before = found()
    monkeypatch.setattr(keyword, "SHARD_POSTINGS", 2)
    assert keyword.build_index(tokens).shards > keyword.LEAST_SHARDS
    assert found() == before and before
