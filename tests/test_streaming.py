"""Stateful operators: batch folds, and streams that equal them."""

from __future__ import annotations

import datetime

from lumenfold.sources import readers, sinks
from lumenfold.sources.versioned import VersionedTable
from lumenfold.streaming import state


def calls(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    times = [0, 1, 2, 9, 10, 11, 11, 30]
    return spark.createDataFrame([("u", k, at(s), k % 2 == 0) for k, s in enumerate(times)], "user_id string, event_id long, ts timestamp, failed boolean")


def test_limiter(spark):
    rows = calls(spark)
    got = [r["accepted"] for r in state.limit_calls(rows, 2, 10.0).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True, False, True]
    assert not any(r["accepted"] for r in state.limit_calls(rows, 0, 10.0).collect())


def test_limiter_stream(spark, tmp_path):
    calls(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(calls(spark).schema).parquet(f"{tmp_path}/in")
    query = state.limit_calls_stream(stream, 2, 10.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["accepted"] for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False, False, True, True, False, True]


def test_ingest(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    args = (spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/check")
    state.ingest_stream(*args).awaitTermination(120)
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    state.ingest_stream(*args).awaitTermination(120)
    assert sorted(r["text"] for r in VersionedTable(spark, f"{tmp_path}/out").read().collect()) == ["a", "b", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"text")
    files = readers.read_files(spark, str(tmp_path)).select("path", "length", "content")
    empty = spark.createDataFrame([("x/d.docx", 0, bytearray())], files.schema)
    got = {r["path"].rsplit("/", 1)[1]: r["rejected"] for r in readers.upload_gate(files.union(empty)).collect()}
    assert got == {"a.PDF": None, "b.pdf": "magic", "c.txt": "format", "d.docx": "empty"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "p", "x"), ("u2", "p", "y")], "user_id string, project_id string, chunk_text string")
    sinks.write_chunks(rows, f"{tmp_path}/chunks")
    sinks.write_chunks(rows.where("user_id = 'u1'").withColumn("chunk_text", rows["user_id"]), f"{tmp_path}/chunks")
    assert {(r["user_id"], r["chunk_text"]) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()} == {("u1", "u1"), ("u2", "y")}
    report = spark.createDataFrame([(1, "q", 0.5)], "id int, question string, faithfulness double")
    sinks.append_report(report, f"{tmp_path}/report")
    sinks.append_report(report, f"{tmp_path}/report")
    back = spark.read.option("header", "true").csv(f"{tmp_path}/report")
    assert back.columns == list(sinks.REPORT_COLUMNS) and back.count() == 2
    assert sinks.write_index(rows, f"{tmp_path}/index").first()["n_chunks"] == 2
