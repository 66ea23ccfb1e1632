"""Scratch tables and files of lists."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lumenfold import scratch
from lumenfold.operators import judging
from lumenfold.sources import readers, sinks


def test_tables_go_when_they_are_released(spark):
    scratch.release(spark)
    a, b = (scratch.materialize(spark.range(k)) for k in (3, 4))
    here = lambda t: os.path.exists(t.scratch_path.removeprefix("file://"))
    assert a.count() == 3 and here(a) and here(b)
    scratch.discard(a)
    assert not here(a) and b.count() == 4
    assert scratch.release(spark) == 1 and not here(b) and scratch.release(spark) == 0


def test_lists_are_written_as_rows_come(spark, tmp_path):
    rows = spark.range(100).where("id < 60").repartition(7, "id").select(F.to_json(F.struct(F.concat(F.lit("line\n\""), "id").alias("chunk_text"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("metadata"))).alias("value"))
    sinks.write_json_lists(rows, f"{tmp_path}/lists")
    back = readers.read_chunks_json(spark, f"{tmp_path}/lists")
    assert {r["chunk_text"] for r in back.collect()} == {f'line\n"{k}' for k in range(60)}
    assert {r["metadata"]["k"] for r in back.where("metadata is not null").collect()} == {str(k) for k in range(60)}
    sinks.write_json_lists(rows.limit(0), f"{tmp_path}/none")
    assert readers.read_chunks_json(spark, f"{tmp_path}/none").count() == 0


def test_a_report_is_sorted_parts(spark, tmp_path):
    rows = spark.range(50).select(F.format_string("%03d", "id").alias("id"), F.lit("q").alias("question"), F.lit("completed").alias("status"), *[F.lit(0.5).alias(c) for c in judging.REPORT_CELLS], F.lit(None).cast("string").alias("error")).repartition(5)
    judging.write_report(rows, f"{tmp_path}/report")
    parts = sorted(p for p in os.listdir(f"{tmp_path}/report") if p.startswith("part-"))
    text = "".join(open(f"{tmp_path}/report/{p}").read() for p in parts)
    lines = text.rstrip("\n").split("\n")
    assert lines[0] == "# Evaluation" and [x.split(" | ")[0] for x in lines[-50:]] == [f"| {k:03d}" for k in range(50)]
    assert judging.read_report(spark.read.text(f"{tmp_path}/report").withColumnRenamed("value", "text")).count() == 50
