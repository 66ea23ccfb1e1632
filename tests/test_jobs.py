"""Ingestion jobs: the guard, the stages, and the stream against the batch."""

from __future__ import annotations

import datetime
import os
import random
import time

from pyspark.sql import functions as F

from lumenfold.streaming import jobs
from lumenfold.streaming.state import STAGES

START = datetime.datetime(2024, 1, 1)


def events(spark, rows):
    """(scope, seconds, job, file, content, stage, ok), numbered in order."""
    return spark.createDataFrame([(s, n, START + datetime.timedelta(seconds=at), j, f, c, stage, ok) for n, (s, at, j, f, c, stage, ok) in enumerate(rows)], jobs.EVENT)


def sent(job, file, content=None, scope="u", at=0):
    return (scope, at, job, file, content, None, None)


def done(job, stage, ok=True, scope="u", at=0):
    return (scope, at, job, None, None, stage, ok)


def run(spark, rows, stale=100.0):
    return [(r["status"], r["reason"]) for r in jobs.job_outcomes(events(spark, rows), stale).orderBy("seq").collect()]


def test_duplicates_under_way_are_refused(spark):
    rows = [sent("a", "f1", "c1"), sent("b", "f1", "c2"), sent("c", "f2", "c1"), sent("d", None, None), sent("a", "f9"), sent("e", "f1", scope="other")]
    assert run(spark, rows) == [("queued", None), ("refused", "file is under way"), ("refused", "content is under way"), ("queued", None), ("refused", "job is under way"), ("queued", None)]


def test_a_failure_frees_and_a_completion_keeps(spark):
    rows = [sent("a", "f1", "c1"), done("a", "security_scan"), done("a", "extract", False), sent("b", "f1", "c1")]
    rows += [done("b", s) for s in STAGES] + [sent("c", "f1"), sent("d", "f2", "c1"), done("b", "index"), done("zz", "extract"), sent("e", "f3"), done("e", "chunk")]
    got = run(spark, rows)
    assert got[:4] == [("queued", None), ("running", "security_scan"), ("failed", "extract"), ("queued", None)]
    assert got[4:10] == [("running", s) for s in STAGES[:-1]] + [("completed", "index")]
    assert got[10:] == [("refused", "file is known"), ("refused", "content is known"), ("ignored", "no such job"), ("ignored", "no such job"), ("queued", None), ("ignored", "stage is out of order")]


def test_stale_jobs_free_their_hashes(spark):
    rows = [sent("a", "f1"), sent("b", "f1", at=99), sent("c", "f1", at=100), done("a", "security_scan", at=101), done("c", "security_scan", at=300)]
    assert run(spark, rows) == [("queued", None), ("refused", "file is under way"), ("queued", None), ("ignored", "no such job"), ("failed", "stale")]


def many(spark, n=400):
    rng = random.Random(8)
    rows, at = [], 0
    for k in range(n):
        at += rng.randint(0, 8)
        scope = "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}"
        if rng.random() < 0.4:
            rows.append(sent(f"j{rng.randrange(60)}", rng.choice([None, *(f"f{x}" for x in range(12))]), rng.choice([None, "c1", "c2", "c3"]), scope, at))
        else:
            rows.append(done(f"j{rng.randrange(60)}", rng.choice(STAGES[: 1 + k % 6]), rng.random() < 0.9, scope, at))
    return events(spark, rows)


def test_stream_and_batch_agree(spark, tmp_path):
    rows = many(spark)
    want = {(r["scope"], r["seq"]): (r["status"], r["reason"]) for r in jobs.job_outcomes(rows, 120.0).collect()}
    assert len({s for s, _ in want.values()}) >= 4
    # two runs of a query on one checkpoint, several micro-batches each
    for part, cond in enumerate(("seq < 250", "seq >= 250")):
        for lo in range(0, 400, 125):
            piece = rows.where(cond).where((F.col("seq") >= lo) & (F.col("seq") < lo + 125)).coalesce(1)
            if not piece.isEmpty():
                piece.write.parquet(f"{tmp_path}/in/{part}-{lo}")
        stream = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        with jobs.keyed_store(spark):
            q = jobs.job_outcomes_stream(stream, 120.0, timers=False).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = {(r["scope"], r["seq"]): (r["status"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def test_timers_end_silent_jobs(spark, tmp_path):
    events(spark, [sent("a", "f1"), sent("b", "f2")]).coalesce(1).write.parquet(f"{tmp_path}/in/1")

    stream = spark.readStream.schema(jobs.EVENT).parquet(f"{tmp_path}/in/*")
    with jobs.keyed_store(spark):
        q = jobs.job_outcomes_stream(stream, 0.5, keep=3600.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    late, until = set(), time.time() + 90
    while len(late) < 2 and q.isActive and time.time() < until:
        time.sleep(2)
        if os.path.exists(f"{tmp_path}/out/_spark_metadata"):
            rows = spark.read.schema("scope string, seq long, job_id string, status string, reason string").parquet(f"{tmp_path}/out").collect()
            late = {(r["job_id"], r["status"], r["reason"]) for r in rows if r["scope"] == "u" and r["seq"] == -1}
    q.stop()
    assert late == {("a", "failed", "stale"), ("b", "failed", "stale")}
