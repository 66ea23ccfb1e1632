"""Order-dependent state per key, in batch and as Structured Streaming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _accept(times: Iterator[float], most: int, seconds: float, log: deque) -> list[bool]:
    out = []
    for t in times:
        while log and log[0] <= t - seconds:
            log.popleft()
        ok = len(log) < most
        if ok:
            log.append(t)
        out.append(ok)
    return out


def _folded(rows: DataFrame, by: str, parts: int | None, order: list[str], fold, added: str) -> DataFrame:
    """Rows of each value of ``by`` in order through a fold, a batch at a time: no history is
    held, only the fold's state of the value at hand."""
    spread = rows.repartition(parts, by) if parts else rows.repartition(by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spread.sortWithinPartitions(by, *order).mapInPandas(fold, f"{schema}, {added}")


def _seconds(times: pd.Series) -> list[float]:
    return (times.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def limit_calls(calls: DataFrame, most: int, seconds: float, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Adds ``accepted``: fewer than ``most`` accepted calls in the last ``seconds`` of the key.

    Only accepted calls count, so this is a fold, one key at a time; the state is at most
    ``most`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = object(), deque()
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], _seconds(pdf[ts]), strict=True):
                if k != now:
                    now, log = k, deque()
                out += _accept([t], most, seconds, log)
            yield pdf.assign(accepted=out)

    return _folded(calls, key, None, [ts, order], run, "accepted boolean")


def limit_calls_stream(calls: DataFrame, most: int, seconds: float, key: str = "user_id") -> DataFrame:
    """The same limiter over a stream of (key, event_id, ts), state kept per key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = deque(state.get[0] if state.exists else [])
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times = (pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        accepted = _accept(iter(times), most, seconds, log)
        state.update((list(log),))
        yield pd.DataFrame({key: k[0], "event_id": pdf["event_id"], "accepted": accepted})

    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, accepted boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, hash_col: str = "text", batch_files: int = 100, buckets: int = 64):
    """Store files' rows once by content hash in a versioned table: of each micro-batch the rows
    whose hashes the table doesn't have, for which it reads the buckets of those hashes alone. A
    batch that runs again after a failure changes nothing. Returns the started query, which
    stops when the source is drained; running it again takes only what is new."""
    from lumenfold.sources.versioned import VersionedTable

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(source)
    hashed = rows.withColumn("content_sha256", F.sha2(F.coalesce(F.col(hash_col), F.lit("")), 256))
    empty = spark.createDataFrame([], hashed.schema)
    if not VersionedTable(spark, target).versions():
        VersionedTable(spark, target).create(empty, ["content_sha256"], buckets)

    def store(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, target).merge_new(batch, (checkpoint, number))

    return hashed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# The stages of an ingestion job, in order.
STAGES = ("security_scan", "extract", "chunk", "embed", "store", "index")


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, state, stage) from a job's events (job_id, seq, stage, ok): queued without one,
    failed at the first stage that isn't ok, completed after the last, else running. What
    comes after a failure, or out of the stages' order, doesn't count."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    own = events.where(F.col("stage").isNotNull()).withColumn("place", place).where("place > 0")
    first = own.groupBy("job_id", "place").agg(F.min_by("ok", "seq").alias("ok"))
    flags = first.groupBy("job_id").agg(F.min(F.when(~F.col("ok"), F.col("place"))).alias("bad"), F.collect_set(F.when(F.col("ok"), F.col("place"))).alias("done"))
    # stages done without a gap from the first
    reach = F.size(F.filter(F.sequence(F.lit(1), F.lit(len(STAGES))), lambda k: F.forall(F.sequence(F.lit(1), k), lambda j: F.array_contains(F.col("done"), j.cast("long")))))
    jobs = events.select("job_id").distinct().join(flags.select("job_id", "bad", reach.alias("reach")), "job_id", "left")
    got = F.coalesce("reach", F.lit(0))
    failed = F.col("bad") == got + 1
    state = F.when(failed, "failed").when(got == len(STAGES), "completed").when(got == 0, "queued").otherwise("running")
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), F.when(failed, got).otherwise(got - 1).cast("int"))
    return jobs.select("job_id", state.alias("state"), stage.alias("stage"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time counts with a watermark: a Spark extra, for telemetry."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
