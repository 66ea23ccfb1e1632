"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: its query's shuffle files go as soon as it has run, as the table
#: replaces them, and Python gets batches of few bytes, which bounds both sides' buffers.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


#: Folders of tables that haven't been discarded.
_written: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local session (as in
    tests) gets a temporary one that goes with the process; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lumenfold-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lumenfold-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write once and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _settings(spark, _WRITING):
        writer.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    _written.add(path)
    return table


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


def release(spark: SparkSession) -> int:
    """Delete all tables of ``materialize`` that this process still has, once no result that
    reads one is needed. Returns how many there were."""
    left = list(_written)
    for path in left:
        _delete(spark, path)
    return len(left)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        with suppress(Exception):  # the session may have ended already
            release(spark)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if df has at most ``rows`` rows; reads no more than that many plus one."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame, bytes_each: int = 1 << 20, split: int = 128 << 20) -> DataFrame:
    """A plain scan of fewer files than there are cores, each of a single split, dealt out for
    costly work on its texts into parts of ``bytes_each`` at least; anything else as it is."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    if "Exchange" in plan or "Scan parquet" not in plan:
        return df
    files, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    size = int(str(execution.optimizedPlan().stats().sizeInBytes()))
    parts = min(cores, size // bytes_each)
    return df.repartition(parts) if files < parts and size < files * split else df
