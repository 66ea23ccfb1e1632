"""A bounded, stated sample of labelled rows, and the held-out fold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Bytes of text that a sample holds at most; a parameter of its users.
MOST_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, text, y) of at most ``most`` labelled rows outside the held-out fold: those with
    the least hash of their id, as long as their texts together have at most ``most_bytes``
    bytes. The ids are broadcast, ``most`` of them at most. A row labelled twice counts as 1
    if either label is; labels that are null or not 0 or 1 are ignored."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = own.join(F.broadcast(chosen), "id")
    # rows of one id, if there are several, stand by their texts
    line = Window.orderBy(F.xxhash64("id"), "id", "text")
    size = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(line)
    return sample.withColumn("upto", size).where(F.col("upto") <= most_bytes).drop("upto")


def train_in_one_task(sample: DataFrame, train) -> bytes:
    """Run ``train(ids, texts, labels) -> bytes`` over a bounded sample in a single task."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(rows) if rows else pa.table({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "y": pa.array([], pa.int32())})
        table = table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        model = train(table.column("id").to_numpy(), table.column("text"), table.column("y").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    # the sample's window has put its rows into one partition
    rows = sample.select("id", "text", "y").coalesce(1).mapInArrow(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else train(*_nothing())


def _nothing():
    import numpy as np

    return np.zeros(0, np.int64), pa.chunked_array([pa.array([], pa.string())]), np.zeros(0)
