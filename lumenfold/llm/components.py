"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import discard, materialize

#: Edges that a task contracts at once: bounds its memory, and never the result.
HELD = 1 << 19


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex) of each vertex of these edges that isn't its component's least."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= HELD:
            u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(u) > HELD // 2:
                yield out(u, v)
                held, size = [], 0
            else:
                held, size = [(u, v)], len(u)
    if size:
        yield out(*stars(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars around least vertices; nothing moves."""
    return materialize(edges.select("u", "v").mapInArrow(_contract, "u long, v long"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of integer vertices -> (id, component) with the smallest id of each
    component, one row per vertex that has an edge to another vertex.

    Partitions contract their edges to stars from larger to least vertices. Then, in rounds,
    a vertex with several parents hangs the others on the least, parents that have parents
    themselves are replaced by those, and partitions contract again. A vertex is a child once
    a partition at most, so no key gathers a large star; what is joined to parents are only
    those that are children, too. Only three numbers a round reach the driver.

    The result reads one scratch table, which ``discard`` deletes with it.

    Null ends and loops are dropped; repeated edges don't matter; an empty table gives an
    empty one.
    """
    now = _contracted(
        edges.where("u is not null and v is not null and u <> v").select(
            F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
        )
    )
    while True:
        first = now.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        children = first.agg(F.count_if(F.col("n") > 1)).first()[0]
        if children:
            least = materialize(first.select("u", "m"))
            moved = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            hung = _contracted(least.select("u", F.col("m").alias("v")).union(moved))
            discard(now, least)
            now = hung
        parents = now.select(F.col("v").alias("u")).distinct()
        higher = materialize(now.groupBy("u").agg(F.min("v").alias("m")).join(parents, "u", "left_semi").select(F.col("u").alias("v"), "m"))
        if not higher.limit(1).count():
            discard(higher)
            if children:
                continue
            break
        raised = _contracted(now.join(higher, "v", "left").select("u", F.coalesce("m", "v").alias("v")))
        discard(now, higher)
        now = raised
    roots = now.select(F.col("v").alias("id")).distinct()
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
    found.scratch_path = now.scratch_path
    return found
