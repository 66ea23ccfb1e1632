"""Centroid clustering with Elkan's bounds (operator 11).

A round is one pass over a written table that holds each vector with its centroid, an upper
bound of the distance to it and a lower bound of the distance to every centroid. Bounds move
with the centroids, and with the distances between centroids they show which products of a
vector and a centroid need no look. Bounds are rounded away from what they bound and prune
only where they are strictly apart, so a tie is always decided by exact integer distances.

The driver holds the centroids alone: at most ``k`` vectors of fixed length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import discard, materialize, spread

#: Components of this size or more would let a squared distance leave a long.
MOST = 1 << 27
#: Relative error that bounds are widened by; a distance in doubles has far less.
SLACK = 1e-12


def _down(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, never above x, never below 0."""
    return np.maximum(np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distances of all centroids, rounded down; its own is infinite."""
    k = len(centroids)
    half = np.full((k, k), np.inf)
    for c in range(k):
        half[c] = np.sqrt(_squared(centroids, centroids[c]).astype(np.float64)) * (0.5 - SLACK)
        half[c, c] = np.inf
    return half


def assign(vectors: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray | None):
    """One pass of Elkan's assignment over a block; own, upper and lower are changed in place.
    Returns how many distances each vector took."""
    n, k = lower.shape
    if moved is not None:
        upper += moved[own] * (1 + SLACK)
        upper *= 1 + SLACK
        lower[:] = _down(lower.astype(np.float64) - moved)
    half = between(centroids)
    nearest = half.min(axis=1)
    exact = np.zeros(n, dtype=np.int64)
    tight = np.zeros(n, dtype=bool)
    took = np.zeros(n, dtype=np.int32)

    def tighten(rows: np.ndarray) -> None:
        rows = rows[~tight[rows]]
        exact[rows] = _squared(vectors[rows], centroids[own[rows]])
        distance = np.sqrt(exact[rows].astype(np.float64))
        upper[rows], lower[rows, own[rows]], tight[rows] = distance * (1 + SLACK), _down(distance), True
        took[rows] += 1

    open_rows = np.flatnonzero(upper >= nearest[own])
    for c in range(k):
        may = lambda rows, c=c: rows[(own[rows] != c) & (upper[rows] >= lower[rows, c]) & (upper[rows] >= half[own[rows], c])]
        rows = may(open_rows)
        tighten(rows)
        rows = may(rows)
        if not len(rows):
            continue
        found = _squared(vectors[rows], centroids[c])
        took[rows] += 1
        distance = np.sqrt(found.astype(np.float64))
        lower[rows, c] = _down(distance)
        better = (found < exact[rows]) | ((found == exact[rows]) & (c < own[rows]))
        rows = rows[better]
        own[rows], exact[rows], upper[rows] = c, found[better], distance[better] * (1 + SLACK)
    return took


_STATE = "{id}, v array<int>, own int, upper double, lower array<float>, took int"


def _matrix(column: pa.ListArray, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind).reshape(-1, width)


def _round(centroids: np.ndarray, moved: np.ndarray | None, first: bool):
    """State of all vectors against new centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = _matrix(batch.column(1), width, np.int64)
            if first:
                own, upper, lower = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros((n, k), dtype=np.float32)
            else:
                own, upper, lower = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy(), _matrix(batch.column(4), k, np.float32)
            took = assign(vectors, own, upper, lower, centroids, moved)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(upper), bounds, pa.array(took)], names=[batch.schema.names[0], "v", "own", "upper", "lower", "took"])

    return run


def _sums(width: int, k: int):
    """Per task: number and sums of each centroid's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            own = batch.column(1).to_numpy()
            np.add.at(sums, own, _matrix(batch.column(0), width, np.int64))
            n += np.bincount(own, minlength=k)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists], names=["own", "n", "sums"])

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy()
            exact = _squared(_matrix(batch.column(1), centroids.shape[1], np.int64), centroids[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(exact)], names=[batch.schema.names[0], "cluster", "distance"])

    return run


def elkan_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, passes: list | None = None) -> DataFrame:
    """Cluster the vectors of ``width`` components by ``rounds`` of assignment and update, then
    assign once more. Components are floor(scale * x), centroids exact floors of means.

    Returns id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256. Rows
    whose vector is null, of another length, or holds a null, a NaN, an infinity or a component
    of 2^27 or more once scaled take no part. Centroids start as the vectors with the smallest
    sha256 of ``seed:id``, equal hashes (a repeated id) by vector; a null id has no hash and
    comes last. Equal vectors each count, ties go to the smaller centroid; fewer vectors than
    ``k`` give fewer centroids, none an empty result. Other columns are ignored. ``passes``
    gets (vectors, distances taken) of each pass appended, which costs a job each.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    scaled = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST / scale)
    kept = vectors.where((F.size(vector_col) == width) & F.forall(vector_col, fine)).select(F.col(id_col), scaled.cast("array<int>").alias("v"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    start = kept.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    schema = _STATE.format(id=f"`{id_col}` {id_type}")
    if not start:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    k = len(centroids)

    def one_pass(state: DataFrame | None, moved: np.ndarray | None) -> DataFrame:
        out = materialize((spread(kept) if state is None else state).mapInArrow(_round(centroids, moved, state is None), schema))
        if state is not None:
            discard(state)
        if passes is not None:
            passes.append(tuple(out.agg(F.count(F.lit(1)), F.sum("took")).first()))
        return out

    state, moved = None, None
    for _ in range(rounds):
        state = one_pass(state, moved)
        sums = state.select("v", "own").mapInArrow(_sums(width, k), "own int, n long, sums array<long>")
        parts = sums.select("own", "n", F.posexplode("sums").alias("pos", "x")).groupBy("own", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        after = centroids.copy()
        for r in parts.collect():  # k times width rows, whatever the input
            after[r["own"], r["pos"]] = r["x"] // r["n"]
        moved = np.sqrt(_squared(after, centroids).astype(np.float64)) * (1 + SLACK)
        centroids = after
    state = one_pass(state, moved)
    final = materialize(state.mapInArrow(_distances(centroids), f"`{id_col}` {id_type}, cluster int, distance long"))
    discard(state)
    digests = [(c, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    per = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in per)
    known = {r["cluster"]: r["cluster_inertia"] for r in per}
    table = spark.createDataFrame([(c, known.get(c, 0), inertia, d) for c, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(table), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
