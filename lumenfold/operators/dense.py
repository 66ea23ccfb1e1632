"""Exact nearest vectors by dot product, with vectors dealt to pivots and balls that are skipped.

Vectors go to the nearest of at most ``PIVOTS`` sampled pivots. No vector of a ball with centre
c and radius r has a larger product with q than q.c + |q| r, so a ball whose bound lies under
the query's running k-th score is never opened. Queries first meet the balls nearest to them,
which gives them that score, and then those that are left; they move as rows, as vectors do,
and a task holds one part of one ball and a block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfold.scratch import discard, materialize

#: Pivots at most; vectors of one part of a ball, about; queries that meet it together.
PIVOTS, PART_ROWS, BLOCK = 256, 8_192, 256
#: What rounding may add to a product or a bound.
SLACK = 1e-9


@dataclass
class Balls:
    """``pivots`` (n, width), ``sizes`` and ``radii`` of the balls, and ``parts``, the first part
    of each and behind them the number of all."""

    pivots: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    parts: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, balls): no product is larger."""
        return queries @ self.pivots.T + np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None] * self.radii[None, :] + SLACK

    def nearest(self, queries: np.ndarray, k: int) -> np.ndarray:
        """(queries, balls): those nearest to a query that hold k vectors together."""
        order = np.argsort(-(queries @ self.pivots.T), axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out


@dataclass
class BallIndex:
    """``rows``: part, chunk_id, vector; and what their balls are."""

    rows: DataFrame
    balls: Balls

    def discard(self) -> None:
        discard(self.rows)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def ball_index(vectors: DataFrame, pivots: int = PIVOTS) -> BallIndex:
    """Deal (chunk_id, vector) to balls. Null vectors take no part; all others have one length.
    The driver gets the pivots, a sample by hash, and a count and a radius of each."""
    own = vectors.where("vector is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    n = own.count()
    some = max(1, min(pivots, int(n**0.5)))
    # of copies in the sample one is a pivot
    sample = list(dict.fromkeys(tuple(r["vector"]) for r in own.select("vector").orderBy(F.xxhash64("chunk_id"), "vector").limit(4 * some).collect()))[:some]
    if not sample:
        none = np.zeros(0, dtype=np.int64)
        return BallIndex(materialize(own.select(F.lit(0).alias("part"), "chunk_id", "vector")), Balls(np.zeros((0, 0)), none, np.zeros(0), np.zeros(1, dtype=np.int64)))
    centres = np.array(sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            squared = np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ centres.T + np.einsum("ij,ij->i", centres, centres)[None, :]
            ball = np.argmin(squared, axis=1)
            gap = np.sqrt(((x - centres[ball]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball.astype(np.int32)), pa.array(gap)], names=["chunk_id", "vector", "ball", "gap"])

    kind = own.schema["chunk_id"].dataType.simpleString()
    dealt = materialize(own.mapInArrow(assign, f"chunk_id {kind}, vector array<double>, ball int, gap double"))
    sizes, radii = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for r in dealt.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).collect():
        sizes[r["ball"]], radii[r["ball"]] = r["n"], r["r"]
    counts = -(-sizes // PART_ROWS)
    parts = np.concatenate([[0], np.cumsum(counts)])
    first = F.array(*[F.lit(int(x)) for x in parts[:-1]])
    wide = F.array(*[F.lit(int(max(x, 1))) for x in counts])
    at = F.col("ball") + 1
    part = F.element_at(first, at) + F.pmod(F.xxhash64("chunk_id"), F.element_at(wide, at)).cast("int")
    rows = dealt.select(part.alias("part"), "chunk_id", "vector")
    rows.scratch_path = dealt.scratch_path
    return BallIndex(rows, Balls(centres, sizes, radii, parts))


def _choose(index: Balls, k: int, again: bool):
    """Queries to the parts of the balls that they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = _matrix(batch.column(1))
            near = index.nearest(queries, k)
            if again:
                least = batch.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                near = ~near & (index.bounds(queries) >= least[:, None] - SLACK)
            near &= index.sizes[None, :] > 0
            who, ball = np.nonzero(near)
            width = np.diff(index.parts)[ball]
            who = np.repeat(who, width)
            part = np.repeat(index.parts[ball], width) + np.arange(len(who)) - np.repeat(np.cumsum(width) - width, width)
            for a in range(0, len(who), 4096):
                some = pa.array(who[a : a + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 4096].astype(np.int32)), batch.column(0).take(some), batch.column(1).take(some)], names=["part", "query_id", "vector"])

    return run


def _best(scores: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by rank."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((rank[some], -scores[some]))][:k]


def _opened(k: int, id_type: pa.DataType, query_type: pa.DataType):
    """Rows of a task in order: a part's vectors, then the queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fresh = None, False
        ids: list[pa.Array] = []
        vectors: list[np.ndarray] = []
        rank = np.zeros(0, dtype=np.int64)

        def meet(who: pa.Array, queries: np.ndarray) -> pa.RecordBatch:
            # equal vectors have equal scores wherever they stand in a block
            scores = np.round(queries @ vectors[0].T, 12)
            own = [_best(s, rank, k) for s in scores]
            sizes = [len(x) for x in own]
            every = np.concatenate(own)
            owner = np.repeat(np.arange(len(own)), sizes)
            columns = [who.take(pa.array(owner)), ids[0].take(pa.array(every)), pa.array(scores[owner, every]), pa.array(np.zeros(len(every), dtype=np.int64))]
            count = [who, pa.nulls(len(who), id_type), pa.nulls(len(who), pa.float64()), pa.array(np.full(len(who), scores.shape[1]))]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(columns, count, strict=True)], names=["query_id", "chunk_id", "dense_score", "products"])

        for batch in batches:
            parts = batch.column(0).to_numpy()
            asked = batch.column(1).to_numpy()  # 0: a vector, 1: a query
            key = parts.astype(np.int64) * 2 + asked
            cuts = np.flatnonzero(np.diff(key)) + 1
            for a, z in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
                if a == z:
                    continue
                x = _matrix(batch.column(4).slice(a, z - a))
                if not asked[a]:
                    if part != parts[a]:
                        part, ids, vectors = parts[a], [], []
                    ids.append(batch.column(2).slice(a, z - a))
                    vectors.append(x)
                    fresh = True
                    continue
                if part != parts[a]:
                    continue  # none is left of this part
                if fresh:
                    ids, vectors, fresh = [pa.concat_arrays(ids)], [np.concatenate(vectors)], False
                    rank = np.empty(len(ids[0]), dtype=np.int64)
                    rank[np.argsort(ids[0].to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(rank))
                for b in range(0, z - a, BLOCK):
                    yield meet(batch.column(3).slice(a + b, min(BLOCK, z - a - b)), x[b : b + BLOCK])

    return run


def search_balls(index: BallIndex, queries: DataFrame, k: int) -> DataFrame:
    """Written rows (query_id, chunk_id, dense_score, products): candidates that hold the k
    largest products of each query (query_id, query_vector), and, without a chunk, how many
    products were formed. Null query vectors find nothing."""
    spark = queries.sparkSession
    asked = materialize(queries.where("query_vector is not null").select("query_id", F.col("query_vector").cast("array<double>").alias("vector")))
    query_type, id_type = asked.schema["query_id"].dataType, index.rows.schema["chunk_id"].dataType
    parts = int(index.balls.parts[-1])
    schema = f"query_id {query_type.simpleString()}, chunk_id {id_type.simpleString()}, dense_score double, products long"
    if not parts:
        discard(asked)
        return spark.createDataFrame([], schema)
    # a task takes a few parts, one after the other
    tasks = min(parts, max(spark.sparkContext.defaultParallelism, parts // 16))

    def opened(rows: DataFrame, again: bool) -> DataFrame:
        meets = rows.mapInArrow(_choose(index.balls, k, again), f"part int, query_id {query_type.simpleString()}, vector array<double>")
        none_id, none_query = F.lit(None).cast(id_type), F.lit(None).cast(query_type)
        stored = index.rows.select("part", F.lit(0).alias("asked"), "chunk_id", none_query.alias("query_id"), "vector")
        every = stored.union(meets.select("part", F.lit(1), none_id, "query_id", "vector"))
        dealt = every.repartitionById(tasks, F.col("part")).sortWithinPartitions("part", "asked")
        return materialize(dealt.mapInArrow(_opened(k, to_arrow_type(id_type), to_arrow_type(query_type)), schema))

    first = opened(asked, False)
    order = Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "chunk_id")
    nth = first.where("chunk_id is not null").withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("query_id", F.col("dense_score").alias("least"))
    second = opened(asked.join(nth, "query_id", "left"), True)
    found = materialize(first.unionByName(second))
    discard(asked, first, second)
    return found
