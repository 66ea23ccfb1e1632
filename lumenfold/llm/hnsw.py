"""Approximate nearest neighbours by navigable small-world graphs (operator 13).

Distinct vectors are dealt by hash to shards of bounded size; a vector's copies are carried as
its smallest ids, as no later one can be among a query's nearest. A shard's graph is built in
one task and written as a row of flat neighbour arrays. Nodes are ordered by level, highest
first, so a layer's nodes are a prefix and a layer is one array of (nodes, links).

Queries meet every shard: each is copied to the shards as a row, sorted behind the shard's
graph, and searched in lockstep blocks. What shards find is ranked again by exact cosines and
merged. A shard's queries are split over tasks, so a task's work is bounded on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.shared import discard, materialize

#: Vectors of a shard, about; queries that one task searches for a shard.
SHARD, TASK_QUERIES = 4_096, 32_768
#: Links of a node in upper layers (twice as many in the lowest), beam while building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 96
#: Nodes that a step of a beam search expands, and nodes or queries searched together.
EXPAND, TOGETHER = 4, 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in 32 bits; scaled by a power of two first, so no square overflows."""
    _, e = np.frexp(np.abs(vectors).max(axis=1))
    v = np.ldexp(vectors, -e[:, None])
    return (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in doubles, each summed in the same order."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def beam_search(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (queries, beam) of a layer by falling similarity, -1 where there are fewer, and the
    similarities. Every query keeps its own beam; all advance in lockstep."""
    n, width = len(queries), links.shape[1]
    seen = np.zeros((n, len(links)), dtype=bool)
    place = np.empty((n, len(links)), dtype=np.int16)
    nodes, near = np.full((n, beam), -1, dtype=np.int64), np.full((n, beam), -np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    e = entries.shape[1]
    nodes[:, :e] = entries
    near[:, :e] = np.where(entries >= 0, np.einsum("qd,qed->qe", queries, vectors[entries]), -np.inf)
    done[:, :e] = entries < 0
    who, slot = np.nonzero(entries >= 0)
    seen[who, entries[who, slot]] = True
    active = np.arange(n)
    expand = min(EXPAND, beam)
    columns = np.arange(expand * width, dtype=np.int16)
    while len(active):
        score = np.where(done[active], -np.inf, near[active])
        best = np.argpartition(-score, expand - 1, axis=1)[:, :expand] if beam > expand else np.broadcast_to(np.arange(beam), score.shape)
        chosen = np.take_along_axis(score, best, 1) > -np.inf
        some = chosen.any(axis=1)
        active, best, chosen = active[some], best[some], chosen[some]
        if not len(active):
            break
        done[active[:, None], best] = True
        heads = np.where(chosen, nodes[active[:, None], best], 0)
        found = np.where(chosen[:, :, None], links[heads], -1).reshape(len(active), -1)
        rows = np.broadcast_to(active[:, None], found.shape)
        new = (found >= 0) & ~seen[rows, found]
        row, node, column = rows[new], found[new], np.broadcast_to(columns, found.shape)[new]
        place[row, node] = column
        once = place[row, node] == column  # a node met twice in a step counts once
        new[new] = once
        row, node = row[once], node[once]
        seen[row, node] = True
        fresh = np.full(found.shape, -np.inf, dtype=np.float32)
        fresh[new] = np.einsum("ed,ed->e", queries[row], vectors[node])
        all_near = np.concatenate([near[active], fresh], axis=1)
        keep = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        near[active] = np.take_along_axis(all_near, keep, 1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], found], axis=1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~new], axis=1), keep, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    return np.where(near > -np.inf, np.take_along_axis(nodes, order, 1), -1), near


def diverse(vectors: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, by falling similarity, those nearer to the row than to any
    taken before; free places go to the nearest of the rest. (rows, most), -1 where fewer."""
    n, c = candidates.shape
    own = vectors[candidates]
    among = np.matmul(own, own.transpose(0, 2, 1))
    taken, count = np.zeros((n, c), dtype=bool), np.zeros(n, dtype=np.int64)
    closest = np.full((n, c), -np.inf, dtype=np.float32)  # to any taken one
    valid = near > -np.inf
    for k in range(c):
        ok = valid[:, k] & (closest[:, k] < near[:, k]) & (count < most)
        taken[:, k] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, among[:, k]), closest)
    order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(candidates, order, 1), -1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((n, most - out.shape[1]), -1, dtype=out.dtype)], axis=1)
    return out


def _link(links: np.ndarray, vectors: np.ndarray, first: int, chosen: np.ndarray) -> None:
    """Set the links of new nodes and the links back to them; full nodes choose anew."""
    width = links.shape[1]
    links[first : first + len(chosen), : chosen.shape[1]] = chosen
    who, slot = np.nonzero(chosen >= 0)
    target = chosen[who, slot]
    # two new nodes that named each other are linked already
    mates = np.flatnonzero(target >= first)
    mutual = np.zeros(len(target), dtype=bool)
    mutual[mates] = (chosen[target[mates] - first] == (first + who[mates])[:, None]).any(axis=1)
    who, target = who[~mutual], target[~mutual]
    order = np.argsort(target, kind="stable")
    target, source = target[order], first + who[order]
    at = np.flatnonzero(np.diff(target, prepend=-1))
    nodes, counts = target[at], np.diff(np.append(at, len(target)))
    # a node that very many new ones point to takes them in turns
    for start in range(0, int(counts.max(initial=0)), width):
        some = counts > start
        take = np.minimum(counts[some] - start, width)
        extra = np.full((some.sum(), width), -1, dtype=links.dtype)
        cell = np.arange(width)[None, :] < take[:, None]
        extra[cell] = source[(np.repeat(at[some] + start, take) + np.concatenate([np.arange(t) for t in take]))]
        own = links[nodes[some]]
        held = (own >= 0).sum(axis=1)
        room = held + take <= width
        # links are without gaps: what fits is put behind them
        cell = (np.arange(width)[None, :] < take[:, None]) & room[:, None]
        who, slot = np.nonzero(cell)
        links[nodes[some][who], held[who] + slot] = extra[who, slot]
        some = np.flatnonzero(some)[~room]
        if not len(some):
            continue
        every = np.concatenate([own[~room], extra[~room]], axis=1)
        own = vectors[nodes[some]]
        near = np.where(every >= 0, np.einsum("qd,qed->qe", own, vectors[every]), -np.inf).astype(np.float32)
        rank = np.argsort(-near, axis=1, kind="stable")
        every, near = np.take_along_axis(every, rank, 1), np.take_along_axis(near, rank, 1)
        links[nodes[some]] = diverse(vectors, every, near, width)


class Graph:
    """Layers over unit vectors that are ordered by level, highest first."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]) -> None:
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        """``levels`` must not rise. Nodes join in batches: each searches the graph so far, and
        the nodes of its own batch are further candidates."""
        sizes = [int((levels >= k).sum()) for k in range(int(levels.max(initial=0)) + 1)]
        layers = [np.full((n, links * (2 if k == 0 else 1)), -1, dtype=np.int64) for k, n in enumerate(sizes)]
        graph, done = cls(vectors, layers), 1
        while done < len(vectors):
            level = int(levels[done])
            upto = min(done + max(1, min(TOGETHER, done)), sizes[level])
            batch = vectors[done:upto]
            entries = np.zeros((len(batch), 1), dtype=np.int64)
            for k in range(int(levels[0]), level, -1):
                entries = beam_search(layers[k][:done], vectors, batch, entries, 1)[0][:, :1]
            for k in range(min(level, int(levels[0])), -1, -1):
                nodes, near = beam_search(layers[k][:done], vectors, batch, entries, beam)
                entries = nodes[:, : max(1, links // 2)]
                entries = np.where(entries >= 0, entries, nodes[:, :1])
                entries = np.where(np.arange(entries.shape[1])[None, :] == 0, entries, np.where(entries == nodes[:, :1], -1, entries))
                among = batch @ batch.T
                np.fill_diagonal(among, -np.inf)
                few = min(len(batch), links)
                mates = np.argpartition(-among, few - 1, axis=1)[:, :few]
                every = np.concatenate([nodes, mates + done], axis=1)
                near = np.concatenate([near, np.take_along_axis(among, mates, 1)], axis=1)
                rank = np.argsort(-near, axis=1, kind="stable")[:, :beam]
                _link(layers[k], vectors, done, diverse(vectors, np.take_along_axis(every, rank, 1), np.take_along_axis(near, rank, 1), links))
            done = upto
        return graph

    def search(self, queries: np.ndarray, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of up to ``beam`` near nodes of each query."""
        entries = np.zeros((len(queries), 1), dtype=np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            entries = beam_search(self.layers[k], self.vectors, queries, entries, 1)[0][:, :1]
        return beam_search(self.layers[0], self.vectors, queries, entries, min(beam, len(self.vectors)))


def levels_of(keys: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Levels with the usual geometric fall, from 64-bit hashes."""
    share = (keys.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.minimum((-np.log(np.maximum(share, 2.0**-53)) / np.log(links)).astype(np.int64), 12)


_INDEX = "dim int, shard long, n int, vectors binary, sizes array<int>, widths array<int>, links binary, id_counts array<int>, ids array<long>"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's vectors to its row of the index."""
    keys = rows["key"].to_numpy()
    levels = levels_of(keys)
    order = np.lexsort((keys, -levels))
    levels = levels[order]
    original = np.stack(rows["v"].to_numpy()).astype(np.float64)[order]
    graph = Graph.build(unit(original), levels)
    ids = [rows["ids"].iloc[k] for k in order]
    return pd.DataFrame({
        "dim": [int(rows["dim"].iloc[0])], "shard": [int(rows["shard"].iloc[0])], "n": [len(rows)], "vectors": [original.tobytes()],
        "sizes": [[len(x) for x in graph.layers]], "widths": [[x.shape[1] for x in graph.layers]],
        "links": [b"".join(x.astype(np.int32).tobytes() for x in graph.layers)],
        "id_counts": [[len(x) for x in ids]], "ids": [np.concatenate(ids).tolist()],
    })


class Shard:
    """A graph read back from its row."""

    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        self.original = np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, dim)
        flat, layers, at = np.frombuffer(row["links"], dtype=np.int32), [], 0
        for size, width in zip(row["sizes"], row["widths"], strict=True):
            layers.append(flat[at : at + size * width].reshape(size, width))
            at += size * width
        self.graph = Graph(unit(self.original), layers)
        self.ids, self.starts = np.array(row["ids"], dtype=np.int64), np.concatenate([[0], np.cumsum(row["id_counts"])])

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, found id, exact cosine) of the k nearest rows found of each query."""
        nodes, _ = self.graph.search(unit(queries), max(beam, 2 * k))
        who, slot = np.nonzero(nodes >= 0)
        node = nodes[who, slot]
        score = cosines(queries[who], self.original[node])
        copies = np.diff(self.starts)[node]
        who, score = np.repeat(who, copies), np.repeat(score, copies)
        at = np.repeat(self.starts[node], copies) + np.arange(len(who)) - np.repeat(np.cumsum(copies) - copies, copies)
        ids = self.ids[at]
        other = ids != query_ids[who]
        who, score, ids = who[other], score[other], ids[other]
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        first = np.searchsorted(who, who)
        few = np.arange(len(who)) - first < k
        return query_ids[who[few]], ids[few], score[few]


_FOUND = "query_id long, vec_id long, score double"


def _search(k: int, beam: int):
    """Rows of a task in order: of each shard its graph, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, held = None, None, []

        def block() -> pa.RecordBatch:
            found = shard.nearest(np.array([x for x, _ in held]), np.array([y for _, y in held], dtype=np.float64), k, beam)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["links"] is not None:
                    if held:
                        yield block()
                    shard, at = Shard(row), (row["dim"], row["shard"])
                    continue
                if shard is None or at != (row["dim"], row["shard"]):
                    continue  # no vector of this length in the shard
                held.append((row["query_id"], row["v"]))
                if len(held) == TOGETHER:
                    yield block()
        if held:
            yield block()

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that have an angle: not empty or zero, no null, NaN or infinity."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    able = vectors.where(F.col(id_col).isNotNull() & F.forall(vector_col, fine) & F.exists(vector_col, lambda x: x != 0))
    return able.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))


def graph_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 6, shard: int = SHARD) -> DataFrame:
    """The written index of all usable rows: a row for each shard. Of equal vectors the
    ``copies`` smallest ids are kept, equal ids once."""
    rows = usable(vectors, id_col, vector_col)
    order = Window.partitionBy("v").orderBy("id")
    ranked = rows.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= copies)
    groups = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    dims = F.size("v").alias("dim")
    distinct = materialize(groups.select("v", "ids", dims, F.xxhash64("v").alias("key")))
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.lit(1)
    if sizes:
        shards = reduce(lambda e, x: e.when(F.col("dim") == x[0], -(-x[1] // shard)), sizes.items(), F).otherwise(1)
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), shards.cast("long")))
    index = materialize(dealt.groupBy("dim", "shard").applyInPandas(_build, _INDEX))
    discard(distinct)
    return index


def nearest_rows(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """Search ``queries`` (query_id, v) in all shards of their length; k nearest rows of each."""
    counts = index.groupBy("dim").agg(F.count(F.lit(1)).alias("shards"))
    parts = max(1, -(-queries.count() // TASK_QUERIES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    # lengths and shards are few; a query is copied to each shard of its length
    asked = queries.withColumn("dim", F.size("v")).join(F.broadcast(counts), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    asked = asked.select("dim", "shard", part.alias("part"), "query_id", "v")
    graphs = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    together = graphs.unionByName(asked, allowMissingColumns=True)
    keys = ["dim", "shard", "part"]
    sorted_rows = together.repartition(*keys).sortWithinPartitions(*keys, F.col("links").isNull(), "query_id")
    found = materialize(sorted_rows.mapInArrow(_search(k, beam), _FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, beam: int = SEARCH_BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k rows
    of other ids with the largest cosines that the graphs find, ties to smaller ids.

    Every usable row is indexed; rows without an id, and vectors that are null, empty, zero or
    hold a null, a NaN or an infinity take no part. Vectors of different lengths never meet.
    Rows that repeat id and vector count once; a repeated id with different vectors is as many
    candidates, and as a query is searched once for each, results then by its best scores.
    Fewer candidates than k give them all; an empty table gives an empty result.
    """
    index = graph_index(vectors, id_col, vector_col, k + 1, shard)
    rows = usable(vectors.where(F.col(id_col) % every == 0), id_col, vector_col)
    return nearest_rows(index, rows.distinct().select(F.col("id").alias("query_id"), "v"), k, beam)
