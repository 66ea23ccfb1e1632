"""Exact top-k keyword retrieval over a written, block-max posting table.

A term counts once a chunk, so a posting's weight depends on the chunk's length alone. Chunks
are dealt to shards and numbered by rising length within one; every posting list is then in
order of falling impact and of number at once, and the shortest length of each block of
postings is its block maximum. ``k1``, ``b`` and the mean length come in at query time.

Queries meet each shard as rows sorted behind its postings. Of a query's terms, rare ones
first, lists are read until what is left of a block can't reach the running k-th score; chunks
met before are looked up in the remaining lists while they may still reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfold.scratch import discard, materialize

#: Chunks of a shard, about; postings of a block; queries that one task takes on for a shard.
SHARD_CHUNKS, BLOCK, TASK_QUERIES = 65_536, 128, 32_768
#: Postings of a shard, about; those that leave Python together, but for a longer list.
SHARD_POSTINGS, POSTINGS_OUT = 1 << 23, 1 << 18
#: Shards at least, so that a small table is searched in parallel, too.
LEAST_SHARDS = 8
#: Scores are whole trillionths; ranks compare billionths, so sums this near may be level.
SLACK = 1_000


@dataclass
class KeywordIndex:
    """``postings``: for each shard a row without a token (its chunk ids by rising length, and
    the lengths) and a row for each token (how many chunks, their numbers, and the least length
    of each block). ``shards`` are numbered from 0; some may be empty. ``n_chunks`` and
    ``avg_length`` are of all chunks."""

    postings: DataFrame
    shards: int
    n_chunks: int
    avg_length: float

    @property
    def frequencies(self) -> DataFrame:
        """(token, df), without reading a list."""
        return self.postings.where("token is not null").groupBy("token").agg(F.sum("n").alias("df"))

    def discard(self) -> None:
        discard(self.postings)


def _schema(id_type: str) -> str:
    return f"shard long, token string, n int, chunk_ids array<{id_type}>, lengths array<int>, docs array<int>, heads array<int>"


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _numbered(id_type: pa.DataType):
    """Rows of one shard in any order to index rows: a null before a row's tokens stands for the
    chunk itself. Postings are held as one number each, and sorted so."""
    names = ["shard", "token", "n", "chunk_ids", "lengths", "docs", "heads"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, sizes, counts, tokens = None, [], [], [], []
        for batch in batches:
            if batch.num_rows:
                shard = batch.column(0)[0].as_py()
                ids.append(batch.column(1).to_numpy(zero_copy_only=False))
                sizes.append(batch.column(2).to_numpy())
                counts.append(np.diff(batch.column(3).offsets.to_numpy()))
                tokens.append(batch.column(3).flatten().dictionary_encode())
        if shard is None:
            return
        of_shard = pa.chunked_array(tokens).unify_dictionaries()
        words = of_shard.chunk(0).dictionary
        codes = np.concatenate([c.indices.fill_null(-1).to_numpy() for c in of_shard.chunks])
        ids, sizes, counts = (np.concatenate(x) for x in (ids, sizes, counts))
        del tokens, of_shard
        row = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        own = row[codes < 0]
        own = own[np.argsort(ids[own], kind="stable")]
        own = own[np.argsort(sizes[own], kind="stable")]
        known, lengths = pd.Index(ids[own]), sizes[own].astype(np.int32)
        n = len(known)
        one = [[shard], [None], [n], [known.tolist()], [lengths], [None], [None]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, kinds, strict=True)], names=names)
        held = codes >= 0
        keys = known.get_indexer(ids)[row[held]] + codes[held].astype(np.int64) * n
        del row, codes, held
        keys.sort()
        starts = np.searchsorted(keys, np.arange(len(words) + 1) * n)
        at = 0
        while at < len(words):
            # a few tokens together, at least one
            upto = max(at + 1, int(np.searchsorted(starts, starts[at] + POSTINGS_OUT, "right")) - 1)
            docs = (keys[starts[at] : starts[upto]] % n).astype(np.int32)
            width = np.diff(starts[at : upto + 1])
            head = (np.arange(len(docs)) - np.repeat(starts[at:upto] - starts[at], width)) % BLOCK == 0
            k = upto - at
            columns = [pa.array(np.full(k, shard)), words.slice(at, k), pa.array(width.astype(np.int32)), pa.nulls(k, kinds[3]), pa.nulls(k, kinds[4])]
            columns += [_lists(width, pa.array(docs)), _lists(-(-width // BLOCK), pa.array(lengths[docs[head]]))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            at = upto

    return run


def build_index(token_rows: DataFrame, shard_chunks: int = SHARD_CHUNKS) -> KeywordIndex:
    """The index of (chunk_id, length, token): a row for each token of a chunk, and one without
    a token for each chunk; of its ``lists``, if it has them. Chunk ids are distinct. An empty
    table gives an empty index."""
    id_type = token_rows.schema["chunk_id"].dataType
    rows = getattr(token_rows, "lists", None)
    if rows is None:
        rows = token_rows.select("chunk_id", "length", F.array("token").alias("tokens"))
    # all of fixed size
    own = F.get("tokens", F.lit(0)).isNull()
    stats = rows.agg(F.count_if(own).alias("n"), F.avg(F.when(own, F.col("length"))).alias("avg"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("postings")).first()
    shards = max(LEAST_SHARDS, -(-stats["n"] // shard_chunks), -(-stats["postings"] // SHARD_POSTINGS))
    # a part is one shard
    dealt = rows.select(F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).alias("shard"), "chunk_id", "length", "tokens")
    parts = dealt.repartitionById(shards, F.col("shard").cast("int"))
    postings = materialize(parts.mapInArrow(_numbered(to_arrow_type(id_type)), _schema(id_type.simpleString())))
    return KeywordIndex(postings, shards, stats["n"], stats["avg"] or 0.0)


class Shard:
    """One shard's lists, with what a chunk's length makes of a term's weight."""

    def __init__(self, chunk_ids: np.ndarray, lengths: np.ndarray, k1: float, b: float, usual: float) -> None:
        self.ids, self.lengths = chunk_ids, lengths
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.k1, self.b, self.usual = k1, b, usual
        self.by_id = np.empty(len(chunk_ids), dtype=np.int64)
        self.by_id[np.argsort(chunk_ids, kind="stable")] = np.arange(len(chunk_ids))

    def weigh(self, idf: float, lengths: np.ndarray) -> np.ndarray:
        """Trillionths of a term's score in chunks of these lengths."""
        part = idf * (self.k1 + 1.0) / (1.0 + self.k1 * (1.0 - self.b + self.b * lengths / self.usual))
        return np.floor(part * 1e12 + 0.5).astype(np.int64)

    def search(self, terms: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and sums of the k best chunks, ties by id, and how many postings were scored."""
        lists = sorted(((idf, *self.lists[t]) for t, idf in terms if t in self.lists), key=lambda x: (-x[0], len(x[1])))
        left = np.cumsum([x[0] for x in lists][::-1])[::-1] if lists else []
        docs, sums, scored = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), 0
        for (idf, own, heads), rest in zip(lists, left, strict=True):
            least = (np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) >= k else 0) - SLACK
            # a bound of a sum of rounded terms: one more for each
            bound = lambda lengths, rest=rest: self.weigh(rest, lengths) + len(lists)
            if len(docs) > k:
                alive = sums + bound(self.lengths[docs]) >= least
                docs, sums = docs[alive], sums[alive]
            # blocks fall in impact: those that may hold a newcomer come first
            open_blocks = int(np.searchsorted(-bound(heads), -least, "right"))
            fresh = own[: open_blocks * BLOCK]
            place = np.searchsorted(own, docs)
            met = place < len(own)
            met[met] = own[place[met]] == docs[met]
            sums[met] += self.weigh(idf, self.lengths[docs[met]])
            fresh = np.setdiff1d(fresh, docs[met], assume_unique=True)
            scored += int(met.sum()) + len(fresh)
            if len(fresh):
                docs, sums = np.concatenate([docs, fresh]), np.concatenate([sums, self.weigh(idf, self.lengths[fresh])])
                order = np.argsort(docs)
                docs, sums = docs[order], sums[order]
        level = (sums + 500) // 1000
        if len(docs) > k:
            some = np.flatnonzero(level >= np.partition(level, len(level) - k)[len(level) - k])
        else:
            some = np.arange(len(docs))
        some = some[np.lexsort((self.by_id[docs[some]], -level[some]))][:k]
        some = some[sums[some] > 0]
        return docs[some], sums[some], scored


def _searched(k: int, k1: float, b: float, usual: float, id_type: pa.DataType, query_type: pa.DataType):
    """Rows of a task in order: a shard's chunks, its lists, its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        out: list[tuple] = []

        def found() -> pa.RecordBatch:
            who, ids, sums, scored = (list(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(who, query_type), pa.array(ids, id_type), pa.array(sums, pa.int64()), pa.array(scored, pa.int64())], names=["query_id", "chunk_id", "sum", "scored"])

        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            kinds, shards = cols["kind"].to_numpy(), cols["shard"].to_numpy()
            tokens = cols["token"].to_pylist()
            (docs, at), (heads, head_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (cols["docs"], cols["heads"]))
            for r, kind in enumerate(kinds):
                if kind == 0:
                    ids, number = cols["chunk_ids"][r].values, shards[r]
                    shard = Shard(ids.to_numpy(zero_copy_only=False), cols["lengths"][r].values.to_numpy(), k1, b, usual)
                elif kind == 1:
                    shard.lists[tokens[r]] = docs[at[r] : at[r + 1]], heads[head_at[r] : head_at[r + 1]]
                elif number == shards[r]:  # else the shard is empty
                    terms = list(zip(cols["terms"][r].as_py(), cols["idfs"][r].as_py(), strict=True))
                    best, sums, scored = shard.search(terms, k)
                    who = cols["query_id"][r].as_py()
                    out += [(who, x, int(y), 0) for x, y in zip(shard.ids[best].tolist(), sums, strict=True)]
                    out.append((who, None, None, scored))  # how much work it was
            if len(out) > 8192:
                yield found()
        if out:
            yield found()

    return run


def searched(index: KeywordIndex, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Written rows (query_id, chunk_id, sum, scored): each shard's k best chunks of a query
    with their scores in trillionths; and, without a chunk, the number of postings scored.
    ``queries`` has query_id and query_tokens."""
    wanted = queries.select("query_id", F.explode("query_tokens").alias("token"))
    idf = F.log(1.0 + (F.lit(index.n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = materialize(wanted.join(index.frequencies, "token").select("query_id", "token", idf.alias("idf")))
    asked = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("t")).select("query_id", F.col("t.token").alias("terms"), F.col("t.idf").alias("idfs"))
    parts = max(1, -(-terms.select("query_id").distinct().count() // TASK_QUERIES))
    heads = index.postings.where("token is null")
    lists = index.postings.where("token is not null").join(terms.select("token").distinct(), "token", "left_semi")
    # every query is asked of every shard: both are rows, dealt by shard and part of the queries
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(index.shards - 1).cast("long"))
    copies = asked.select(F.explode(numbers).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.lit(2).alias("kind"), "query_id", "terms", "idfs")
    stored = heads.withColumn("kind", F.lit(0)).unionByName(lists.withColumn("kind", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = stored.unionByName(copies, allowMissingColumns=True)
    slot = (F.col("shard") * parts + F.col("part")).cast("int")
    ordered = rows.repartitionById(index.shards * parts, slot).sortWithinPartitions("shard", "part", "kind")
    id_type, query_type = index.postings.schema["chunk_ids"].dataType.elementType, queries.schema["query_id"].dataType
    run = _searched(k, k1, b, max(index.avg_length, 1.0), to_arrow_type(id_type), to_arrow_type(query_type))
    out = materialize(ordered.mapInArrow(run, f"query_id {query_type.simpleString()}, chunk_id {id_type.simpleString()}, sum long, scored long"))
    discard(terms)
    return out
