"""Keyword, dense and hybrid retrieval for many queries at once.

A text is tokenised once: of its tokens only those that some query has are written, as a list
with the chunk's length. Statistics, scores and overlaps all come from that table, whose rows
are dealt by chunk, so a query's score of a chunk is summed where its rows are and only the
best of each part move. Candidate pools are per query; ties are broken by id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import STOPWORDS, lexical_overlap, lexical_tokens
from lumenfold.operators.dense import ball_index, search_balls
from lumenfold.operators.keyword import KeywordIndex, build_index, searched
from lumenfold.scratch import discard, materialize, small_enough, spread

POOL, RRF_K, OVERLAP_WEIGHT = 40, 60, 0.15
#: Rows that are broadcast at most: tokens of queries, candidates. More are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of queries' tokens that are sent to all tasks at most.
BROADCAST_BYTES = 16 << 20
#: Postings times the queries of their tokens that a task sums at most, on average.
TASK_MATCHES = 1_000_000


def with_tokens(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    return chunks.withColumn("tokens", lexical_tokens(F.col(text)))


def bm25_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and mean number of distinct tokens, empty chunks included."""
    return with_tokens(chunks).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size("tokens")).alias("avg_length"))


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", lexical_tokens(F.col("query_text")).alias("query_tokens"))


def _spread(small: DataFrame) -> DataFrame:
    """A table of queries or candidates, broadcast as long as its rows are few."""
    return F.broadcast(small) if small_enough(small, BROADCAST_ROWS) else small


#: Bytes that a token has stay, all others are blanks.
_BLANKED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _tokenized(wanted: list[str] | None):
    """(chunk_id, chunk_text) to (chunk_id, length, tokens), of the wanted tokens alone if they
    are given, a null before them. A batch is split, numbered and made distinct as a whole."""
    stop, own = pa.array(STOPWORDS), None if wanted is None else pa.array(wanted, pa.string())
    of = lambda a: np.asarray(a.to_numpy(zero_copy_only=False), dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = (x or "" for x in batch.column(1).to_pylist())
            folded = pa.array([(x if x.isascii() else unicodedata.normalize("NFKC", x)).lower() for x in texts], pa.large_string())
            _, offsets, data = folded.buffers()
            blanked = pa.py_buffer(data.to_pybytes().translate(_BLANKED) if data else b"")
            split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(n, offsets, blanked))
            words = split.flatten().dictionary_encode()
            names = words.dictionary.cast(pa.string())
            width = max(len(names), 1)
            pairs = np.sort(np.repeat(np.arange(n), np.diff(split.offsets)) * width + words.indices.to_numpy())
            pairs = pairs[np.concatenate([[True], np.diff(pairs) != 0])] if len(pairs) else pairs
            counted = ~of(pc.is_in(names, value_set=stop)) & of(pc.not_equal(names, ""))
            pairs = pairs[counted[pairs % width]]
            lengths = np.bincount(pairs // width, minlength=n).astype(np.int32)
            if own is not None:
                pairs = pairs[of(pc.is_in(names, value_set=own))[pairs % width]]
            chunk = pairs // width
            tokens = np.full(n + len(pairs), -1)
            tokens[np.arange(len(pairs)) + chunk + 1] = pairs % width
            starts = np.concatenate([[0], np.cumsum(np.bincount(chunk, minlength=n) + 1)])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), names.take(pa.array(tokens, mask=tokens < 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), lists], names=["chunk_id", "length", "tokens"])

    return run


def token_index(chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(chunk_id, length, token), written: a row for each token of a chunk, of those alone that
    some query has if queries are given, and one without a token for each chunk; length is the
    chunk's number of tokens. Tokens are those of ``lexical_tokens``. Where a chunk's rows were
    written as one, ``lists`` of the result has these: chunk_id, length, tokens."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    lists = lambda wanted: spread(chunks.select("chunk_id", "chunk_text")).mapInArrow(_tokenized(wanted), f"chunk_id {kind}, length int, tokens array<string>")
    rows = lambda table: table.select("chunk_id", "length", F.explode("tokens").alias("token"))
    wanted = None
    if queries is not None:
        asked = materialize(query_tokens(queries).select(F.explode("query_tokens").alias("key")).distinct())
        n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
        if n > BROADCAST_ROWS or size > BROADCAST_BYTES:
            # a chunk's own row gets a key that no token is, so these rows don't meet in one task
            keyed = rows(lists(None)).withColumn("key", F.coalesce("token", F.concat(F.lit("-"), F.col("chunk_id").cast("string"))))
            held = keyed.join(asked.withColumn("wanted", F.lit(True)), "key", "left")
            made = materialize(held.where("token is null or wanted").select("chunk_id", "length", "token"))
            discard(asked)
            return made
        wanted = [r["key"] for r in asked.collect()]
        discard(asked)
    table = materialize(lists(wanted))
    made = rows(table)
    made.lists, made.scratch_path = table, table.scratch_path
    return made


def bm25_matches(index: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, bm25_score, n_common) of every matching pair; terms count once a
    chunk. A sum of whole trillionths is the same in any order."""
    wanted = query_tokens(queries).select("query_id", F.explode("query_tokens").alias("token"))
    postings = index.where("token is not null")
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = index.where("token is null").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("avg_length"))
    weights = wanted.join(df, "token").join(F.broadcast(stats))
    idf = F.log(1.0 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = _spread(weights.select("query_id", "token", idf.alias("idf"), F.greatest("avg_length", F.lit(1.0)).alias("usual")))
    # dealt by chunk, pairs of a chunk are together without another exchange; a posting becomes a
    # row for each query of its token, so tasks are numbered by those, not by what is shuffled
    askers = wanted.groupBy("token").agg(F.count(F.lit(1)).alias("askers"))
    rows = df.join(askers, "token").agg(F.sum(F.col("df") * F.col("askers"))).first()[0] or 0
    hit = postings.repartition(max(postings.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_MATCHES)), "chunk_id").join(weights, "token")
    part = F.col("idf") * (k1 + 1.0) / (1.0 + k1 * (1.0 - b + b * F.col("length") / F.col("usual")))
    found = hit.groupBy("chunk_id", "query_id").agg(F.sum(F.round(part * 1e12).cast("long")).alias("sum"), F.count(F.lit(1)).alias("n_common"))
    return found.select("query_id", "chunk_id", F.round(F.col("sum") / 1e12, 9).alias("bm25_score"), "n_common").where("bm25_score > 0")


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, bm25_score) of every matching pair."""
    return bm25_matches(token_index(chunks, queries), queries, k1, b).drop("n_common")


def top_k(scored: DataFrame, score: str, k: int, rank: str = "rank", ids_descending: bool = False) -> DataFrame:
    """The k best of each query; ties by id."""
    tie = F.desc("chunk_id") if ids_descending else F.asc("chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def dense_pool(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k vectors with the largest products with each query, with dense_rank, exactly; balls
    of vectors that can't hold one aren't opened."""
    index = ball_index(vectors)
    found = search_balls(index, queries, k)
    index.discard()
    return top_k(found.where("chunk_id is not null").drop("products"), "dense_score", k, "dense_rank")


def rrf(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two pools by a full outer join."""
    one = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return dense.join(sparse, ["query_id", "chunk_id"], "full_outer").withColumn("rrf_score", canonical(one("dense_rank") + one("sparse_rank")))


def rounded(score: Column, places: int) -> Column:
    """Rounded on the double itself, as SQL engines do. Spark's own rounds the shortest decimal
    that names the double, which may lie on the other side of a half."""
    return F.round(score * 10.0**places) / 10.0**places


def canonical(score: Column) -> Column:
    """Twelve decimals: sums that differ in the last bit alone are equal, and rank as equals."""
    return rounded(score, 12)


def add_overlap(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds the share of the query's tokens that a candidate has; candidates' texts alone are
    tokenised."""
    found = materialize(candidates)
    own = chunks.select("chunk_id", "chunk_text").join(_spread(found.select("chunk_id").distinct()), "chunk_id", "left_semi")
    texts = own.select("chunk_id", lexical_tokens(F.col("chunk_text")).alias("tokens"))
    joined = found.join(texts, "chunk_id").join(query_tokens(queries), "query_id")
    return joined.withColumn("overlap", lexical_overlap(F.col("query_tokens"), F.col("tokens"))).drop("tokens", "query_tokens")


def add_overlap_of_index(candidates: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """The same from the token index, without a text; chunks that it doesn't have drop out."""
    found = materialize(candidates)
    asked = query_tokens(queries)
    wanted = asked.select("query_id", F.explode("query_tokens").alias("token"))
    rows = index.join(_spread(found.select("query_id", "chunk_id")), "chunk_id").join(_spread(wanted.withColumn("common", F.lit(1))), ["query_id", "token"], "left")
    common = rows.groupBy("query_id", "chunk_id").agg(F.count("common").alias("n"))
    joined = found.join(common, ["query_id", "chunk_id"]).join(asked, "query_id")
    share = F.when(F.size("query_tokens") > 0, F.col("n") / F.size("query_tokens")).otherwise(F.lit(0.0))
    return joined.withColumn("overlap", share).drop("n", "query_tokens")


def keyword_pool(index: KeywordIndex, queries: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """(query_id, chunk_id, bm25_score) and rank of each query's k best chunks, exactly, by
    postings that can matter alone; ties by id."""
    found = searched(index, query_tokens(queries), k).where("chunk_id is not null")
    return top_k(found.select("query_id", "chunk_id", F.round(F.col("sum") / 1e12, 9).alias("bm25_score")), "bm25_score", k, rank)


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int, rank: str = "rank", tokens: DataFrame | None = None) -> DataFrame:
    """The same from texts, or from their token rows; the index goes once it has answered."""
    rows = token_index(chunks, queries) if tokens is None else tokens
    index = build_index(rows)
    found = keyword_pool(index, queries, k, rank)
    index.discard()
    if tokens is None:
        discard(rows)
    return found


def retrieve_keyword(chunks: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    return keyword_search(chunks, queries, k).withColumn("combined_score", F.col("bm25_score"))


def retrieve_dense(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 8, weight: float = OVERLAP_WEIGHT, least: float = 0.0, pool: int = POOL) -> DataFrame:
    """Dense pool re-ranked by lexical overlap, then the score floor, then the cut; ties keep
    the dense order."""
    found = add_overlap(dense_pool(vectors, queries, max(k, pool)), chunks, queries)
    found = found.withColumn("combined_score", canonical(F.col("dense_score") + weight * F.col("overlap"))).where(F.col("dense_score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), F.asc("dense_rank"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_candidates(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 8, pool: int = POOL, index: DataFrame | None = None) -> DataFrame:
    """Both pools, fused; ``index`` is the chunks' token index, if there is one already."""
    index = token_index(chunks, queries) if index is None else index
    dense = dense_pool(vectors, queries, max(k, pool))
    return rrf(dense, keyword_search(chunks, queries, pool, "sparse_rank", index))


def retrieve_hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 8, weight: float = OVERLAP_WEIGHT, least: float = 0.0, pool: int = POOL, index: DataFrame | None = None) -> DataFrame:
    """Fused pools ordered by fusion plus weighted overlap, then id, both descending. A
    candidate of the keyword pool alone passes the score floor. ``index`` is the chunks' token
    index, if there is one already."""
    index = token_index(chunks, queries) if index is None else index
    found = add_overlap_of_index(hybrid_candidates(chunks, vectors, queries, k, pool, index), index, queries)
    found = found.withColumn("combined_score", canonical(F.col("rrf_score") + weight * F.col("overlap")))
    found = found.where(F.col("dense_score").isNull() | (F.col("dense_score") >= least))
    return top_k(found, "combined_score", k, ids_descending=True)


def rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, scorer, k: int = 8) -> DataFrame:
    """Order a pool by an injected pair scorer, a pandas UDF of (query_text, chunk_text)."""
    pairs = candidates.join(chunks.select("chunk_id", "chunk_text"), "chunk_id").join(queries.select("query_id", "query_text"), "query_id")
    scored = pairs.withColumn("pair_score", scorer("query_text", "chunk_text")).drop("chunk_text", "query_text")
    return top_k(scored, "pair_score", k, ids_descending=True)


def expand_parents(found: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """A retrieved chunk's text, replaced by its parent's where it has one."""
    text = chunks.select("chunk_id", "chunk_text", "parent_chunk_id")
    up = parents.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_text").alias("parent_text"))
    return found.join(text, "chunk_id").join(up, "parent_chunk_id", "left").withColumn("context_text", F.coalesce("parent_text", "chunk_text")).drop("parent_text")
