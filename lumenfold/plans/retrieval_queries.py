"""Retrieval and evaluation queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import evidence as E
from lumenfold.operators import metrics as M
from lumenfold.operators import retrieval as R
from lumenfold.plans.catalog import query
from lumenfold.plans.fixtures import Tables
from lumenfold.plans.sqltext import BM25, DENSE, OVERLAP, POOLS, QRELS, QUERIES, RUN, tokens
from lumenfold.scratch import materialize
from lumenfold.sources import sinks


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*[R.rounded(F.col(c), 6).alias(c) if c in names else F.col(c) for c in rows.columns])


@query(f"SELECT count(*) AS n_chunks, round(avg(len(x)), 6) AS avg_length FROM (SELECT {tokens('text')} AS x FROM documents)")
def agg_df_avgdl(t: Tables) -> DataFrame:
    return _rounded(R.bm25_stats(t.chunks), "avg_length")


@query(f"WITH {BM25} SELECT query_id, chunk_id, round(round(bm25_score, 9), 6) AS bm25_score FROM bm25")
def agg_bm25(t: Tables) -> DataFrame:
    return _rounded(R.bm25_scores(t.chunks, t.queries), "bm25_score")


@query(f"WITH {BM25}, {RUN} SELECT query_id, chunk_id, rank FROM run")
def topk_bm25(t: Tables) -> DataFrame:
    return t.run(8).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {BM25}, {RUN} SELECT query_id, chunk_id, round(round(bm25_score, 9), 6) AS combined_score FROM run JOIN bm25 USING (query_id, chunk_id)")
def retrieve_keyword(t: Tables) -> DataFrame:
    return _rounded(R.retrieve_keyword(t.chunks, t.queries).select("query_id", "chunk_id", "combined_score"), "combined_score")


@query(f"WITH {QUERIES}, {DENSE} SELECT query_id, chunk_id, round(dense_score, 6) AS dense_score FROM dense QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) <= 8")
def topk_dense(t: Tables) -> DataFrame:
    return _rounded(R.dense_pool(t.vectors, t.queries, 8).select("query_id", "chunk_id", "dense_score"), "dense_score")


@query(f"""WITH {POOLS}, c AS (SELECT query_id, chunk_id, dense_rank, dense_score, round(dense_score + 0.15 * {OVERLAP}, 12) AS s FROM dpool JOIN tok USING (chunk_id) JOIN queries USING (query_id) WHERE dense_score >= 0)
SELECT query_id, chunk_id, round(s, 6) AS combined_score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, dense_rank) <= 8""")
def retrieve_dense(t: Tables) -> DataFrame:
    return _rounded(R.retrieve_dense(t.chunks, t.vectors, t.queries).select("query_id", "chunk_id", "combined_score"), "combined_score")


FUSED = f"""{POOLS}, fused AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, dense_score, bm25_score, round(coalesce(1.0 / (60 + dense_rank), 0.0) + coalesce(1.0 / (60 + sparse_rank), 0.0), 12) AS rrf FROM dpool d FULL OUTER JOIN spool s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id)"""


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round(rrf, 6) AS rrf_score FROM fused")
def join_rrf_full_outer(t: Tables) -> DataFrame:
    return _rounded(R.hybrid_candidates(t.chunks, t.vectors, t.queries).select("query_id", "chunk_id", "rrf_score"), "rrf_score")


HYBRID = f"""{FUSED}, c AS (SELECT query_id, chunk_id, dense_score, round(rrf + 0.15 * {OVERLAP}, 12) AS s FROM fused JOIN tok USING (chunk_id) JOIN queries USING (query_id))"""
TOP = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id DESC) <= 8"


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, round(s, 6) AS combined_score FROM c WHERE dense_score IS NULL OR dense_score >= 0 {TOP}")
def retrieve_hybrid(t: Tables) -> DataFrame:
    return _rounded(R.retrieve_hybrid(t.chunks, t.vectors, t.queries).select("query_id", "chunk_id", "combined_score"), "combined_score")


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, round(s, 6) AS combined_score FROM c WHERE dense_score IS NULL OR dense_score >= 0.2 {TOP}")
def hybrid_min_score(t: Tables) -> DataFrame:
    return _rounded(R.retrieve_hybrid(t.chunks, t.vectors, t.queries, least=0.2).select("query_id", "chunk_id", "combined_score"), "combined_score")


@query(f"WITH {FUSED} SELECT DISTINCT query_id, chunk_id FROM fused")
def set_union_candidates(t: Tables) -> DataFrame:
    dense = R.dense_pool(t.vectors, t.queries, R.POOL).select("query_id", "chunk_id")
    sparse = t.run(R.POOL).select("query_id", "chunk_id")
    return dense.union(sparse).distinct()


@query(f"""WITH {FUSED}, x AS (SELECT fused.query_id, chunk_id, list_distinct(string_split(query_text, '')) AS a, list_distinct(string_split(text, '')) AS b FROM fused JOIN queries USING (query_id) JOIN documents ON doc_id = chunk_id), y AS (SELECT query_id, chunk_id, len(list_intersect(a, b)) / greatest(1, len(a)) AS s FROM x)
SELECT query_id, chunk_id, round(s, 6) AS pair_score FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id DESC) <= 8""")
def rerank_cross_encoder(t: Tables) -> DataFrame:
    """With a stand-in for the injected scorer: the share of equal characters."""
    @F.pandas_udf("double")
    def scorer(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([len(set(a) & set(b)) / max(1, len(set(a))) for a, b in zip(q, c, strict=True)])

    found = R.rerank(R.hybrid_candidates(t.chunks, t.vectors, t.queries).select("query_id", "chunk_id"), t.chunks, t.queries, scorer)
    return _rounded(found.select("query_id", "chunk_id", "pair_score"), "pair_score")


def _run(t: Tables) -> DataFrame:
    return t.run(8)


JUDGED = f"""{BM25}, {RUN}, {QRELS}, nrel AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
j AS (SELECT run.*, q.chunk_id IS NOT NULL AS rel FROM run LEFT JOIN qrels q ON q.query_id = run.query_id AND q.chunk_id = run.chunk_id)"""


def _at(k: int) -> str:
    ideal = f"(SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, {k}) + 1) r(i))"
    return f"""round(count(*) FILTER (WHERE rel AND rank <= {k}) / {k}, 6) AS precision_{k}, round(count(*) FILTER (WHERE rel AND rank <= {k}) / n_rel, 6) AS recall_{k}, round(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel AND rank <= {k}), 0.0) / {ideal}, 6) AS ndcg_{k}"""


@query(f"WITH {JUDGED} SELECT nrel.query_id, n_rel, {_at(3)}, {_at(5)}, {_at(8)}, round(coalesce(1 / min(rank) FILTER (WHERE rel), 0.0), 6) AS mrr FROM nrel LEFT JOIN j USING (query_id) GROUP BY nrel.query_id, n_rel")
def agg_retrieval_metrics(t: Tables) -> DataFrame:
    found = M.rank_metrics(_run(t), t.qrels)
    return _rounded(found, *[c for c in found.columns if c not in ("query_id", "n_rel")])


EXACT = f"""{JUDGED}, e AS (SELECT nrel.query_id, n_rel, count(j.chunk_id) AS got, count(*) FILTER (WHERE rel) AS hits, min(rank) FILTER (WHERE rel) AS first_rank FROM nrel LEFT JOIN j ON j.query_id = nrel.query_id AND rank <= 5 GROUP BY nrel.query_id, n_rel)"""


@query(f"""WITH {EXACT} SELECT query_id, round(coalesce(hits / nullif(got, 0), 0.0), 6) AS precision, round(hits / n_rel, 6) AS recall, round(CASE WHEN hits > 0 THEN 2 * (hits / got) * (hits / n_rel) / (hits / got + hits / n_rel) ELSE 0.0 END, 6) AS f1, CAST(hits > 0 AS INTEGER) AS hit, first_rank, round(coalesce(1 / first_rank, 0.0), 6) AS mrr FROM e""")
def agg_exact_chunk_metrics(t: Tables) -> DataFrame:
    found = _rounded(M.exact_metrics(_run(t), t.qrels), "precision", "recall", "f1", "mrr")
    return found.withColumn("first_rank", F.col("first_rank").cast("long"))


@query(f"WITH {JUDGED} SELECT query_id, min(rank) AS first_rank FROM j WHERE rel GROUP BY query_id")
def win_first_relevant(t: Tables) -> DataFrame:
    hit = _run(t).join(t.qrels, ["query_id", "chunk_id"])
    return hit.groupBy("query_id").agg(F.min("rank").cast("long").alias("first_rank"))


@query(f"WITH {JUDGED} SELECT query_id, chunk_id FROM run INTERSECT SELECT query_id, chunk_id FROM qrels")
def set_intersect_hits(t: Tables) -> DataFrame:
    return _run(t).select("query_id", "chunk_id").intersect(t.qrels)


@query(f"""WITH {HYBRID}, {RUN}, {QRELS}, runs AS (SELECT 'keyword' AS mode, query_id, chunk_id, rank FROM run WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id DESC) AS r FROM c WHERE dense_score IS NULL OR dense_score >= 0 QUALIFY r <= 5),
nrel AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY 1), j AS (SELECT mode, runs.query_id, count(*) AS got, count(q.chunk_id) AS hits, sum(CASE WHEN q.chunk_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM runs LEFT JOIN qrels q ON q.query_id = runs.query_id AND q.chunk_id = runs.chunk_id GROUP BY 1, 2)
SELECT mode, round(avg(hits / got), 6) AS precision, round(avg(hits / n_rel), 6) AS recall, round(avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, got) + 1) r(i))), 6) AS ndcg, count(*) AS n_queries FROM j JOIN nrel USING (query_id) GROUP BY 1""")
def agg_compare_metrics(t: Tables) -> DataFrame:
    keyword = _run(t).withColumn("mode", F.lit("keyword"))
    hybrid = R.retrieve_hybrid(t.chunks, t.vectors, t.queries, index=t.tokens).select("query_id", "chunk_id", "rank").withColumn("mode", F.lit("hybrid"))
    # judged twice, as rows and as counts; every matching pair is scored for it once
    return _rounded(M.compare_modes(keyword.unionByName(hybrid), materialize(t.qrels)), "precision", "recall", "ndcg")


@query("SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 6 = 1 THEN NULL ELSE (value + value / 2) / 2 END, 6) AS composite FROM events")
def agg_composite(t: Tables) -> DataFrame:
    a = F.when(F.col("event_id") % 6 != 1, F.col("value"))
    b = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 6 != 1, F.col("value") / 2)
    rows = t.events.select("event_id", a.alias("a"), b.alias("b"))
    return _rounded(M.composite(rows, ["a", "b"]).select("event_id", "composite"), "composite")


@query("SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'missing:a' WHEN value / 100 < 0.7 THEN 'low:a' END, CASE WHEN value / 200 < 0.7 THEN 'low:b' END) AS flags FROM events")
def agg_suggestions(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value") / 100).alias("a"), (F.col("value") / 200).alias("b"))
    return M.suggestions(rows, ["a", "b"]).select("event_id", F.array_join("flags", ",").alias("flags"))


@query("SELECT event_id, round(value * 0.75, 6) AS measured_ms, round(CASE WHEN event_id % 2 = 0 THEN value * 0.25 ELSE 0.0 END, 6) AS unaccounted_ms FROM events")
def agg_latency_report(t: Tables) -> DataFrame:
    """Stages of each request; the total of every second one is below their sum."""
    stages = F.create_map(F.lit("rag_ms"), F.col("value") * 0.5, F.lit("web_search_wall_ms"), F.lit(None).cast("double"), F.lit("generation_ms"), F.col("value") * 0.25)
    total = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.col("value") * 0.5)
    return _rounded(sinks.latency_report(t.events.select("event_id", total.alias("total_ms"), stages.alias("stages"))).select("event_id", "measured_ms", "unaccounted_ms"), "measured_ms", "unaccounted_ms")


@query("SELECT count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def agg_summary_counts(t: Tables) -> DataFrame:
    return M.summary_counts(t.events.select(F.when(F.col("event_type") == "error", F.lit("e")).alias("error")))


@query("SELECT event_id AS id, value AS faithfulness, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS total_latency_ms FROM events")
def join_scores_latency(t: Tables) -> DataFrame:
    scores = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("faithfulness"))
    timed = t.events.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("value") * 2).alias("total_latency_ms"))
    return M.with_latencies(scores, timed)


@query("SELECT item_id AS id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def anti_resume(t: Tables) -> DataFrame:
    return sinks.remaining(t.benchmark.select(F.col("item_id").alias("id")), t.labels.select(F.col("doc_id").alias("id")))


@query("SELECT d.doc_id AS id, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def join_labels(t: Tables) -> DataFrame:
    """Labels of known documents; one of an unknown would be an error."""
    truth = t.documents.select(F.col("doc_id").alias("id"))
    return M.join_labels(t.labels.select(F.col("doc_id").alias("id"), "quality"), truth).select("id", "quality")


@query("(SELECT 'head' AS side, event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5) UNION ALL (SELECT 'tail' AS side, event_id, value FROM events ORDER BY value, event_id LIMIT 5)")
def sort_ranked_report(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value")
    head = rows.orderBy(F.desc("value"), "event_id").limit(5).select(F.lit("head").alias("side"), "event_id", "value")
    tail = rows.orderBy("value", "event_id").limit(5).select(F.lit("tail").alias("side"), "event_id", "value")
    return head.union(tail)


@query(f"WITH {POOLS} SELECT query_id, chunk_id, dense_rank AS rank FROM dpool")
def win_rank_enumerate(t: Tables) -> DataFrame:
    return R.dense_pool(t.vectors, t.queries, 40).select("query_id", "chunk_id", F.col("dense_rank").cast("long").alias("rank"))


@query(f"WITH {BM25}, {RUN} SELECT query_id, md5(string_agg('[S' || CAST(rank AS VARCHAR) || '] (' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(query_text)) AS digest FROM run JOIN queries USING (query_id) JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY query_id")
def prompt_build(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("context_text"))
    found = _run(t).where("rank <= 3").join(texts, "chunk_id").join(t.queries.select("query_id", "query_text"), "query_id")
    return E.build_prompts(found).select("query_id", F.md5("prompt").alias("digest"))


@query(f"WITH {BM25}, {RUN} SELECT query_id, 'S' || CAST(rank AS VARCHAR) AS marker, chunk_id FROM run WHERE rank IN (1, 3)")
def join_citations(t: Tables) -> DataFrame:
    sources = _run(t).withColumn("marker", F.concat(F.lit("S"), F.col("rank").cast("string")))
    answers = t.queries.select("query_id", F.lit("As told [S3], and [S1]; again [S3], not [S99].").alias("answer"))
    return E.citations(answers, sources).select("query_id", "marker", "chunk_id")


@query(f"WITH {BM25}, {RUN} SELECT query_id, 'S' || CAST(rank AS VARCHAR) AS marker, chunk_id FROM run WHERE rank NOT IN (1, 3)")
def set_except_uncited(t: Tables) -> DataFrame:
    sources = _run(t).withColumn("marker", F.concat(F.lit("S"), F.col("rank").cast("string")))
    answers = t.queries.select("query_id", F.lit("As told [S3], and [S1].").alias("answer"))
    return E.uncited(answers, sources).select("query_id", "marker", "chunk_id")


@query(f"WITH {BM25}, {RUN} SELECT query_id, chunk_id, CASE WHEN doc_id IS NULL THEN 'missing' END AS note, lang FROM run LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) ON doc_id = chunk_id")
def join_metadata(t: Tables) -> DataFrame:
    metadata = t.documents.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("metadata"))
    return E.attach_metadata(_run(t), metadata).select("query_id", "chunk_id", F.col("metadata_note").alias("note"), F.col("metadata").alias("lang"))


@query("SELECT d.doc_id AS chunk_id, md5(coalesce(p.text, d.text)) AS digest FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id // 10 AND d.doc_id % 2 = 0")
def join_parent_expand(t: Tables) -> DataFrame:
    children = t.chunks.withColumn("parent_chunk_id", F.when(F.col("chunk_id") % 2 == 0, F.floor(F.col("chunk_id") / 10)))
    return R.expand_parents(children.select("chunk_id"), children, t.chunks).select("chunk_id", F.md5("context_text").alias("digest"))


@query(f"WITH {QUERIES}, {DENSE} SELECT query_id, chunk_id, lang FROM dense JOIN documents ON doc_id = chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) <= 8")
def join_index_refs(t: Tables) -> DataFrame:
    hits = R.dense_pool(t.vectors, t.queries, 8).select("query_id", "chunk_id")
    return hits.join(t.documents.select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id").select("query_id", "chunk_id", "lang")
