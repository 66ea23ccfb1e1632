"""Evidence tables: guard, deduplication, recency, ranks, links, citations and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.web import evidence_key, recency, safety_key, url_status
from lumenfold.operators.dedup import first_per


def distinct_urls(results: DataFrame) -> DataFrame:
    """The first result of each raw URL over all queries."""
    return first_per(results, ["url"], F.asc("query_pos"), F.asc("result_pos"))


def with_url_status(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds safety_key and url_status, looked up once for each distinct key; a result whose
    key has no answer, or that has no key, is an error."""
    keyed = results.withColumn("safety_key", safety_key(F.col("url")))
    known = verdicts.select("safety_key", url_status(F.col("malicious"), F.col("suspicious"), F.col("http_status")).alias("known"))
    return keyed.join(known, "safety_key", "left").withColumn("url_status", F.coalesce("known", F.lit("error"))).drop("known")


def guard_sources(results: DataFrame, verdicts: DataFrame, enabled: bool = True) -> DataFrame:
    """Results that are safe and not flagged; any other status, or none, is dropped. Each
    distinct key is looked up once: ``verdicts`` has (safety_key, malicious, suspicious,
    http_status)."""
    if not enabled:
        return results
    flagged = F.coalesce(F.col("flagged"), F.lit(True)) if "flagged" in results.columns else F.lit(False)
    return with_url_status(results, verdicts).where((F.col("url_status") == "safe") & ~flagged)


def rank_approved(approved: DataFrame) -> DataFrame:
    """Rank of approved results within each query."""
    order = Window.partitionBy("query_pos").orderBy("result_pos")
    return approved.withColumn("rank", F.row_number().over(order))


def merge_evidence(*sources: DataFrame) -> DataFrame:
    """Union of evidence, earlier sources first in priority."""
    out = None
    for priority, rows in enumerate(sources):
        now = rows.withColumn("priority", F.lit(priority))
        out = now if out is None else out.unionByName(now, allowMissingColumns=True)
    return out


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """One row for each kind and URL or text, by priority, then id."""
    keyed = evidence.withColumn("evidence_key", evidence_key(F.col("kind"), F.col("url"), F.col("text_excerpt")))
    return first_per(keyed, ["evidence_key"], F.asc("priority"), F.asc("chunk_id"))


def with_recency(evidence: DataFrame, start: Column, end: Column) -> DataFrame:
    return evidence.withColumn("recency", recency(F.col("publication_date"), start, end))


def default_window(today: Column) -> tuple[Column, Column]:
    """The last 30 days, both ends included."""
    return F.date_sub(today, 29), today


def link_findings(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(finding_id, section, evidence_ids): known distinct ids in order of appearance; trends
    need two, others one."""
    ids = findings.select("finding_id", "section", F.posexplode("evidence_ids").alias("pos", "chunk_id"))
    known = ids.join(evidence.select("chunk_id").distinct(), "chunk_id")
    first = known.groupBy("finding_id", "section", "chunk_id").agg(F.min("pos").alias("pos"))
    linked = first.groupBy("finding_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("evidence_ids"))
    return linked.where(F.size("evidence_ids") >= F.when(F.col("section") == "trend", 2).otherwise(1))


def min_evidence(findings: DataFrame) -> DataFrame:
    need = F.when(F.col("section") == "trend", 2).otherwise(1)
    return findings.where(F.size(F.array_distinct("evidence_ids")) >= need)


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, marker, chunk_id) of the [S1]-like markers in an answer that are known, each
    once, in order of appearance."""
    found = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(S\d+)\]"), F.lit(1))).alias("pos", "marker"))
    first = found.groupBy("query_id", "marker").agg(F.min("pos").alias("pos"))
    return first.join(sources.select("query_id", "marker", "chunk_id"), ["query_id", "marker"])


def uncited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.join(citations(answers, sources).select("query_id", "marker"), ["query_id", "marker"], "left_anti")


def build_prompts(found: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): numbered source blocks in rank order, then the question; queries
    without a source are left out."""
    block = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] ("), F.col("source"), F.lit(")\n"), F.col("context_text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    made = found.groupBy("query_id", "query_text").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("context"))
    if history is not None:
        made = made.join(history, "query_id", "left")
    past = F.coalesce(F.col("history"), F.lit("")) if history is not None else F.lit("")
    return made.select("query_id", F.concat_ws("\n\n", F.nullif(past, F.lit("")), "context", F.concat(F.lit("Question: "), F.col("query_text"))).alias("prompt"))


def attach_metadata(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds metadata and a note: ambiguous ids have none, unknown ones another note."""
    per = metadata.groupBy("chunk_id").agg(F.countDistinct("metadata").alias("n"), F.min("metadata").alias("one"))
    joined = items.join(per, "chunk_id", "left")
    note = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
    return joined.withColumn("metadata", F.when(F.col("n") == 1, F.col("one"))).withColumn("metadata_note", note).drop("n", "one")


def attached_paragraphs(text: Column, most: int = 4) -> Column:
    """The first paragraphs if there are several, else the whole text."""
    parts = F.filter(F.split(text, r"\n\n", -1), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) > 1, F.slice(parts, 1, most)).otherwise(F.array(text))


def normalize_results(raw: DataFrame) -> DataFrame:
    """Typed search results: text columns, a score or null, the first valid date of three."""
    day = F.coalesce(*[F.try_to_timestamp(F.col(c)) for c in ("published_date", "published_at", "date")])
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("title", "url", "content")]
    return raw.select(*text, F.col("score").try_cast("double").alias("score"), day.alias("published_at"))
