"""Sinks: partitioned tables, reports and audit text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import redact

# Columns of a report of judged answers.
REPORT_COLUMNS = (
    "id", "question", "generated_answer", "faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness",
    "retrieval_latency_ms", "generation_latency_ms", "total_latency_ms", "prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost",
)


def write_chunks(chunks: DataFrame, path: str, scope: tuple[str, ...] = ("user_id", "project_id")) -> None:
    """Chunks by scope; only the partitions of the frame are replaced."""
    present = [c for c in scope if c in chunks.columns]
    writer = chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*present) if present else writer).parquet(path)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("validation_status").agg(F.count(F.lit(1)).alias("n"))


def write_validation_report(regions: DataFrame, path: str) -> DataFrame:
    """Writes a record for each region; returns how many there are of each type and status."""
    columns = [c for c in ("document_id", "page_number", "region_id", "region_type", "validation_status", "method", "failure_reason") if c in regions.columns]
    regions.select(*columns).write.mode("overwrite").parquet(path)
    return regions.sparkSession.read.parquet(path).groupBy("region_type", "validation_status").agg(F.count(F.lit(1)).alias("n"))


def write_tables(regions: DataFrame, path: str, cells: str = "rows") -> None:
    """Structured tables that passed, one JSON object each."""
    own = regions.where((F.col("region_type") == "table") & (F.col("validation_status") == "ok"))
    own.select("region_id", cells).write.mode("overwrite").json(path)


def category_counts(elements: DataFrame) -> DataFrame:
    """Elements by tool and category: what extractors differ in."""
    return elements.groupBy("tool", "category").agg(F.count(F.lit(1)).alias("n"))


def spans(events: DataFrame) -> DataFrame:
    """(trace_id, span_id, name, metadata, duration_ms) from starts and ends (what, at_ms);
    a span without an end has no duration. Secrets in the metadata are masked."""
    at = lambda what: F.max(F.when(F.col("what") == what, F.col("at_ms")))
    paired = events.groupBy("trace_id", "span_id", "name").agg((at("end") - at("start")).alias("duration_ms"), F.first("metadata").alias("metadata"))
    return paired.select("trace_id", "span_id", "name", redact(F.col("metadata")).alias("metadata"), "duration_ms")


def latency_report(rows: DataFrame, total: str = "total_ms", stages: str = "stages") -> DataFrame:
    """Adds measured_ms, the sum of a map of stages, and unaccounted_ms, what is left of the
    total, nought at least."""
    measured = F.aggregate(F.map_values(stages), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return rows.withColumn("measured_ms", measured).withColumn("unaccounted_ms", F.greatest(F.lit(0.0), F.col(total) - F.col("measured_ms")))


def raw_snapshot(regions: DataFrame) -> DataFrame:
    """Regions of a page as one sorted array, before any cleaning."""
    item = F.struct("reading_order", "region_id", "region_type", "text_content")
    return regions.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("regions"))


def region_markdown(kind, text, failed):
    """A region in Markdown by type, with a mark for what is missing."""
    lost = F.concat(F.lit("> [missing "), kind, F.lit("]"))
    body = (
        F.when(kind == "heading", F.concat(F.lit("## "), text)).when(kind == "list_item", F.concat(F.lit("- "), text))
        .when(kind == "caption", F.concat(F.lit("*"), text, F.lit("*"))).when(kind == "footnote", F.concat(F.lit("<sub>"), text, F.lit("</sub>"))).otherwise(text)
    )
    return F.when(failed | text.isNull(), lost).otherwise(body)


def audit_markdown(regions: DataFrame) -> DataFrame:
    """(document_id, markdown) in reading order."""
    line = region_markdown(F.col("region_type"), F.col("text_content"), F.col("validation_status") == "failed")
    parts = F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "region_id", line.alias("line"))))
    return regions.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("markdown"))


def report_rows(results: DataFrame) -> DataFrame:
    """Exactly the report's columns in order, absent ones null."""
    return results.select(*[F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in REPORT_COLUMNS])


def append_report(results: DataFrame, path: str) -> None:
    report_rows(results).write.mode("append").option("header", "true").csv(path)


def write_index(index: DataFrame, path: str) -> DataFrame:
    """Replace an index table; returns its manifest."""
    index.write.mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("n_chunks"))


def write_json_lists(items: DataFrame, path: str) -> None:
    """Files of one JSON list each, from rows with a JSON ``value``: a file for each partition,
    written line by line as rows come, so no list is ever held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = "["
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"value": [f"{before if k == 0 else ','}{v}" for k, v in enumerate(pdf["value"])]})
                before = ","
        yield pd.DataFrame({"value": ["[]" if before == "[" else "]"]})

    items.select("value").mapInPandas(run, "value string").write.mode("overwrite").text(path)


def remaining(questions: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run still has to do."""
    return questions.join(done.select("id").distinct(), "id", "left_anti")
