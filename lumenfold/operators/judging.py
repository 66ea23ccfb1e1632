"""Judged answers: prompts, an injected judge with retries, scores, and the report."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import bounded_score
from lumenfold.operators.providers import retrying

SCORES = ("faithfulness", "answer_relevancy", "answer_correctness")


def judge_prompt(question: Column, answer: Column, reference: Column, contexts: Column) -> Column:
    """What a judge is asked about one answer and its numbered contexts."""
    numbered = F.array_join(F.transform(contexts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    rule = F.lit("Give faithfulness to CONTEXTS, answer_relevancy to QUESTION and answer_correctness against REFERENCE, each from 0 to 1, and a rationale, as one JSON object.")
    parts = [rule]
    for name, text in (("QUESTION", question), ("ANSWER", answer), ("REFERENCE", reference), ("CONTEXTS", numbered)):
        parts.append(F.concat(F.lit(f"{name}:\n"), F.coalesce(text, F.lit(""))))
    return F.concat_ws("\n\n", *parts)


def judge_answers(rows: DataFrame, judge: Callable[[str], str], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, the three scores, rationale, judge_error, tries) of rows with id and prompt.

    The judge is called once for each prompt, again after a rate limit; scores are cut to
    0..1, and what can't be read is null. Errors are rows, not failures of the job."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retrying(judge, attempts, sleep=sleep)
        for pdf in batches:
            done = [call(p) for p in pdf["prompt"]]
            yield pd.DataFrame({"id": pdf["id"], "raw": [d[0] for d in done], "judge_error": [d[1] for d in done], "tries": [d[2] for d in done]})

    called = rows.select("id", "prompt").mapInPandas(run, f"id {kind}, raw string, judge_error string, tries int")
    read = called.withColumn("m", F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", "map<string,string>")))
    error = F.coalesce("judge_error", F.when(F.col("m").isNull(), F.lit("invalid JSON")))
    scores = [bounded_score(F.col("m")[c]).alias(c) for c in SCORES]
    return read.select("id", *scores, F.col("m")["rationale"].alias("rationale"), error.alias("judge_error"), "tries")


# The cells of a question in the report.
REPORT_CELLS = ("retriever_hit_at_k", "first_relevant_rank", "chunk_precision", "chunk_recall", "chunk_f1", *SCORES, "total_latency_ms")


def eval_summary(rows: DataFrame) -> DataFrame:
    """One row: questions, the mean of each metric over the rows that have it, judged rows,
    and how many failed."""
    have = [c for c in REPORT_CELLS if c in rows.columns]
    return rows.agg(
        F.count(F.lit(1)).alias("questions"), *[F.avg(c).alias(c) for c in have],
        (F.count("faithfulness") if "faithfulness" in have else F.lit(0)).alias("judged"), F.count_if(F.coalesce(F.col("status") != "completed", F.lit(False))).alias("failed"),
    )


def _cell(text: Column) -> Column:
    r"""A text as a table's cell: ``\`` and ``|`` and line ends get a backslash."""
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def report_lines(rows: DataFrame) -> DataFrame:
    """(id, line): each question as a row of the report's Markdown table."""
    number = lambda c: F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("N/A"))
    cells = [F.col("id").cast("string"), _cell(F.col("question")), *[number(c) for c in REPORT_CELLS], F.coalesce("status", F.lit("completed"))]
    return rows.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report_markdown(rows: DataFrame) -> DataFrame:
    """(section, place, id, line): the lines of the report, its means first, then a row for each
    question. In the order of section, place and id they are the Markdown text; sorted, they are
    written as parts that a reader joins, so no task holds the report."""
    mean = lambda c: F.concat(F.lit(f"| {c} | "), F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("N/A")), F.lit(" |"))
    head = F.array(
        F.lit("# Evaluation"), F.lit(""), F.concat(F.lit("Questions: "), F.col("questions").cast("string"), F.lit(", judged: "), F.col("judged").cast("string")),
        F.lit(""), F.lit("| Metric | Mean |"), F.lit("| --- | --- |"), *[mean(c) for c in REPORT_CELLS], F.lit(""),
        F.lit("| ID | Question | " + " | ".join(REPORT_CELLS) + " | Status |"), F.lit("|" + " --- |" * (len(REPORT_CELLS) + 3)),
    )
    lines = report_lines(rows)
    none = F.lit(None).cast(lines.schema["id"].dataType)
    return eval_summary(rows).select(F.posexplode(head).alias("place", "line")).select(F.lit(0).alias("section"), "place", none.alias("id"), "line").unionByName(lines.select(F.lit(1).alias("section"), F.lit(0).alias("place"), "id", "line"))


def write_report(rows: DataFrame, path: str) -> None:
    """The report as sorted parts of lines."""
    report_markdown(rows).orderBy("section", "place", "id").select("line").write.mode("overwrite").text(path)


def read_report(report: DataFrame) -> DataFrame:
    """(id, question, metrics) of the completed questions of reports with a ``text``, whole or
    line by line: what a resumed run needn't ask again. Other lines are passed over."""
    width = len(REPORT_CELLS) + 3
    lines = report.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.startswith("line", F.lit("| ")) & F.endswith("line", F.lit(" |")))
    # escaped signs step aside while the line is cut
    safe = F.replace(F.replace(F.col("line"), F.lit("\\\\"), F.lit("\u0001")), F.lit("\\|"), F.lit("\u0002"))
    cells = F.split(F.expr("substring(safe, 3, length(safe) - 4)"), r" \| ", -1)
    rows = lines.withColumn("safe", safe).withColumn("cells", cells).where((F.size("cells") == width) & (F.col("cells")[width - 1] == "completed"))
    question = F.replace(F.col("cells")[1], F.lit("\\n"), F.lit("\n"))
    question = F.replace(F.replace(question, F.lit("\u0002"), F.lit("|")), F.lit("\u0001"), F.lit("\\"))
    return rows.select(F.col("cells")[0].alias("id"), question.alias("question"), *[F.col("cells")[j + 2].try_cast("double").alias(c) for j, c in enumerate(REPORT_CELLS)])
