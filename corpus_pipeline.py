"""Corpus pipeline: five of the training-data operators, one after another.

Rejected documents, all but one of each near-duplicate group and contaminated documents go;
secrets are masked; what is left is packed. All stages but the last return the columns of
``documents``, with n_chars kept true to a masked text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.decontaminate import benchmark_hits, contaminated
from lumenfold.llm.jaccard import jaccard_components
from lumenfold.llm.packing import best_fit_packing
from lumenfold.llm.qualityrules import quality_rules
from lumenfold.llm.secretscan import secret_scan
from lumenfold.llm.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Rows are judged one by one, whatever their ids, so ties and repeated rows are judged
    alike. Null, empty and blank texts go; very long ones are read whole; null languages and
    sources are groups of their own. An empty table stays empty. Further columns, whatever
    their names, are carried along."""
    parts = {c: docs[f"`{c}`"] for c in docs.columns}
    judged = docs.select(F.struct(*parts.values()).alias("row"), *[parts[c] for c in ("lang", "source", "text")])
    return quality_rules(judged, keep=["row"]).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each group of five-word shingles at 0.8 or more.

    Rows are judged by text: those that share an id, or have none, are rows of their own. Of
    a group, rows with an id come before those without, then smaller ids, then the less hash
    of the text; of rows equal in both the one stored first stays. Null, empty and blank texts
    are alone in their group and stay; very long ones are read whole. An empty table stays
    empty. Further columns, whatever their names, are carried along."""
    # ids that aren't keys of rows are replaced by one that is, written so that it holds
    unkeyed = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not unkeyed:
        classes = jaccard_components(docs, ngram=5, percent=80)
        return _only(docs, "doc_id", classes.where("component_id = doc_id").select("doc_id"))
    key = "row_key"
    while key in docs.columns:
        key += "_"
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    classes = jaccard_components(keyed, ngram=5, percent=80, id_col=key)
    order = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.col("hash"), F.col(key).alias("key"))
    named = classes.select(key, "component_id").join(keyed.select(key, "doc_id", F.xxhash64("text").alias("hash")), key)
    first = materialize(named.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.key").alias(key)))
    return _only(keyed, key, first).drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items.

    Rows are judged one by one, whatever their ids; repeated rows alike. Null and empty texts
    have no words and stay; very long ones are read whole. Without items all stay. Further
    columns, whatever their names, are carried along."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = benchmark_hits(_packed(docs), benchmark, keep=["row"])
    return found.where(~contaminated(F.col("n_words"), F.col("n_hit"))).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars kept true.

    Rows change one by one, whatever their ids; repeated rows alike. A null text stays null,
    an empty one empty; very long ones are read whole. An empty table stays empty. Further
    columns, whatever their names, are carried along."""
    found = secret_scan(_packed(docs, "text"), keep=["row"], with_text=True)
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("masked_text")}
    if "n_chars" in columns:
        length = F.length("masked_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("spans") == "", columns["n_chars"]).otherwise(length)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    Null and empty texts are one end token; very long ones are cut. Repeated rows, and rows
    without an id, are packed one by one. An empty table gives no piece. Other columns than
    id and text are left out, whatever their names."""
    return best_fit_packing(docs)


def _only(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted; both sides grow with the corpus, so none is broadcast."""
    wanted = wanted.select(F.col(key).alias("wanted_key")).hint("merge")
    return docs.join(wanted, docs[key] == wanted["wanted_key"], "left_semi")


def _packed(docs: DataFrame, *without: str) -> DataFrame:
    """All columns as one, so that none clashes with an operator's own."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in without]).alias("row"), "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("packing", packing),
]

#: Trained stages and packing can't be put in SQL; tests/llm compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
