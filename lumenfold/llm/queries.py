"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The contract's rules for op2.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.urlrules import match_url_rules, rule_table

    return match_url_rules(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.qualitymodel import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Key of the registered query's pseudonyms; a deployment passes its own.
PSEUDONYM_KEY = b"lumenfold example key"


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.pseudonyms import pseudonymized

    found = pseudonymized(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return found.select("doc_id", "text", "n_pii", kinds.alias("kinds"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.secretscan import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.qualityrules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.decontaminate import benchmark_hits, contaminated

    found = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.packing import best_fit_packing

    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.centroids import elkan_clusters

    return elkan_clusters(_table(spark, sf_dir, "embeddings"))


def op12_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.bandjoin import near_price_lines

    return near_price_lines(_table(spark, sf_dir, "sale_lines"), _table(spark, sf_dir, "items"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.hnsw import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_secret_scans": op5_secret_scans,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_band_join": op12_band_join,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": oracles.URL_FILTERS,
    "op7_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op8_jaccard_join": oracles.JACCARD_JOIN,
    "op9_benchmark_decontamination": oracles.DECONTAMINATION,
    "op11_centroid_clustering": oracles.CENTROID_CLUSTERING,
    "op12_band_join": oracles.BAND_JOIN,
}
