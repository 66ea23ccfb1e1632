"""Three families of retrieval metrics, which differ in denominators and repeats, and report
aggregates. Runs are (query_id, chunk_id, rank), judgments (query_id, chunk_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    wanted = qrels.select("query_id", "chunk_id").distinct().withColumn("rel", F.lit(1))
    return run.join(wanted, ["query_id", "chunk_id"], "left").fillna(0, ["rel"])


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_rel"))


def _ideal(n) -> object:
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda r: 1 / F.log2(r + 1)), F.lit(0.0), lambda a, x: a + x)


def rank_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """Per judged query: precision over k, recall, nDCG with the ideal capped at k, and the
    reciprocal rank within the largest k."""
    rows = _relevant(qrels).join(_judged(run, qrels), "query_id", "left")
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    out = [F.max("n_rel").alias("n_rel")]
    for k in ks:
        inside = F.col("rank") <= k
        hits = F.coalesce(F.sum(F.when(inside, F.col("rel"))), F.lit(0))
        out += [(hits / k).alias(f"precision_{k}"), (hits / F.max("n_rel")).alias(f"recall_{k}")]
        out.append((F.coalesce(F.sum(F.when(inside, gain)), F.lit(0.0)) / _ideal(F.least(F.max("n_rel"), F.lit(k)))).alias(f"ndcg_{k}"))
    first = F.min(F.when((F.col("rel") == 1) & (F.col("rank") <= max(ks)), F.col("rank")))
    return rows.groupBy("query_id").agg(*out, F.coalesce(1 / first, F.lit(0.0)).alias("mrr"))


def exact_metrics(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Set precision over what was retrieved, recall, F1, hit, first relevant rank and MRR."""
    rows = _relevant(qrels).join(_judged(run.where(F.col("rank") <= k), qrels), "query_id", "left")
    per = rows.groupBy("query_id").agg(
        F.max("n_rel").alias("n_rel"), F.countDistinct("chunk_id").alias("n_got"), F.countDistinct(F.when(F.col("rel") == 1, F.col("chunk_id"))).alias("n_hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank")
    )
    precision = F.when(F.col("n_got") > 0, F.col("n_hit") / F.col("n_got")).otherwise(F.lit(0.0))
    per = per.withColumn("precision", precision).withColumn("recall", F.col("n_hit") / F.col("n_rel"))
    total = F.col("precision") + F.col("recall")
    return per.select(
        "query_id", "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)).alias("f1"),
        (F.col("n_hit") > 0).cast("int").alias("hit"), "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
    )


def compare_modes(runs: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Mean precision, recall and nDCG of each mode; runs have a ``mode`` column. The ideal
    is capped at what was retrieved."""
    rows = runs.where(F.col("rank") <= k)
    wanted = qrels.select("query_id", "chunk_id").distinct().withColumn("rel", F.lit(1))
    judged = rows.join(wanted, ["query_id", "chunk_id"], "left").fillna(0, ["rel"])
    per = judged.join(_relevant(qrels), "query_id").groupBy("mode", "query_id").agg(
        F.sum("rel").alias("hits"), F.count(F.lit(1)).alias("got"), F.max("n_rel").alias("n_rel"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    per = per.select("mode", (F.col("hits") / F.col("got")).alias("p"), (F.col("hits") / F.col("n_rel")).alias("r"), (F.col("dcg") / _ideal(F.least("n_rel", "got"))).alias("g"))
    return per.groupBy("mode").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("g").alias("ndcg"), F.count(F.lit(1)).alias("n_queries"))


def macro_mean(per_query: DataFrame) -> DataFrame:
    columns = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(*[F.avg(c).alias(c) for c in columns])


def composite(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Row mean of the metrics that a row has; null if it has none."""
    have = F.array_compact(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]))
    return scores.withColumn("composite", F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have)))


def suggestions(scores: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    """Flags: ``low:m`` under the threshold, ``missing:m`` where uncomputed."""
    flags = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")).when(F.col(c) < least, F.lit(f"low:{c}")) for c in columns]
    return scores.withColumn("flags", F.array_compact(F.array(*flags)))


def summary_counts(rows: DataFrame) -> DataFrame:
    """One row: how many rows have no error, and how many have one."""
    return rows.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def with_latencies(scores: DataFrame, timed: DataFrame) -> DataFrame:
    """Scores with the times of their id; without, null."""
    return scores.join(timed, "id", "left")


def join_labels(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Labels with what they label; an id that isn't known is an error."""
    unknown = labels.join(truth.select("id"), "id", "left_anti").limit(1).count()
    if unknown:
        raise ValueError("labels have ids that the labelled set doesn't have")
    return labels.join(truth, "id")
