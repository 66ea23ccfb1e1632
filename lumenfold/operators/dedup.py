"""Content-addressed deduplication: the first writer of a hash owns it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import content_hash, normalized_hash
from lumenfold.scratch import materialize, small_enough, spread

#: Owners that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 200_000


def first_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order. Each task keeps its first of a key before
    anything moves, so a hot key's rows meet nowhere."""
    window = Window.partitionBy(*keys).orderBy(*order)
    # the limit on the rank is what lets Spark cut each task's groups before the shuffle
    return rows.withColumn("_n", F.row_number().over(window)).where("_n <= 1").drop("_n")


def with_owner(chunks: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Adds chunk_hash and owner_id: the registry's owner, or else the first chunk of the hash
    by (doc_seq, child_seq). The owner comes from an aggregate, so a very frequent hash is
    pre-combined and not sorted in one task."""
    hashed = chunks.withColumn("chunk_hash", normalized_hash(F.col("chunk_text")))
    first = hashed.groupBy("chunk_hash").agg(F.min_by("chunk_id", F.struct("doc_seq", "child_seq", "chunk_id")).alias("first_id"))
    joined = hashed.join(first, "chunk_hash")
    if registry is None:
        return joined.withColumn("owner_id", F.col("first_id")).drop("first_id").withColumn("known", F.lit(False))
    known = registry.select(F.col("hash").alias("chunk_hash"), F.col("chunk_id").alias("known_id"))
    joined = joined.join(known, "chunk_hash", "left")
    return joined.withColumn("owner_id", F.coalesce("known_id", "first_id")).withColumn("known", F.col("known_id").isNotNull()).drop("first_id", "known_id")


def distinct_chunks(children: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Children to store, with chunk_hash and owner_id: those that own their hash, unless a
    registry knows it. A text is read and hashed once, for an aggregate of ids; texts move only
    if those ids are too many to be broadcast. A chunk id is a chunk's own."""
    hashed = children.select(normalized_hash(F.col("chunk_text")).alias("chunk_hash"), "chunk_id", "doc_seq", "child_seq").where("chunk_hash is not null")
    first = hashed.groupBy("chunk_hash").agg(F.min_by("chunk_id", F.struct("doc_seq", "child_seq", "chunk_id")).alias("chunk_id"))
    if registry is not None:
        first = first.join(registry.select(F.col("hash").alias("chunk_hash")), "chunk_hash", "left_anti")
    owners = materialize(first)
    few = F.broadcast(owners) if small_enough(owners, BROADCAST_ROWS) else owners
    return children.join(few, "chunk_id").withColumn("owner_id", F.col("chunk_id"))


def kept_parents(parents: DataFrame, stored: DataFrame) -> DataFrame:
    """Parents are never hashed; a document's parents stay if any child of it does."""
    return parents.join(stored.select("document_id").distinct(), "document_id", "left_semi")


def dedup_report(children: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Per document: chunks, stored, reused, and whether nothing was new."""
    owned = with_owner(children, registry)
    new = (F.col("owner_id") == F.col("chunk_id")) & ~F.col("known")
    return owned.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(new).alias("n_stored"), F.count_if(~new).alias("n_reused")).withColumn(
        "exact_duplicate", F.col("n_stored") == 0
    )


def registry_of(chunks: DataFrame) -> DataFrame:
    """A registry from existing chunks: one owner for each hash."""
    owned = with_owner(chunks).where("owner_id = chunk_id")
    return owned.select(F.lit("chunk").alias("kind"), F.col("chunk_hash").alias("hash"), "document_id", "chunk_id")


def duplicate_documents(docs: DataFrame) -> DataFrame:
    """Documents whose content hash an earlier one has; short texts have none. Texts are hashed
    once, and written as hashes alone."""
    rows = spread(docs.select("document_id", "doc_seq", "text"))
    hashed = materialize(rows.select("document_id", "doc_seq", content_hash(F.col("text")).alias("content_hash"))).where("content_hash is not null")
    first = hashed.groupBy("content_hash").agg(F.min_by("document_id", F.struct("doc_seq", "document_id")).alias("original_id"))
    return hashed.join(first, "content_hash").where("original_id <> document_id").select("document_id", "original_id")


def ambiguous_ids(chunks: DataFrame) -> DataFrame:
    """Chunk ids with more than one metadata value."""
    return chunks.groupBy("chunk_id").agg(F.countDistinct("metadata").alias("n_metadata")).where("n_metadata > 1")
