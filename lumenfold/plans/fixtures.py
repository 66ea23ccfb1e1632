"""How the driver's tables stand in for the engine's entities."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Entities over one data folder; each property reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def chunks(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("chunk_text"))

    @property
    def lines(self) -> DataFrame:
        """Pages are groups of ten lines."""
        rows = self.documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        return rows.withColumn("page_number", (F.floor(F.col("line_no") / 10) + 1).cast("int"))

    @property
    def headed_lines(self) -> DataFrame:
        """Lines of pages of three, each page under one running header."""
        rows = self.documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        rows = rows.withColumn("page_number", (F.floor(F.col("line_no") / 3) + 1).cast("int"))
        head = rows.select("document_id", F.lit(-1).alias("line_no"), F.lit("Running header").alias("line"), "page_number").distinct()
        return rows.unionByName(head)

    @property
    def regions(self) -> DataFrame:
        """A line is a region: by its number a heading, table, figure or text, with edges."""
        kind = F.when(F.col("line_no") % 7 == 0, "heading").when(F.col("line_no") % 7 == 3, "table").when(F.col("line_no") % 7 == 5, "figure").otherwise("text")
        status = F.when(F.length("line") % 5 == 0, "failed").when(F.length("line") % 5 == 1, "low_confidence").otherwise("ok")
        return self.lines.select(
            "document_id", "page_number", F.concat_ws("-", F.col("document_id").cast("string"), F.col("line_no").cast("string")).alias("region_id"), kind.alias("region_type"),
            F.col("line_no").alias("reading_order"), F.col("line").alias("text_content"), status.alias("validation_status"),
            F.when(F.length("line") % 3 == 0, "ocr").otherwise("native").alias("method"), ((F.length("line") % 4) * 50.0).alias("left_edge"), ((F.col("line_no") % 5) * 20.0).alias("top_edge"),
        )

    @property
    def queries(self) -> DataFrame:
        """Benchmark items with the vector of the same number as the query vector."""
        own = self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
        return own.join(self.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")

    @property
    def vectors(self) -> DataFrame:
        """Vectors of existing documents."""
        own = self.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
        return own.join(self.documents.select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")

    @cached_property
    def tokens(self) -> DataFrame:
        """The chunks' tokens that queries have, from one pass over the texts."""
        from lumenfold.operators.retrieval import token_index

        return token_index(self.chunks, self.queries)

    @cached_property
    def matches(self) -> DataFrame:
        """(query_id, chunk_id, bm25_score, n_common) of every matching pair."""
        from lumenfold.operators.retrieval import bm25_matches

        return bm25_matches(self.tokens, self.queries)

    def run(self, k: int) -> DataFrame:
        """(query_id, chunk_id, rank) of keyword retrieval."""
        from lumenfold.operators.retrieval import keyword_search

        return keyword_search(self.chunks, self.queries, k, tokens=self.tokens).select("query_id", "chunk_id", "rank")

    @property
    def qrels(self) -> DataFrame:
        """Documents that share at least half of an item's tokens are relevant."""
        from lumenfold.functions.text import lexical_tokens

        own = self.queries.select("query_id", F.size(lexical_tokens(F.col("query_text"))).alias("n_query"))
        return self.matches.join(own, "query_id").where(F.col("n_common") / F.col("n_query") >= 0.5).select("query_id", "chunk_id")

    @property
    def messages(self) -> DataFrame:
        own = self.conversations.where("role <> 'system'")
        return own.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("id"), "role", "text")

    @property
    def results(self) -> DataFrame:
        """Web results: twenty pages to a query."""
        return self.pages.select((F.floor(F.col("page_id") / 20)).alias("query_pos"), (F.col("page_id") % 20).alias("result_pos"), "page_id", "url", F.col("html").alias("content"))

    @property
    def verdicts(self) -> DataFrame:
        """One reputation answer for each host, from the host's length."""
        from lumenfold.functions.web import safety_key

        n = F.length("safety_key")
        keys = self.pages.select(safety_key(F.col("url")).alias("safety_key")).distinct().where("safety_key is not null")
        return keys.select(
            "safety_key", F.when(n % 5 == 0, 1).otherwise(0).alias("malicious"), F.when(n % 7 == 0, 2).when(n % 11 == 0, F.lit(None)).otherwise(0).alias("suspicious"), F.when(n % 13 == 0, 429).otherwise(200).alias("http_status")
        )

    @property
    def memories(self) -> DataFrame:
        """Suppliers as stored memories of one user, the nation as chat."""
        kinds = F.array(*[F.lit(x) for x in ("business_goal", "competitor", "budget_constraint", "business_constraint", "kpi", "industry")])
        return self.supplier.select(
            F.lit("u1").alias("user_id"), F.concat(F.lit("chat"), F.col("s_nationkey").cast("string")).alias("chat_id"), F.element_at(kinds, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("memory_type"),
            F.concat(F.lit("key_"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("value"),
        )

    @property
    def candidates(self) -> DataFrame:
        """Proposed memories for every supplier: equal, changed, new, or secret."""
        own = self.memories.join(self.supplier.select(F.concat(F.lit("key_"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_suppkey").alias("seq")), "key")
        value = F.when(F.col("seq") % 8 == 0, F.upper("value")).when(F.col("seq") % 8 == 2, F.concat(F.col("value"), F.lit(" new"))).when(F.col("seq") % 8 == 4, F.lit("my password is x")).otherwise(F.col("value"))
        key = F.when(F.col("seq") % 8 == 6, F.concat(F.lit("New Key-"), F.col("seq").cast("string"))).otherwise(F.col("key"))
        return own.select("user_id", "chat_id", "memory_type", key.alias("key"), value.alias("value"), "seq")

    @property
    def odd_text(self) -> DataFrame:
        """Documents with glyph tokens, hyphen breaks, page numbers, blanks and blank lines."""
        tail = F.concat(F.lit("\n\n\nPage "), (F.col("doc_id") % 40).cast("string"), F.lit(" of 40\ninfor-\nmation well-\nknown Meta-\nVerse  a\t b  \n2025 plan\n12/40\n"))
        return self.documents.select("doc_id", F.concat(F.replace(F.col("text"), F.lit(" the "), F.lit(" (cid:7)the /gid0012 ")), tail).alias("text"))


#: The same perturbation in SQL.
ODD = r"""odd AS (SELECT doc_id, replace(text, ' the ', ' (cid:7)the /gid0012 ') || chr(10) || chr(10) || chr(10) || 'Page ' || CAST(doc_id % 40 AS VARCHAR) || ' of 40' || chr(10) || 'infor-' || chr(10) || 'mation well-' || chr(10) || 'known Meta-' || chr(10) || 'Verse  a' || chr(9) || ' b  ' || chr(10) || '2025 plan' || chr(10) || '12/40' || chr(10) AS text FROM documents)"""
LINES = r"""lines AS (SELECT doc_id AS document_id, i - 1 AS line_no, ls[i] AS line, CAST((i - 1) // 10 + 1 AS INTEGER) AS page_number FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""
REGIONS = LINES + r""", regions AS (SELECT document_id, page_number, CAST(document_id AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) AS region_id, CASE line_no % 7 WHEN 0 THEN 'heading' WHEN 3 THEN 'table' WHEN 5 THEN 'figure' ELSE 'text' END AS region_type, line_no AS reading_order, line AS text_content, CASE length(line) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'low_confidence' ELSE 'ok' END AS validation_status, CASE WHEN length(line) % 3 = 0 THEN 'ocr' ELSE 'native' END AS method, (length(line) % 4) * 50.0 AS left_edge, (line_no % 5) * 20.0 AS top_edge FROM lines)"""
