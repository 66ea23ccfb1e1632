"""Sources: file gates, JSON and vector tables, injected extractors, transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# File formats that are taken in.
FORMATS = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".mp3", ".mp4")

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
# What a question of a labelled set must have.
TRUTH_FIELDS = ("id", "question", "ground_truth")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def supported(path: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    return suffix(path).isin(*formats)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Binary files with their hash; Spark itself leaves out those without a byte."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).withColumn("file_sha256", F.sha2("content", 256))


def upload_gate(files: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """Adds ``rejected``: why a file isn't taken, or null."""
    kind = suffix(F.col("path"))
    magic = F.substring("content", 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")
    return files.withColumn("rejected", F.when(~kind.isin(*FORMATS), "format").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "size").when((kind == ".pdf") & ~magic, "magic"))


def extract_with(files: DataFrame, extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run an injected extractor over accepted files; it answers failures as rows with an
    ``extraction_error``."""
    return files.mapInPandas(extractor, schema)


_PAGES = "array<struct<text:string,error:string>>"


def extract_pages(files: DataFrame, extract: Callable[[bytes], dict], most_bytes: int = 200 << 20, most_pages: int = 50) -> DataFrame:
    """Adds pages and extraction_error: an injected extractor of one file's bytes answers with
    ``encrypted`` and ``pages``, each with a text or an error. Empty, too large, foreign,
    encrypted and unreadable files, and those without a page or with too many, are rejected
    with a reason; what the extractor needn't see isn't sent to it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    magic = F.substring("content", 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")
    early = F.when((F.col("length") == 0) | F.col("content").isNull(), "empty").when(F.col("length") > most_bytes, "size").when(~magic, "magic")
    gated = files.withColumn("extraction_error", early)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages, errors = [], []
            for content, error in zip(pdf["content"], pdf["extraction_error"], strict=True):
                found = []
                if error is None:
                    try:
                        made = extract(content)
                        found = [(p.get("text"), p.get("error")) for p in made["pages"]]
                        error = "encrypted" if made.get("encrypted") else None if 1 <= len(found) <= most_pages else "pages"
                    except Exception:  # an unreadable file is a row
                        error = "corrupt"
                pages.append([{"text": a, "error": b} for a, b in found] if error is None else [])
                errors.append(error)
            yield pdf.assign(extraction_error=errors, pages=pages)

    return gated.mapInPandas(run, f"{schema}, extraction_error string, pages {_PAGES}")


#: Pages that a layout model is given at once.
PAGE_BATCH = 10
# Region types of a layout model's labels, and labels that are noise.
REGION_TYPES = {
    "title": "heading", "section_header": "heading", "text": "text", "paragraph": "text", "list_item": "list_item", "caption": "caption",
    "footnote": "footnote", "page_header": "header", "page_footer": "footer", "table": "table", "picture": "figure", "chart": "figure",
    "formula": "formula", "code": "code", "handwritten_text": "text",
}
NOISE = ("marker", "document_index")


Layout = Callable[[list[tuple[int, str | bytes]]], list[dict]]


def segment_pages(pages: DataFrame, layout: Layout, content: str = "content", batch: int = PAGE_BATCH) -> DataFrame:
    """(document_id, page_number, region_id, reading_order, raw_label, text_content, left_edge,
    top_edge, layout_error): pages of a document dealt to an injected layout model in batches of
    consecutive ones, by number.

    The model gets (page_number, content) of a batch in order and answers with its items, each
    with page_number, raw_label and, if it has them, text, left and top; they are numbered by
    page in its order. Items of other pages, or without a page, are dropped. A batch that
    fails is given page by page, and a page that fails is a row with the error alone. A page
    that comes twice is given once; the tasks hold a batch each, never a document."""
    kind = pages.schema["document_id"].dataType.simpleString()
    out = f"document_id {kind}, page_number int, region_id string, reading_order int, raw_label string, text_content string, left_edge double, top_edge double, layout_error string"
    names = [c.split()[0] for c in out.split(", ")]

    def items(document, given: list[tuple[int, str | bytes]]) -> list[tuple]:
        try:
            found, rows = layout(given), []
            for number, _ in given:
                own = [x for x in found if x.get("page_number") == number]
                rows += [(document, number, f"{document}-{number}-{k}", k, x.get("raw_label"), x.get("text"), x.get("left"), x.get("top"), None) for k, x in enumerate(own)]
            return rows
        except Exception as e:  # a page that can't be read is a row
            if len(given) > 1:
                return [row for one in given for row in items(document, [one])]
            return [(document, given[0][0], None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]

    schema = to_arrow_schema(T.StructType.fromDDL(out))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type, from_pandas=True) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, given = None, []
        for rows in batches:
            out = []
            for document, part, number, page in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                if now != (document, part):
                    out += items(now[0], given) if given else []
                    now, given = (document, part), []
                if not given or given[-1][0] != int(number):
                    given.append((int(number), page))
            yield table(out)
        if given:
            yield table(items(now[0], given))

    part = F.floor((F.col("page_number") - 1) / batch).alias("batch")
    numbered = pages.where("page_number is not null").select("document_id", part, "page_number", content)
    # sorted, so that a task takes batch after batch and not a frame for each
    return numbered.repartition("document_id", "batch").sortWithinPartitions("document_id", "batch", "page_number").mapInArrow(run, out)


def labelled_regions(regions: DataFrame) -> DataFrame:
    """Adds region_type and is_handwritten from raw_label; noise drops out, what is unknown is
    called so."""
    known = F.create_map(*[F.lit(x) for kv in REGION_TYPES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(known, F.col("raw_label")), F.lit("unknown"))
    own = regions.where(~F.coalesce(F.col("raw_label").isin(*NOISE), F.lit(False)))
    return own.withColumn("region_type", kind).withColumn("is_handwritten", F.coalesce(F.col("raw_label") == "handwritten_text", F.lit(False)))


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CHUNK_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("source_path", F.input_file_name())


def read_embeddings(spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors with unique ids; a repeated id is an error when rows are read."""
    rows = spark.read.parquet(path).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("vector"))
    repeated = rows.groupBy("chunk_id").count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError("chunk ids of embeddings must be unique")
    return rows


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("multiLine", "true").json(path)
    absent = [c for c in TRUTH_FIELDS if c not in rows.columns]
    if absent or rows.limit(1).count() == 0:
        raise ValueError(f"ground truth is empty or lacks {absent}")
    bad = rows.where(" or ".join(f"{c} is null" for c in TRUTH_FIELDS)).limit(1).count()
    if bad:
        raise ValueError("ground truth has rows without a required field")
    return rows


def metadata_map(text: Column) -> Column:
    """A JSON object as a map; unreadable text is an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def utterance_chunks(transcripts: DataFrame) -> DataFrame:
    """One chunk for each utterance, ``Speaker n (s-e): text``; without utterances, one chunk
    of the whole transcript."""
    said = "array<struct<speaker:int,start:double,end:double,transcript:string>>"
    parsed = transcripts.select("document_id", F.from_json("payload", f"struct<utterances:{said},transcript:string>").alias("p"))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("speaker"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.col("p.transcript").alias("transcript")))
    rows = parsed.select("document_id", F.posexplode(F.when(F.size(F.coalesce(F.col("p.utterances"), F.array().cast(said))) > 0, F.col("p.utterances")).otherwise(whole)).alias("chunk_index", "u"))
    head = F.format_string("Speaker %d (%.2f-%.2f): ", "u.speaker", "u.start", "u.end")
    return rows.select("document_id", "chunk_index", "u.speaker", "u.start", "u.end", F.concat(F.when(F.col("u.speaker").isNull(), F.lit("")).otherwise(head), "u.transcript").alias("chunk_text"))
