"""Queries around injected services, agents, sinks and the remaining projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import normalized_hash
from lumenfold.operators import agents as A
from lumenfold.operators import chats as C
from lumenfold.operators import chunking, dedup, pages, providers, retrieval, trace
from lumenfold.plans.catalog import query
from lumenfold.plans.chat_queries import KEY, VERDICTS
from lumenfold.plans.fixtures import REGIONS, Tables
from lumenfold.plans.officefiles import slide_files, word_files
from lumenfold.plans.sqltext import BM25, RUN
from lumenfold.scratch import scratch_dir
from lumenfold.sources import office, readers, sinks
from lumenfold.sources.versioned import VersionedTable


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'format' WHEN doc_id % 4 = 1 THEN 'size' WHEN doc_id % 4 = 2 THEN 'magic' END AS rejected FROM documents")
def src_upload_gate(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    head = F.when(n % 4 == 2, F.lit("")).otherwise(F.lit("%PDF-"))
    files = t.documents.select("doc_id", F.when(n % 4 == 0, "a.exe").otherwise("A.PDF").alias("path"), F.when(n % 4 == 1, F.lit(60 << 20)).otherwise(F.lit(100)).alias("length"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
    return readers.upload_gate(files).select("doc_id", "rejected")


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids FROM embeddings")
def src_embeddings(t: Tables) -> DataFrame:
    rows = readers.read_embeddings(t.spark, f"{t.dir}/embeddings.parquet")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_ids"))


_LEGAL = "regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
#: The lines of a text that aren't blank, trimmed.
OFFICE_LINES = f"""x AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split({_LEGAL}, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents)"""


def _office(t: Tables) -> DataFrame:
    """Documents as what an Office file is made of."""
    lang, source = (F.coalesce(c, F.lit("")) for c in ("lang", "source"))
    table = F.array(F.array(F.concat(F.lit(" "), lang), source), F.array(F.lit("a"), F.lit("b ")), F.array(F.lit(" ")))
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), "\n", -1)
    return t.documents.select(F.col("doc_id").cast("string").alias("n"), lang.alias("title"), lines.alias("lines"), table.alias("table"), source.alias("note"))


def _doc_id(path: str) -> Column:
    return F.regexp_extract(path, r"(\d+)\.", 1).cast("long").alias("doc_id")


_ONCE = "array_to_string(list_filter(b, lambda v, i: list_position(b, v) = i), chr(10))"


@query(f"WITH {OFFICE_LINES}, s AS (SELECT doc_id, 1 AS part, list_concat([lang], ls, [lang || ' | ' || source, 'a | b'], ['Speaker notes: ' || source]) AS b FROM x UNION ALL SELECT doc_id, 2, ls FROM x WHERE len(ls) > 0) SELECT doc_id, part, md5({_ONCE}) AS digest FROM s")
def src_pptx(t: Tables) -> DataFrame:
    """Each document as a file of two slides, read back: title, shapes, tables and notes, each
    block once in order."""
    files = slide_files(_office(t).select(F.concat("n", F.lit(".pptx")).alias("path"), "title", F.col("lines").alias("shapes"), "table", "note"))
    found = office.slide_chunks(office.office_rows(files))
    return found.select(_doc_id("path"), "part", F.md5("text").alias("digest"))


@query(f"WITH {OFFICE_LINES} SELECT doc_id, len(ls) + 2 AS n_blocks, md5(array_to_string(list_concat(ls, [lang || ' | ' || source, 'a | b']), chr(10) || chr(10))) AS digest FROM x")
def src_docx(t: Tables) -> DataFrame:
    """Each document as a file, read back: paragraphs, then table rows, in groups; all groups
    together are all blocks."""
    files = word_files(_office(t).select(F.concat("n", F.lit(".docx")).alias("path"), F.col("lines").alias("paragraphs"), "table"))
    found = office.document_text(office.office_rows(files))
    groups = chunking.pack_blocks(F.col("blocks"))
    return found.select(_doc_id("path"), F.size("blocks").cast("long").alias("n_blocks"), F.md5(F.array_join(groups, "\n\n")).alias("digest"))


@query(f"WITH {REGIONS} SELECT region_type, validation_status, count(*) AS n FROM regions GROUP BY 1, 2")
def sink_validation_report(t: Tables) -> DataFrame:
    return sinks.write_validation_report(t.regions, _scratch(t))


@query(f"WITH {REGIONS} SELECT region_id FROM regions WHERE region_type = 'table' AND validation_status = 'ok'")
def sink_tables(t: Tables) -> DataFrame:
    path = _scratch(t)
    sinks.write_tables(t.regions.withColumn("rows", F.array(F.array("text_content"))), path)
    return t.spark.read.schema("region_id string").json(path)


@query("SELECT event_id AS id, value AS total_latency_ms, CAST(NULL AS VARCHAR) AS faithfulness FROM events")
def sink_eval_csv(t: Tables) -> DataFrame:
    rows = sinks.report_rows(t.events.select(F.col("event_id").alias("id"), F.col("value").alias("total_latency_ms")))
    return rows.select("id", "total_latency_ms", "faithfulness")


@query("SELECT l_orderkey AS table_id, 'a|a;b|' AS grid FROM lineitem GROUP BY 1")
def fn_table_grid(t: Tables) -> DataFrame:
    keys = t.lineitem.select(F.col("l_orderkey").alias("table_id")).distinct()
    cell = lambda r, c, cs, x: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(1).alias("row_span"), F.lit(cs).alias("col_span"), F.lit(x).alias("text"))
    grid = pages.table_grid(keys.select("table_id", F.inline(F.array(cell(0, 0, 2, "a"), cell(1, 0, 1, "b")))))
    return grid.select("table_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("grid"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN 800.0 - 100.0 - (s_suppkey % 5) ELSE NULL END AS DOUBLE) AS y0 FROM supplier")
def fn_crop(t: Tables) -> DataFrame:
    high = F.lit(100.0) + F.col("s_suppkey") % 5
    box = pages.crop_box(F.lit(0.0), high, F.lit(10.0), F.lit(100.0), F.lit(800.0), F.lit(True))
    return t.supplier.select("s_suppkey", box["y0"].alias("y0"))


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || ':' || source || ':0') AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN '1' WHEN doc_id % 3 > 1 THEN '1,' || CAST(doc_id % 3 AS VARCHAR) ELSE '1' END AS pages, length(text) AS n_chars FROM documents")
def fn_build_chunk(t: Tables) -> DataFrame:
    pages = F.array(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3), F.lit(1).cast("long"), F.lit(1).cast("long"))
    made = chunking.build_chunk(F.col("doc_id"), F.col("source"), F.lit(0), pages, F.col("text"))
    rows = t.documents.select("doc_id", made.alias("c"))
    return rows.select("doc_id", F.col("c.chunk_id").alias("chunk_id"), F.array_join(F.transform("c.page_numbers", lambda p: p.cast("string")), ",").alias("pages"), F.col("c.n_chars").cast("long").alias("n_chars"))


@query(f"WITH {REGIONS} SELECT region_id, md5(CASE WHEN validation_status = 'failed' THEN '> [missing ' || region_type || ']' WHEN region_type = 'heading' THEN '## ' || text_content ELSE text_content END) AS digest FROM regions")
def fn_render_region_md(t: Tables) -> DataFrame:
    line = sinks.region_markdown(F.col("region_type"), F.col("text_content"), F.col("validation_status") == "failed")
    return t.regions.select("region_id", F.md5(line).alias("digest"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2024' WHEN 1 THEN '2023' END AS publication_date, CASE WHEN event_id % 2 = 0 THEN 'http://x' END AS url FROM events")
def fn_evidence_provenance(t: Tables) -> DataFrame:
    n = F.col("event_id")
    meta = F.create_map(F.when(n % 3 == 0, "publication_date").when(n % 3 == 1, "date").otherwise("other"), F.when(n % 3 == 0, "2024").otherwise("2023"), F.when(n % 2 == 0, "link").otherwise("nothing"), F.lit("http://x"))
    found = A.provenance(meta)
    return t.events.select("event_id", found["publication_date"].alias("publication_date"), found["url"].alias("url"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS author, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END AS page FROM documents")
def fn_chunk_response(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    given = F.when(n % 2 == 0, F.create_map(F.lit("lang"), F.col("lang"), F.lit("author"), F.col("source"))).otherwise(F.create_map(F.lit("lang"), F.col("lang")))
    pages_of = F.when(n % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n % 3, n))
    made = t.documents.select("doc_id", A.chunk_response(given, pages_of, {"lang": "none", "author": "unknown"}).alias("r"))
    return made.select("doc_id", F.col("r.metadata")["lang"].alias("lang"), F.col("r.metadata")["author"].alias("author"), F.col("r.page").alias("page"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'meeting_title,executive_brief' ELSE 'meeting_title' END AS keys FROM documents")
def fn_briefing_projection(t: Tables) -> DataFrame:
    base = [F.lit("meeting_title"), F.col("lang"), F.lit("trace_id"), F.col("source")]
    entries = F.when(F.col("doc_id") % 2 == 0, F.create_map(*base, F.lit("executive_brief"), F.col("text"))).otherwise(F.create_map(*base))
    return t.documents.select("doc_id", F.array_join(F.map_keys(A.briefing(entries)), ",").alias("keys"))


@query("SELECT page_id, starts_with(url, 'https') AS safe FROM pages")
def fn_safe_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", A.safe_url(F.col("url"), "own.example").alias("safe"))


@query(f"WITH {REGIONS} SELECT DISTINCT document_id, page_number FROM regions r WHERE NOT EXISTS (SELECT 1 FROM regions x WHERE x.document_id = r.document_id AND x.page_number = r.page_number AND x.region_type = 'table')")
def table_fallback(t: Tables) -> DataFrame:
    ragged = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    extracted = t.regions.select("document_id", "page_number").distinct().withColumn("rows", ragged)
    return pages.table_fallback(t.regions, extracted).where("size(rows[1]) = 2").select("document_id", "page_number")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'low_confidence' ELSE 'failed' END AS validation_status FROM documents")
def table_validate(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    rows = t.documents.select("doc_id", F.when(n % 3 == 0, F.array(F.array(F.lit("cell"), F.lit("text")))).alias("rows"), F.when(n % 3 == 1, "read text").alias("ocr_text"), F.lit(None).cast("string").alias("vision_text"))
    return pages.validate_tables(rows).select("doc_id", "validation_status")


@query("SELECT event_id, event_id % 30 >= 15 AND value / 100 >= 0.75 AS ok FROM events")
def pred_text_image(t: Tables) -> DataFrame:
    return t.events.select("event_id", pages.text_image(F.col("event_id") % 30, F.col("value") / 100).alias("ok"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'parent' WHEN 1 THEN 'too_short' WHEN 2 THEN 'heading_only' END AS skip_reason FROM documents")
def embed_filter(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    text = F.when(n % 4 == 1, "ab").when(n % 4 == 2, "Long-term implications\nTechnology").otherwise("a body sentence that is long enough.")
    rows = t.documents.select("doc_id", F.when(n % 4 == 0, "parent").otherwise("child").alias("chunk_level"), text.alias("chunk_text"))
    return providers.embed_filter(rows).select("doc_id", "skip_reason")


@query("SELECT event_id, event_type || ',x' AS reasons FROM events")
def guard_reasons(t: Tables) -> DataFrame:
    verdict = F.create_map(F.lit("message"), F.lit("x"), F.lit("reason"), F.col("event_type"), F.lit("label"), F.col("event_type"), F.lit("other"), F.lit("y"))
    return t.events.select("event_id", F.array_join(A.guard_reasons(verdict), ",").alias("reasons"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' u o,' ELSE '' END || 'p1,p2,p3' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ',p4' END AS queries FROM customer")
def company_focus_query(t: Tables) -> DataFrame:
    planned = F.array(*[F.lit(x) for x in ("p1", "p2", "p2", "p3", "p4", "p5")])
    own = A.focus_queries(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("u"), F.lit("o"), planned)
    return t.customer.select("c_custkey", F.array_join(own, ",").alias("queries"))


@query("SELECT event_id, event_id % 3 = 0 OR event_id % 3 = 1 AS valid FROM events")
def readiness_rule(t: Tables) -> DataFrame:
    n = F.col("event_id")
    missing = F.when(n % 3 == 1, F.array(F.lit("budget"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return t.events.select("event_id", A.readiness_valid(n % 3 == 0, missing, F.lit("Which?")).alias("valid"))


@query("SELECT event_id, event_type || ',b' AS items FROM events")
def item_validate_drop(t: Tables) -> DataFrame:
    items = F.array(F.concat(F.lit(" "), "event_type"), F.lit("  "), F.lit(None).cast("string"), F.lit("b"), F.lit("c"))
    return t.events.select("event_id", F.array_join(A.valid_items(items, 2), ",").alias("items"))


@query("SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def pred_supported_intelligence(t: Tables) -> DataFrame:
    sources = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("s"))).when(F.col("event_id") % 4 == 1, F.array().cast("array<string>"))
    return t.events.select("event_id", A.supported(sources).alias("ok"))


@query("SELECT d.doc_id AS chunk_id, md5(p.text) AS parent FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id // 10 AND p.lang = d.lang")
def join_parent_text(t: Tables) -> DataFrame:
    child = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("document_id"), F.floor(F.col("doc_id") / 10).alias("parent_chunk_id"))
    parent = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("document_id"), F.md5("text").alias("chunk_text"))
    return chunking.join_parents(child, parent).select("chunk_id", F.col("parent_text").alias("parent"))


@query("SELECT doc_id AS region_id, CASE WHEN doc_id % 2 = 0 THEN 'crop' WHEN doc_id % 3 = 0 THEN 'stored' ELSE 'failed' END AS image_status FROM documents")
def join_figure_images(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("region_id"), F.lit("p").alias("path"))
    return pages.figure_images(rows.select("region_id"), rows.where("region_id % 2 = 0"), rows.where("region_id % 3 = 0")).select("region_id", "image_status")


@query("SELECT event_id, round((value / 100 * 0.7 + 0.5 * 0.3) / 1.0, 6) AS score FROM events")
def agg_infographic(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(pages.infographic_score(F.col("value") / 100, F.lit(0.5), 0.7, 0.3), 6).alias("score"))


@query(f"WITH {REGIONS} SELECT document_id, CASE max(CASE validation_status WHEN 'failed' THEN 2 WHEN 'low_confidence' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'low_confidence' ELSE 'ok' END AS status FROM regions GROUP BY 1")
def agg_status_worst(t: Tables) -> DataFrame:
    rows = t.regions.withColumn("chunk_id", F.col("document_id")).withColumn("confidence", F.lit(1.0))
    return chunking.chunk_roll_up(rows).select(F.col("chunk_id").alias("document_id"), "status")


@query(f"WITH {REGIONS} SELECT document_id, round(avg(CASE WHEN length(text_content) % 2 = 0 THEN length(text_content) / 100 END), 6) AS confidence FROM regions GROUP BY 1")
def agg_confidence(t: Tables) -> DataFrame:
    n = F.length("text_content")
    rows = t.regions.withColumn("chunk_id", F.col("document_id")).withColumn("confidence", F.when(n % 2 == 0, n / 100))
    return chunking.chunk_roll_up(rows).select(F.col("chunk_id").alias("document_id"), F.round("confidence", 6).alias("confidence"))


@query("SELECT count(DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS n FROM documents".replace("\\\\", "\\"))
def distinct_registry_backfill(t: Tables) -> DataFrame:
    rows = t.chunks.withColumn("doc_seq", F.col("document_id")).withColumn("child_seq", F.lit(0))
    return dedup.registry_of(rows).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT chunk_id FROM (SELECT s_suppkey % 20 AS chunk_id FROM supplier UNION SELECT s_suppkey % 30 FROM supplier)")
def distinct_sources(t: Tables) -> DataFrame:
    first = t.supplier.select((F.col("s_suppkey") % 20).alias("chunk_id"), F.col("s_suppkey").alias("position"))
    second = t.supplier.select((F.col("s_suppkey") % 30).alias("chunk_id"), F.col("s_suppkey").alias("position"))
    return A.merge_sources(first, second).select("chunk_id")


@query("SELECT user_id, count(DISTINCT event_id % 4) AS n FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_id > last GROUP BY 1")
def distinct_strategy_payloads(t: Tables) -> DataFrame:
    """Payloads of one content, with their keys in either order."""
    n = F.col("event_id")
    payload = F.when(n % 8 < 4, F.format_string('{"a":%d,"b":{"c":1,"d":2}}', n % 4)).otherwise(F.format_string('{"b":{"d":2,"c":1},"a":%d}', n % 4))
    last = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    after = t.events.join(last, "user_id").where("event_id > last").select("user_id", n.alias("id"), payload.alias("payload"))
    return C.distinct_payloads(after, ["user_id"], "payload").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT user_id, event_id, event_id % 3 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events WHERE event_type <> 'error') SELECT user_id AS chat_id, max(event_id) FILTER (WHERE back <= 10 AND k > 0) AS follow_up, max(event_id) FILTER (WHERE k = 1) AS deck FROM m GROUP BY 1 HAVING deck IS NOT NULL OR follow_up IS NOT NULL")
def win_latest_briefing(t: Tables) -> DataFrame:
    """A follow-up takes a completed or partial briefing of the last ten messages, a deck a
    completed one of the whole chat."""
    status = F.when(F.col("event_id") % 3 == 1, "completed").when(F.col("event_id") % 3 == 2, "partial").otherwise("failed")
    rows = t.events.where("event_type <> 'error'").select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("id"), F.lit("m").alias("agent"), status.alias("status"), F.lit("{}").alias("payload"))
    follow = C.latest_payloads(rows, "m", ("completed", "partial"), 10).select("chat_id", F.col("id").alias("follow_up"))
    deck = C.latest_payloads(rows, "m", ("completed",)).select("chat_id", F.col("id").alias("deck"))
    return follow.join(deck, "chat_id", "full_outer").select("chat_id", "follow_up", "deck")


@query("SELECT user_id, arg_max(event_id, event_id) AS id, arg_max(props, event_id) AS sources FROM events WHERE event_type = 'click' GROUP BY 1")
def win_prior_sources(t: Tables) -> DataFrame:
    found = C.latest(t.events, ["user_id"], "event_id", "props", F.col("event_type") == "click")
    return found.select("user_id", F.col("event_id").alias("id"), F.col("props").alias("sources"))


@query(f"WITH {REGIONS} SELECT region_id FROM regions ORDER BY document_id, page_number, reading_order")
def sort_regions(t: Tables) -> DataFrame:
    return pages.sort_regions(t.regions).select("region_id")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey = 7 DESC, s_name")
def sort_pending_docs(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_name").orderBy(F.desc(F.col("s_suppkey") == 7), "s_name")


@query("""WITH old AS (SELECT c_custkey AS chat_id, c_custkey % 5 AS owner FROM customer WHERE c_mktsegment <> 'BUILDING'), new AS (SELECT DISTINCT o_custkey AS chat_id FROM orders)
SELECT coalesce(o.chat_id, n.chat_id) AS chat_id, CASE WHEN n.chat_id IS NULL THEN 'kept' WHEN o.chat_id IS NULL THEN 'inserted' WHEN owner = 0 THEN 'refused' ELSE 'touched' END AS operation FROM old o FULL OUTER JOIN new n ON o.chat_id = n.chat_id""")
def upsert_chat(t: Tables) -> DataFrame:
    """Orders as messages to customers' chats; some come from a user who isn't the owner."""
    now = F.lit("2024-01-01").cast("timestamp")
    chats = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("chat_id"), (F.col("c_custkey") % 5).cast("long").alias("user_id"), F.col("c_name").alias("title"), now.alias("updated_at"))
    writer = F.when(F.col("o_custkey") % 5 == 0, F.lit(9)).otherwise(F.col("o_custkey") % 5).cast("long")
    messages = t.orders.select(F.col("o_custkey").alias("chat_id"), writer.alias("user_id"), F.col("o_orderkey").alias("id"), F.lit("t").alias("title"))
    return C.upsert_chats(chats, messages, now).select("chat_id", "operation")


@query("SELECT s_name AS value FROM supplier WHERE s_suppkey = 3")
def memory_point_get(t: Tables) -> DataFrame:
    return t.memories.where("user_id = 'u1' and key = 'key_3'").select("value")


@query("SELECT doc_id FROM documents WHERE lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) NOT IN (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM documents WHERE doc_id % 2 = 0)".replace("\\\\", "\\"))
def st_checkpoint(t: Tables) -> DataFrame:
    done = t.documents.where("doc_id % 2 = 0").select(normalized_hash(F.col("text")).alias("chunk_hash"), F.lit("m").alias("model"), F.lit(64).alias("dim"))
    return providers.pending_embeddings(t.chunks, done, "m", 64).select(F.col("chunk_id").alias("doc_id"))


@query("SELECT doc_id AS chunk_id, 64 AS n, true AS is_unit FROM documents WHERE length(trim(text)) > 0")
def udf_embed(t: Tables) -> DataFrame:
    """Chunks of spaces alone, or without text, aren't embedded."""
    rows = providers.embed_chunks(t.chunks.where(F.col("chunk_text").rlike(r"[^\p{Zs}]")), providers.hashed_embedding(64))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("chunk_id", F.size("vector").cast("long").alias("n"), (F.abs(norm - 1) < 1e-4).alias("is_unit"))


def _found(t: Tables, queries: DataFrame | None = None) -> DataFrame:
    """What keyword retrieval finds for all queries, or for those given alone, with its texts."""
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("context_text"))
    run = t.run(8) if queries is None else retrieval.keyword_search(t.chunks, queries, 8).select("query_id", "chunk_id", "rank")
    asked = t.queries if queries is None else queries
    return run.join(texts, "chunk_id").join(asked.select("query_id", "query_text"), "query_id")


@query(f"WITH {BM25}, {RUN} SELECT q.query_id, CAST(r.chunk_id AS VARCHAR) AS cited FROM queries q LEFT JOIN (SELECT * FROM run WHERE rank = 1) r USING (query_id)")
def rag_trace(t: Tables) -> DataFrame:
    """Retrieve, prompt, generate with a stand-in, cite."""
    answered = providers.answer_questions(t.queries, _found(t), providers.echo_generator)
    return answered.select("query_id", F.nullif(F.array_join(F.col("citations").cast("array<string>"), ","), F.lit("")).alias("cited"))


@query(f"WITH {BM25}, {RUN} SELECT query_id, 'rag' AS kind, chunk_id, rank FROM run")
def rag_client(t: Tables) -> DataFrame:
    return _found(t).select("query_id", F.lit("rag").alias("kind"), "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CASE event_type WHEN 'click' THEN 'repeat' ELSE 'follow_up' END ELSE 'new' END AS class FROM events")
def agent_reuse(t: Tables) -> DataFrame:
    label = F.when(F.col("event_type") == "click", "repeat").when(F.col("event_type") == "view", "follow_up").when(F.col("event_type") == "error", F.lit(None)).otherwise("bad label")
    return t.events.select("event_id", A.reuse_class(label).alias("class"))


@query(f"""WITH {BM25}, {RUN}, {VERDICTS}, web AS (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url),
ev AS (SELECT 'rag' AS kind, lower(trim(text)) AS k FROM run JOIN documents ON doc_id = chunk_id UNION SELECT 'web', lower(trim(url)) FROM web JOIN status ON k = {KEY} WHERE s = 'safe')
SELECT kind, 'recent' AS recency, count(*) AS n FROM ev GROUP BY 1""")
def agent_intelligence(t: Tables) -> DataFrame:
    """Evidence from retrieval and guarded web results, merged, distinct, dated and linked."""
    from lumenfold.operators import evidence as E

    rag = _found(t).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.lit("rag").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("context_text").alias("text_excerpt"))
    web = E.guard_sources(E.distinct_urls(t.results), t.verdicts).select(F.concat(F.lit("web"), F.col("page_id").cast("string")).alias("chunk_id"), F.lit("web").alias("kind"), "url", F.col("content").alias("text_excerpt"))
    merged = E.distinct_evidence(E.merge_evidence(rag, web)).withColumn("publication_date", F.lit("2024-01-15"))
    today = F.lit("2024-01-31").cast("date")
    return E.with_recency(merged, *E.default_window(today)).groupBy("kind", "recency").agg(F.count(F.lit(1)).alias("n"))


def _scratch(t: Tables) -> str:
    return scratch_dir(t.spark)


@query("SELECT lang, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1")
def src_chunks_json(t: Tables) -> DataFrame:
    """Files that each hold one JSON list of chunks, written and read back."""
    path = _scratch(t)
    item = F.struct(F.col("text").alias("chunk_text"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    sinks.write_json_lists(t.documents.repartition(64).select(F.to_json(item).alias("value")), path)
    rows = readers.read_chunks_json(t.spark, path)
    return rows.groupBy(F.col("metadata")["lang"].alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk_text")).alias("chars"))


@query("SELECT lang AS user_id, count(*) AS n FROM documents GROUP BY 1")
def sink_chunks(t: Tables) -> DataFrame:
    path = _scratch(t)
    sinks.write_chunks(t.documents.select(F.col("lang").alias("user_id"), F.lit("p").alias("project_id"), F.col("text").alias("chunk_text")), path)
    return t.spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 3 THEN 'changed' ELSE md5(text) END AS digest FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT -1 - doc_id, 'new' FROM documents WHERE doc_id % 10 = 5")
def sink_index(t: Tables) -> DataFrame:
    """An index that is made once, then updated: a tenth of its chunks changes, a tenth goes, a
    tenth is new; half of its buckets are compacted, older versions deleted."""
    table = VersionedTable(t.spark, _scratch(t))
    own = t.chunks.select("chunk_id", F.md5("chunk_text").alias("digest"))
    table.create(own, ["chunk_id"], buckets=16)
    changed = own.where("chunk_id % 10 = 3").select("chunk_id", F.lit("changed").alias("digest"))
    added = own.where("chunk_id % 10 = 5").select((-1 - F.col("chunk_id")).alias("chunk_id"), F.lit("new").alias("digest"))
    table.commit(changed.union(added), own.where("chunk_id % 10 = 7"))
    table.compact(range(8))
    table.vacuum()
    return table.read()


@query("SELECT count(*) AS n, sum(len(embedding)) AS floats FROM embeddings")
def sink_embeddings(t: Tables) -> DataFrame:
    path = _scratch(t)
    t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")).write.parquet(path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("floats"))


@query("SELECT item_id AS id, text AS question FROM benchmark")
def src_ground_truth(t: Tables) -> DataFrame:
    path = _scratch(t)
    item = F.struct(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("a").alias("ground_truth"))
    sinks.write_json_lists(t.benchmark.repartition(8).select(F.to_json(item).alias("value")), path)
    return readers.read_ground_truth(t.spark, path).select("id", "question")


@query(f"WITH {BM25}, {RUN} SELECT query_id, '[S1]' AS marker FROM run GROUP BY 1")
def udf_generate(t: Tables) -> DataFrame:
    """With a stand-in generator."""
    from lumenfold.operators.evidence import build_prompts

    made = providers.apply_service(build_prompts(_found(t)), providers.echo_generator, "query_id long, answer string, prompt_tokens long")
    return made.select("query_id", F.regexp_extract("answer", r"\[S1\]", 0).alias("marker"))


@query("SELECT 3 AS query_id, CAST(chunk_id AS VARCHAR) AS cited FROM (WITH " + BM25 + ", " + RUN + " SELECT chunk_id FROM run WHERE rank = 1 AND query_id = 3)")
def trace_one_question(t: Tables) -> DataFrame:
    one = t.queries.where("query_id = 3")
    answered = providers.answer_questions(one, _found(t, one), providers.echo_generator)
    return answered.select(F.col("query_id").cast("int").alias("query_id"), F.array_join(F.col("citations").cast("array<string>"), ",").alias("cited"))


@query(f"""WITH {REGIONS}, r AS (SELECT * FROM regions WHERE document_id = 1 AND page_number = 1),
p AS (SELECT string_agg(text_content, chr(10) ORDER BY reading_order) AS raw FROM r HAVING count(*) > 0),
x AS (SELECT *, length(text_content) AS n, trim(text_content) <> '' AND NOT regexp_matches(text_content, '(?i)\\(cid:\\d+\\)|/(?:gid|glyph|g)\\d{{2,}}') AND length(regexp_replace(text_content, '[^A-Za-z0-9\\s.,;:!?''\"()\\-]', '', 'g')) / greatest(length(text_content), 1) >= 0.4 AS good FROM r),
s AS (SELECT *, good AND (n % 10) / 10 >= 0.6 AS ocr_ok, good AND (n % 10) / 10 >= 0.3 AS ocr_low, n % 4 = 0 AS vision FROM x),
v AS (SELECT *, CASE WHEN good OR ocr_ok THEN 'ok' WHEN ocr_low OR vision THEN 'low_confidence' ELSE 'failed' END AS status, CASE WHEN good THEN 'native' WHEN ocr_ok OR ocr_low THEN 'ocr' WHEN vision THEN 'vision' ELSE 'none' END AS how FROM s)
SELECT 1 AS stage, 'page' AS item, 'raw_text' AS field, raw AS value, contains(raw, 'the') AS found FROM p
UNION ALL SELECT 2, 'page', f[1], f[2], NULL FROM (SELECT unnest([['is_blank', CAST(length(trim(raw)) <= 3 AS VARCHAR)], ['is_scanned', 'false'], ['is_broken_font', 'false'], ['has_table_hint', 'false'], ['native_trusted', 'true']]) AS f FROM p)
UNION ALL SELECT 3, region_id, 'region_type', region_type, NULL FROM v UNION ALL SELECT 3, region_id, 'text_content', text_content, contains(text_content, 'the') FROM v
UNION ALL SELECT 4, region_id, 'validation_status', status, NULL FROM v UNION ALL SELECT 4, region_id, 'method', how, NULL FROM v""")
def trace_one_page(t: Tables) -> DataFrame:
    """All stages of one page; the cleaned texts, which SQL can't make, are left out here."""
    n = F.length("text_content")
    given = t.regions.drop("method", "validation_status").withColumn("ocr_text", F.col("text_content")).withColumn("ocr_confidence", (n % 10) / 10).withColumn("vision_text", F.when(n % 4 == 0, F.lit("seen")))
    lines = F.array_sort(F.collect_list(F.struct("reading_order", "text_content")))
    zero = {c: F.lit(0) for c in ("n_images", "n_spans", "n_suspect_spans", "line_rect_count")}
    raw = t.regions.groupBy("document_id", "page_number").agg(F.array_join(F.transform(lines, lambda x: x["text_content"]), "\n").alias("raw_text")).withColumns({**zero, "image_area_ratio": F.lit(0.0)})
    wanted = t.spark.createDataFrame([(1, 1)], "document_id long, page_number int")
    found = trace.trace_pages(raw, given, wanted, "the")
    return found.where("field not in ('final_text', 'preview')").select("stage", "item", "field", "value", "found")


@query("SELECT user_id, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT DISTINCT user_id, event_type AS k FROM events WHERE event_type <> 'error') GROUP BY 1")
def agent_meeting(t: Tables) -> DataFrame:
    """Sources of two earlier results merged, each once."""
    rows = t.events.where("event_type <> 'error'").select("user_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("chunk_id"), F.col("event_id").alias("position"), "event_type")
    merged = A.merge_sources(rows.where("position % 2 = 0"), rows)
    return merged.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("keys"))
