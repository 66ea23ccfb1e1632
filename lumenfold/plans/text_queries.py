"""Projection, predicate and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions import web as W
from lumenfold.plans.catalog import query
from lumenfold.plans.fixtures import ODD, Tables
from lumenfold.plans.sqltext import UNITS, tokens
from lumenfold.scratch import materialize
from lumenfold.sources import readers

GLYPH_SQL = r"(?i)\(cid:\d+\)|/(?:gid|glyph|g)\d{2,}"


def _digest(rows: DataFrame, column) -> DataFrame:
    return rows.select("doc_id", F.length(column).cast("long").alias("n"), F.md5(column).alias("digest"))


def _sql(expression: str) -> str:
    return f"WITH {ODD}, x AS (SELECT doc_id, {expression} AS v FROM odd) SELECT doc_id, length(v) AS n, md5(v) AS digest FROM x"


@query(_sql(f"regexp_replace(text, '{GLYPH_SQL}', '', 'g')"))
def fn_strip_glyph_tokens(t: Tables) -> DataFrame:
    return _digest(t.odd_text, T.strip_glyph_tokens(F.col("text")))


@query(f"WITH {ODD} SELECT doc_id, len(regexp_extract_all(text, '{GLYPH_SQL}')) AS n FROM odd", name="fn_glyph_token_count")
def glyph_count(t: Tables) -> DataFrame:
    return t.odd_text.select("doc_id", T.glyph_token_count(F.col("text")).cast("long").alias("n"))


@query(_sql("replace(replace(replace(text, 'infor-' || chr(10) || 'mation', 'information'), 'well-' || chr(10) || 'known', 'well-known'), 'Meta-' || chr(10) || 'Verse', 'Meta-Verse')"))
def fn_dehyphenate(t: Tables) -> DataFrame:
    return _digest(t.odd_text, T.dehyphenate(F.col("text")))


@query(f"""WITH {ODD}, l AS (SELECT doc_id, i, trim(ls[i], ' ' || chr(9)) AS s, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM odd)),
p AS (SELECT *, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l)
SELECT doc_id, count(*) FILTER (WHERE NOT (s <> '' AND s IS NOT DISTINCT FROM prev)) AS n, md5(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (s <> '' AND s IS NOT DISTINCT FROM prev))) AS digest FROM p GROUP BY doc_id""")
def fn_drop_dup_lines(t: Tables) -> DataFrame:
    out = T.drop_duplicate_lines(F.col("text"))
    return t.odd_text.select("doc_id", F.size(T.lines(out)).cast("long").alias("n"), F.md5(out).alias("digest"))


@query(_sql(r"list_aggregate(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\s*(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?\s*$')), 'string_agg', chr(10))"))
def fn_drop_page_numbers(t: Tables) -> DataFrame:
    return _digest(t.odd_text, T.drop_page_numbers(F.col("text")))


@query(_sql(r"trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' +' || chr(10), chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"))
def fn_collapse_ws(t: Tables) -> DataFrame:
    return _digest(t.odd_text, T.collapse_whitespace(F.col("text")))


@query()
def clean_text(t: Tables) -> DataFrame:
    made = T.clean_text(t.odd_text, F.col("text"), "c")
    return made.select("doc_id", F.col("c.text").alias("text"), F.array_join("c.applied_fixes", ",").alias("fixes"))


@query("SELECT doc_id, md5('fi 1⁄2 ABC 12 ' || nfc_normalize(text) || ' km x2') AS digest FROM documents")
def fn_nfkc(t: Tables) -> DataFrame:
    """Each text between a ligature, a fraction, full-width letters, circled and raised digits;
    the tables themselves have no compatibility forms, which NFC would keep."""
    odd = F.concat(F.lit("ﬁ ½ ＡＢＣ ①② "), F.col("text"), F.lit(" ㎞ x²"))
    return materialize(t.documents.select("doc_id", F.md5(T.normalized(odd)).alias("digest")))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def fn_fix_mojibake(t: Tables) -> DataFrame:
    """Misread as Latin-1, and every third as Windows-1252 where that has all of its bytes."""
    latin = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    windows = F.translate(latin, T.CONTROLS, T.WINDOWS)
    broken = F.when((F.col("doc_id") % 3 == 0) & ~windows.rlike("[\u0080-\u009f]"), windows).otherwise(latin)
    return t.documents.select("doc_id", F.md5(T.fix_mojibake(broken)).alias("digest"))


RATIO = r"(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Za-z0-9\s.,;:!?''\"()\-]', '', 'g')) / length(text) ELSE 0.0 END)".replace('\\"', '"')


@query(f"SELECT doc_id, round({RATIO}, 6) AS ratio FROM documents")
def fn_meaningful_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(T.meaningful_ratio(F.col("text")), 6).alias("ratio"))


@query(f"WITH {ODD} SELECT doc_id, trim(text) <> '' AND NOT regexp_matches(text, '{GLYPH_SQL}') AND {RATIO} >= 0.95 AS ok FROM odd")
def pred_text_acceptable(t: Tables) -> DataFrame:
    return t.odd_text.select("doc_id", T.text_acceptable(F.col("text"), 0.95).alias("ok"))


@query(f"WITH x AS (SELECT doc_id, list_aggregate(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, '|'))), 'string_agg', ' ') AS text FROM documents) SELECT doc_id, NOT (trim(text) <> '' AND NOT regexp_matches(text, '{GLYPH_SQL}') AND {RATIO} >= 0.97) AS garbage FROM x")
def pred_table_garbage(t: Tables) -> DataFrame:
    rows = F.transform(F.split("text", "\n", -1), lambda x: F.split(x, r"\|", -1))
    return t.documents.select("doc_id", T.table_garbage(rows, 0.97).alias("garbage"))


@query(rf"WITH {ODD} SELECT doc_id, contains(text, '(cid:') OR regexp_matches(text, '(?i)/(?:gid|glyph|g)\d{{2,}}') AS suspect FROM odd")
def fn_cid_suspect(t: Tables) -> DataFrame:
    return t.odd_text.select("doc_id", T.cid_suspect(F.col("text")).alias("suspect"))


@query(f"SELECT doc_id, len(x) AS n, md5(coalesce(list_aggregate(list_sort(x), 'string_agg', ' '), '')) AS digest FROM (SELECT doc_id, {tokens('text')} AS x FROM documents)")
def fn_lexical_tokens(t: Tables) -> DataFrame:
    x = T.lexical_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(x), " ")).alias("digest"))


@query(f"SELECT item_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0.0 END, 6) AS overlap FROM (SELECT item_id, {tokens('b.text')} AS q, {tokens('d.text')} AS d FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)")
def fn_lexical_overlap(t: Tables) -> DataFrame:
    both = t.benchmark.select("item_id", T.lexical_tokens(F.col("text")).alias("q")).join(t.documents.select(F.col("doc_id").alias("item_id"), T.lexical_tokens(F.col("text")).alias("d")), "item_id")
    return both.select("item_id", F.round(T.lexical_overlap(F.col("q"), F.col("d")), 6).alias("overlap"))


@query(r"""SELECT doc_id, length(trim(coalesce(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: NOT (regexp_matches(trim(x), '^[A-Z][\w\s\-&]{0,40}$') AND len(list_filter(string_split_regex(trim(x), '\s+'), lambda w: w <> '')) <= 6 AND NOT regexp_matches(trim(x), '[.!?:;,]$'))), 'string_agg', ' '), ''))) AS n FROM documents""")
def fn_effective_body_len(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.effective_body_length(F.col("text")).cast("long").alias("n"))


@query("SELECT doc_id, '| id | lang |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || CAST(doc_id AS VARCHAR) || ' | ' || lang || ' |' AS md FROM documents")
def fn_rows_to_markdown(t: Tables) -> DataFrame:
    rows = F.array(F.array(F.lit("id"), F.lit("lang")), F.array(F.col("doc_id").cast("string"), F.col("lang")))
    return t.documents.select("doc_id", T.rows_to_markdown(rows).alias("md"))


@query(f"""WITH {UNITS} SELECT doc_id, len(u) AS n, md5(coalesce(array_to_string(u, chr(10) || chr(10)), '')) AS digest FROM units""")
def fn_semantic_units(t: Tables) -> DataFrame:
    units = T.semantic_units(F.col("text"))
    return t.documents.select("doc_id", F.size(units).alias("n"), F.md5(F.array_join(units, "\n\n")).alias("digest"))


@query("SELECT n_nationkey, lower(trim(regexp_replace('  ' || n_name || '   X ', '\\s+', ' ', 'g'))) AS v FROM nation".replace("\\\\", "\\"))
def fn_value_norm(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", T.value_norm(F.concat(F.lit("  "), F.col("n_name"), F.lit("   X "))).alias("v"))


@query("SELECT item_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM benchmark".replace("\\\\", "\\"))
def fn_question_norm(t: Tables) -> DataFrame:
    folded = T.strip(F.regexp_replace(T.casefold(T.nfkc(F.col("text"))), r"(?U)\s+", " "))
    # full case folding and lower case agree on these tables but for the sharp s
    return t.benchmark.select("item_id", F.md5(F.when(F.contains("text", F.lit("ß")), F.lower(T.strip(F.regexp_replace("text", r"(?U)\s+", " ")))).otherwise(folded)).alias("digest"))


@query("SELECT s_suppkey, CASE WHEN regexp_matches(k, '^[a-z][a-z0-9_]{0,63}$') THEN k END AS k FROM (SELECT s_suppkey, replace(replace(lower(trim(x)), ' ', '_'), '-', '_') AS k FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ' Key Name-' || CAST(s_suppkey AS VARCHAR) || ' ' ELSE s_name END AS x FROM supplier))")
def fn_memory_key_norm(t: Tables) -> DataFrame:
    x = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" Key Name-"), F.col("s_suppkey").cast("string"), F.lit(" "))).otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", T.memory_key_norm(x).alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS j FROM events")
def fn_json_object_extract(t: Tables) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, F.lit("no object here")).otherwise(F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```")))
    return t.events.select("event_id", T.json_object(x).alias("j"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN -1.0 END, 0.0) AS score FROM events")
def fn_alias_coalesce(t: Tables) -> DataFrame:
    doc = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("score"), F.when(F.col("event_id") % 3 == 0, F.lit(-1.0)).alias("rating")))
    names = [F.get_json_object(doc, f"$.{k}").try_cast("double") for k in ("score", "rating", "points")]
    return t.events.select("event_id", F.coalesce(*names, F.lit(0.0)).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN least(greatest(value / 100.0, 0.0), 1.0) END AS score FROM events")
def fn_bounded_score(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise((F.col("value") / 100).cast("string"))
    return t.events.select("event_id", T.bounded_score(raw).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN value END AS v FROM events")
def fn_finite_float(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return t.events.select("event_id", T.finite(raw).alias("v"))


@query("SELECT c_custkey, '[redacted]' AS api_key, '[redacted]' AS session_token, c_name AS name FROM customer")
def fn_redact(t: Tables) -> DataFrame:
    entries = F.create_map(F.lit("api_key"), F.col("c_name"), F.lit("session_token"), F.col("c_name"), F.lit("name"), F.col("c_name"))
    made = t.customer.select("c_custkey", T.redact(entries).alias("m"))
    return made.select("c_custkey", F.col("m")["api_key"].alias("api_key"), F.col("m")["session_token"].alias("session_token"), F.col("m")["name"].alias("name"))


@query("SELECT conv_id, turn, turn % 3 = 0 OR turn % 4 = 1 AS sensitive FROM conversations")
def pred_sensitive(t: Tables) -> DataFrame:
    value = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("my password is "), F.col("text"))).when(F.col("turn") % 4 == 1, F.lit("ghp_abcdefgh1234")).otherwise(F.lit("plain words"))
    return t.conversations.select("conv_id", "turn", (~T.storable(F.lit("note"), value)).alias("sensitive"))


@query("SELECT s_suppkey, regexp_matches(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'u.' || CAST(s_suppkey AS VARCHAR) END, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$') AS ok FROM supplier")
def fn_scope_validate(t: Tables) -> DataFrame:
    x = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("u."), F.col("s_suppkey").cast("string")))
    return t.supplier.select("s_suppkey", T.scope_valid(x).alias("ok"))


KEY_SQL = r"'domain:' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '')"


@query(f"SELECT page_id, {KEY_SQL} AS k FROM pages")
def fn_safety_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", W.safety_key(F.col("url")).alias("k"))


@query("SELECT page_id, replace(replace(rtrim(to_base64(encode(url)), '='), '+', '-'), '/', '_') AS k FROM pages")
def fn_url_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", W.url_id(F.col("url")).alias("k"))


@query("SELECT page_id, 'web:' || substr(sha256(url), 1, 16) AS k FROM pages")
def fn_evidence_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", W.evidence_id(F.col("url"), F.lit("title")).alias("k"))


@query("SELECT doc_id, bit_count(xor(doc_id * 2654435761, doc_id * 40503)) AS d FROM documents")
def fn_hamming(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.hamming(F.col("doc_id") * 2654435761, F.col("doc_id") * 40503).alias("d"))


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def fn_file_sha256(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 32 THEN sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS c FROM documents".replace("\\\\", "\\"))
def fn_text_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.normalized_hash(F.col("text")).alias("h"), T.content_hash(F.col("text")).alias("c"))


@query("SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value * p_retailprice / 1000.0 END, 6) AS cost FROM events LEFT JOIN part ON p_partkey = event_id AND p_partkey % 2 = 0")
def fn_cost(t: Tables) -> DataFrame:
    prices = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("event_id"), "p_retailprice")
    joined = t.events.join(prices, "event_id", "left")
    return joined.select("event_id", F.round(F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value") * F.col("p_retailprice") / 1000.0), 6).alias("cost"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 60 AS DOUBLE) END AS s FROM events")
def fn_retry_delay(t: Tables) -> DataFrame:
    error = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("quota; Retry in "), (F.col("event_id") % 60).cast("string"), F.lit("s"))).otherwise(F.lit("fine"))
    return t.events.select("event_id", T.retry_delay(error).alias("s"))


@query("SELECT event_id, event_id % 3 = 0 AS limited FROM events")
def pred_rate_limited(t: Tables) -> DataFrame:
    error = F.when(F.col("event_id") % 3 == 0, F.lit("HTTP 429: quota exceeded")).otherwise(F.lit("connection reset"))
    return t.events.select("event_id", T.rate_limited(error).alias("limited"))


@query("SELECT doc_id, lang || ' > ' || source AS title FROM documents")
def fn_section_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.section_title(F.array("lang", "source")).alias("title"))


@query("SELECT DISTINCT event_type, upper(event_type[1]) || event_type[2:] || ' Count' AS label FROM events")
def fn_public_payload(t: Tables) -> DataFrame:
    return t.events.select("event_type").distinct().select("event_type", T.public_label(F.concat("event_type", F.lit("_count"))).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS v FROM customer")
def fn_blank_to_null(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.blank_to_null(F.when(F.col("c_custkey") % 2 == 0, "   ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))).alias("v"))


@query("SELECT event_id, concat_ws('; ', 'type ' || event_type, CASE WHEN event_id % 2 = 0 THEN 'user ' || CAST(user_id AS VARCHAR) END) AS objective FROM events")
def fn_meeting_objective(t: Tables) -> DataFrame:
    user = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return t.events.select("event_id", F.concat_ws("; ", F.concat(F.lit("type "), "event_type"), user).alias("objective"))


@query("SELECT event_id, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-31' THEN 'recent' ELSE 'not_recent' END AS recency FROM events")
def recency_label(t: Tables) -> DataFrame:
    today = F.lit("2024-01-31").cast("date")
    return t.events.select("event_id", W.recency(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_sub(today, 29), today).alias("recency"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cross-industry' ELSE c_mktsegment END AS industry, CASE WHEN c_custkey % 3 = 0 THEN 'default' ELSE 'request' END AS origin FROM customer")
def scope_defaults(t: Tables) -> DataFrame:
    given = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", F.coalesce(given, F.lit("cross-industry")).alias("industry"), F.when(given.isNull(), "default").otherwise("request").alias("origin"))


@query("SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.pdf', '.html') AS ok FROM pages".replace("\\\\", "\\"))
def src_format_gate(t: Tables) -> DataFrame:
    return t.pages.select("page_id", readers.suffix(F.col("url")).alias("suffix"), readers.supported(F.col("url"), (".pdf", ".html")).alias("ok"))


@query("SELECT doc_id, greatest(0, (len(w) - 1) // 90 + 1) AS n, coalesce(len(w), 0) AS n_words FROM (SELECT doc_id, list_filter(string_split_regex(substr(text, 1, 4000), '\\s+'), lambda x: x <> '') AS w FROM documents)".replace("\\\\", "\\"))
def src_attach_extract(t: Tables) -> DataFrame:
    from lumenfold.operators.chunking import attach_windows, attached_words

    return t.documents.select("doc_id", F.size(attach_windows(F.col("text"))).cast("long").alias("n"), F.size(attached_words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS score, CAST(date_trunc('second', ts) AS TIMESTAMP) AS published_at FROM events")
def src_web_normalize(t: Tables) -> DataFrame:
    from lumenfold.operators.evidence import normalize_results

    raw = t.events.select(
        F.col("event_id").cast("string").alias("title"), F.lit("u").alias("url"), F.lit("c").alias("content"), F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.col("value").cast("string")).alias("score"),
        F.lit(None).cast("string").alias("published_date"), F.lit("not a date").alias("published_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
    )
    return normalize_results(raw).select(F.col("title").cast("long").alias("event_id"), "score", "published_at")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def src_index_load(t: Tables) -> DataFrame:
    broken = F.when(F.col("event_id") % 4 == 0, F.lit("{bad")).otherwise(F.col("props"))
    return t.events.select("event_id", F.try_element_at(readers.metadata_map(broken), F.lit("k")).cast("long").alias("k"))


@query("SELECT conv_id AS document_id, CAST(turn AS INTEGER) AS chunk_index, 'Speaker ' || CAST(turn % 2 AS VARCHAR) || ' (' || printf('%.2f', turn * 1.0) || '-' || printf('%.2f', turn + 0.5) || '): ' || text AS chunk_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) WHERE pos = turn")
def src_media(t: Tables) -> DataFrame:
    said = F.struct((F.col("turn") % 2).cast("int").alias("speaker"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).alias("end"), F.col("text").alias("transcript"))
    whole = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("u"))
    payload = F.to_json(F.struct(F.transform("u", lambda x: x["s"]).alias("utterances"), F.lit("whole").alias("transcript")))
    made = readers.utterance_chunks(whole.select(F.col("conv_id").alias("document_id"), payload.alias("payload")))
    return made.where(F.col("chunk_index") == F.col("start")).select("document_id", "chunk_index", "chunk_text")
