"""Evidence, guard, chat, memory and state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import format_exchange
from lumenfold.functions.web import url_status
from lumenfold.operators import chats as C
from lumenfold.operators import evidence as E
from lumenfold.plans.catalog import query
from lumenfold.plans.fixtures import Tables
from lumenfold.scratch import scratch_dir
from lumenfold.streaming import state as S

KEY = r"'domain:' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '')"
VERDICTS = f"""keys AS (SELECT DISTINCT {KEY} AS k FROM pages),
status AS (SELECT k, CASE WHEN length(k) % 13 = 0 THEN 'rate_limited' WHEN length(k) % 7 <> 0 AND length(k) % 11 = 0 THEN 'error' WHEN length(k) % 5 = 0 OR length(k) % 7 = 0 THEN 'blocked' ELSE 'safe' END AS s FROM keys)"""


@query(f"WITH {VERDICTS} SELECT k AS safety_key, s AS status FROM status", name="url_status")
def url_status_query(t: Tables) -> DataFrame:
    return t.verdicts.select("safety_key", url_status(F.col("malicious"), F.col("suspicious"), F.col("http_status")).alias("status"))


@query(f"WITH {VERDICTS} SELECT page_id FROM pages JOIN status ON k = {KEY} WHERE s = 'safe'")
def source_guard(t: Tables) -> DataFrame:
    return E.guard_sources(t.results, t.verdicts).select("page_id")


@query(f"WITH {VERDICTS} SELECT page_id, coalesce(s, 'error') AS status FROM pages LEFT JOIN status ON k = {KEY}")
def join_guard_back(t: Tables) -> DataFrame:
    return E.with_url_status(t.results, t.verdicts).select("page_id", F.col("url_status").alias("status"))


@query("SELECT page_id FROM pages QUALIFY row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id) = 1")
def distinct_web_urls(t: Tables) -> DataFrame:
    return E.distinct_urls(t.results.withColumn("url", F.substring_index("url", "?", 1))).select("page_id")


@query(f"WITH {VERDICTS} SELECT page_id, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id % 20) AS rank FROM pages JOIN status ON k = {KEY} WHERE s = 'safe'")
def win_rank_per_query(t: Tables) -> DataFrame:
    return E.rank_approved(E.guard_sources(t.results, t.verdicts)).select("page_id", F.col("rank").cast("long").alias("rank"))


def _evidence(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.lit("rag").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("text").alias("text_excerpt"))
    web = t.pages.select((F.col("page_id") + 1_000_000).alias("chunk_id"), F.lit("web").alias("kind"), F.upper(F.substring_index("url", "?", 1)).alias("url"), F.lit("x").alias("text_excerpt"))
    return E.merge_evidence(web, docs)


EVIDENCE = """ev AS (SELECT doc_id AS chunk_id, 'rag' AS kind, sha256(lower(trim(text))) AS k, 1 AS priority FROM documents UNION ALL SELECT page_id + 1000000, 'web', lower(split_part(url, '?', 1)), 0 FROM pages)"""


@query(f"WITH {EVIDENCE} SELECT chunk_id FROM ev QUALIFY row_number() OVER (PARTITION BY kind, k ORDER BY priority, chunk_id) = 1")
def distinct_evidence(t: Tables) -> DataFrame:
    return E.distinct_evidence(_evidence(t)).select("chunk_id")


@query(f"WITH {EVIDENCE} SELECT kind, priority, count(*) AS n FROM ev GROUP BY 1, 2")
def set_union_evidence(t: Tables) -> DataFrame:
    return _evidence(t).groupBy("kind", "priority").agg(F.count(F.lit(1)).alias("n"))


def _findings(t: Tables) -> DataFrame:
    n = F.col("event_id")
    ids = F.array(n % 300, (n * 7) % 2000, n % 300)
    return t.events.select(n.alias("finding_id"), F.when(n % 2 == 0, "trend").otherwise("risk").alias("section"), ids.alias("evidence_ids"))


LINKS = """f AS (SELECT event_id AS finding_id, CASE WHEN event_id % 2 = 0 THEN 'trend' ELSE 'risk' END AS section, event_id % 300 AS a, (event_id * 7) % 2000 AS b FROM events)"""


@query(f"""WITH {LINKS}, l AS (SELECT finding_id, section, CASE WHEN a IN (SELECT doc_id FROM documents) THEN a END AS x, CASE WHEN b <> a AND b IN (SELECT doc_id FROM documents) THEN b END AS y FROM f)
SELECT finding_id, concat_ws(',', x, y) AS ids FROM l WHERE (x IS NOT NULL)::INT + (y IS NOT NULL)::INT >= CASE section WHEN 'trend' THEN 2 ELSE 1 END""")
def join_evidence_ids(t: Tables) -> DataFrame:
    found = E.link_findings(_findings(t), t.documents.select(F.col("doc_id").alias("chunk_id")))
    return found.select("finding_id", F.array_join(F.col("evidence_ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {LINKS} SELECT finding_id FROM f WHERE section = 'risk' OR a <> b")
def min_evidence_filter(t: Tables) -> DataFrame:
    return E.min_evidence(_findings(t)).select("finding_id")


@query("SELECT doc_id, 1 AS n FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 4 FROM documents WHERE doc_id % 2 = 0")
def limit_paragraphs(t: Tables) -> DataFrame:
    body = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("\n\n", *[F.col("lang")] * 6)).otherwise(F.col("lang"))
    return t.documents.select("doc_id", F.size(E.attached_paragraphs(body)).alias("n"))


PAIRS = """m AS (SELECT * FROM conversations WHERE role <> 'system'), pairs AS (SELECT conv_id AS chat_id, turn AS id, CASE WHEN lag(role) OVER w = 'user' THEN lag(text) OVER w END AS question, text AS answer, role FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"WITH {PAIRS} SELECT chat_id, id, md5(coalesce(question, '-')) AS question, md5(answer) AS answer FROM pairs WHERE role <> 'user'")
def win_pair_exchanges(t: Tables) -> DataFrame:
    found = C.pair_exchanges(t.messages)
    return found.select("chat_id", "id", F.md5(F.coalesce("question", F.lit("-"))).alias("question"), F.md5("answer").alias("answer"))


@query(f"WITH {PAIRS} SELECT chat_id, md5(string_agg(CAST(id AS VARCHAR) || '. Q: ' || question || chr(10) || 'A: ' || substr(answer, 1, 800), chr(10) ORDER BY id)) AS digest FROM pairs WHERE role <> 'user' AND question IS NOT NULL GROUP BY 1")
def fn_format_exchanges(t: Tables) -> DataFrame:
    pairs = C.pair_exchanges(t.messages).where("question is not null")
    parts = F.array_sort(F.collect_list(F.struct("id", format_exchange(F.col("id"), F.col("question"), F.col("answer")).alias("x"))))
    return pairs.groupBy("chat_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["x"]), "\n")).alias("digest"))


@query("SELECT conv_id AS chat_id, turn AS id FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def win_history_tail(t: Tables) -> DataFrame:
    return C.history_tail(t.messages, 3).select("chat_id", "id")


def _exchanges(t: Tables) -> DataFrame:
    pairs = C.pair_exchanges(t.messages).where("question is not null")
    agent = F.when(F.col("id") % 3 != 0, F.lit("strategy"))
    status = F.when(F.col("id") % 5 == 1, "failed").otherwise("completed")
    return pairs.withColumn("agent", agent).withColumn("status", status).withColumn("error_code", F.lit(None).cast("string"))


@query(f"WITH {PAIRS} SELECT chat_id, id FROM pairs WHERE role <> 'user' AND question IS NOT NULL AND id % 3 = 0 AND id % 5 <> 1")
def eligible_exchanges(t: Tables) -> DataFrame:
    return C.eligible_exchanges(_exchanges(t), None).select("chat_id", "id")


@query(f"WITH {PAIRS}, asked AS (SELECT chat_id * 100 + id AS query_id, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS q FROM pairs WHERE role <> 'user' AND question IS NOT NULL), known AS (SELECT lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS q, chat_id * 100 + id AS id FROM pairs WHERE role <> 'user' AND question IS NOT NULL) SELECT query_id, max(id) AS id FROM asked JOIN known USING (q) GROUP BY 1".replace("\\\\", "\\"))
def win_exact_repeat(t: Tables) -> DataFrame:
    pairs = C.pair_exchanges(t.messages).where("question is not null").withColumn("id", F.col("chat_id") * 100 + F.col("id"))
    asked = pairs.select(F.col("id").alias("query_id"), F.upper("question").alias("query_text"))
    return C.exact_repeats(pairs, asked).select("query_id", "id")


@query("SELECT conv_id AS chat_id, max(turn) AS id, md5(arg_max(text, turn)) AS digest FROM conversations WHERE role = 'assistant' AND turn % 2 = 1 GROUP BY 1")
def win_latest_meeting(t: Tables) -> DataFrame:
    found = C.latest(t.messages, ["chat_id"], "id", "text", (F.col("role") == "assistant") & (F.col("id") % 2 == 1))
    return found.select("chat_id", "id", F.md5("text").alias("digest"))


@query("SELECT c_custkey AS chat_id, count(o_orderkey) AS message_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_chat_counts(t: Tables) -> DataFrame:
    return C.chat_counts(t.customer.select(F.col("c_custkey").alias("chat_id")), t.orders.select(F.col("o_custkey").alias("chat_id")))


@query("SELECT o_orderkey AS session_id, c_name AS user_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def join_session(t: Tables) -> DataFrame:
    live = C.live_sessions(t.orders.withColumn("expires_at", F.col("o_orderdate")), F.lit("1998-01-01").cast("timestamp"))
    return live.join(t.customer, live["o_custkey"] == F.col("c_custkey")).select(F.col("o_orderkey").alias("session_id"), F.col("c_name").alias("user_name"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def expire_sessions(t: Tables) -> DataFrame:
    return C.live_sessions(t.orders.withColumn("expires_at", F.col("o_orderdate")), F.lit("1998-01-01").cast("timestamp")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id AS chat_id, turn AS id FROM conversations WHERE role <> 'system' AND conv_id % 3 <> 0")
def delete_cascade(t: Tables) -> DataFrame:
    return C.delete_chats(t.messages, t.messages.where("chat_id % 3 = 0")).select("chat_id", "id")


@query("SELECT s_suppkey FROM supplier UNION SELECT s_suppkey + 5 FROM supplier")
def create_user(t: Tables) -> DataFrame:
    return C.insert_new(t.supplier.select("s_suppkey"), t.supplier.select((F.col("s_suppkey") + 5).alias("s_suppkey")), "s_suppkey")


MEM = """mem AS (SELECT 'u1' AS user_id, 'chat' || CAST(s_nationkey AS VARCHAR) AS chat_id, (['business_goal', 'competitor', 'budget_constraint', 'business_constraint', 'kpi', 'industry'])[s_suppkey % 6 + 1] AS memory_type, 'key_' || CAST(s_suppkey AS VARCHAR) AS key, s_name AS value, s_suppkey FROM supplier)"""


@query(f"""WITH {MEM} SELECT user_id, chat_id, memory_type, key, CASE WHEN s_suppkey % 8 = 2 THEN value || ' new' ELSE value END AS value, CASE WHEN s_suppkey % 8 = 2 THEN 'updated' WHEN s_suppkey % 8 IN (4, 6) THEN 'kept' ELSE 'ignored' END AS operation FROM mem
UNION ALL SELECT user_id, chat_id, memory_type, 'new_key_' || CAST(s_suppkey AS VARCHAR), value, 'inserted' FROM mem WHERE s_suppkey % 8 = 6""")
def upsert_memory(t: Tables) -> DataFrame:
    return C.upsert_memory(t.memories, C.storable_candidates(t.candidates))


@query(f"""WITH {MEM} SELECT chat_id, memory_type, CASE WHEN s_suppkey % 8 = 6 THEN 'new_key_' ELSE 'key_' END || CAST(s_suppkey AS VARCHAR) AS key FROM mem WHERE s_suppkey % 8 <> 4""")
def process_message(t: Tables) -> DataFrame:
    return C.storable_candidates(t.candidates.unionByName(t.candidates.withColumn("seq", F.col("seq") + 1000))).select("chat_id", "memory_type", "key")


@query(f"""WITH {MEM} SELECT chat_id, CASE memory_type WHEN 'business_goal' THEN 'business_goals' WHEN 'competitor' THEN 'competitors' WHEN 'kpi' THEN 'kpis' ELSE 'constraints' END AS label, string_agg(value, ',' ORDER BY memory_type, key) AS memory_values FROM mem WHERE memory_type <> 'industry' GROUP BY 1, 2""")
def agg_memory_context(t: Tables) -> DataFrame:
    return C.memory_context(t.memories).select("chat_id", "label", F.array_join("memory_values", ",").alias("memory_values"))


@query(f"WITH {MEM} SELECT chat_id, key FROM mem UNION ALL SELECT 'branch', key FROM mem WHERE chat_id = 'chat1'")
def clone_chat(t: Tables) -> DataFrame:
    return C.clone_memory(t.memories, "chat1", "branch").select("chat_id", "key")


@query(f"WITH {MEM} SELECT memory_type, key, value FROM mem ORDER BY memory_type, key")
def sort_memories(t: Tables) -> DataFrame:
    return t.memories.select("memory_type", "key", "value").orderBy("memory_type", "key")


@query(f"""WITH {MEM}, op AS (SELECT *, s_suppkey % 8 AS k FROM mem)
SELECT 'memory' AS record, chat_id, memory_type || '/' || key AS name, CASE WHEN k = 2 THEN value || ' new' ELSE value END AS value FROM op UNION ALL SELECT 'memory', chat_id, memory_type || '/new_key_' || CAST(s_suppkey AS VARCHAR), value FROM op WHERE k = 6
UNION ALL SELECT 'profile', chat_id, key, CASE WHEN k = 2 THEN value || ' new' ELSE value END FROM op WHERE memory_type = 'industry' UNION ALL SELECT 'profile', chat_id, 'new_key_' || CAST(s_suppkey AS VARCHAR), value FROM op WHERE k = 6 AND memory_type = 'industry'""")
def upsert_memory_profile(t: Tables) -> DataFrame:
    """Memories stored, then upserted, in a table whose commits hold rows and profile entries."""
    table = C.create_store(t.spark, scratch_dir(t.spark), 8)
    C.store_memories(table, t.memories.withColumn("seq", F.lit(0)))
    C.store_memories(table, t.candidates)
    profiles = C.stored_profiles(table).select(F.lit("profile").alias("record"), "chat_id", F.explode("profile").alias("name", "value"))
    return C.stored_memories(table).select(F.lit("memory").alias("record"), "chat_id", F.concat_ws("/", "memory_type", "key").alias("name"), "value").unionByName(profiles)


@query(f"""WITH {MEM}, c AS (SELECT chat_id, string_agg(value, ' ' ORDER BY s_suppkey) AS title FROM mem GROUP BY 1) SELECT 'chat' AS what, chat_id || '-b' AS chat_id, substr(title || ' (Branch)', 1, 120) AS value FROM c WHERE right(chat_id, 1) <> '4'
UNION ALL SELECT 'memory', chat_id || '-b', key FROM mem WHERE right(chat_id, 1) <> '4'""")
def fork_chat(t: Tables) -> DataFrame:
    """Branches of all chats but some, with their memories; a fork of an unknown chat is none."""
    rows = t.memories.join(t.supplier.select(F.concat(F.lit("key_"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_suppkey").alias("n")), "key")
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), " ")
    chats = rows.groupBy("chat_id", "user_id").agg(titles.alias("title"))
    forks = chats.where(~F.col("chat_id").endswith("4")).select("chat_id", F.concat("chat_id", F.lit("-b")).alias("new_chat_id")).union(t.spark.createDataFrame([("none", "lost")], "chat_id string, new_chat_id string"))
    made, copies = C.fork_chats(chats, t.memories, forks)
    return made.select(F.lit("chat").alias("what"), "chat_id", F.col("title").alias("value")).union(copies.select(F.lit("memory"), "chat_id", "key"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'market' WHEN 'view' THEN 'target_audience' ELSE 'company_context' END AS slot FROM events")
def clarification_slot(t: Tables) -> DataFrame:
    item = F.when(F.col("event_type") == "click", "Target COUNTRIES").when(F.col("event_type") == "view", "the audience").otherwise("budget")
    return t.events.select("event_id", C.clarification_slot(item).alias("slot"))


@query("SELECT user_id, arg_max(props, event_id) AS state FROM events WHERE event_type <> 'error' GROUP BY 1")
def strategy_state(t: Tables) -> DataFrame:
    return C.latest(t.events, ["user_id"], "event_id", "props", F.col("event_type") != "error").select("user_id", F.col("props").alias("state"))


@query("""WITH RECURSIVE ev AS (SELECT user_id, event_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, [t] AS log, true AS accepted FROM ev WHERE rn = 1 UNION ALL SELECT user_id, event_id, rn, CASE WHEN len(live) < 4 THEN list_append(live, t) ELSE live END, len(live) < 4 FROM (SELECT e.user_id, e.event_id, e.rn, e.t, list_filter(f.log, lambda x: x > e.t - 86400) AS live FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT event_id, accepted FROM f""")
def st_sliding_limiter(t: Tables) -> DataFrame:
    return S.limit_calls(t.events.select("user_id", "event_id", "ts"), 4, 86_400.0).select("event_id", "accepted")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def events_windowed(t: Tables) -> DataFrame:
    """A Spark extra over telemetry, not an operator of the survey."""
    counted = S.windowed_counts(t.events)
    return counted.select("event_type", F.col("window.start").alias("hour"), "n")
