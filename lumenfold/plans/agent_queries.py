"""Judges, batches, chains, searches, images, accounts and other injected services, with
deterministic stand-ins for the services."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import images
from lumenfold.operators import agents as A
from lumenfold.operators import chains as X
from lumenfold.operators import imaging as I
from lumenfold.operators import judging as J
from lumenfold.operators import providers as P
from lumenfold.plans.catalog import query
from lumenfold.plans.fixtures import LINES, Tables
from lumenfold.plans.sqltext import BM25, RUN
from lumenfold.schemas import broken_checks
from lumenfold.scratch import scratch_dir
from lumenfold.sources import readers, sinks
from lumenfold.sources.versioned import VersionedTable
from lumenfold.streaming import jobs
from lumenfold.streaming import state as S


def _no_wait(_: float) -> None:
    return None


def _judge(prompt: str) -> str:
    n = len(prompt.split("QUESTION:\n", 1)[1].split("\n\nANSWER:", 1)[0])
    if n % 7 == 0:
        raise RuntimeError("429 rate limit")
    if n % 5 == 0:
        return "no object"
    return json.dumps({"faithfulness": n % 13 / 10, "answer_relevancy": "n/a" if n % 3 == 0 else 0.5, "answer_correctness": -0.2, "rationale": f"r{n}"})


@query("""SELECT item_id AS id, CASE WHEN n % 7 <> 0 AND n % 5 <> 0 THEN least(n % 13 / 10, 1.0) END AS faithfulness, CASE WHEN n % 7 <> 0 AND n % 5 <> 0 AND n % 3 <> 0 THEN 0.5::DOUBLE END AS answer_relevancy, CASE WHEN n % 7 <> 0 AND n % 5 <> 0 THEN 0::DOUBLE END AS answer_correctness, CASE WHEN n % 7 <> 0 AND n % 5 <> 0 THEN 'r' || CAST(n AS VARCHAR) END AS rationale,
CASE WHEN n % 7 = 0 THEN '429 rate limit' WHEN n % 5 = 0 THEN 'invalid JSON' END AS judge_error, CASE WHEN n % 7 = 0 THEN 5 ELSE 1 END AS tries FROM (SELECT item_id, length(text) AS n FROM benchmark)""")
def udf_judge(t: Tables) -> DataFrame:
    rows = t.benchmark.join(t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("context")), "item_id", "left")
    prompt = J.judge_prompt(F.col("text"), F.lit("an answer"), F.lit("a reference"), F.array_compact(F.array("context")))
    return J.judge_answers(rows.select(F.col("item_id").alias("id"), prompt.alias("prompt")), _judge, sleep=_no_wait)


def _generate(prompt: str) -> str:
    if len(prompt) % 4 == 0:
        raise RuntimeError("connection reset")
    return f"{len(prompt)} characters [S1]"


@query(f"""WITH {BM25}, {RUN}, p AS (SELECT query_id, count(*) AS k, sum(length('[S' || CAST(rank AS VARCHAR) || '] (' || source || ')' || chr(10) || text)) + 2 * (count(*) - 1) + 2 + length('Question: ') + any_value(length(query_text)) AS n FROM run JOIN queries USING (query_id) JOIN documents ON doc_id = chunk_id GROUP BY 1)
SELECT item_id AS id, CASE WHEN n IS NULL OR n % 4 = 0 THEN '' ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) || ' characters [S1]' END AS answer, CASE WHEN n IS NULL OR n % 4 = 0 THEN 0 ELSE k END AS n_contexts, coalesce(n % 4 <> 0, true) AS timed, CASE WHEN n % 4 = 0 THEN 'connection reset' END AS error FROM benchmark LEFT JOIN p ON query_id = item_id""")
def src_ask_batch(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("context_text"), (F.col("doc_id") % 9).alias("page"))
    found = t.run(8).join(texts, "chunk_id")
    asked = P.ask_batch(t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question")), found, _generate, sleep=_no_wait)
    return asked.select("id", "answer", F.size("contexts").cast("long").alias("n_contexts"), F.col("generation_latency_ms").isNotNull().alias("timed"), "error")


def _judged(t: Tables) -> DataFrame:
    n = F.col("item_id")
    question = F.concat(F.col("text"), F.lit(" | a\\b\\| x\ny"))
    scores = [F.when(n % 3 != k % 3, ((n * (k + 1)) % 10) / 10).alias(c) for k, c in enumerate(J.REPORT_CELLS)]
    return t.benchmark.select(n.alias("id"), question.alias("question"), *scores, F.when(n % 11 == 0, "failed").when(n % 2 == 0, "completed").alias("status"))


_CELLS = ", ".join(f"CASE WHEN item_id % 3 <> {k % 3} THEN ((item_id * {k + 1}) % 10) / 10 END AS {c}" for k, c in enumerate(J.REPORT_CELLS))


@query(f"SELECT CAST(item_id AS VARCHAR) AS id, md5(text || ' | a\\b\\| x' || chr(10) || 'y') AS question, {_CELLS} FROM benchmark WHERE item_id % 11 <> 0")
def sink_eval_report(t: Tables) -> DataFrame:
    """The Markdown report, written, and read again as a resumed run does."""
    path = scratch_dir(t.spark)
    J.write_report(_judged(t), path)
    return J.read_report(t.spark.read.text(path).withColumnRenamed("value", "text")).withColumn("question", F.md5("question"))


@query(f"WITH x AS (SELECT CASE WHEN item_id % 11 = 0 THEN 1 ELSE 0 END AS bad, {_CELLS} FROM benchmark) SELECT count(*) AS questions, count(faithfulness) AS judged, sum(bad) AS failed, round(avg(faithfulness), 6) AS faithfulness, round(avg(chunk_f1), 6) AS chunk_f1, round(avg(total_latency_ms), 6) AS total_latency_ms FROM x")
def agg_eval_means(t: Tables) -> DataFrame:
    found = J.eval_summary(_judged(t))
    return found.select("questions", "judged", "failed", *[F.round(c, 6).alias(c) for c in ("faithfulness", "chunk_f1", "total_latency_ms")])


def _stub(*columns):
    return lambda rows: rows.select("request_id", *columns)


def _agents() -> X.Agents:
    """Agents whose answers go by the request's number."""
    n = F.col("request_id")
    status = F.when(n % 11 == 3, "failed").when(n % 13 == 5, "declined").otherwise("completed")
    return X.Agents(
        classify=_stub((n % 7 != 2).alias("on_topic"), (n % 14 == 2).alias("is_greeting")),
        research=_stub(status.alias("intel_status"), (n % 5).alias("n_sources"), F.when(n % 11 == 3, F.lit("index_not_found")).alias("intel_error")),
        assess=_stub((n % 4 != 1).alias("ready")),
        develop=_stub((n % 3).alias("n_priorities"), (n % 2).alias("n_questions"), F.when(n % 17 == 4, F.lit("generation_error")).alias("develop_error")),
        prepare=_stub(F.when(n % 19 == 6, F.lit("generation_unavailable")).alias("prepare_error")),
        intend=_stub(F.when(n % 3 == 0, "expand_strategy").when(n % 3 == 1, "modify_meeting").alias("intent")),
    )


_OUTCOME = """CASE WHEN intel = 'failed' THEN 'failed' WHEN intel = 'declined' THEN 'declined' WHEN src = 0 THEN 'partial' WHEN NOT ready THEN 'needs_input' WHEN n % 17 = 4 THEN 'failed' WHEN n % 3 > 0 OR n % 2 > 0 THEN 'completed' ELSE 'partial' END AS status,
CASE WHEN intel = 'failed' THEN 'index_not_found' WHEN intel = 'declined' THEN 'out_of_scope' WHEN src > 0 AND ready AND n % 17 = 4 THEN 'generation_error' END AS error_code"""
_HTTP = "CASE error_code WHEN 'index_not_found' THEN 404 WHEN 'generation_unavailable' THEN 503 WHEN 'generation_error' THEN 502 ELSE 200 END AS http_status"
_INTEL = "CASE WHEN n % 11 = 3 THEN 'failed' WHEN n % 13 = 5 THEN 'declined' ELSE 'completed' END"


INTEL_OF_EVENTS = _INTEL.replace("n %", "event_id %")


@query(f"""WITH r AS (SELECT event_id AS n, user_id AS chat, 'Sell ' || event_type || ' ' || CAST(event_id % 50 AS VARCHAR) AS objective, user_id % 6 = 0 AS resumed FROM events),
k AS (SELECT chat, max(n) AS hit, objective FROM (SELECT user_id AS chat, event_id AS n, 'sell ' || event_type || ' ' || CAST(event_id % 50 AS VARCHAR) AS objective FROM events WHERE event_id % 10 = 0) GROUP BY chat, objective),
m AS (SELECT r.*, CASE WHEN NOT resumed THEN hit END AS hit FROM r LEFT JOIN k ON k.chat = r.chat AND k.objective = lower(r.objective)),
s AS (SELECT *, CASE WHEN resumed THEN 'completed' ELSE {_INTEL} END AS intel, CASE WHEN resumed THEN 2 ELSE n % 5 END AS src, n % 4 <> 1 AS ready FROM m),
o AS (SELECT n, hit, resumed, objective, {_OUTCOME} FROM s),
f AS (SELECT n, hit, CASE WHEN hit IS NOT NULL THEN 'replayed' WHEN n % 7 = 2 THEN 'declined' ELSE status END AS status, CASE WHEN hit IS NOT NULL THEN NULL WHEN n % 7 = 2 THEN CASE WHEN n % 14 <> 2 THEN 'out_of_scope' END ELSE error_code END AS error_code, CASE WHEN hit IS NOT NULL OR n % 7 = 2 THEN 'keep' WHEN status = 'needs_input' THEN 'save' ELSE 'clear' END AS state, CASE WHEN resumed AND n % 7 <> 2 THEN 'Enter the market (Target/Clarification: ' || objective || ')' ELSE objective END AS objective FROM o)
SELECT n AS request_id, status, error_code, state, hit AS replayed_id, md5(objective) AS objective, {_HTTP} FROM f""")
def chain_strategy(t: Tables) -> DataFrame:
    requests = t.events.select(_event("request_id"), F.col("user_id").alias("chat_id"), _objective().alias("objective"))
    pending = t.events.where("user_id % 6 = 0").select(F.col("user_id").alias("chat_id"), F.lit("Enter the market").alias("objective"), F.lit(2).alias("n_sources")).distinct()
    earlier = t.events.where("event_id % 10 = 0").select(F.col("user_id").alias("chat_id"), _event("id"), F.upper(_objective()).alias("question"), F.lit("a").alias("answer"))
    found = X.strategy_chain(requests, pending, earlier, _agents())
    return found.select("request_id", "status", "error_code", "state", "replayed_id", F.md5("objective").alias("objective"), "http_status")


def _event(name: str):
    return F.col("event_id").alias(name)


def _objective():
    return F.concat(F.lit("Sell "), F.col("event_type"), F.lit(" "), (F.col("event_id") % 50).cast("string"))


@query(f"""WITH s AS (SELECT event_id AS n, {INTEL_OF_EVENTS} AS intel FROM events), f AS (SELECT n, CASE WHEN intel <> 'completed' THEN intel WHEN n % 19 = 6 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN intel = 'failed' THEN 'index_not_found' WHEN intel = 'declined' THEN 'out_of_scope' WHEN n % 19 = 6 THEN 'generation_unavailable' END AS error_code FROM s)
SELECT n AS request_id, status, error_code, {_HTTP} FROM f""")
def chain_meeting(t: Tables) -> DataFrame:
    return X.meeting_chain(t.events.select(_event("request_id"), _objective().alias("objective")), _agents()).drop("strategy_status")


@query(f"""WITH r AS (SELECT event_id AS n, user_id % 8 <> 0 AS has, CASE WHEN event_id % 3 = 0 THEN 'expand_strategy' WHEN event_id % 3 = 1 THEN 'modify_meeting' WHEN event_type = 'click' THEN 'modify_meeting' ELSE 'expand_strategy' END AS intent FROM events),
s AS (SELECT *, {_INTEL} AS intel, n % 5 AS src, true AS ready FROM r), o AS (SELECT *, {_OUTCOME} FROM s),
f AS (SELECT n, has, intent, CASE WHEN intent = 'modify_meeting' THEN CASE WHEN intel <> 'completed' THEN intel WHEN n % 19 = 6 THEN 'failed' ELSE 'completed' END ELSE status END AS status, CASE WHEN intent = 'modify_meeting' THEN CASE WHEN intel = 'failed' THEN 'index_not_found' WHEN intel = 'declined' THEN 'out_of_scope' WHEN n % 19 = 6 THEN 'generation_unavailable' END ELSE error_code END AS error_code FROM o)
SELECT n AS request_id, intent, CASE intent WHEN 'modify_meeting' THEN 'meeting_preparation' ELSE 'market_strategy' END AS agent, status, error_code, {_HTTP} FROM f WHERE has UNION ALL SELECT n, NULL, NULL, 'refused', NULL, 409 FROM f WHERE NOT has""")
def chain_follow_up(t: Tables) -> DataFrame:
    message = F.concat(F.when(F.col("event_type") == "click", F.lit("Please CHANGE ")).otherwise(F.lit("exchange ")), _objective())
    requests = t.events.select(_event("request_id"), F.col("user_id").alias("chat_id"), message.alias("objective"))
    briefings = t.events.where("user_id % 8 <> 0").select(F.col("user_id").alias("chat_id"), F.lit("Meet").alias("objective")).distinct()
    return X.follow_up_chain(requests, briefings, _agents())


@query("SELECT event_id, event_type = 'click' OR event_id % 4 = 0 AS hit FROM events")
def market_snapshot_pred(t: Tables) -> DataFrame:
    """A bare trend counts, wherever it stands, and white space of any kind; market conditions don't."""
    asked = F.concat(F.when(F.col("event_type") == "click", F.lit("the COMPETITIVE \n landscape ")).otherwise(F.lit("compete ")), F.when(F.col("event_id") % 4 == 0, F.lit("or what is UpTRENDing")).otherwise(F.lit("or market conditions")))
    return t.events.select("event_id", X.asks_for_snapshot(asked).alias("hit"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'modify_meeting' ELSE 'expand_strategy' END AS intent FROM events")
def followup_intent_fallback(t: Tables) -> DataFrame:
    message = F.concat(F.lit("please "), F.when(F.col("event_type") == "view", "Revise").otherwise("revised"), F.lit(" it"))
    return t.events.select("event_id", X.follow_up_intent(message).alias("intent"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'declined' WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 > 0 AND event_id % 2 > 0 THEN 'completed' ELSE 'partial' END AS status, CASE WHEN event_id % 14 = 7 THEN 'out_of_scope' WHEN event_id % 7 <> 0 AND event_id % 5 = 0 THEN 'generation_error' END AS error_code FROM events")
def agent_status_gate(t: Tables) -> DataFrame:
    n = F.col("event_id")
    found = X.intelligence_status(n % 7 != 0, n % 14 == 0, F.when(n % 5 == 0, F.lit("generation_error")), n % 3, n % 2)
    return t.events.select("event_id", found["status"].alias("status"), found["error_code"].alias("error_code"))


@query(f"WITH s AS (SELECT event_id AS n, {INTEL_OF_EVENTS} AS intel, event_id % 5 AS src, event_id % 4 <> 1 AS ready FROM events) SELECT n AS event_id, {_OUTCOME}, 3 AS n_opportunities, 4 AS n_actions FROM s")
def agent_strategy(t: Tables) -> DataFrame:
    """Gates, readiness and the caps of the sections of each strategy."""
    rows = t.events.select(_event("request_id"), _objective().alias("objective"))
    agents = _agents()
    gated = X._developed(X._joined(rows, agents.research(rows)), agents)
    items = F.array(*[F.lit(x) for x in (" a", "", "b", "c ", "d", "e", "f")])
    return gated.select(
        F.col("request_id").alias("event_id"), "status", "error_code", F.size(A.valid_items(items, A.CAPS[0])).alias("n_opportunities"), F.size(A.valid_items(items, A.CAPS[5])).alias("n_actions")
    )


@query("SELECT item_id AS query_pos, i AS result_pos, 'https://host' || CAST(i AS VARCHAR) || '.example/' || CAST(item_id AS VARCHAR) AS url, i / 10 AS score, CAST(NULL AS VARCHAR) AS error FROM benchmark, range(0, 5) r(i) WHERE item_id % 11 <> 0 AND i < item_id % 7 UNION ALL SELECT item_id, NULL, NULL, NULL, 'search is away' FROM benchmark WHERE item_id % 11 = 0")
def src_web_search(t: Tables) -> DataFrame:
    def search(text: str, most: int) -> list[dict]:
        n = int(text.split(" ", 1)[0])
        if n % 11 == 0:
            raise RuntimeError("search is away")
        return [{"title": "t", "url": f"https://host{i}.example/{n}", "content": text, "score": i / 10} for i in range(n % 7)]

    asked = t.benchmark.select(F.col("item_id").alias("query_pos"), F.concat_ws(" ", F.col("item_id").cast("string"), "text").alias("query_text"))
    return P.search_web(asked, search).select("query_pos", "result_pos", "url", "score", "error")


@query("SELECT item_id AS request_id, CASE WHEN item_id % 7 <> 0 AND item_id % 5 < 4 AND item_id % 9 <> 0 THEN 'report ' || CAST(item_id AS VARCHAR) END AS report, CASE WHEN item_id % 7 <> 0 AND item_id % 5 < 4 AND item_id % 9 <> 0 THEN 1 + item_id % 2 END AS n_sources, CASE WHEN item_id % 5 = 4 THEN 'research timed out' WHEN item_id % 7 = 0 THEN 'research failed' WHEN item_id % 9 = 0 THEN 'research gave no report' END AS error FROM benchmark")
def src_research(t: Tables) -> DataFrame:
    """A service that completes after some polls; three are allowed."""

    def at(name: str) -> dict:
        n, k = (int(x) for x in name.split(":"))
        status = "running" if k < n % 5 else "failed" if n % 7 == 0 else "completed"
        report = " " if n % 9 == 0 else f" report {n} "
        return {"id": name, "status": status, "report": report, "sources": [{"url": "u"}, {"url": ""}, {"url": "v" if n % 2 else None}]}

    class Clock:
        """Time passes by pauses alone, and so counts the polls."""

        now = 0.0

        def sleep(self, seconds: float) -> None:
            self.now += seconds

    clock = Clock()

    def start(prompt: str) -> dict:
        clock.now = 0.0
        return at(f"{prompt}:0")

    def poll(name: str) -> dict:
        return at(f"{name.split(':')[0]}:{int(clock.now)}")

    asked = t.benchmark.select(F.col("item_id").alias("request_id"), F.col("item_id").cast("string").alias("prompt"))
    found = P.research(asked, start, poll, deadline=3.0, pause=1.0, clock=lambda: clock.now, sleep=clock.sleep)
    return found.select("request_id", "report", F.when(F.col("sources").isNotNull(), F.size("sources")).cast("long").alias("n_sources"), "error")


PIXELS = "(SELECT doc_id, list_transform(range(64), lambda i: ((i * (doc_id % 97 + 1)) % 251)) AS p FROM documents)"


def _pixels(t: Tables) -> DataFrame:
    n = F.col("doc_id") % 97 + 1
    return t.documents.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * n) % 251).cast("int")).alias("p"))


@query(f"SELECT doc_id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN p[i + 1] > list_avg(p) THEN power(2::HUGEINT, 63 - i)::HUGEINT ELSE 0::HUGEINT END)) AS BIGINT) AS phash FROM {PIXELS}")
def fn_phash(t: Tables) -> DataFrame:
    """Bitmaps of eight by eight grey levels, decoded and hashed."""
    content = F.unhex(F.concat(F.hex(F.lit("P5 8 8 255\n")), F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x), 2, "0")), "")))
    return I.image_features(_pixels(t).select("doc_id", content.alias("content"))).select("doc_id", "phash")


@query()
def fn_image_features(t: Tables) -> DataFrame:
    """Whole texts as bitmaps of 32 columns, a byte a pixel: hash, share of edges, size."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    height = F.ceil(F.octet_length(text) / 32)
    body = F.rpad(text, (height * 32).cast("int"), F.lit(b" "))
    content = F.concat(F.encode(F.concat(F.lit("P5 32 "), height.cast("string"), F.lit(" 255\n")), "UTF-8"), body)
    return I.image_features(t.documents.select("doc_id", content.alias("content"))).drop("content")


@query(f"SELECT doc_id, round(len(list_filter(p, lambda x: x % 3 = 0 AND x <> 0)) / 64, 6) AS density FROM {PIXELS}")
def fn_edge_density(t: Tables) -> DataFrame:
    edges = F.transform("p", lambda x: F.when(x % 3 == 0, x).otherwise(F.lit(0)))
    return _pixels(t).select("doc_id", F.round(images.edge_density(edges), 6).alias("density"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang || chr(10) || source END AS text, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE round((0.5 + doc_id % 10 / 10) / 2, 6) END AS mean_confidence, CASE WHEN doc_id % 91 < 45 THEN CASE WHEN doc_id % 91 > 0 THEN CAST(doc_id % 91 AS DOUBLE) ELSE 0.0 END WHEN doc_id % 91 = 45 THEN 45.0 WHEN doc_id % 91 = 90 THEN 0.0 ELSE CAST(doc_id % 91 - 90 AS DOUBLE) END AS angle FROM documents")
def fn_ocr(t: Tables) -> DataFrame:
    """With a stand-in for the injected reader, which can't take a batch with every seventh image."""

    def ocr(contents: list[bytes]) -> list[list[tuple[str, float]]]:
        made = [c.decode().split("|") for c in contents]
        if len(made) > 1 and any(int(n) % 7 == 0 for n, *_ in made):
            raise TimeoutError("too slow")
        return [[(lang, 0.5), (source, int(n) % 10 / 10)] if int(n) % 4 else [] for n, lang, source in made]

    files = t.documents.select("doc_id", F.encode(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source"), "UTF-8").alias("content"))
    read = I.read_images(files, ocr)
    return read.select("doc_id", F.col("ocr_text").alias("text"), F.round("ocr_confidence", 6).alias("mean_confidence"), images.deskew_angle(-(F.col("doc_id") % 91).cast("double")).alias("angle"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unavailable' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'failed' ELSE 'described' END AS status FROM documents")
def udf_vision(t: Tables) -> DataFrame:
    """With a stand-in that fails for some images and has no words for others."""

    def describe(batches):
        for pdf in batches:
            yield pdf[["doc_id"]].assign(text=[None if n % 5 == 0 else " " if n % 7 == 0 else "a chart" for n in pdf["doc_id"]], error=["away" if n % 5 == 0 else None for n in pdf["doc_id"]])

    made = P.apply_service(t.documents.select("doc_id"), describe, "doc_id long, text string, error string")
    return made.select("doc_id", images.vision_status(F.col("doc_id") % 3 != 0, F.col("text"), F.col("error")).alias("status"))


@query("SELECT source AS tool, lang AS category, count(*) AS n FROM documents GROUP BY 1, 2")
def ext_compare_tools(t: Tables) -> DataFrame:
    return sinks.category_counts(t.documents.select(F.col("source").alias("tool"), F.col("lang").alias("category")))


@query("SELECT user_id AS trace_id, count(*) AS n_spans, round(sum(value), 4) AS total_ms, round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS click_ms, count(*) FILTER (WHERE event_id % 9 = 0) AS n_open FROM events GROUP BY 1")
def trace_obs(t: Tables) -> DataFrame:
    """Starts and ends of spans as rows; the metadata's secrets are masked on the way."""
    meta = F.create_map(F.lit("api_key"), F.lit("x"), F.lit("kind"), F.col("event_type"))
    base = t.events.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("name"), meta.alias("metadata"), "value", "event_id")
    starts = base.select("trace_id", "span_id", "name", F.lit("start").alias("what"), F.lit(0.0).alias("at_ms"), "metadata")
    ends = base.where("event_id % 9 <> 0").select("trace_id", "span_id", "name", F.lit("end").alias("what"), F.col("value").alias("at_ms"), "metadata")
    spans = sinks.spans(starts.union(ends))
    safe = spans.where(F.col("metadata")["api_key"] == "[redacted]")
    timed = safe.join(t.events.select(F.col("event_id").alias("span_id"), "value"), "span_id")
    length = F.coalesce("duration_ms", "value")
    return timed.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.round(F.sum(length), 4).alias("total_ms"), F.round(F.sum(F.when(F.col("name") == "click", length)), 4).alias("click_ms"), F.count_if(F.col("duration_ms").isNull()).alias("n_open")
    )


@query("""WITH m AS (SELECT user_id, event_id, event_type, event_id % 4 AS k FROM events), l AS (SELECT user_id, max(event_id) AS last FROM m WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT m.user_id, k, min(event_id) AS id FROM m JOIN l USING (user_id) WHERE event_id > last AND event_type = 'click' GROUP BY 1, 2),
a AS (SELECT user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS n FROM s GROUP BY 1)
SELECT user_id AS chat_id, 'Meeting ' || CAST(last AS VARCHAR) AS title, CAST(last AS VARCHAR) || coalesce(',' || ids, '') AS source_ids, 1 + coalesce(n, 0) AS n_sections FROM l LEFT JOIN a USING (user_id)""")
def deck_export(t: Tables) -> DataFrame:
    """The context of a deck: the latest finished briefing and the different strategies after
    it. Rendering is a service."""
    n = F.col("event_id")
    payload = (
        F.when(F.col("event_type") == "purchase", F.format_string('{"agent":"meeting_preparation","status":"completed","meeting_title":"Meeting %d"}', n))
        .when(F.col("event_type") == "click", F.when(n % 8 < 4, F.format_string('{"agent":"market_strategy","status":"completed","x":{"b":1,"a":%d}}', n % 4)).otherwise(F.format_string('{"x":{"a":%d,"b":1},"status":"completed","agent":"market_strategy"}', n % 4)))
        .otherwise('{"agent":"market_intelligence"}')
    )
    rows = t.events.select(F.col("user_id").alias("chat_id"), _event("id"), payload.alias("payload"))
    return A.deck_contexts(rows).select("chat_id", "title", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("source_ids"), F.size("source_ids").cast("long").alias("n_sections"))


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderkey % 8 AS k FROM orders) SELECT job_id, CASE WHEN k = 0 THEN 'queued' WHEN k = 7 THEN 'failed' WHEN k = 6 THEN 'completed' ELSE 'running' END AS state, (['security_scan', 'extract', 'chunk', 'embed', 'store', 'index'])[CASE WHEN k = 7 THEN 4 WHEN k = 0 THEN NULL ELSE k END] AS stage FROM j""")
def job_stages(t: Tables) -> DataFrame:
    """Jobs that have come so far; one kind fails at its fourth stage, after which nothing counts."""
    k = F.col("o_orderkey") % 8
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))
    rows = t.orders.select(F.col("o_orderkey").alias("job_id"), k.alias("k"), F.explode(steps).alias("seq"))
    stages = F.array(*[F.lit(s) for s in S.STAGES])
    stage = F.when(F.col("k") > 0, F.get(stages, F.least(F.col("seq"), F.lit(6)) - 1))
    events = rows.select("job_id", F.col("seq").cast("long").alias("seq"), stage.alias("stage"), (~((F.col("k") == 7) & (F.col("seq") == 4))).alias("ok"))
    return S.job_states(events)


def _uploads(t: Tables) -> DataFrame:
    """Each order of a customer is an upload whose file is the order's priority: submitted, and
    at once taken through all stages if it is urgent; others fail at extraction, but those of
    low priority hear nothing more."""
    own = t.orders.select(F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("p"))
    stages = F.array(F.struct(F.lit(0).alias("nth"), F.lit(None).cast("string").alias("stage"), F.lit(True).alias("ok")), *[F.struct(F.lit(k + 1).alias("nth"), F.lit(s).alias("stage"), F.lit(True).alias("ok")) for k, s in enumerate(S.STAGES)])
    some = F.when(F.col("p") == "1-URGENT", stages).when(F.col("p") == "5-LOW", F.slice(stages, 1, 1)).otherwise(F.concat(F.slice(stages, 1, 2), F.array(F.struct(F.lit(2).alias("nth"), F.lit("extract").alias("stage"), F.lit(False).alias("ok")))))
    rows = own.select("scope", "n", "p", F.inline(some))
    job = F.col("n").cast("string")
    sent = F.col("nth") == 0
    return rows.select(
        "scope", (F.col("n") * 10 + F.col("nth")).alias("seq"), F.timestamp_seconds(F.col("n") * 10 + F.col("nth")).alias("at"), job.alias("job_id"), F.when(sent, F.col("p")).alias("file_sha256"),
        F.when(sent, F.concat(F.lit("text "), "p")).alias("content_sha256"), "stage", "ok",
    )


#: Of a customer's uploads of one file the first urgent one completes, and those after it are
#: refused; the first low one stays under way; all others fail in their second stage.
JOBS = """SELECT CAST(o_custkey AS VARCHAR) AS scope, CAST(o_orderkey AS VARCHAR) AS job_id,
CASE WHEN nth > 1 AND o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'refused' WHEN o_orderpriority = '1-URGENT' THEN 'completed' WHEN o_orderpriority = '5-LOW' THEN 'queued' ELSE 'failed' END AS status,
CASE WHEN nth > 1 AND o_orderpriority = '1-URGENT' THEN 'file is known' WHEN nth > 1 AND o_orderpriority = '5-LOW' THEN 'file is under way' WHEN o_orderpriority = '1-URGENT' THEN 'index' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'extract' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders)"""


@query(JOBS)
def st_job_machine(t: Tables) -> DataFrame:
    """Uploads by scope in order: duplicates of what is under way or known are refused."""
    return jobs.job_table(jobs.job_outcomes(_uploads(t), 1e12))


@query(JOBS)
def st_job_stream(t: Tables) -> DataFrame:
    """The same from a stream of the events in files, with the state kept by scope."""
    path = scratch_dir(t.spark)
    _uploads(t).repartitionByRange(4, "seq").write.parquet(f"{path}/events")
    events = t.spark.readStream.schema(jobs.EVENT).parquet(f"{path}/events")
    with jobs.keyed_store(t.spark):
        jobs.job_outcomes_stream(events, 1e12, timers=False).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return jobs.job_table(t.spark.read.parquet(f"{path}/out"))


@query("SELECT count(DISTINCT text) AS n FROM documents")
def ingest_once(t: Tables) -> DataFrame:
    """Documents streamed once into a table, one row for each content."""
    path = scratch_dir(t.spark)
    S.ingest_stream(t.spark, f"{t.dir}/documents.parquet*", t.documents.schema, f"{path}/out", f"{path}/state").awaitTermination()
    return VersionedTable(t.spark, f"{path}/out").read().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'quarantine' WHEN 1 THEN 'retry' WHEN 2 THEN 'retry' ELSE 'accept' END AS route FROM documents")
def scan_malware(t: Tables) -> DataFrame:
    def scan(content: bytes) -> str:
        n = int(bytes(content).split(b" ", 1)[0]) % 5
        if n == 2:
            raise TimeoutError("scanner is away")
        return {0: "stream: Eicar FOUND", 1: "size limit ERROR"}.get(n, "OK")

    files = t.documents.select("doc_id", F.encode(F.concat_ws(" ", F.col("doc_id").cast("string"), "lang"), "UTF-8").alias("content"))
    return P.scan_files(files, scan).select("doc_id", "route")


@query("SELECT event_id AS id, CAST(k AS INTEGER) AS seq, 'key' || CAST(k AS VARCHAR) AS key FROM events, range(0, 3) r(k) WHERE event_id % 4 = 0 AND k <= event_id % 3")
def udf_memory_extract(t: Tables) -> DataFrame:
    def extract(text: str) -> str:
        n = int(text.split(" ")[-1])
        if n % 4 == 1:
            raise RuntimeError("away")
        if n % 4:
            return "{oops" if n % 4 == 2 else '{"no": "list"}'
        return json.dumps([{"memory_type": "kpi", "key": f"key{k}", "value": "v"} for k in range(n % 3 + 1)] + [{"key": None}])

    rows = t.events.select(_event("id"), F.concat(F.lit("message "), F.col("event_id").cast("string")).alias("text"))
    return P.memory_candidates(rows, extract).select("id", F.col("seq").cast("int").alias("seq"), "key")


@query("SELECT 'role in (''user'', ''assistant'')' AS \"check\", count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS n FROM conversations UNION ALL SELECT 'unique keys', count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1)")
def ddl_tables(t: Tables) -> DataFrame:
    """Keys and conditions of tables as assertions: what breaks them."""
    from lumenfold.schemas import violations

    doubled = violations(t.conversations.select("conv_id"), ("conv_id",)).agg(F.count(F.lit(1)).alias("n"))
    return broken_checks("messages", t.conversations).unionByName(doubled.select(F.lit("unique keys").alias("check"), "n"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'size' WHEN 2 THEN 'magic' WHEN 3 THEN 'encrypted' WHEN 4 THEN 'pages' WHEN 5 THEN 'corrupt' END AS extraction_error, CASE WHEN doc_id % 7 = 6 THEN 2 END AS n_pages, CASE WHEN doc_id % 7 = 6 AND doc_id % 2 = 0 THEN 'page 2' END AS page_error FROM documents")
def src_pdf(t: Tables) -> DataFrame:
    """With a stand-in extractor: rejects become error rows, a failing page one of its own."""

    def extract(content: bytes) -> dict:
        n = int(bytes(content)[5:].split(b" ", 1)[0])
        if n % 7 == 5:
            raise ValueError("no cross-reference table")
        pages = [{"text": "one"}, {"error": "page 2"} if n % 2 == 0 else {"text": "two"}]
        return {"encrypted": n % 7 == 3, "pages": pages * 40 if n % 7 == 4 else pages}

    n = F.col("doc_id")
    head = F.when(n % 7 == 2, F.lit("%TXT-")).otherwise(F.lit("%PDF-"))
    content = F.when(n % 7 == 0, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode(F.concat(head, n.cast("string"), F.lit(" x")), "UTF-8"))
    length = F.when(n % 7 == 1, F.lit(201 << 20)).otherwise(F.octet_length(content)).cast("long")
    files = t.documents.select("doc_id", F.lit("a.pdf").alias("path"), content.alias("content"), length.alias("length"))
    made = readers.extract_pages(files, extract)
    bad = F.get(F.filter(F.transform("pages", lambda p: p["error"]), lambda e: e.isNotNull()), 0)
    return made.select("doc_id", "extraction_error", F.when(F.col("extraction_error").isNull(), F.size("pages")).alias("n_pages"), bad.alias("page_error"))


@query(f"WITH {LINES} SELECT document_id, page_number, line_no % 10 AS reading_order, CASE length(line) % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'text' WHEN 2 THEN 'figure' WHEN 3 THEN 'text' ELSE 'unknown' END AS region_type, length(line) % 6 = 3 AS is_handwritten, md5(line) AS digest FROM lines WHERE length(line) % 6 <> 4")
def src_layout(t: Tables) -> DataFrame:
    """Pages of ten lines through a stand-in for the layout model, which takes every line for a
    region and can't take a batch with every thirteenth page; its labels mapped, noise left out."""

    def layout(given: list[tuple[int, str]]) -> list[dict]:
        if len(given) > 1 and any(n % 13 == 0 for n, _ in given):
            raise MemoryError("too much at once")
        labels = ("title", "paragraph", "picture", "handwritten_text", "document_index", "mystery")
        return [{"page_number": n, "raw_label": labels[len(x) % 6], "text": x} for n, page in given for x in page.split("\n")]

    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    pages = t.lines.groupBy("document_id", "page_number").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))
    found = readers.labelled_regions(readers.segment_pages(pages, layout))
    return found.select("document_id", "page_number", F.col("reading_order").cast("long").alias("reading_order"), "region_type", "is_handwritten", F.md5("text_content").alias("digest"))
