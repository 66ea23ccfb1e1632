"""Agent chains as tables: which request is replayed, declined, asked back, researched, answered.

Each step filters the requests that reach it before an injected agent sees them, so an agent
is called for no other. Agents are functions of a table of requests to a table by request_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import casefold, strip, value_norm
from lumenfold.operators.chats import exact_repeats
from lumenfold.scratch import materialize

Agent = Callable[[DataFrame], DataFrame]

# Words that ask for a changed briefing, and phrases that ask for the market.
REVISION_WORDS = ("add", "include", "missed", "forgot", "update", "change", "correct", "remove", "replace", "revise", "regenerate")
SNAPSHOT_PHRASES = ("trend", "trending", "competitor", "competitive landscape", "competition", "market intelligence", "market update", "market movement")


@dataclass(frozen=True)
class Agents:
    """classify: (request_id, on_topic, is_greeting); research: (request_id, intel_status,
    n_sources, intel_error); assess: (request_id, ready); develop: (request_id, n_priorities,
    n_questions, develop_error); prepare: (request_id, prepare_error); intend: (request_id,
    intent). All but the first column may be null."""

    classify: Agent
    research: Agent
    assess: Agent
    develop: Agent
    prepare: Agent | None = None
    intend: Agent | None = None


def http_status(error_code: Column) -> Column:
    return (
        F.when(error_code == "index_not_found", 404).when(error_code.isin("generation_unavailable", "persistent_context_unavailable"), 503)
        .when(error_code.isin("retrieval_error", "generation_error"), 502).otherwise(200)
    )


def intelligence_status(on_topic: Column, is_greeting: Column, error: Column, n_evidence: Column, n_findings: Column) -> Column:
    """struct(status, error_code) of a research run: greetings and other topics are declined,
    errors fail, without evidence or findings it is partial."""
    declined = ~F.coalesce(on_topic, F.lit(True))
    status = F.when(declined, "declined").when(error.isNotNull(), "failed").when((n_evidence > 0) & (n_findings > 0), "completed").otherwise("partial")
    code = F.when(declined & ~F.coalesce(is_greeting, F.lit(False)), "out_of_scope").when(~declined, error)
    return F.struct(status.alias("status"), code.alias("error_code"))


def strategy_status(intel_status: Column, intel_error: Column, n_sources: Column, ready: Column, develop_error: Column, n_priorities: Column, n_questions: Column) -> Column:
    """struct(status, error_code) of a strategy run, gate by gate."""
    passed = ~intel_status.isin("failed", "declined") & (F.coalesce(n_sources, F.lit(0)) > 0)
    some = (F.coalesce(n_priorities, F.lit(0)) > 0) | (F.coalesce(n_questions, F.lit(0)) > 0)
    status = (
        F.when(intel_status == "failed", "failed").when(intel_status == "declined", "declined").when(~passed, "partial")
        .when(~F.coalesce(ready, F.lit(True)), "needs_input").when(develop_error.isNotNull(), "failed").when(some, "completed").otherwise("partial")
    )
    code = F.when(intel_status == "failed", intel_error).when(intel_status == "declined", "out_of_scope").when(passed & F.coalesce(ready, F.lit(True)), develop_error)
    return F.struct(status.alias("status"), code.alias("error_code"))


def follow_up_intent(message: Column, intent: Column | None = None) -> Column:
    """The agent's intent, or by a whole word: modify_meeting or expand_strategy."""
    words = F.split(strip(F.lower(message)), r"\s+")
    by_word = F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in REVISION_WORDS])), "modify_meeting").otherwise("expand_strategy")
    return by_word if intent is None else F.coalesce(F.when(intent.isin("modify_meeting", "expand_strategy"), intent), by_word)


def asks_for_snapshot(question: Column) -> Column:
    """True if a phrase stands anywhere in the question, whatever its case and white space."""
    low = F.regexp_replace(casefold(question), r"(?U)\s+", " ")
    return reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in SNAPSHOT_PHRASES])


def with_clarification(objective: Column, answer: Column) -> Column:
    """A pending objective with the answer to what was asked back, unless it has it already."""
    own = strip(answer)
    known = (own == "") | F.contains(F.lower(objective), F.lower(own))
    return F.when(known, objective).otherwise(F.concat(objective, F.lit(" (Target/Clarification: "), own, F.lit(")")))


def _joined(rows: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by request, both sides dealt out: requests that are written compress to files so
    small that millions of them would be taken for few, and broadcast through the driver."""
    return rows.join(more.hint("merge"), "request_id", how)


def _developed(rows: DataFrame, agents: Agents, always_ready: bool = False) -> DataFrame:
    """Adds the strategy's status and error_code to rows with research results."""
    passed = rows.where("intel_status not in ('failed', 'declined') and n_sources > 0").select("request_id", "objective")
    ready = passed.select("request_id", F.lit(True).alias("ready")) if always_ready else agents.assess(passed).select("request_id", "ready")
    ready = materialize(ready)
    made = agents.develop(_joined(passed, ready.where("ready"), "left_semi")).select("request_id", "n_priorities", "n_questions", "develop_error")
    joined = _joined(_joined(rows, ready, "left"), made, "left")
    outcome = strategy_status(*[F.col(c) for c in ("intel_status", "intel_error", "n_sources", "ready", "develop_error", "n_priorities", "n_questions")])
    return joined.withColumn("outcome", outcome).select(*rows.columns, "outcome.status", "outcome.error_code")


def strategy_chain(requests: DataFrame, pending: DataFrame, exchanges: DataFrame, agents: Agents, has_store: bool = True) -> DataFrame:
    """(request_id, chat_id, status, error_code, http_status, state, replayed_id, objective).

    ``requests`` have request_id, chat_id and objective; ``pending`` chat_id, objective and
    n_sources of strategies that wait for an answer; ``exchanges`` chat_id, id, question and
    answer that may be replayed. An answer that was waited for resumes the pending request
    with its research. Otherwise an equal earlier question is replayed. Off-topic messages
    are declined and leave what is pending. ``state`` says what becomes of it: save, clear
    or keep. Asking back without a store fails."""
    waiting = pending.select("chat_id", F.col("objective").alias("pending_objective"), F.col("n_sources").alias("pending_sources"))
    own = requests.select("request_id", "chat_id", "objective").join(waiting, "chat_id", "left").withColumn("resumed", F.col("pending_objective").isNotNull())
    asked = own.where("not resumed").select(F.col("request_id").alias("query_id"), F.concat_ws("\u0001", F.col("chat_id").cast("string"), value_norm(F.col("objective"))).alias("query_text"))
    known = exchanges.select(F.concat_ws("\u0001", F.col("chat_id").cast("string"), value_norm(F.col("question"))).alias("question"), "id", "answer")
    repeats = exact_repeats(known, asked).select(F.col("query_id").alias("request_id"), F.col("id").alias("replayed_id"))
    own = materialize(_joined(own, repeats, "left"))
    fresh = own.where("replayed_id is null")
    topic = materialize(agents.classify(fresh.select("request_id", "objective")).select("request_id", "on_topic", "is_greeting"))
    off = topic.where("not on_topic")
    going = _joined(fresh, off, "left_anti")
    going = going.withColumn("objective", F.when(F.col("resumed"), with_clarification(F.col("pending_objective"), F.col("objective"))).otherwise(F.col("objective")))
    found = agents.research(going.where("not resumed").select("request_id", "objective")).select("request_id", "intel_status", "n_sources", "intel_error")
    stored = going.where("resumed").select("request_id", F.lit("completed").alias("intel_status"), F.col("pending_sources").alias("n_sources"), F.lit(None).cast("string").alias("intel_error"))
    researched = materialize(_joined(going.select("request_id", "chat_id", "objective"), found.unionByName(stored)))
    done = _developed(researched, agents)
    lost = (F.col("status") == "needs_input") & F.lit(not has_store)
    state = F.when((F.col("status") == "needs_input") & F.lit(has_store), "save").otherwise("clear")
    done = done.select(
        "request_id", "chat_id", F.when(lost, "failed").otherwise(F.col("status")).alias("status"), F.when(lost, "persistent_context_unavailable").otherwise(F.col("error_code")).alias("error_code"),
        state.alias("state"), F.lit(None).cast("long").alias("replayed_id"), "objective",
    )
    none = F.lit(None).cast("string")
    declined = _joined(fresh, off).select(
        "request_id", "chat_id", F.lit("declined").alias("status"), F.when(F.coalesce("is_greeting", F.lit(False)), none).otherwise("out_of_scope").alias("error_code"),
        F.lit("keep").alias("state"), F.lit(None).cast("long").alias("replayed_id"), "objective",
    )
    replayed = own.where("replayed_id is not null").select("request_id", "chat_id", F.lit("replayed").alias("status"), none.alias("error_code"), F.lit("keep").alias("state"), "replayed_id", "objective")
    every = done.unionByName(declined).unionByName(replayed)
    return every.withColumn("http_status", http_status(F.col("error_code")))


def meeting_chain(requests: DataFrame, agents: Agents) -> DataFrame:
    """(request_id, status, error_code, http_status) of meeting briefings: research, strategy,
    then the briefing, which fails or is declined with the research."""
    rows = requests.select("request_id", "objective")
    found = agents.research(rows).select("request_id", "intel_status", "n_sources", "intel_error")
    researched = materialize(_joined(rows, found))
    # the strategy's sources go into the briefing; its own status doesn't stop it
    strategy = _developed(researched, agents).select("request_id", F.col("status").alias("strategy_status"))
    going = researched.where("intel_status not in ('failed', 'declined')").select("request_id", "objective")
    made = agents.prepare(going).select("request_id", "prepare_error")
    joined = _joined(_joined(researched, strategy, "left"), made, "left")
    status = F.when(F.col("intel_status").isin("failed", "declined"), F.col("intel_status")).when(F.col("prepare_error").isNotNull(), "failed").otherwise("completed")
    code = F.when(F.col("intel_status") == "failed", F.col("intel_error")).when(F.col("intel_status") == "declined", "out_of_scope").otherwise(F.col("prepare_error"))
    return joined.select("request_id", status.alias("status"), code.alias("error_code"), http_status(code).alias("http_status"), "strategy_status")


def follow_up_chain(requests: DataFrame, briefings: DataFrame, agents: Agents) -> DataFrame:
    """(request_id, intent, agent, status, error_code, http_status) of messages after a
    briefing: (chat_id, id, objective) are the latest usable one of each chat. Without one the
    answer is 409; a change prepares the meeting anew, anything else expands the strategy,
    which then needs no more context."""
    own = requests.select("request_id", "chat_id", "objective").join(briefings.select("chat_id", F.col("objective").alias("meeting_objective")), "chat_id", "left")
    having = own.where("meeting_objective is not null")
    told = agents.intend(having.select("request_id", "objective")).select("request_id", F.col("intent").alias("told"))
    having = materialize(_joined(having, told, "left").withColumn("intent", follow_up_intent(F.col("objective"), F.col("told"))))
    change = having.where("intent = 'modify_meeting'").select("request_id", F.col("meeting_objective").alias("objective"))
    expand = having.where("intent = 'expand_strategy'").select("request_id", "objective")
    revised = meeting_chain(change, agents).select("request_id", F.lit("meeting_preparation").alias("agent"), "status", "error_code", "http_status")
    found = agents.research(expand).select("request_id", "intel_status", "n_sources", "intel_error")
    expanded = _developed(materialize(_joined(expand, found)), agents, always_ready=True)
    expanded = expanded.select("request_id", F.lit("market_strategy").alias("agent"), "status", "error_code", http_status(F.col("error_code")).alias("http_status"))
    done = _joined(having.select("request_id", "intent"), revised.unionByName(expanded))
    none = F.lit(None).cast("string")
    refused = own.where("meeting_objective is null").select("request_id", none.alias("intent"), none.alias("agent"), F.lit("refused").alias("status"), none.alias("error_code"), F.lit(409).alias("http_status"))
    return done.unionByName(refused)
