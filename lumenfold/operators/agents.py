"""What the agents do around their model calls: gates, validation, caps and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import strip
from lumenfold.operators.dedup import first_per

#: How many items of each section a strategy keeps.
CAPS = (3, 3, 3, 3, 3, 4, 4)


def focus_queries(company: Column, url: Column, objective: Column, planned: Column, most: int = 4) -> Column:
    """Planned queries, after one on the company if it is given; distinct, at most ``most``."""
    own = F.when(F.coalesce(company, F.lit("")) != "", F.array(F.concat_ws(" ", company, url, objective))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(own, planned)), 1, most)


def valid_items(items: Column, most: int) -> Column:
    """Stripped items without blank ones, the first ``most``."""
    return F.slice(F.filter(F.transform(items, strip), lambda x: F.coalesce(x != "", F.lit(False))), 1, most)


def readiness_valid(ready: Column, missing: Column, question: Column) -> Column:
    """Ready, or else exactly one missing item and a question."""
    return ready | ((F.size(missing) == 1) & (F.coalesce(strip(question), F.lit("")) != ""))


def supported(sources: Column) -> Column:
    return F.coalesce(F.size(sources) > 0, F.lit(False))


def reuse_class(label: Column) -> Column:
    """repeat, refinement or follow_up; anything else, or a failure, is new."""
    return F.when(label.isin("repeat", "refinement", "follow_up"), label).otherwise("new")


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Sources unique by chunk id, earlier tables and positions first."""
    from lumenfold.operators.evidence import merge_evidence

    return first_per(merge_evidence(*sources), ["chunk_id"], F.asc("priority"), F.asc("position"))


def deck_contexts(messages: DataFrame) -> DataFrame:
    """(chat_id, title, source_ids, payloads) for a deck: the latest completed briefing of each
    chat and, after it, the strategies of different content, the first of each, in order.
    ``messages`` have chat_id, id and payload, a JSON object; chats without a completed
    briefing have no row."""
    agent, status = (F.get_json_object("payload", f"$.{k}") for k in ("agent", "status"))
    own = messages.select("chat_id", "id", "payload", agent.alias("agent"), status.alias("status"))
    done = own.where("agent = 'meeting_preparation' and status = 'completed'")
    last = done.groupBy("chat_id").agg(F.max_by(F.struct("id", "payload"), "id").alias("last"))
    # objects as variants have their keys in order, so equal ones are equal texts
    canonical = F.to_json(F.parse_json("payload"))
    later = own.where("agent = 'market_strategy' and status in ('completed', 'partial')").join(last, "chat_id").where(F.col("id") > F.col("last.id"))
    first = later.groupBy("chat_id", canonical.alias("content")).agg(F.min(F.struct("id", "payload")).alias("item"))
    items = first.groupBy("chat_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    every = F.concat(F.array("last"), F.coalesce("items", F.array().cast("array<struct<id:bigint,payload:string>>")))
    title = F.coalesce(F.get_json_object("last.payload", "$.meeting_title"), F.lit("Meeting Preparation"))
    joined = last.join(items, "chat_id", "left").withColumn("every", every)
    return joined.select("chat_id", title.alias("title"), F.transform("every", lambda x: x["id"]).alias("source_ids"), F.transform("every", lambda x: x["payload"]).alias("payloads"))


def status_of(found: Column, failures: Column) -> Column:
    """completed with findings and no failure, partial with both, failed with neither."""
    return F.when((found > 0) & (failures == 0), "completed").when(found > 0, "partial").otherwise("failed")


def guard_reasons(entries: Column) -> Column:
    """Distinct reasons from five keys of a verdict map, in order."""
    keys = ("reason", "category", "detector", "label", "message")
    return F.array_distinct(F.array_compact(F.array(*[F.try_element_at(entries, F.lit(k)) for k in keys])))


def provenance(metadata: Column) -> Column:
    """struct(publication_date, url) from the first key that has one."""
    first = lambda *keys: F.coalesce(*[F.try_element_at(metadata, F.lit(k)) for k in keys])
    return F.struct(first("publication_date", "published_at", "published_date", "date").alias("publication_date"), first("url", "source_url", "link").alias("url"))


def with_defaults(metadata: Column, defaults: dict[str, str]) -> Column:
    """Metadata with defaults where a key is absent."""
    given = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(given, lambda k, _: ~F.map_contains_key(metadata, k)), metadata)


def keep_keys(entries: Column, keys: list[str]) -> Column:
    return F.map_filter(entries, lambda k, _: k.isin(*keys))


def chunk_response(metadata: Column, pages: Column, defaults: dict[str, str]) -> Column:
    """struct(metadata, page): defaults only where a key is absent, the first page or null."""
    return F.struct(with_defaults(metadata, defaults).alias("metadata"), F.get(pages, 0).alias("page"))


# What a briefing passes on.
BRIEFING_KEYS = (
    "meeting_title", "meeting_objective", "attendee_context", "product", "industry", "geography", "budget", "key_competitors", "timeline",
    "executive_brief", "key_facts_to_remember", "strategic_talking_points", "questions_to_ask", "risks_to_watch", "recommended_actions",
    "relevant_market_trends", "relevant_competitor_intelligence",
)


def briefing(entries: Column) -> Column:
    return keep_keys(entries, list(BRIEFING_KEYS))


def safe_url(url: Column, own_host: str) -> Column:
    """The same host, or https to a name or public address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    https = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)|^\[?(::1|f[cd]|fe80)")
    return F.coalesce((host == own_host) | (https & ~private), F.lit(False))
