"""Chats, memory and account tables: snapshots in, new snapshots out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import memory_key_norm, storable, strip, value_norm
from lumenfold.operators.dedup import first_per
from lumenfold.scratch import discard, materialize
from lumenfold.sources.versioned import VersionedTable

# Memory types and the labels of those that aren't part of the profile.
PROFILE_TYPES = ("company_context", "industry", "user_role", "target_audience", "market", "brand_positioning", "user_preference")
LABELS = {
    "business_goal": "business_goals",
    "strategic_priority": "strategic_priorities",
    "competitor": "competitors",
    "budget_constraint": "constraints",
    "business_constraint": "constraints",
    "marketing_channel": "marketing_channels",
    "kpi": "kpis",
}
CLOSED = ("declined", "needs_input", "failed")


def pair_exchanges(messages: DataFrame, last: int | None = None) -> DataFrame:
    """(chat_id, id, question, answer): each answer with the user message right before it, or
    null; ``last`` keeps the newest of each chat."""
    order = Window.partitionBy("chat_id").orderBy("id")
    before = F.when(F.lag("role").over(order) == "user", F.lag("text").over(order))
    pairs = messages.withColumn("question", before).where("role <> 'user'").select("chat_id", "id", "question", F.col("text").alias("answer"))
    if last is None:
        return pairs
    newest = Window.partitionBy("chat_id").orderBy(F.desc("id"))
    return pairs.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")


def history_tail(messages: DataFrame, last: int) -> DataFrame:
    newest = Window.partitionBy("chat_id").orderBy(F.desc("id"))
    return messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)


def eligible_exchanges(exchanges: DataFrame, agent: str | None) -> DataFrame:
    """Exchanges of the same agent, null-safe, that ended well with text on both sides."""
    status = F.coalesce(F.col("status"), F.lit("completed"))
    full = (strip(F.col("question")) != "") & (strip(F.col("answer")) != "")
    return exchanges.where(F.col("agent").eqNullSafe(F.lit(agent)) & ~status.isin(*CLOSED) & F.col("error_code").isNull() & full)


def exact_repeats(exchanges: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, answer): the latest exchange whose question equals, normalised."""
    known = exchanges.select(F.sha2(value_norm(F.col("question")), 256).alias("h"), "id", "answer")
    new = asked.select("query_id", F.sha2(value_norm(F.col("query_text")), 256).alias("h"))
    return new.join(known, "h").groupBy("query_id").agg(F.max("id").alias("id"), F.max_by("answer", "id").alias("answer"))


def latest(rows: DataFrame, keys: list[str], order: str, value: str, where: Column) -> DataFrame:
    """The value at the greatest order among the rows that a predicate picks."""
    return rows.where(where).groupBy(*keys).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def chat_counts(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Every chat with its number of messages, pre-counted before the join."""
    counted = messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))
    return chats.join(counted, "chat_id", "left").select("chat_id", F.coalesce("n", F.lit(0)).alias("message_count"))


def storable_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with a valid key, without secrets, the first of each type and key."""
    own = candidates.withColumn("key", memory_key_norm(F.col("key"))).withColumn("value", strip(F.col("value")))
    own = own.where(F.col("key").isNotNull() & (F.col("value") != "") & storable(F.col("key"), F.col("value")))
    return first_per(own, ["user_id", "chat_id", "memory_type", "key"], F.asc("seq"))


_KEYS = ["user_id", "chat_id", "memory_type", "key"]


def upsert_memory(memories: DataFrame, candidates: DataFrame) -> DataFrame:
    """New snapshot with ``operation``: inserted, updated, ignored (equal value) or kept."""
    new = candidates.select(*_KEYS, F.col("value").alias("new_value"))
    both = memories.select(*_KEYS, "value").join(new, _KEYS, "full_outer")
    same = value_norm(F.col("value")) == value_norm(F.col("new_value"))
    operation = F.when(F.col("new_value").isNull(), "kept").when(F.col("value").isNull(), "inserted").when(same, "ignored").otherwise("updated")
    value = F.when(operation.isin("inserted", "updated"), F.col("new_value")).otherwise(F.col("value"))
    return both.select(*_KEYS, value.alias("value"), operation.alias("operation"))


def memory_context(memories: DataFrame) -> DataFrame:
    """(user_id, chat_id, label, memory_values): business memories by label, profile ones out."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("memory_type")), F.col("memory_type"))
    own = memories.where(~F.col("memory_type").isin(*PROFILE_TYPES)).withColumn("label", label)
    ordered = F.array_sort(F.collect_list(F.struct("memory_type", "key", "value")))
    return own.groupBy("user_id", "chat_id", "label").agg(F.transform(ordered, lambda x: x["value"]).alias("memory_values"))


def merge_profile(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Profile maps with later values winning."""
    joined = profiles.join(changes.withColumnRenamed("profile", "change"), ["user_id", "chat_id"], "full_outer")
    old = F.coalesce("profile", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    new = F.coalesce("change", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return joined.select("user_id", "chat_id", F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new).alias("profile"))


#: Keys of the memory table: a record is a memory, named by type and key, or an entry of the
#: chat's profile, named by key.
STORE_KEYS = ["user_id", "chat_id", "record", "name"]
STORE = "user_id string, chat_id string, record string, name string, memory_type string, key string, value string"


def create_store(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """An empty memory table."""
    table = VersionedTable(spark, path)
    table.create(spark.createDataFrame([], STORE), STORE_KEYS, buckets)
    return table


def store_memories(table: VersionedTable, candidates: DataFrame, tag: tuple[str, int] | None = None) -> DataFrame:
    """Upsert storable candidates (user_id, chat_id, memory_type, key, value, seq) and return
    their keys with the operation: inserted, updated or ignored.

    Memories and the profile change in one commit, or not at all, and the buckets of the
    candidates' keys alone are read. A candidate of a profile type that isn't ignored sets its
    key in the chat's profile; of several types with one key the later candidate wins."""
    own = materialize(storable_candidates(candidates))
    named = own.select("user_id", "chat_id", F.lit("memory").alias("record"), F.concat_ws("/", "memory_type", "key").alias("name"), "memory_type", "key", "value", "seq")
    known = table.read_keys(named).select(*STORE_KEYS, F.col("value").alias("old"))
    both = named.join(known, STORE_KEYS, "left")
    same = value_norm(F.col("old")) == value_norm(F.col("value"))
    operation = F.when(F.col("old").isNull(), "inserted").when(same, "ignored").otherwise("updated")
    done = materialize(both.withColumn("operation", operation))
    changed = done.where("operation <> 'ignored'")
    entries = changed.where(F.col("memory_type").isin(*PROFILE_TYPES)).withColumn("record", F.lit("profile")).withColumn("name", F.col("key"))
    last = entries.groupBy(*STORE_KEYS).agg(F.max_by(F.struct("memory_type", "key", "value"), "seq").alias("last")).select(*STORE_KEYS, "last.*")
    columns = [*STORE_KEYS, "memory_type", "key", "value"]
    table.commit(changed.select(*columns).unionByName(last.select(*columns)), tag=tag)
    discard(own)
    return done.select(*_KEYS, "value", "operation")


def stored_memories(table: VersionedTable) -> DataFrame:
    return table.read().where("record = 'memory'").select(*_KEYS, "value")


def stored_profiles(table: VersionedTable) -> DataFrame:
    """(user_id, chat_id, profile): a map for each chat that has an entry."""
    own = table.read().where("record = 'profile'")
    return own.groupBy("user_id", "chat_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("profile"))


def fork_chats(chats: DataFrame, memories: DataFrame, forks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New chats of ``forks`` (chat_id, new_chat_id), titled as branches of their sources and
    empty of messages, and copies of the sources' memories for them; what a new chat has
    already stays. Forks of unknown chats make nothing."""
    own = chats.select("chat_id", "user_id", "title").join(forks.select("chat_id", "new_chat_id"), "chat_id")
    made = own.select(F.col("new_chat_id").alias("chat_id"), "user_id", fork_title(F.col("title")).alias("title"))
    copies = memories.join(own.select("chat_id", "user_id", "new_chat_id"), ["chat_id", "user_id"]).withColumn("chat_id", F.col("new_chat_id")).drop("new_chat_id").select(*memories.columns)
    return made, copies.join(memories.select(*_KEYS), _KEYS, "left_anti").select(*memories.columns)


def clone_memory(memories: DataFrame, source: Column | str, target: str) -> DataFrame:
    """The snapshot and a copy of one chat's memories; what the target has stays."""
    copy = memories.where(F.col("chat_id") == source).withColumn("chat_id", F.lit(target))
    return memories.unionByName(copy.join(memories.select(*_KEYS), _KEYS, "left_anti"))


def fork_title(title: Column) -> Column:
    return F.substring(F.concat(title, F.lit(" (Branch)")), 1, 120)


def delete_chats(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("chat_id").distinct(), "chat_id", "left_anti")


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def insert_new(rows: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """On conflict do nothing."""
    return rows.unionByName(incoming.dropDuplicates([key]).join(rows.select(key), key, "left_anti"))


def upsert_chats(chats: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """(chat_id, user_id, title, updated_at, operation): new chats are inserted with their
    first message's title, known ones touched; a message of another user than the chat's is
    refused and changes nothing. ``messages`` have chat_id, user_id, id and title."""
    first = messages.groupBy("chat_id", "user_id").agg(F.min_by("title", "id").alias("new_title"), F.min("id").alias("id"))
    # of several users that write to a new chat, the first is its owner
    owner = first.groupBy("chat_id").agg(F.min_by("user_id", "id").alias("first_user"))
    old = chats.select("chat_id", F.col("user_id").alias("owner"), "title", "updated_at")
    both = old.join(first.join(owner, "chat_id"), "chat_id", "full_outer")
    owned = F.coalesce("owner", "first_user")
    operation = F.when(F.col("user_id").isNull(), "kept").when(F.col("user_id") != owned, "refused").when(F.col("owner").isNull(), "inserted").otherwise("touched")
    title = F.substring(F.coalesce("title", F.nullif(strip(F.col("new_title")), F.lit("")), F.lit("New conversation")), 1, 120)
    return both.select("chat_id", F.coalesce("user_id", "owner").alias("user_id"), title.alias("title"), F.when(operation.isin("inserted", "touched"), now).otherwise(F.col("updated_at")).alias("updated_at"), operation.alias("operation"))


def latest_payloads(messages: DataFrame, agent: str, statuses: tuple[str, ...], last: int | None = None) -> DataFrame:
    """(chat_id, id, payload) of the latest message of an agent with one of some statuses,
    among the ``last`` of each chat if that is given."""
    own = history_tail(messages, last) if last else messages
    return latest(own, ["chat_id"], "id", "payload", (F.col("agent") == agent) & F.col("status").isin(*statuses))


def distinct_payloads(messages: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """The first message of each different payload; JSON objects differ by content, not by the
    order of their keys."""
    content = F.coalesce(F.to_json(F.try_parse_json(F.col(payload))), F.col(payload))
    return first_per(messages.withColumn("_content", content), [*keys, "_content"], F.asc("id")).drop("_content")


def clarification_slot(item: Column) -> Column:
    low = F.lower(item)
    return F.when(low.rlike("geograph|market|region|countr"), "market").when(low.rlike("audience"), "target_audience").otherwise("company_context")
