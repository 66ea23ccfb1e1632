"""The memory store, forks, and the trace of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import chats, trace

CANDIDATE = "user_id string, chat_id string, memory_type string, key string, value string, seq long"


def stored(spark, table, *rows):
    frame = spark.createDataFrame([("u", *r) for r in rows], CANDIDATE)
    return {(r["chat_id"], r["memory_type"], r["key"]): r["operation"] for r in chats.store_memories(table, frame).collect()}


def test_memories_and_profile_in_one_commit(spark, tmp_path):
    table = chats.create_store(spark, str(tmp_path), 4)
    got = stored(spark, table, ("c", "industry", "sector", "steel", 1), ("c", "market", "region", "north", 2), ("c", "kpi", "margin", "5", 3), ("d", "user_role", "role", "chief", 4), ("c", "kpi", "login", "my password is x", 5))
    assert set(got.values()) == {"inserted"} and len(got) == 4
    versions = table.versions()
    # equal values change nothing, not the profile either; of two types with a key the later wins
    got = stored(spark, table, ("c", "industry", "sector", " STEEL ", 6), ("c", "market", "region", "south", 7), ("c", "user_preference", "region", "west", 8), ("d", "kpi", "margin", "7", 9))
    assert got == {("c", "industry", "sector"): "ignored", ("c", "market", "region"): "updated", ("c", "user_preference", "region"): "inserted", ("d", "kpi", "margin"): "inserted"}
    assert len(table.versions()) == len(versions) + 1
    profiles = {r["chat_id"]: r["profile"] for r in chats.stored_profiles(table).collect()}
    assert profiles == {"c": {"sector": "steel", "region": "west"}, "d": {"role": "chief"}}
    memories = {(r["chat_id"], r["memory_type"], r["key"]): r["value"] for r in chats.stored_memories(table).collect()}
    assert memories[("c", "market", "region")] == "south" and memories[("c", "industry", "sector")] == "steel" and len(memories) == 6
    # the version before has both as they were
    old = {(r["record"], r["name"]): r["value"] for r in table.read(versions[-1]).where("chat_id = 'c'").collect()}
    assert old[("profile", "region")] == "north" and old[("memory", "market/region")] == "north"
    assert chats.store_memories(table, spark.createDataFrame([], CANDIDATE)).count() == 0 and len(table.versions()) == len(versions) + 1


def test_forks(spark):
    chat = spark.createDataFrame([("a", "u", "x" * 130), ("b", "u", "short")], "chat_id string, user_id string, title string")
    memories = spark.createDataFrame([("u", "a", "kpi", "k", "1"), ("v", "a", "kpi", "k", "other user"), ("u", "b", "kpi", "k", "2"), ("u", "new", "kpi", "k", "kept")], "user_id string, chat_id string, memory_type string, key string, value string")
    forks = spark.createDataFrame([("a", "new"), ("b", "b1"), ("b", "b2"), ("gone", "lost")], "chat_id string, new_chat_id string")
    made, copies = chats.fork_chats(chat, memories, forks)
    assert {r["chat_id"]: r["title"] for r in made.collect()} == {"new": "x" * 120, "b1": "short (Branch)", "b2": "short (Branch)"}
    assert {(r["user_id"], r["chat_id"], r["value"]) for r in copies.collect()} == {("u", "b1", "2"), ("u", "b2", "2")}


def test_trace(spark):
    pages = spark.createDataFrame([("d", 1, "Plan of the year, in some more words than forty", 0, 0.0, 0, 0, 0), ("d", 2, "", 0, 0.0, 0, 0, 0)], "document_id string, page_number int, raw_text string, n_images int, image_area_ratio double, n_spans int, n_suspect_spans int, line_rect_count int")
    rows = [("d", 1, "r2", "text", 2, "(cid:1)(cid:2)", "read words", 0.4, None), ("d", 1, "r1", "heading", 1, "Plan of the year", None, None, None), ("d", 1, "r3", "text", 3, None, None, None, None), ("d", 2, "r9", "text", 1, "other page", None, None, None)]
    regions = spark.createDataFrame(rows, "document_id string, page_number int, region_id string, region_type string, reading_order int, text_content string, ocr_text string, ocr_confidence double, vision_text string")
    wanted = spark.createDataFrame([("d", 1)], "document_id string, page_number int")
    got = trace.trace_pages(pages, regions, wanted, "year").orderBy("stage", "place", "field").collect()
    by = {(r["stage"], r["item"], r["field"]): (r["value"], r["found"]) for r in got}
    assert by[(1, "page", "raw_text")][1] is True and by[(2, "page", "native_trusted")] == ("true", None)
    assert by[(3, "r1", "text_content")] == ("Plan of the year", True) and by[(3, "r2", "text_content")][1] is False
    assert by[(4, "r2", "validation_status")][0] == "low_confidence" and by[(4, "r2", "method")][0] == "ocr" and by[(4, "r2", "final_text")] == ("read words", False)
    assert by[(4, "r3", "validation_status")][0] == "failed" and [r["item"] for r in got if r["stage"] == 5] == ["r1", "r2"]
    assert not [r for r in got if r["item"] == "r9"] and trace.trace_pages(pages, regions, wanted.limit(0)).count() == 0
    assert trace.trace_pages(pages, regions, wanted).where(F.col("found").isNotNull()).count() == 0
