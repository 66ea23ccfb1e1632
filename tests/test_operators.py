"""Table operators against worked cases and plain models."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import chats, chunking, dedup, evidence, metrics, pages, retrieval


@pytest.fixture
def index(spark):
    chunks = spark.createDataFrame([("a", "alpha"), ("b", "alpha beta"), ("c", "alpha alpha alpha"), ("d", "gamma"), ("e", "")], "chunk_id string, chunk_text string")
    vectors = spark.createDataFrame([("a", [0.8, 0.6]), ("b", [0.75, 0.66]), ("d", [0.2, 0.98])], "chunk_id string, vector array<float>")
    queries = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "what is the", [0.0, 1.0])], "query_id long, query_text string, query_vector array<float>")
    return chunks, vectors, queries


def test_bm25(index):
    chunks, _, queries = index
    scores = {(r["query_id"], r["chunk_id"]): r["bm25_score"] for r in retrieval.bm25_scores(chunks, queries).collect()}
    assert set(scores) == {(1, "a"), (1, "b"), (1, "c")} and scores[1, "a"] == scores[1, "c"]
    two = chunks.where("chunk_id in ('a', 'd')")
    assert retrieval.bm25_scores(two, queries).first()["bm25_score"] == pytest.approx(math.log(2), abs=1e-6)


def test_dense_rerank(index):
    chunks, vectors, queries = index
    found = {r["chunk_id"]: r["combined_score"] for r in retrieval.retrieve_dense(chunks, vectors, queries.where("query_id = 1")).collect()}
    assert found["b"] == pytest.approx(0.90, abs=1e-6) and found["a"] == pytest.approx(0.875, abs=1e-6)


def test_hybrid_keeps_keyword_hits_under_the_floor(index):
    chunks, vectors, queries = index
    found = {r["chunk_id"]: r for r in retrieval.retrieve_hybrid(chunks, vectors, queries.where("query_id = 1"), least=0.5).collect()}
    assert "d" not in found and found["c"]["dense_score"] is None
    assert found["b"]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62)
    order = sorted(found.values(), key=lambda r: r["rank"])
    assert [r["chunk_id"] for r in order] == sorted(found, key=lambda k: (found[k]["combined_score"], k), reverse=True)


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "noise", 1), (2, "answer", 2)], "query_id long, chunk_id string, rank int")
    qrels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "answer"), (3, "z")], "query_id long, chunk_id string")
    exact = {r["query_id"]: r for r in metrics.exact_metrics(run, qrels).collect()}
    assert exact[1]["precision"] == pytest.approx(2 / 3) and exact[1]["recall"] == 1
    assert (exact[2]["hit"], exact[2]["first_rank"], exact[2]["mrr"], exact[2]["precision"]) == (1, 2, 0.5, 0.5) and exact[2]["f1"] == pytest.approx(2 / 3)
    assert exact[3]["hit"] == 0 and exact[3]["mrr"] == 0
    ranked = {r["query_id"]: r for r in metrics.rank_metrics(run, qrels).collect()}
    assert ranked[2]["ndcg_5"] == pytest.approx(1 / math.log2(3)) and ranked[2]["precision_5"] == pytest.approx(0.2) and ranked[3]["recall_8"] == 0


def test_dedup(spark):
    rows = [("d1", 0, 0, "c1", "A"), ("d1", 0, 1, "c2", "B"), ("d2", 1, 0, "c3", " a "), ("d2", 1, 1, "c4", "C"), ("d3", 2, 0, "c5", "A")]
    children = spark.createDataFrame(rows, "document_id string, doc_seq int, child_seq int, chunk_id string, chunk_text string")
    stored = dedup.distinct_chunks(children)
    assert {r["chunk_id"] for r in stored.collect()} == {"c1", "c2", "c4"}
    report = {r["document_id"]: r for r in dedup.dedup_report(children).collect()}
    assert report["d2"]["n_reused"] == 1 and not report["d2"]["exact_duplicate"] and report["d3"]["exact_duplicate"]
    parents = spark.createDataFrame([("d1", "p1"), ("d3", "p3")], "document_id string, chunk_id string")
    assert [r["chunk_id"] for r in dedup.kept_parents(parents, stored).collect()] == ["p1"]
    registry = dedup.registry_of(children.where("doc_seq = 0"))
    assert {r["chunk_id"] for r in dedup.distinct_chunks(children.where("doc_seq > 0"), registry).collect()} == {"c4"}


def plain_children(text, size, overlap):
    units = []
    for p in re.split(r"\n\s*\n+", text.strip()):
        p = " ".join(p.split())
        if p:
            units += [p] if len(p) <= size else [s.strip() for s in re.split(r"(?<=[.!?…])(?:[\"')\]]+)?\s+", p) if s.strip()]
    out, now = [], []
    for unit in units:
        if now and len("\n\n".join([*now, unit])) > size:
            out.append("\n\n".join(now))
            k = len(now) - 1
            while k > 0 and len("\n\n".join(now[k - 1 :])) <= overlap:
                k -= 1
            now = now[k:]
            while now and len("\n\n".join([*now, unit])) > size:
                now = now[1:]
        now = [*now, unit]
    return out + (["\n\n".join(now)] if now else [])


def test_packing(spark):
    rng = random.Random(1)
    texts = ["", "   ", "One. Two! Three? Four.", "A very " * 30 + "long sentence."]
    for _ in range(40):
        texts.append("\n\n".join(" ".join("w" * rng.randint(1, 12) + rng.choice([".", "", '!"']) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: list(r["p"]) for r in rows.select("k", chunking.pack_children(F.col("text"), 80, 25).alias("p")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == plain_children(text, 80, 25), text


def test_tables(spark):
    rows = [["n", "v"]] + [[str(k), "cell " * 12] for k in range(30)]
    tables = spark.createDataFrame([(1, rows), (2, [["h" * 2100]]), (3, rows[:3])], "table_id int, rows array<array<string>>")
    got = [(r["table_id"], r["row_group_start"]) for r in chunking.split_tables(tables).collect()]
    assert sorted(got) == [(1, 1), (1, 16), (3, 0)]
    text = chunking.split_tables(tables).where("row_group_start = 16").first()["chunk_text"]
    assert text.startswith("| n | v |\n| --- | --- |\n| 15 |")


def test_sections(spark):
    rows = [("d", 1, 0, "a", "heading", "H1"), ("d", 1, 1, "b", "heading", "H2"), ("d", 1, 2, "c", "text", "x"), ("d", 2, 0, "d", "text", "y"), ("d", 3, 0, "e", "heading", "H3"), ("d", 3, 1, "f", "text", "z")]
    rows += [("e", 1, k, f"e{k}", kind, t) for k, (kind, t) in enumerate([("heading", "A"), ("heading", "B"), ("text", "x"), ("heading", "C"), ("text", "y")])]
    regions = spark.createDataFrame(rows, "document_id string, page_number int, reading_order int, region_id string, region_type string, text_content string")
    got = {r["region_id"]: r["section_title"] for r in chunking.section_paths(regions).collect()}
    assert got == {"c": "H1 > H2", "d": "H1 > H2", "f": "H3", "e2": "A > B", "e4": "A > C"}


def test_headers(spark):
    lines = [("d", p, k, t) for p in range(1, 6) for k, t in enumerate([f"body {p} {k}" for k in range(4)])]
    lines += [("d", p, -1, "often") for p in (1, 2, 3)] + [("d", p, -2, "seldom") for p in (1, 2)]
    frame = spark.createDataFrame(lines, "document_id string, page_number int, line_no int, line string")
    assert [r["line_text"] for r in pages.header_footer_lines(frame).collect()] == ["often"]
    cleaned = {r["page_number"]: r["text"] for r in pages.clean_document(frame).collect()}
    assert cleaned[1].startswith("seldom\nbody 1 0") and cleaned[3].startswith("body 3 0")


def test_pages(spark):
    rows = [("d", 1, "abc", 0, 0.0, 0, 0, 0), ("d", 2, "x" * 40, 1, 0.5, 0, 0, 4), ("d", 3, "text " * 20, 0, 0.0, 3, 1, 3)]
    frame = spark.createDataFrame(rows, "document_id string, page_number int, raw_text string, n_images int, image_area_ratio double, n_spans int, n_suspect_spans int, line_rect_count int")
    analysis = pages.analyze_pages(frame)
    got = {r["page_number"]: r for r in analysis.collect()}
    assert got[1]["is_blank"] and got[2]["is_scanned"] and got[2]["has_table_hint"] and got[3]["is_broken_font"]
    layout = spark.createDataFrame([("d", 1, 0.6), ("d", 9, 0.1)], "document_id string, page_number int, infographic_score double")
    routed = {r["page_number"]: (r["use_native"], r["use_ocr"], r["use_vision"]) for r in pages.route_pages(analysis, layout).collect()}
    assert routed == {1: (True, True, True), 2: (False, True, False), 3: (False, True, False), 9: (True, False, False)}


def test_similar_images(spark):
    rng = random.Random(2)
    hashes = [rng.getrandbits(63) for _ in range(30)]
    hashes += [h ^ (1 << rng.randint(0, 62)) ^ (1 << rng.randint(0, 62)) for h in hashes[:10]]
    frame = spark.createDataFrame([(k % 2, k, k % 5, h) for k, h in enumerate(hashes)], "document_id int, image_id long, page_number int, phash long")
    near = lambda k: [j for j in range(40) if j % 2 == k % 2 and bin(hashes[k] ^ hashes[j]).count("1") <= 4]
    assert {r["image_id"]: (r["n_similar"], r["first_similar"]) for r in pages.similar_images(frame).collect()} == {k: (len(near(k)) - 1, min(near(k))) for k in range(40)}


def test_evidence(spark):
    findings = spark.createDataFrame([("f1", "trend", ["a", "b", "a"]), ("f2", "trend", ["a", "a"]), ("f3", "risk", ["zz"]), ("f4", "risk", ["b"])], "finding_id string, section string, evidence_ids array<string>")
    known = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert {r["finding_id"]: list(r["evidence_ids"]) for r in evidence.link_findings(findings, known).collect()} == {"f1": ["a", "b"], "f4": ["b"]}
    rows = "chunk_id string, kind string, url string, text_excerpt string"
    prior = spark.createDataFrame([("old", "web", "http://A/x ", "t")], rows)
    new = spark.createDataFrame([("new", "web", "http://a/X", "u"), ("r1", "rag", None, " Same "), ("r2", "rag", "", "same")], rows)
    assert {r["chunk_id"] for r in evidence.distinct_evidence(evidence.merge_evidence(prior, new)).collect()} == {"old", "r1"}
    results = spark.createDataFrame([(0, 0, "http://a.b/1"), (0, 1, "http://www.a.b/2"), (0, 2, "http://c.d/"), (0, 3, "bad")], "query_pos int, result_pos int, url string")
    verdicts = spark.createDataFrame([("domain:a.b", 0, 1, 200)], "safety_key string, malicious int, suspicious int, http_status int")
    assert [r["result_pos"] for r in evidence.guard_sources(results, verdicts).orderBy("result_pos").collect()] == [0, 1]


def test_memory(spark):
    keys = "user_id string, chat_id string, memory_type string, key string, value string"
    memories = spark.createDataFrame([("u", "c", "kpi", "a", "Old"), ("u", "c", "industry", "b", "Retail"), ("u", "c", "budget_constraint", "k", "low")], keys)
    offered = spark.createDataFrame([("u", "c", "kpi", "A", "new", 0), ("u", "c", "industry", "b", " RETAIL ", 1), ("u", "c", "kpi", "x-y", "1", 2), ("u", "c", "kpi", "x y", "2", 3), ("u", "c", "kpi", "p", "my password is 1", 4)], keys + ", seq int")
    got = {(r["memory_type"], r["key"]): (r["value"], r["operation"]) for r in chats.upsert_memory(memories, chats.storable_candidates(offered)).collect()}
    assert got == {("kpi", "a"): ("new", "updated"), ("industry", "b"): ("Retail", "ignored"), ("kpi", "x_y"): ("1", "inserted"), ("budget_constraint", "k"): ("low", "kept")}
    assert {r["label"] for r in chats.memory_context(memories).collect()} == {"kpis", "constraints"}
    assert chats.clone_memory(memories, "c", "branch").where("chat_id = 'branch'").count() == 3


def test_exchanges(spark):
    rows = [("c", 1, "user", "q1"), ("c", 2, "assistant", "a1"), ("c", 3, "assistant", "a2"), ("c", 4, "user", "q2")]
    messages = spark.createDataFrame(rows, "chat_id string, id long, role string, text string")
    assert [(r["question"], r["answer"]) for r in chats.pair_exchanges(messages).orderBy("id").collect()] == [("q1", "a1"), (None, "a2")]
    assert chats.pair_exchanges(messages, last=1).first()["answer"] == "a2"
    pairs = chats.pair_exchanges(messages).where("question is not null")
    asked = spark.createDataFrame([(7, "  Q1 ")], "query_id long, query_text string")
    assert chats.exact_repeats(pairs, asked).first()["answer"] == "a1"


def test_config_and_keys(spark):
    from lumenfold.schemas import TABLES, EngineConfig, violations

    config = EngineConfig.of({"chunk_size": 300, "nonsense": 1})
    assert config.chunk_size == 300 and config.chunk_overlap == 75
    for columns, keys in TABLES.values():
        assert violations(spark.createDataFrame([], columns), keys).count() == 0
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "user_id string")
    assert violations(rows, ("user_id",)).count() == 2
