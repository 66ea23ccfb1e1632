"""Costly steps run once: what reads them twice reads a written table."""

from pyspark.sql import functions as F

from lumenfold.functions.text import clean_text, collapse_whitespace
from lumenfold.operators import pages


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_cleaned_once(spark):
    rows = [(d, p, n, x) for d in (1, 2) for p in range(1, 6) for n, x in enumerate(["Head", f"été {d} {p}", " a\tb  c ", "", "Foot" if d == 1 else f"foot {p}", "well-\nknown"])]
    rows += [(3, 1, 0, "Head"), (3, 2, 0, "Head"), (None, 1, 0, "Head"), (None, 2, 0, "Head"), (4, 1, 0, None)]
    lines = spark.createDataFrame(rows, "document_id long, page_number int, line_no int, line string")
    found = pages.clean_document(lines)
    assert "ArrowEvalPython" not in _plan(found)
    page = lines.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all")).select("document_id", "page_number", F.array_join("all.line", "\n").alias("x"))
    again = clean_text(page, F.col("x")).select("document_id", "page_number", F.posexplode(F.split("cleaned.text", "\n", -1)).alias("line_no", "line"))
    left = pages.strip_known_lines(again, pages.header_footer_lines(again)).groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"))
    want = left.select("document_id", "page_number", collapse_whitespace(F.array_join("all.line", "\n")).alias("text"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert not found.where("document_id = 3").count()


def test_pages_of_a_batch_may_come_in_parts(spark):
    from lumenfold.sources import readers

    asked = spark.createDataFrame([(d, p, f"{d} {p}") for d in (None, 7, 8) for p in (1, 2, 3, 9) for _ in range(2)], "document_id long, page_number int, content string")

    def layout(given):
        return [{"page_number": n, "raw_label": "text", "text": f"{len(given)}:{x}", "left": float("nan")} for n, x in given]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = readers.segment_pages(asked, layout, batch=4)
        assert "FlatMapGroups" not in _plan(found)
        rows = sorted((str(r["document_id"]), r["page_number"], r["text_content"], r["left_edge"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows == [(str(d), p, f"{1 if p == 9 else 3}:{d} {p}", None) for d in (7, 8) for p in (1, 2, 3, 9)] + [("None", p, f"{1 if p == 9 else 3}:None {p}", None) for p in (1, 2, 3, 9)]


def test_office_blocks_come_in_batches(spark):
    from lumenfold.plans.officefiles import _zip, docx, pptx
    from lumenfold.sources import office

    whole = docx(["one\ttwo", " ", "three &<>"], [[["a", ""], ["b", "c"]]])
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    rels = '<Relationships><Relationship xmlns="http://schemas.openxmlformats.org/package/2006/relationships" Id="a" Type="x/officeDocument" Target="d.xml"/></Relationships>'
    odd = lambda body, head="": _zip({"_rels/.rels": rels, "d.xml": f'{head}<w:document xmlns:w="{word}"><w:body><w:p><w:t>first</w:t></w:p>{body}'})
    files = [("1.docx", whole), ("2.pptx", pptx([{"title": "T", "shapes": ["x\x0by"], "note": "n"}])), ("3.docx", odd("<w:p><w:t>cut")), ("4.docx", odd("<w:p><w:t>&none;</w:t></w:p></w:body></w:document>", '<!DOCTYPE w SYSTEM "w.dtd">')), ("5.docx", None)]
    found = office.office_rows(spark.createDataFrame(files, "path string, content binary"))
    assert "MapInArrow" in _plan(found) and "MapInPandas" not in _plan(found)
    rows = {}
    for r in sorted(found.collect(), key=lambda r: (r["path"], r["block"] if r["block"] >= 0 else 99)):
        rows.setdefault(r["path"], []).append(r["text"] or r["error"].split(":")[0])
    assert rows == {"1.docx": ["one\ttwo", "three &<>", "a", "b | c"], "2.pptx": ["T", "xy", "n"], "3.docx": ["first", "ParseError"], "4.docx": ["first", "ParseError"], "5.docx": ["BadZipFile"]}


def test_edges_are_stepped_from_once():
    """A weak edge that winds over many rows: a pass over all pixels for each step is quadratic."""
    import time

    import numpy as np

    from lumenfold.operators.imaging import edge_map

    n = 60_000
    ramp = np.zeros((n, 32), np.uint8)
    ramp[:, 16:] = 30  # a gradient of 120, weak but for the first rows
    ramp[:2, 16:] = 255
    began = time.process_time()
    found = edge_map(ramp)
    assert time.process_time() - began < 30
    assert found.any(axis=1).all()


def test_lines_of_a_table_are_made_once(spark):
    from lumenfold.operators.chunking import split_tables

    wide = [["h", "k"]] + [[str(i), "x" * 60] for i in range(31)]
    tables = spark.createDataFrame([(1, wide), (2, wide[:3]), (3, []), (4, None), (5, [["y" * 2100]]), (6, [["a"], None, ["b"]])], "table_id int, rows array<array<string>>")
    found = split_tables(tables)
    assert _plan(found).count("---") == 1
    rows = {(r["table_id"], r["row_group_start"]): r["chunk_text"] for r in found.collect()}
    line = lambda r: f"| {' | '.join(r)} |"
    head = [line(wide[0]), "| --- | --- |"]
    assert rows == {
        **{(1, s): "\n".join(head + [line(r) for r in wide[s : s + 15]]) for s in (1, 16, 31)},
        (2, 0): "\n".join(head + [line(r) for r in wide[1:3]]), (3, 0): "", (4, 0): "", (6, 0): "| a |\n| --- |\n| b |",
    }


def test_documents_are_hashed_once(spark):
    from lumenfold.operators.dedup import duplicate_documents

    words = "one two three four five six seven eight"
    texts = [words, f" {words.replace(' ', chr(0xA0), 3)}\n", words.replace(" ", "\t  ", 2), words.replace(" ", "\v"), words.replace("one", "One"), "short", None, words + "x"]
    docs = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "document_id long, doc_seq long, text string")
    found = duplicate_documents(docs)
    assert "sha2" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 0), (2, 0), (3, 0)]


def test_modes_are_compared_over_one_token_index(spark, monkeypatch):
    from lumenfold.operators import retrieval
    from lumenfold.plans import catalog

    made, index = [], retrieval.token_index
    monkeypatch.setattr(retrieval, "token_index", lambda *a: made.append(1) or index(*a))
    assert catalog.QUERIES["agg_compare_metrics"](spark, "/root/testdata/sf0.001").columns == ["mode", "precision", "recall", "ndcg", "n_queries"]
    assert len(made) == 1


def test_one_question_is_searched_alone(spark, monkeypatch):
    from lumenfold.operators import retrieval
    from lumenfold.plans import catalog

    asked, search = [], retrieval.keyword_search
    monkeypatch.setattr(retrieval, "keyword_search", lambda chunks, queries, *a, **b: asked.append(queries.count()) or search(chunks, queries, *a, **b))
    catalog.QUERIES["trace_one_question"](spark, "/root/testdata/sf0.001")
    assert asked == [1]
