"""Pages dealt to an injected layout model."""

from __future__ import annotations

from lumenfold.sources import readers


def test_batches_of_pages(spark):
    pages = [("d", n, f"text {n}", "x") for n in range(1, 24)] + [("d", 5, "text 5", "x"), ("e", 1, None, "x"), ("e", None, "lost", "x")]
    frame = spark.createDataFrame(pages, "document_id string, page_number int, content string, reading_order string").repartition(4)

    def layout(given):
        numbers = [n for n, _ in given]
        assert numbers == sorted(numbers) and len(given) <= 10 and len({(n - 1) // 10 for n in numbers}) == 1
        if any(n == 13 for n in numbers):
            raise MemoryError("page 13")
        made = [{"page_number": n, "raw_label": "text", "text": f"{c} of {len(given)}", "left": 1.5} for n, c in given for _ in range(2)]
        return [*made, {"page_number": 999, "raw_label": "text"}, {"raw_label": "text"}]

    rows = readers.segment_pages(frame, layout).collect()
    by = {(r["document_id"], r["page_number"], r["reading_order"]): r for r in rows}
    assert len(rows) == 2 * 22 + 1 + 2 and {r["region_id"] for r in rows if r["region_id"]} >= {"d-1-0", "d-1-1", "e-1-0"}
    assert by["d", 1, 1]["text_content"] == "text 1 of 10" and by["d", 23, 0]["text_content"] == "text 23 of 3" and by["d", 12, 0]["text_content"] == "text 12 of 1"
    assert by["d", 13, None]["layout_error"] == "MemoryError: page 13" and by["d", 13, None]["raw_label"] is None
    assert by["e", 1, 0]["left_edge"] == 1.5 and by["e", 1, 0]["top_edge"] is None
    assert readers.segment_pages(frame.limit(0), layout).count() == 0
