"""Word and PowerPoint files through both readers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.plans.officefiles import docx, pptx
from lumenfold.sources import office

SLIDES = [
    {"title": " Plan ", "shapes": ["one\ntwo", "  ", "Plan", "one\ntwo"], "rows": [["a", " b "], ["", ""], ["c", ""]], "picture": b"pixels", "note": "say it"},
    {},
    {"shapes": ["third <&> \x07 slide"], "note": "Click to add notes"},
    {"title": "last", "note": ""},
]
BOX = '<w:p><w:r><w:t>outer</w:t><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>deep</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "w.docx").write_bytes(docx([" first\tline ", "", "  ", "second\nhalf <x> & é"], [[["h1", " h2 "], ["", " "], ["v1", ""]], [["t2"]]], BOX))
    (tmp_path / "p.pptx").write_bytes(pptx(SLIDES))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "cut.pptx").write_bytes(pptx(SLIDES)[:200])
    (tmp_path / "empty.docx").write_bytes(docx([]))
    (tmp_path / "other.txt").write_text("x")
    return tmp_path


WORD = [("paragraph", "first\tline"), ("paragraph", "second\nhalf <x> & é"), ("paragraph", "outer"), ("row", "h1 | h2"), ("row", "v1"), ("row", "t2"), ("row", "cell")]


def blocks(frame, name):
    rows = frame.where(F.col("path").endswith(name)).orderBy("part", "block").collect()
    return [(r["kind"], r["text"]) if r["part"] == 0 else (r["part"], r["kind"], r["text"]) for r in rows]


SHOWN = [
    (1, "title", "Plan"), (1, "shape", "one\ntwo"), (1, "shape", "Plan"), (1, "shape", "one\ntwo"), (1, "row", "a | b"), (1, "row", "c"), (1, "picture", "ppt/media/image0.png"), (1, "note", "say it"),
    (3, "shape", "third <&>  slide"), (4, "title", "last"),
]


@pytest.mark.parametrize("slides", [1, 3, 50])
def test_source(spark, folder, slides):
    office.register(spark)
    rows = spark.read.format("lumenfold_office").option("slides", slides).load(str(folder))
    assert blocks(rows, "w.docx") == WORD and blocks(rows, "p.pptx") == SHOWN and blocks(rows, "empty.docx") == []
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows.where("error is not null").collect()}
    assert set(errors) == {"bad.docx", "cut.pptx"}
    assert rows.rdd.getNumPartitions() == {1: 8, 3: 6, 50: 5}[slides]


def test_filters_and_columns(spark, folder):
    office.register(spark)
    rows = spark.read.format("lumenfold_office").load(str(folder))
    assert [r["text"] for r in rows.where("kind = 'note'").select("text").collect()] == ["say it"]
    assert rows.where("kind in ('row', 'title')").count() == 8
    reader = office.OfficeReader(["file:///a.pptx", "file:///b.docx"], 5)
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    left = list(reader.pushFilters([EqualTo(("path",), "file:///b.docx"), In(("kind",), ("row", "note")), IsNotNull(("text",))]))
    assert left == [IsNotNull(("text",))] and reader.paths == ["file:///b.docx"] and reader.kinds == {"row", "note"}


def test_files_that_spark_has_read(spark, folder):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pptx}").load(str(folder))
    rows = office.office_rows(files)
    assert blocks(rows, "w.docx") == WORD and blocks(rows, "p.pptx") == SHOWN
    assert rows.where("error is not null").count() == 2
    assert office.office_rows(files, ("note",)).where("error is null").count() == 1
    assert office.office_rows(spark.createDataFrame([("x.docx", None)], "path string, content binary")).first()["error"]
    assert office.office_rows(files.limit(0)).count() == 0
    text = office.document_text(rows).where(F.col("path").endswith("w.docx")).first()["blocks"]
    assert text == [t for _, t in WORD]
    chunks = {r["part"]: (r["title"], r["text"], r["ocr_used"]) for r in office.slide_chunks(rows, lambda path, part: F.concat(F.lit("seen in "), part)).collect()}
    assert chunks == {1: ("Plan", "Plan\none\ntwo\na | b\nc\nImage text: seen in ppt/media/image0.png\nSpeaker notes: say it", True), 3: (None, "third <&>  slide", False), 4: ("last", "last", False)}
    assert "Image" not in office.slide_chunks(rows).where("part = 1").first()["text"]
