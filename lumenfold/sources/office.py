"""Word and PowerPoint files as rows: zip parts, streamed XML, no document model.

Two ways in. ``office_rows`` takes files that Spark has read (a table with their bytes), from
any store that Spark reads. ``OfficeSource`` is a Python data source over paths that
``pyarrow.fs`` opens: it lists the files, deals slides in ranges as input partitions, leaves
out notes or tables that no wanted column or filter needs, and of a file's zip reads the
directory and the parts of its range alone.

A row is a block: of a Word file its paragraphs in order, then its tables' rows; of a slide its
title, shapes and tables in order, pictures, then its notes.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import ParseError
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: path of the file; part: 0 for a Word file, the slide's number; kind: paragraph, row, title,
#: shape, picture or note; for a picture the text is the zip part's name, for ``ocr`` to read.
SCHEMA = "path string, part int, block int, kind string, text string, error string"
KINDS = ("paragraph", "row", "title", "shape", "picture", "note")
# Fixed value: what an empty notes page says.
NO_NOTES = "click to add notes"

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships}"
#: Bytes of one XML part at most, as it says itself; a larger one is an error row.
MOST_PART = 512 << 20
#: Characters of rows that a task gathers at most before it hands them on.
BATCH_CHARS = 2 << 20


class OfficeError(ValueError):
    """The file isn't what its name says."""


@dataclass
class Block:
    kind: str
    text: str


def _part(archive: zipfile.ZipFile, name: str):
    info = archive.getinfo(name)
    if info.file_size > MOST_PART:
        raise OfficeError(f"{name} has {info.file_size} bytes")
    return archive.open(info)


def _walk(file, start: Callable[[str, dict], None], end: Callable[[str], None], said: Callable[[str], None]) -> Iterator[None]:
    """Hand a part's tags and text to functions, chunk by chunk; no tree is built."""

    def other(data: str) -> None:
        if data.startswith("&"):
            raise expat.ExpatError(f"undefined entity {data}: line {parser.CurrentLineNumber}, column {parser.CurrentColumnNumber}")

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.DefaultHandlerExpand = start, end, said, other
    chunk = b"-"
    while chunk:
        chunk = file.read(16 << 10)
        try:
            parser.Parse(chunk, not chunk)
        except expat.ExpatError as e:
            yield  # what came before the fault counts
            raise ParseError(str(e)) from e
        yield


def _attributes(file, wanted: str) -> list[dict]:
    """Attributes of a part's elements of one name."""
    out: list[dict] = []
    for _ in _walk(file, lambda tag, own: out.append(own) if tag == wanted else None, lambda tag: None, lambda data: None):
        pass
    return out


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Of a part: relation ids to (last word of the type, part)."""
    folder, name = posixpath.split(part)
    rels = posixpath.join(folder, "_rels", f"{name}.rels")
    try:
        archive.getinfo(rels)
    except KeyError:
        return {}
    out = {}
    for e in _attributes(_part(archive, rels), f"{_REL}Relationship"):
        if e.get("TargetMode") != "External":
            target = e.get("Target", "")
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[e.get("Id")] = e.get("Type", "").rsplit("/", 1)[-1], full
    return out


def _document_part(archive: zipfile.ZipFile) -> str:
    for kind, part in _related(archive, "").values():
        if kind == "officeDocument":
            return part
    raise OfficeError("no main document")


# Tags that are a character.
_WORD_TEXT = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
_DRAWN_TEXT = {f"{_A}tab": "\t", f"{_A}br": "\n"}


def word_blocks(archive: zipfile.ZipFile, rows: bool = True) -> Iterator[Block]:
    """Paragraphs of the body, then rows of its tables, cells joined by " | "; blank ones drop
    out. Only the body's own paragraphs and tables count, not those of text boxes or of tables
    within a cell, whose text belongs to the cell."""
    tables: list[str] = []
    table = box = 0
    text: list[str] = []
    paragraphs: list[str] = []  # of the cell that is open
    cells: list[str] = []
    found: list[Block] = []
    own = inside = False  # a paragraph has been, a run's text is open
    run: list[str] = []
    w_t, w_p, w_tc, w_tr, w_tbl, w_box = (f"{_W}{x}" for x in ("t", "p", "tc", "tr", "tbl", "txbxContent"))

    def start(tag: str, _: dict) -> None:
        nonlocal table, box, own, text, cells, paragraphs, inside, run
        inside = tag == w_t
        if inside:
            run = []
        elif tag == w_tbl:
            table += 1
        elif tag == w_box:
            box += 1
        elif tag == w_p and not box:
            own, text = True, []
        elif tag == w_tr and table == 1:
            cells = []
        elif tag == w_tc and table == 1:
            paragraphs = []

    def end(tag: str) -> None:
        nonlocal table, box, text, inside
        inside = False
        if tag == w_tbl:
            table -= 1
        elif tag == w_box:
            box -= 1
        elif box:
            pass
        elif tag == w_t:
            if own:
                text += run
        elif tag == w_p:
            said = "".join(text)
            if table == 1:
                paragraphs.append(said)
            elif not table and said.strip():
                found.append(Block("paragraph", said.strip()))
            text = []
        elif tag == w_tc and table == 1:
            cells.append("\n".join(paragraphs).strip())
        elif tag == w_tr and table == 1:
            if rows and any(cells):
                tables.append(" | ".join(c for c in cells if c))
        elif own and tag in _WORD_TEXT:
            text.append(_WORD_TEXT[tag])

    def said(data: str) -> None:
        if inside:
            run.append(data)

    for _ in _walk(_part(archive, _document_part(archive)), start, end, said):
        yield from found
        found.clear()
    for row in tables:
        yield Block("row", row)


def slide_parts(archive: zipfile.ZipFile) -> list[str]:
    """Parts of the slides, in the order of the presentation."""
    main = _document_part(archive)
    related = _related(archive, main)
    ids = [e.get(f"{_R}id") for e in _attributes(_part(archive, main), f"{_P}sldId")]
    return [related[i][1] for i in ids if i in related]


def _shapes(archive: zipfile.ZipFile, part: str) -> Iterator[tuple[str, str, str | None]]:
    """(kind, text, placeholder) of a part's own shapes in order: title, shape, row or picture,
    the last with its relation id. What is grouped isn't the slide's own."""
    group = 0
    kind, paragraphs, text, cells, relation, run, inside = None, [], [], [], None, [], False
    found: list[tuple[str, str, str | None]] = []
    a_t, a_p, a_tc, a_tr, a_blip = (f"{_A}{x}" for x in ("t", "p", "tc", "tr", "blip"))
    p_sp, p_pic, p_frame, p_group, p_ph = (f"{_P}{x}" for x in ("sp", "pic", "graphicFrame", "grpSp", "ph"))
    holders = {}  # attributes of what is open, as an element counts where it ends

    def start(tag: str, own: dict) -> None:
        nonlocal group, kind, paragraphs, text, cells, relation, run, inside
        inside = tag == a_t
        if inside:
            run = []
        elif tag == a_p:
            text = []
        elif tag in (p_sp, p_pic, p_frame):
            if not group:
                kind, paragraphs, relation = None, [], None
        elif tag == a_tc:
            paragraphs = []
        elif tag == a_tr:
            cells = []
        elif tag == p_group:
            group += 1
        elif tag in (p_ph, a_blip):
            holders[tag] = own

    def end(tag: str) -> None:
        nonlocal group, kind, relation, inside
        inside = False
        if tag == p_group:
            group -= 1
        elif group:
            pass
        elif tag == a_t:
            text.extend(run)
        elif tag == a_p:
            paragraphs.append("".join(text))
        elif tag == p_sp:
            said = "\n".join(paragraphs).strip()
            if said:
                found.append(("title" if kind in ("title", "ctrTitle") else "shape", said, kind))
        elif tag == p_ph:
            kind = holders[tag].get("type", "body")
        elif tag == a_blip:
            relation = holders[tag].get(f"{_R}embed")
        elif tag == a_tc:
            cells.append("\n".join(paragraphs).strip())
        elif tag == a_tr:
            if any(cells):
                found.append(("row", " | ".join(c for c in cells if c), None))
        elif tag == p_pic:
            if relation:
                found.append(("picture", relation, kind))
        elif tag in _DRAWN_TEXT:
            text.append(_DRAWN_TEXT[tag])

    def said(data: str) -> None:
        if inside:
            run.append(data)

    for _ in _walk(_part(archive, part), start, end, said):
        yield from found
        found.clear()


def slide_blocks(archive: zipfile.ZipFile, part: str, notes: bool = True) -> list[Block]:
    """A slide's blocks: the title first, wherever it stands."""
    related = _related(archive, part)
    found = list(_shapes(archive, part))
    titles = [Block(k, t) for k, t, _ in found if k == "title"][:1]
    rest = [Block(k, related.get(t, ("", t))[1] if k == "picture" else t) for k, t, _ in found if k != "title"]
    rest += [Block("shape", t) for k, t, _ in found if k == "title"][1:]
    own = []
    if notes:
        for kind, target in related.values():
            if kind == "notesSlide" and target in archive.namelist():
                own += [Block("note", t) for k, t, _ in _shapes(archive, target) if k in ("shape", "title") and NO_NOTES not in t.lower()]
    return titles + rest + own


def _rows(path: str, file, first: int | None, last: int | None, kinds: frozenset[str]) -> Iterator[tuple]:
    """Rows of a file, or of slides first to last; one row with an error if it can't be read."""
    try:
        with zipfile.ZipFile(file) as archive:
            if path.lower().endswith(".docx"):
                for n, b in enumerate(word_blocks(archive, "row" in kinds)):
                    if b.kind in kinds:
                        yield path, 0, n, b.kind, b.text, None
                return
            parts = slide_parts(archive)
            for number in range(first or 1, min(last or len(parts), len(parts)) + 1):
                for n, b in enumerate(slide_blocks(archive, parts[number - 1], "note" in kinds)):
                    if b.kind in kinds:
                        yield path, number, n, b.kind, b.text, None
    except (zipfile.BadZipFile, ParseError, KeyError, ValueError, OSError, NotImplementedError, RuntimeError, EOFError) as e:
        yield path, first or 0, -1, None, None, f"{type(e).__name__}: {e}"[:500]


def office_rows(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Blocks of ``files`` (path, content), as ``SCHEMA``; a null content is an error row, too.
    A file is one task's at most: its bytes are one value. Blank text makes no row."""
    wanted = frozenset(kinds)

    schema = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (c.split() for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                for row in _rows(path.as_py(), io.BytesIO(content.as_py() or b""), None, None, wanted):
                    rows.append(row)
                    size += len(row[4] or "") + 100
                    if size >= BATCH_CHARS:
                        yield table()
                        rows, size = [], 0
        if rows:
            yield table()

    return files.select("path", "content").mapInArrow(run, SCHEMA)


class _Range(InputPartition):
    def __init__(self, path: str, first: int | None, last: int | None) -> None:
        self.path, self.first, self.last = path, first, last


def _open(path: str):
    from pyarrow.fs import FileSystem

    fs, own = FileSystem.from_uri(path)
    return fs.open_input_file(own)


class OfficeReader(DataSourceReader):
    def __init__(self, paths: list[str], slides: int) -> None:
        self.paths, self.slides, self.kinds, self.errors = paths, slides, frozenset(KINDS), True

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """kind = ... and kind in (...) say which parts of a file aren't read at all, path = ...
        which files; Spark checks the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("kind",), ("path",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if f.attribute == ("kind",):
                    self.kinds, self.errors = self.kinds & values, False
                else:
                    self.paths = [p for p in self.paths if p in values]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            if path.lower().endswith(".docx"):
                out.append(_Range(path, None, None))
                continue
            try:
                with _open(path) as file, zipfile.ZipFile(file) as archive:
                    n = len(slide_parts(archive))
            except Exception:  # the task that reads it says what is wrong
                n = 1
            out += [_Range(path, a, min(a + self.slides - 1, n)) for a in range(1, n + 1, self.slides)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with _open(partition.path) as file:
                for row in _rows(partition.path, file, partition.first, partition.last, self.kinds):
                    if self.errors or row[-1] is None:
                        yield row
        except OSError as e:  # it is gone, or can't be opened
            if self.errors:
                yield partition.path, partition.first or 0, -1, None, None, f"{type(e).__name__}: {e}"[:500]


class OfficeSource(DataSource):
    """``spark.read.format("lumenfold_office").load(folder)`` once ``register`` has been called;
    ``slides`` is the number of slides of a partition (20). A filter on kind drops error rows."""

    @classmethod
    def name(cls) -> str:
        return "lumenfold_office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OfficeReader:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        root = self.options["path"]
        root = root if re.match(r"\w+://", root) else f"file://{root}"
        scheme = root.split("://")[0]
        fs, own = FileSystem.from_uri(root)
        info = fs.get_file_info(own)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(own, recursive=True))
        paths = sorted(f"{scheme}://{x.path}" for x in found if x.type == FileType.File and x.path.lower().endswith((".docx", ".pptx")))
        return OfficeReader(paths, max(1, int(self.options.get("slides", 20))))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfficeSource)


def document_text(blocks: DataFrame) -> DataFrame:
    """(path, blocks): the texts of a Word file's blocks in order."""
    own = blocks.where("kind in ('paragraph', 'row')")
    return own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("b")).select("path", F.col("b.text").alias("blocks"))


def slide_chunks(blocks: DataFrame, ocr: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(path, part, title, text, ocr_used): a chunk for each slide with a block, each text once
    in order. ``ocr`` is given path and zip part of a picture and answers with its text, or
    null; without one pictures count for nothing."""
    seen = ocr(F.col("path"), F.col("text")) if ocr else F.lit(None).cast("string")
    text = F.when(F.col("kind") == "note", F.concat(F.lit("Speaker notes: "), "text")).when(F.col("kind") == "picture", F.concat(F.lit("Image text: "), F.nullif(F.trim(seen), F.lit("")))).otherwise(F.col("text"))
    own = blocks.where("part > 0 and kind is not null").select("path", "part", "block", "kind", text.alias("text")).where("text is not null")
    found = own.groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("b"), F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"), F.max(F.col("kind") == "picture").alias("ocr_used"))
    return found.select("path", "part", "title", F.array_join(F.array_distinct(F.col("b.text")), "\n").alias("text"), "ocr_used")
