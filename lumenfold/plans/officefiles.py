"""Word and PowerPoint files made of rows, for queries and tests of their readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_P = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{_OFFICE}" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
#: Characters that XML can't hold.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _text(x: str) -> str:
    return escape(_ILLEGAL.sub("", x), {"\r": "&#13;"})


def _rels(*targets: tuple[str, str]) -> str:
    own = "".join(f'<Relationship Id="rId{n}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for n, (kind, target) in enumerate(targets, 1))
    return f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{own}</Relationships>'


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return out.getvalue()


def _word_paragraph(text: str) -> str:
    runs = "".join("<w:tab/>" if x == "\t" else "<w:br/>" if x == "\n" else f'<w:t xml:space="preserve">{_text(x)}</w:t>' for x in re.split(r"([\t\n])", text) if x)
    return f"<w:p><w:r>{runs}</w:r></w:p>"


def docx(paragraphs: list[str], tables: list[list[list[str]]] = (), extra: str = "") -> bytes:
    """A file with the tables behind the first paragraph; ``extra`` is further body XML."""
    grid = "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_word_paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in table) + "</w:tbl>" for table in tables)
    body = [_word_paragraph(p) for p in paragraphs]
    xml = f"{_HEAD}<w:document {_W}><w:body>{''.join(body[:1])}{grid}{''.join(body[1:])}{extra}</w:body></w:document>"
    return _zip({"_rels/.rels": _rels(("officeDocument", "word/document.xml")), "word/document.xml": xml})


def _drawn(text: str) -> str:
    own = "".join(f"<a:p>{''.join('<a:br/>' if x == chr(11) else f'<a:r><a:t>{_text(x)}</a:t></a:r>' for x in re.split(chr(11), line))}</a:p>" for line in text.split("\n"))
    return f"<p:txBody>{own}</p:txBody>"


def _shape(text: str, kind: str | None = None) -> str:
    place = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else "<p:nvPr/>"
    return f"<p:sp><p:nvSpPr>{place}</p:nvSpPr>{_drawn(text)}</p:sp>"


def pptx(slides: list[dict]) -> bytes:
    """Slides of title, shapes, rows (a table), picture (bytes) and note, all optional; the title
    stands behind the shapes, and slides are stored in reverse."""
    n = len(slides)
    parts: dict[str, str | bytes] = {"_rels/.rels": _rels(("officeDocument", "ppt/presentation.xml"))}
    parts["ppt/_rels/presentation.xml.rels"] = _rels(*[("slide", f"slides/slide{n - k}.xml") for k in range(n)])
    parts["ppt/presentation.xml"] = f'{_HEAD}<p:presentation {_P}><p:sldIdLst>{"".join(f"<p:sldId id=\"{256 + k}\" r:id=\"rId{k + 1}\"/>" for k in range(n))}</p:sldIdLst></p:presentation>'
    for k, s in enumerate(slides):
        name = f"slide{n - k}.xml"
        tree = "".join(_shape(x) for x in s.get("shapes") or ())
        if s.get("rows"):
            rows = "".join("<a:tr>" + "".join(f"<a:tc>{_drawn(c).replace('p:txBody', 'a:txBody')}</a:tc>" for c in row) + "</a:tr>" for row in s["rows"])
            tree += f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
        related = []
        if s.get("picture"):
            related.append(("image", f"../media/image{k}.png"))
            parts[f"ppt/media/image{k}.png"] = s["picture"]
            tree += f'<p:pic><p:blipFill><a:blip r:embed="rId{len(related)}"/></p:blipFill></p:pic>'
        if s.get("title") is not None:
            tree += _shape(s["title"], "title")
        if s.get("note") is not None:
            related.append(("notesSlide", f"../notesSlides/notes{k}.xml"))
            parts[f"ppt/notesSlides/notes{k}.xml"] = f"{_HEAD}<p:notes {_P}><p:cSld><p:spTree>{_shape(s['note'], 'body')}</p:spTree></p:cSld></p:notes>"
        parts[f"ppt/slides/{name}"] = f"{_HEAD}<p:sld {_P}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
        if related:
            parts[f"ppt/slides/_rels/{name}.rels"] = _rels(*related)
    return _zip(parts)


#: Files that a task makes before it hands them on.
_AT_ONCE = 256


def _files(rows: DataFrame, columns: list[str], make: Callable[..., bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _AT_ONCE):
                path, *given = (c.to_pylist() for c in whole.slice(k, _AT_ONCE).columns)
                made = [make(*x) for x in zip(*given, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return rows.select("path", *columns).mapInArrow(run, "path string, content binary")


def word_files(rows: DataFrame) -> DataFrame:
    """(path, content) of rows with path, paragraphs and a table."""
    return _files(rows, ["paragraphs", "table"], lambda paragraphs, table: docx(paragraphs, [table]))


def slide_files(rows: DataFrame) -> DataFrame:
    """(path, content) of rows with path, title, shapes, table and note: one slide of them all,
    then one of the shapes alone."""
    return _files(rows, ["title", "shapes", "table", "note"], lambda a, s, t, n: pptx([{"title": a, "shapes": s, "rows": t, "note": n}, {"shapes": s}]))
