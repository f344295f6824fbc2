"""Word documents as rows of paragraphs and table cells, with stable codes for what isn't readable."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from .files import picture

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
D = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"

# Limits, what tracked changes are called, and what stands for a character.
MOST_PACKAGE = 128 << 20
REVISIONS = {f"{W}{n}" for n in ("ins", "del", "moveFrom", "moveTo", "rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "tcPrChange", "trPrChange", "tblGridChange", "tblPrExChange", "numberingChange", "cellIns", "cellDel", "cellMerge", "moveFromRangeStart", "moveToRangeStart", "customXmlInsRangeStart", "customXmlDelRangeStart")}
MARKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "‑"}

SCHEMA = "path string, status string, ord long, kind string, text string, math string, images array<string>, markers array<string>, table_no long, row long, col long, rowspan long, colspan long"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


class DocxError(ValueError):
    """A document that isn't read; the message is a stable code."""


def xml(data: bytes) -> ElementTree.Element:
    """A part's root; document types and so entities aren't allowed."""
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise DocxError("DOCX_XML_UNSAFE")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise DocxError("DOCX_XML_INVALID") from e


def math_tree(e: ElementTree.Element) -> list:
    """A math element as name, text and children, properties left out."""
    return [e.tag.removeprefix(M), (e.text or "").strip(), [math_tree(c) for c in e if not c.tag.endswith("Pr")]]


def hidden(run: ElementTree.Element) -> bool:
    mark = run.find(f"{W}rPr/{W}vanish")
    return mark is not None and mark.get(f"{W}val", "1") not in ("0", "false", "off")


def paragraph(p: ElementTree.Element, pictures: dict[str, str]) -> tuple[str, str | None, list[str], list[str]]:
    """Visible text, math, hashes of pictures and bookmark names."""
    text: list[str] = []
    for r in p.iter(f"{W}r"):
        if not hidden(r):
            text += [x.text or "" if x.tag == f"{W}t" else MARKS.get(x.tag, "") for x in r]
    math = [math_tree(m) for m in p.iter(f"{M}oMath")]
    images = [pictures.get(b.get(f"{R}embed", ""), "missing") for b in p.iter(f"{A}blip")]
    return "".join(text), str(math) if math else None, images, [b.get(f"{W}name", "") for b in p.iter(f"{W}bookmarkStart")]


def cells(table: ElementTree.Element) -> list[tuple[int, int, int, int, str]]:
    """Logical cells of a table: row, column, spans and text; a cell that continues one above adds to its span."""
    above: dict[int, list] = {}
    out: list[list] = []
    for r, row in enumerate(table.findall(f"{W}tr")):
        c, fresh = 0, {}
        for cell in row.findall(f"{W}tc"):
            span, merge = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
            across = int(span.get(f"{W}val", "1")) if span is not None else 1
            if merge is not None and merge.get(f"{W}val", "continue") == "continue":
                own = above.get(c)
                if own is None or own[3] != across:
                    raise DocxError("DOCX_TABLE_MERGE_INVALID")
                own[2] += 1
            else:
                own = [r, c, 1, across, "\n".join(paragraph(p, {})[0] for p in cell.iter(f"{W}p"))]
                out.append(own)
            fresh[c] = own
            c += across
        above = fresh
    return [tuple(x) for x in out]


def read(data: bytes) -> Iterator[tuple]:
    """Rows of one package, without path and status."""
    if len(data) > MOST_PACKAGE:
        raise DocxError("DOCX_SIZE_LIMIT")
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise DocxError("DOCX_PACKAGE_INVALID") from e
    names = package.namelist()
    if len(set(names)) != len(names):
        raise DocxError("DOCX_PACKAGE_DUPLICATE")
    if "word/document.xml" not in names or "[Content_Types].xml" not in names:
        raise DocxError("DOCX_PART_MISSING")
    if sum(i.file_size for i in package.infolist()) > MOST_PACKAGE:
        raise DocxError("DOCX_SIZE_LIMIT")
    body = xml(package.read("word/document.xml")).find(f"{W}body")
    if body is None:
        raise DocxError("DOCX_BODY_MISSING")
    if any(e.tag in REVISIONS for e in body.iter()):
        raise DocxError("DOCX_REVISIONS_UNSUPPORTED")
    pictures = {}
    if "word/_rels/document.xml.rels" in names:
        for rel in xml(package.read("word/_rels/document.xml.rels")):
            target = "word/" + rel.get("Target", "").lstrip("/").removeprefix("word/")
            if rel.get("Type", "").endswith("/image") and rel.get("TargetMode") != "External" and target in names:
                pictures[rel.get("Id", "")] = hashlib.sha256(package.read(target)).hexdigest()
    tables = 0
    for n, e in enumerate(body, 1):
        if e.tag == f"{W}p":
            yield (n, "paragraph", *paragraph(e, pictures), None, None, None, None, None)
        elif e.tag == f"{W}tbl":
            tables += 1
            for r, c, down, across, text in cells(e):
                yield n, "cell", text, None, [], [], tables, r, c, down, across


def documents(files: DataFrame) -> DataFrame:
    """Rows of all documents of a ``binaryFile`` table; a file that isn't read is one row with its code in ``status``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, "OK", *r) for r in read(content)]
                except DocxError as e:
                    rows = [(path, str(e), *[None] * (len(NAMES) - 2))]
                except (ValueError, KeyError, zipfile.BadZipFile, zlib.error, NotImplementedError):  # a bad number, part or packing
                    rows = [(path, "DOCX_CONTENT_INVALID", *[None] * (len(NAMES) - 2))]
                out = pd.DataFrame(rows, columns=NAMES, dtype=object)
                yield out.astype({c: "Int64" for c in ("ord", "table_no", "row", "col", "rowspan", "colspan")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def package_state(data: bytes) -> tuple[bool, int]:
    """Whether a package has text or math to edit, and the characters of its text; a fault of its parts is raised.

    All parts in XML are read; relationships lead to parts of the package; pictures have a head that can be read; drawings have an extent.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        if sum(i.file_size for i in package.infolist()) > MOST_PACKAGE:
            raise DocxError("DOCX_SIZE_LIMIT")
        names = set(package.namelist())
        for name in sorted(names):
            if name.startswith("word/media/") and not name.endswith("/"):
                kind, _, _, error = picture(package.read(name))
                if kind is None or error == "IMAGE_DECODE_ERROR":
                    raise DocxError("IMAGE_DECODE_ERROR")
            if not name.endswith((".xml", ".rels")):
                continue
            root = xml(package.read(name))
            for rel in root if name.endswith(".rels") else ():
                if rel.get("TargetMode") == "External":
                    raise DocxError("EXTERNAL_RELATIONSHIP")
                base = posixpath.dirname(posixpath.dirname(name))
                if posixpath.normpath(posixpath.join("/", base, rel.get("Target", ""))).lstrip("/") not in names:
                    raise DocxError("OOXML_TARGET_MISSING")
        if "word/document.xml" not in names:
            raise DocxError("DOCX_PART_MISSING")
        root = xml(package.read("word/document.xml"))
    if any(int(e.get(side, "0")) <= 0 for e in root.iter(f"{D}extent") for side in ("cx", "cy")):
        raise DocxError("INVALID_IMAGE_EXTENT")
    text = "".join(t.text or "" for t in root.iter(f"{W}t"))
    math = "".join(t.text or "" for m in root.iter(f"{M}oMath") for t in m.iter(f"{M}t"))
    return bool(text.strip() or math.strip()), len(text)


def packages(files: DataFrame) -> DataFrame:
    """path, status, editable and n_chars of the packages of a ``binaryFile`` table; one that fails has its code in ``status`` and nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, "OK", *package_state(content)))
                except DocxError as e:
                    rows.append((path, str(e), None, None))
                except (ValueError, KeyError, zipfile.BadZipFile, zlib.error, NotImplementedError):
                    rows.append((path, "DOCX_PACKAGE_INVALID", None, None))
            yield pd.DataFrame(rows, columns=["path", "status", "editable", "n_chars"], dtype=object).astype({"editable": "boolean", "n_chars": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, status string, editable boolean, n_chars long")
