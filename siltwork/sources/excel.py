"""Spreadsheets (.xlsx) as records, read with the standard library.

Cells come as texts, as a reader of the sheet sees them: shared, inline and formula texts,
numbers and dates in their cell's format, otherwise as written without a needless fraction,
booleans as TRUE or FALSE. A sheet is one part, read by one task: sheets are bounded by their
format (1,048,576 rows).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.sources.cellformat import BUILT_IN, shown
from siltwork.sources.records import ReadOptions, project

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


class ExcelError(ValueError):
    """A workbook, sheet or header row that can't be read."""


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def column_number(ref: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


@dataclass(frozen=True)
class Book:
    """What cells refer to: shared texts, the formats of their styles, and the day from which dates count."""

    shared: list[str]
    formats: list[str]
    date1904: bool


def read_book(book: zipfile.ZipFile) -> Book:
    shared, formats = [], []
    names = book.namelist()
    if "xl/sharedStrings.xml" in names:
        shared = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    if "xl/styles.xml" in names:
        styles = ElementTree.fromstring(book.read("xl/styles.xml"))
        own = {int(n.get("numFmtId")): n.get("formatCode") or "" for n in styles.iter(f"{_MAIN}numFmt")}
        used = styles.find(f"{_MAIN}cellXfs")
        for xf in used if used is not None else ():
            n = int(xf.get("numFmtId") or 0)
            formats.append(own.get(n) or BUILT_IN.get(n, "General"))
    about = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
    return Book(shared, formats, about is not None and about.get("date1904") in ("1", "true"))


def _cell(cell, book: Book) -> str:
    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _texts(cell)
    text = value.text if value is not None and value.text else ""
    if kind == "s":
        return book.shared[int(text)] if text else ""
    if kind == "b":
        return "TRUE" if text == "1" else "FALSE"
    if kind == "n" and text:
        style = int(cell.get("s") or 0)
        if style < len(book.formats) and book.formats[style].lower() != "general":
            return shown(text, book.formats[style], book.date1904)
        if re.fullmatch(r"-?\d+\.0+", text):
            return text.split(".")[0]
    return text


def sheet_names(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheets in order, with the paths of their parts."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    out = {}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = rels[s.get(_REL)]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    return out


def sheet_rows(data: bytes, sheet: str = "") -> list[list[str]]:
    """The rows of a sheet, the first one by default; rows left out in the file are empty."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ExcelError("not a workbook") from e
    names = sheet_names(book)
    if not names:
        raise ExcelError("the workbook has no sheets")
    if sheet and sheet not in names:
        raise ExcelError(f"there is no sheet {sheet!r}")
    held = read_book(book)
    rows: list[list[str]] = []
    with book.open(names[sheet or next(iter(names))]) as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag != f"{_MAIN}row":
                continue
            at = int(node.get("r") or len(rows) + 1)
            while len(rows) < at - 1:
                rows.append([])
            row: list[str] = []
            for cell in node.iter(f"{_MAIN}c"):
                k = column_number(cell.get("r")) if cell.get("r") else len(row)
                row += [""] * (k - len(row))
                row.append(_cell(cell, held))
            rows.append(row)
            node.clear()
    return rows


def headings(row: list[str]) -> dict[str, int]:
    """Columns by trimmed heading; blank ones are left out, of equal ones the last counts."""
    return {h.strip(): i for i, h in enumerate(row) if h.strip()}


def read_excel(spark: SparkSession, path: str, options: ReadOptions | None = None) -> DataFrame:
    """The sheet's records, texts and lists of texts by target field. Errors are raised when the frame is read, but for the header's."""
    options = options or ReadOptions()
    if options.header < 1:
        raise ExcelError(f"header row {options.header} is out of range")
    header, sheet = options.header, options.sheet
    used = sorted({p.strip() for e in options.fields.values() for p in re.split(r"[&|]" if "&" not in e else "&", e) if p.strip()})

    def parse(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows = sheet_rows(bytes(data), sheet)
                if header > len(rows):
                    raise ExcelError(f"header row {header} is out of range ({len(rows)} rows)")
                at = headings(rows[header - 1])
                yield pd.DataFrame({f"c{i}": [r[at[h]] if h in at and at[h] < len(r) else None for r in rows[header:]] for i, h in enumerate(used)}, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    raw = files.mapInPandas(parse, ", ".join(f"c{i} string" for i in range(len(used))) or "c0 string")
    number = {h: i for i, h in enumerate(used)}
    return project(raw, options, lambda name: F.col(f"c{number[name]}"))
