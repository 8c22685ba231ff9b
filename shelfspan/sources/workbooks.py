"""Workbooks in the Office Open XML format (.xlsx), read where Spark reads their bytes.

A workbook is a task: its sheets are parsed row by row and leave in batches, so a task holds the file, its table of shared
texts and one batch. Any number of workbooks of a folder or pattern are read side by side. Formats and limits are those of
the published standard: a sheet has at most 1,048,576 rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch.
BATCH = 2000
SCHEMA = "path string, sheet_no int, sheet string, row long, cells array<string>, is_text array<boolean>"
_TYPES = pa.schema([("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("is_text", pa.list_(pa.bool_()))])
#: Numbers of the formats that show a number as a date or time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _walk(book: zipfile.ZipFile, part: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of a part with the given name, each freed once it's used."""
    with book.open(part) as f:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if _plain(e.tag) == wanted:
                yield e
                if parents:
                    parents[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    """The text of a string item without its phonetic hints."""
    if _plain(e.tag) == "rPh":
        return ""
    return (e.text or "") if _plain(e.tag) == "t" else "".join(map(_text, e))


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in their order; charts and other parts that have no cells are left out."""
    targets = {e.get("Id"): e.get("Target") for e in _walk(book, "xl/_rels/workbook.xml.rels", "Relationship") if (e.get("Type") or "").endswith("/worksheet")}
    found = []
    for e in _walk(book, "xl/workbook.xml", "sheet"):
        target = targets.get(next((v for k, v in e.attrib.items() if _plain(k) == "id"), None))
        if target is not None:
            found.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Styles of cells that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    said = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode") or "").lower() for e in _walk(book, "xl/styles.xml", "numFmt")}
    dates = DATE_FORMATS | {n for n, code in said.items() if re.search("[ymdhs]", code)}
    formats = next(_walk(book, "xl/styles.xml", "cellXfs"), None)
    return set() if formats is None else {k for k, e in enumerate(formats) if int(e.get("numFmtId") or 0) in dates}


def _moment(days: float, from_1904: bool) -> str | None:
    """A serial number of days as date, with the time where it isn't midnight; null outside the calendar."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30 if days >= 60 else 31)
    try:
        at = start + timedelta(seconds=round(days * 86400))
    except OverflowError:
        return None
    return at.strftime("%Y-%m-%d") if at.time() == at.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def _number(v: str) -> str:
    """A number as text, whole ones without a point."""
    if re.fullmatch(r"[+-]?\d+", v):
        return v
    x = float(v)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def _place(reference: str | None, after: int) -> int:
    """The column of a cell's reference (AB12), counted from 0, or the next one where it has none."""
    n = 0
    for ch in re.match("[A-Z]*", reference or "").group():
        n = n * 26 + ord(ch) - 64
    return n - 1 if n else after


def rows_of(book: zipfile.ZipFile, part: str, shared: list[str], dates: set[int], from_1904: bool) -> Iterator[tuple[int, list, list]]:
    """(row from 0, cells, whether a cell is text) of a sheet; empty and error cells are null."""
    at = 0
    for e in _walk(book, part, "row"):
        at = int(e.get("r") or at + 1)
        cells: list[str | None] = []
        is_text: list[bool] = []
        for c in e:
            if _plain(c.tag) != "c":
                continue
            k = _place(c.get("r"), len(cells))
            cells += [None] * (k + 1 - len(cells))
            is_text += [False] * (k + 1 - len(is_text))
            kind = c.get("t") or "n"
            v = next((x.text for x in c if _plain(x.tag) == "v"), None)
            if kind == "inlineStr":
                v = "".join(_text(x) for x in c if _plain(x.tag) == "is")
            if not v or kind == "e":
                continue
            is_text[k] = kind in ("s", "str", "inlineStr")
            if kind == "s":
                v = shared[int(v)]
            elif kind == "b":
                v = "True" if v == "1" else "False"
            elif kind == "n":
                v = _moment(float(v), from_1904) if int(c.get("s") or 0) in dates else _number(v)
            cells[k] = v or None
        yield at - 1, cells, is_text


def _parse(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(e) for e in _walk(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = _date_styles(book)
        from_1904 = any(e.get("date1904") in ("1", "true") for e in _walk(book, "xl/workbook.xml", "workbookPr"))
        for k, (name, part) in enumerate(sheets_of(book)):
            yield path, k, name, -1, [], []  # a sheet without rows is named too
            for row, cells, is_text in rows_of(book, part, shared, dates, from_1904):
                yield path, k, name, row, cells, is_text


def _batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in files:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            held: list[tuple] = []
            for row in _parse(path.as_py(), content.as_py()):
                held.append(row)
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet_no, sheet, row, cells, is_text): rows of all sheets of all workbooks of a path; row -1 states each sheet."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_batches, SCHEMA)
