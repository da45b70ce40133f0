"""Sheets of spreadsheet workbooks (Office Open XML), as rows of text."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_files

#: Rows of a sheet that a workbook can hold, and rows handed on at a time.
MOST_ROWS = 1_048_576
BATCH = 4096
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_NUMBER = re.compile(r"-?[0-9]+(\.0+)?$")
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """The file of each sheet in the archive, by the sheet's name, in their order."""
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return {s.get("name"): posixpath.normpath(posixpath.join("xl", target[s.get(_REL)].lstrip("/").removeprefix("xl/"))) for s in sheets}


def _text(node: ET.Element) -> str:
    """Text of a string, all of its runs but not their readings."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ET.iterparse(f):
            if node.tag == f"{_MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def _column(reference: str) -> int:
    place = 0
    for c in reference:
        if not c.isalpha():
            break
        place = place * 26 + ord(c.upper()) - 64
    return place - 1


def _value(cell: ET.Element, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inner = cell.find(f"{_MAIN}is")
        return _text(inner) if inner is not None else None
    node = cell.find(f"{_MAIN}v")
    if node is None or node.text is None:
        return None
    if kind == "s":
        return shared[int(node.text)]
    if kind == "b":
        return "True" if node.text.strip() == "1" else "False"
    return node.text.split(".")[0] if kind == "n" and _NUMBER.match(node.text) else node.text


def sheet_rows(content: bytes, sheet: str) -> Iterator[list[str | None]]:
    """Rows of a sheet, each up to its last cell; blank rows between are empty. Whole numbers have no decimals, logical values are
    True or False, dates are the numbers that they are stored as, errors their text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = sheet_parts(book)
        if sheet not in parts:
            raise ValueError(f"no such sheet: {sheet}, but {list(parts)}")
        shared, nth = _shared(book), 0
        with book.open(parts[sheet]) as f:
            for _, node in ET.iterparse(f):
                if node.tag != f"{_MAIN}row":
                    continue
                place = int(node.get("r", nth + 1))
                while nth + 1 < place:
                    nth += 1
                    yield []
                nth, line = place, []
                for cell in node.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(line)
                    line.extend([None] * (at - len(line)))
                    line.append(_value(cell, shared))
                yield line
                node.clear()


def _rows(sheet: str, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                lines: list[list[str | None]] = []
                start = 0
                for line in sheet_rows(content.as_py(), sheet):
                    lines.append(line)
                    if len(lines) == BATCH or len(lines) == most:
                        yield _batch(path, start, lines)
                        start, lines = start + len(lines), []
                        if most:
                            break
                if lines:
                    yield _batch(path, start, lines)

    return run


def _batch(path: str, start: int, lines: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(range(start, start + len(lines)), pa.int64()), pa.array(lines, pa.list_(pa.string()))], ["path", "place", "cells"])


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(path, place, and a text column for each header cell) of the sheet of that name in each workbook under ``path``; ``place`` is the row's, from 1 after the header.

    Workbooks are read side by side, each by one task as a stream of rows: a sheet is one compressed stream of at most a million rows, which can't be split. The
    header is the first workbook's first row, all workbooks are taken to have it; blank header cells give no column, rows without a filled cell are dropped, and
    missing cells are null. A sheet that a workbook lacks is an error.
    """
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")
    kind = "path string, place long, cells array<string>"
    first = books.select("path").agg(F.min("path").alias("p")).first()["p"]
    if first is None:
        raise FileNotFoundError(f"no workbook under {path}")
    head = books.where(F.col("path") == first).mapInArrow(_rows(sheet, 1), kind).first()
    names = [(k, n) for k, n in enumerate(head["cells"] if head else []) if n is not None and n.strip()]
    rows = books.mapInArrow(_rows(sheet, None), kind).where("place > 0").where(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    return rows.select("path", "place", *[F.get("cells", F.lit(k)).alias(n) for k, n in names])


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = "http://schemas.openxmlformats.org/"


def _packed(parts: pd.DataFrame, sheets: list[str]) -> bytes:
    """A workbook of sheets of rows already in markup."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        many = range(1, len(sheets) + 1)
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_NS}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in many) + "</Types>")
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_NS}package/2006/relationships"><Relationship Id="rId1" Type="{_NS}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-3]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(many, sheets, strict=True)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_NS}package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_NS}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in many) + "</Relationships>")
        for k, name in zip(many, sheets, strict=True):
            own = parts[parts["sheet"] == name].sort_values("place")
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                for r, line in enumerate(own["cells"], 1):
                    cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", c))}</t></is></c>' if c is not None else "<c/>" for c in line)
                    f.write(f'<row r="{r}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_workbooks(sheets: dict[str, tuple[DataFrame, str]], root: str, book: str | None = None) -> int:
    """Write workbooks with the given sheets (name: rows and the column that orders them) below ``root``; how many.

    All rows go to one workbook, or to one for each value of the column ``book``, which then all sheets have and which names the file. A workbook is made by
    one task, since it is one file of at most MOST_ROWS rows a sheet; more rows are an error. Values are written as text; characters that XML can't hold are left out.
    """
    names, every = list(sheets), None
    for name, (rows, order) in sheets.items():
        columns = [c for c in rows.columns if c != book]
        keyed = rows.select((F.col(book).cast("string") if book else F.lit("book")).alias("name"), F.lit(name).alias("sheet"), F.col(order).cast("double").alias("place"), F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"))
        head = keyed.select("name").distinct().select("name", F.lit(name).alias("sheet"), F.lit(float("-inf")).alias("place"), F.array(*map(F.lit, columns)).alias("cells"))
        both = keyed.unionByName(head)
        every = both if every is None else every.unionByName(both)

    def packed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        if len(parts) and parts.groupby("sheet").size().max() > MOST_ROWS:
            raise ValueError(f"workbook {key[0]}: more rows than a sheet can hold")
        return pd.DataFrame({"name": [f"{key[0]}.xlsx"], "content": [_packed(parts, names)]})

    return write_files(every.groupBy("name").applyInPandas(packed, "name string, content binary"), root)
