"""Sheets of workbooks (.xlsx) as rows, read as streams of XML.

A workbook is a zip of XML parts.  Spark lists and fetches the files, from any store it
reads; a task opens a workbook, walks the XML of the sheet asked for and holds one row of
it at a time, besides the workbook's shared strings.  Every cell is text as stored: whole
and decimal numbers as written, booleans as true and false, dates as serial numbers,
formulas by their last value.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_LINK = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
ROWS = "path string, sheet string, row long, cells array<string>"
BATCH = 1000


def _text(node: ElementTree.Element) -> str:
    """All runs of a string, but not its phonetic hints."""
    return "".join(t.text or "" for run in node if run.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([run] if run.tag == f"{_MAIN}t" else run.findall(f"{_MAIN}t")))


def column(reference: str) -> int:
    """Of a cell such as AB12, from 0."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and members of the sheets, the one that was open first."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_LINK)}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    found = [(s.get("name"), links[s.get(_REL)]) for s in root.iter(f"{_MAIN}sheet")]
    found = [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in found]
    view = next(root.iter(f"{_MAIN}workbookView"), None)
    active = int(view.get("activeTab", 0)) if view is not None else 0
    return found[active : active + 1] + found[:active] + found[active + 1 :]


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag == f"{_MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return None if inline is None else _text(inline)
    if value is None or value.text is None:
        return None
    if kind == "s":
        return strings[int(value.text)]
    return {"1": "true", "0": "false"}.get(value.text, value.text) if kind == "b" else value.text


def rows_of(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers and cells of a sheet; cells that aren't there are null."""
    strings = _strings(book)
    with book.open(member) as part:
        number = 0
        for _, node in ElementTree.iterparse(part):
            if node.tag == f"{_MAIN}row":
                number = int(node.get("r", number + 1))
                cells: list[str | None] = []
                for cell in node.findall(f"{_MAIN}c"):
                    at = column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(_value(cell, strings))
                yield number, cells
                node.clear()


def cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """path, sheet, row and cells of every row of the sheet of that name in the workbooks
    of a path, or of the sheet that was open when they were saved.  Files that aren't
    workbooks, or lack the sheet, have no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in frame.itertuples(index=False, name=None):
                try:
                    book = zipfile.ZipFile(io.BytesIO(content))
                    chosen = [s for s in sheets(book) if sheet in (None, s[0])][:1]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for title, member in chosen:
                    held = []
                    for number, found in rows_of(book, member):
                        held.append((name, title, number, found))
                        if len(held) >= BATCH:
                            yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])

    return files.mapInPandas(run, ROWS)


def table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet with a header: _file, _row and a text column for each name in the first row
    of the first workbook; cells beyond the header and empty rows are left out."""
    found = cells(spark, path, sheet)
    head = found.orderBy("path", "row").first()
    if head is None:
        return spark.createDataFrame([], "_file string, _row long")
    rows = found.where(F.exists("cells", lambda c: c.isNotNull()) & (F.col("row") > head["row"]))
    named = [(i, n) for i, n in enumerate(head["cells"]) if n]
    return rows.select(F.col("path").alias("_file"), F.col("row").alias("_row"), *(F.get("cells", F.lit(i)).alias(n) for i, n in named))
