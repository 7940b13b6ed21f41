"""Spreadsheet files as cells."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffloom.operators.cells import CELL_SCHEMA

# fixed values of the file format: element and attribute names, places of the parts
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BOOK, LINKS, SHARED = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
# fixed values: texts that count as empty cells, as in the pandas readers
EMPTY_TEXTS = frozenset({
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
})
BATCH = 20_000
#: bytes of files that are handed to Python at a time; a single larger file goes alone
FILE_BATCH = 64 * 1024 * 1024


def _elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[ET.Element]:
    """Complete elements of one name, in order; each is emptied, and so is what holds it."""
    if part not in book.namelist():
        return
    with book.open(part) as stream:
        path: list[ET.Element] = []
        for event, node in ET.iterparse(stream, events=("start", "end")):
            if event == "start":
                path.append(node)
                continue
            path.pop()
            if node.tag.rpartition("}")[2] == name:
                yield node
                node.clear()
                if path:
                    path[-1].clear()


def _plain(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _parts_of_sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> its part, in the order of the workbook; sheets without a part are left out."""
    place = {}
    for link in _elements(book, LINKS, "Relationship"):
        # a target is relative to the workbook's folder unless it starts at the root
        place[link.get("Id")] = posixpath.normpath(posixpath.join("/xl", link.get("Target", ""))).lstrip("/")
    present = set(book.namelist())
    return {s.get("name"): place[s.get(LINK_ID)] for s in _elements(book, BOOK, "sheet") if place.get(s.get(LINK_ID)) in present}


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _cell(node: ET.Element, shared: list[str]) -> tuple | None:
    """``vtype, sval, nval, formula`` of a cell element; none if it has no value."""
    kind, value, formula = node.get("t", "n"), node.findtext(f"{MAIN}v"), node.findtext(f"{MAIN}f")
    if kind == "inlineStr":
        value = _plain(node)
    elif kind == "s" and value is not None:
        value = shared[int(value)]
    if value is None or value in EMPTY_TEXTS or kind == "e":
        return None
    formula = None if formula is None else "=" + formula
    if kind in ("n", "b"):
        return "bool" if kind == "b" else "num", None, float(value), formula
    return "str", value, None, formula  # texts, and dates given as text


def workbook_cells(doc_id: str, content: bytes) -> Iterator[tuple]:
    """The valued cells of one workbook; styled empty rows cost nothing but their bytes."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_plain(item) for item in _elements(book, SHARED, "si")]
        for sheet, part in _parts_of_sheets(book).items():
            row = -1
            for line in _elements(book, part, "row"):
                row = int(line.get("r", row + 2)) - 1
                col = -1
                for node in line.iter(f"{MAIN}c"):
                    col = _column(node.get("r")) if node.get("r") else col + 1
                    if cell := _cell(node, shared):
                        yield doc_id, sheet, row, col, *cell


def _bounded(files: DataFrame) -> DataFrame:
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(FILE_BATCH))
    return files.select("doc_id", "content")


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Cells of workbooks given as ``doc_id, content`` rows.

    A file that cannot be read gives the cells before the fault; :func:`workbook_errors` names it.
    """
    names = [f.split()[0] for f in CELL_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                rows = []
                try:
                    for cell in workbook_cells(doc_id, content):
                        rows.append(cell)
                        if len(rows) >= BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except (ET.ParseError, zipfile.BadZipFile, KeyError, ValueError, IndexError, TypeError):
                    pass  # told by workbook_errors
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return _bounded(files).mapInPandas(parse, CELL_SCHEMA)


def workbook_errors(files: DataFrame) -> DataFrame:
    """``doc_id, error`` for every file that cannot be read to its end."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    for _ in workbook_cells(doc_id, content):
                        pass
                except (ET.ParseError, zipfile.BadZipFile, KeyError, ValueError, IndexError, TypeError) as error:
                    rows.append((doc_id, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["doc_id", "error"])

    return _bounded(files).mapInPandas(judge, "doc_id string, error string")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every ``*.xlsx`` under a directory; ``doc_id`` is the path."""
    return parse_workbooks(_files(spark, path))


def read_workbook_errors(spark: SparkSession, path: str) -> DataFrame:
    """The files under a directory that cannot be read."""
    return workbook_errors(_files(spark, path))
