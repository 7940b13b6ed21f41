"""Notice files as blocks."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.operators.notices import padded, with_context
from tariffloom.session import cut_lineage, dealt
from tariffloom.sources.spreadsheets import FILE_BATCH

BLOCK_SCHEMA = ("doc_id string, ord bigint, kind string, text string, section string, table_no int, "
                "grid array<array<string>>")
SECTION = re.compile(r"Contents/section\d+\.xml")
# fixed values of the file format: paragraph, text, table, row, cell
NAMES = {fixed.HWPX_NS + short: long for short, long in
         (("p", "paragraph"), ("t", "text"), ("tbl", "table"), ("tr", "row"), ("tc", "cell"))}


@dataclass
class Open:
    """An element that is being read, with what it has gathered so far."""

    kind: str
    words: list[str] = field(default_factory=list)
    parts: list = field(default_factory=list)
    blocks: list = field(default_factory=list)
    holds_table: bool = False

    def said(self) -> str:
        return "".join(self.words).strip()


def _grid(table: Open) -> list[list[str]]:
    """A cell's text is that of its paragraphs, a line each; or its own if it has none with text."""
    lines = lambda cell: [p.said() for p in cell.parts if p.said()]
    return [["\n".join(lines(cell)) or cell.said() for cell in row.parts] for row in table.parts]


class Reader:
    """Gathers the blocks of one section from its parse events.

    A paragraph around a table is dissolved into what it holds; any other outermost paragraph is
    one block if it has text.  An outermost table is one block; tables in its cells add their rows
    and words to it.
    """

    def __init__(self) -> None:
        self.open: list[Open] = [Open("section")]

    def above(self, kind: str) -> list[Open]:
        return [o for o in self.open if o.kind == kind]

    def start(self, kind: str) -> None:
        item = Open(kind)
        within = {"paragraph": "cell", "cell": "row", "row": "table"}.get(kind)
        for holder in self.above(within) if within else ():
            holder.parts.append(item)
        self.open.append(item)

    def end(self, kind: str, text: str | None) -> list[tuple]:
        """Closes an element and returns the blocks that are now certain."""
        item = self.open.pop()
        if kind == "text":
            for holder in self.open:
                holder.words.append(text or "")
            return []
        if self.above("table") or kind not in ("table", "paragraph"):
            return []
        if kind == "table":
            for holder in self.above("paragraph"):
                holder.holds_table = True
            done = [("표", None, _grid(item))]
        else:
            done = item.blocks if item.holds_table else [("문단", item.said(), None)] if item.said() else []
        outer = self.above("paragraph")
        if outer:
            outer[-1].blocks += done
            return []
        return done


def section_blocks(stream) -> Iterator[tuple]:
    reader = Reader()
    for event, node in ET.iterparse(stream, events=("start", "end")):
        kind = NAMES.get(node.tag)
        if event == "start":
            if kind:
                reader.start(kind)
            continue
        if kind:
            yield from reader.end(kind, node.text)
        node.clear()


def notice_blocks(doc_id: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        sections = sorted(filter(SECTION.match, file.namelist()))
        if not sections:
            raise ValueError("no section in the notice")
        order, tables = 0, 0
        for section in sections:
            with file.open(section) as stream:
                for kind, text, grid in section_blocks(stream):
                    yield doc_id, order, kind, text, section, tables if grid is not None else None, grid
                    order += 1
                    tables += grid is not None


def _scan(files: DataFrame, errors: bool) -> DataFrame:
    names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            failed = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows = pd.DataFrame(list(notice_blocks(doc_id, content)), columns=names)
                except (ET.ParseError, zipfile.BadZipFile, ValueError, TypeError) as error:
                    failed.append((doc_id, f"{type(error).__name__}: {error}"))
                    continue
                if not errors:
                    rows["table_no"] = rows["table_no"].astype("Int32")
                    yield rows
            if errors:
                yield pd.DataFrame(failed, columns=["doc_id", "error"])

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(FILE_BATCH))
    return files.select("doc_id", "content").mapInPandas(parse, "doc_id string, error string" if errors else BLOCK_SCHEMA)


def parse_notices(files: DataFrame) -> DataFrame:
    """Blocks of notices given as ``doc_id, content`` rows, with padded grids and context.

    A file that cannot be read gives no block; :func:`notice_file_errors` names it.  The blocks are
    written first: their context is looked for in several branches, and files are parsed once.
    """
    return with_context(dealt(cut_lineage(_scan(files, errors=False)), "doc_id")).withColumn("grid", padded(F.col("grid")))


def notice_file_errors(files: DataFrame) -> DataFrame:
    """``doc_id, error`` for every notice that cannot be read."""
    return _scan(files, errors=True)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hwpx").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every ``*.hwpx`` under a directory; ``doc_id`` is the path."""
    return parse_notices(_files(spark, path))


def read_notice_errors(spark: SparkSession, path: str) -> DataFrame:
    """The notices under a directory that cannot be read."""
    return notice_file_errors(_files(spark, path))
