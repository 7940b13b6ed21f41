"""Collecting labels from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.text import normalize_label
from tariffloom.operators.cells import SHEET
from tariffloom.operators.segment import text_cells

# Row-major position of a cell as one number, with room beyond the spreadsheet format (2^20 rows,
# 2^14 columns): 2^24 rows, 2^18 columns, 2^21 tables of a sheet.
def position(table_idx, row, col):
    return (table_idx.cast("bigint") * (1 << 24) + row) * (1 << 18) + col


def label_cells(tagged: DataFrame) -> DataFrame:
    """Text cells with their canonical form ``norm`` and reading position ``pos``; value words
    and labels that normalise to nothing are left out."""
    found = text_cells(tagged).withColumn("norm", normalize_label(F.col("text")))
    return found.filter((F.col("norm") != "") & ~F.col("text").isin(*fixed.IGNORED_LABELS)).withColumn(
        "pos", position(F.col("table_idx"), F.col("row"), F.col("col")))


def collect_labels(found: DataFrame) -> DataFrame:
    """One label per sheet and canonical form: the first cell in reading order speaks for it."""
    return found.groupBy(*SHEET, "norm").agg(
        F.min_by(F.struct(F.col("text").alias("raw"), "pos", "table_idx", "row", "col"), "pos").alias("__l")
    ).select(*SHEET, "norm", "__l.*")


def collisions(found: DataFrame) -> DataFrame:
    """Different raw labels that share a canonical form, in long form."""
    spellings = found.select(*SHEET, "norm", F.col("text").alias("raw")).distinct()
    shared = spellings.groupBy(*SHEET, "norm").agg(F.count("*").alias("n_raw")).filter(F.col("n_raw") > 1)
    return spellings.join(shared, [*SHEET, "norm"])
