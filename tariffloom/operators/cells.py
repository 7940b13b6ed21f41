"""Operators on cell grids in long form.

``cells``: ``doc_id, sheet, row, col, vtype ('str'|'num'|'bool'), sval, nval, formula``; one row
per non-empty cell, 0-based.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.literals import literal_rows
from tariffloom.functions.text import is_blank, removed_codepoints, sanitize, squeeze
from tariffloom.session import not_broadcast

SHEET = ("doc_id", "sheet")
CELL = ("doc_id", "sheet", "row", "col")
CELL_SCHEMA = ("doc_id string, sheet string, row int, col int, vtype string, sval string, nval double, "
               "formula string")


def filled(cells: DataFrame) -> DataFrame:
    """Cells that hold something: any number or flag, and texts that are not blank."""
    return cells.filter((F.col("vtype") != "str") | ~is_blank(F.col("sval")))


def used_range(cells: DataFrame) -> DataFrame:
    """Used rectangle per sheet: the last valued row and column cap what must be read."""
    return cells.groupBy(*SHEET).agg(
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"),
        F.max("col").alias("col1"), F.count("*").alias("n_cells"))


def missing_sheets(docs: DataFrame, cells: DataFrame, required: Sequence[str] = fixed.SHEETS) -> DataFrame:
    """Required sheets a document lacks."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, required))).alias("sheet"))
    return wanted.join(not_broadcast(cells.select(*SHEET).distinct()), list(SHEET), "left_anti")


def sanitized(cells: DataFrame) -> DataFrame:
    """Cells with clean texts; ``original`` keeps what was read."""
    clean = F.when(F.col("vtype") == "str", sanitize(F.col("sval"))).otherwise(F.col("sval"))
    return cells.withColumn("original", F.col("sval")).withColumn("sval", clean)


def sanitize_audit(clean_cells: DataFrame) -> DataFrame:
    """Changed cells with the characters they lost."""
    return clean_cells.filter((F.col("vtype") == "str") & (F.col("original") != F.col("sval"))).select(
        *CELL, "original", F.col("sval").alias("cleaned"),
        removed_codepoints(F.col("original"), F.col("sval")).alias("removed"))


def with_search_text(cells: DataFrame) -> DataFrame:
    """Adds ``squeezed``, the whitespace-free text used for finding anchors."""
    return cells.withColumn("squeezed", squeeze(sanitize(F.col("sval"))))


def find_texts(df: DataFrame, text: Column, anchors: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows times the anchors their text contains, as ``anchor``.

    ``anchors`` are (name, search text) pairs known to the program, so the theta join is a
    filter over a constant array in the row: no shuffle and no nested-loop join.
    """
    spec = literal_rows(list(anchors), "name string, find string")
    hits = F.filter(spec, lambda a: F.contains(text, a["find"]))
    return df.withColumn("__hits", hits).filter(F.size("__hits") > 0).withColumn(
        "__hit", F.explode("__hits")).withColumn("anchor", F.col("__hit.name")).drop("__hits", "__hit")


def anchor_sheet_counts(cells: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """How often each anchor occurs per sheet."""
    texts = cells.filter(F.col("vtype") == "str")
    found = find_texts(texts, F.col("sval"), [(a, a) for a in anchors])
    return found.groupBy("doc_id", "anchor", "sheet").agg(F.count("*").alias("n"))


def anchor_scan(cells: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """How often each anchor occurs per document and how risky it is to rely on; anchors that
    never occur are reported too."""
    totals = anchor_sheet_counts(cells, anchors).groupBy("doc_id", "anchor").agg(
        F.sum("n").alias("total"), F.count("*").alias("n_sheets"))
    everyone = cells.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, anchors))).alias("anchor"))
    total, sheets = F.coalesce("total", F.lit(0)), F.coalesce("n_sheets", F.lit(0))
    return everyone.join(not_broadcast(totals), ["doc_id", "anchor"], "left").select(
        "doc_id", "anchor", total.alias("total"), sheets.alias("n_sheets"),
        F.when((total > 1) | (sheets > 1), "risky").when(total == 1, "safe").otherwise("absent").alias("risk"))


def at_offsets(anchored: DataFrame, cells: DataFrame, offsets: Sequence[tuple[str, int, int]],
               how: str = "inner") -> DataFrame:
    """The cells at (row + dr, col + dc) of anchored cells; ``offsets`` are (key, dr, dc)."""
    spec = literal_rows(list(offsets), "key string, dr int, dc int")
    wanted = anchored.select("*", F.explode(spec).alias("__o")).select(
        *anchored.columns, F.col("__o.key").alias("key"), (F.col("row") + F.col("__o.dr")).alias("at_row"),
        (F.col("col") + F.col("__o.dc")).alias("at_col"))
    values = cells.select("doc_id", "sheet", F.col("row").alias("at_row"), F.col("col").alias("at_col"),
                          F.col("vtype").alias("at_vtype"), F.col("sval").alias("at_sval"),
                          F.col("nval").alias("at_nval"))
    return wanted.join(not_broadcast(values), ["doc_id", "sheet", "at_row", "at_col"], how)


def context_window(marks: DataFrame, cells: DataFrame, reach: int = 3) -> DataFrame:
    """The cells around marked cells, ``reach`` in each direction, clamped to the sheet.

    The range condition becomes an equi join: every mark names its (2*reach+1)^2 positions, so
    the join hashes on cells and no sheet becomes one group.
    """
    around = F.sequence(F.lit(-reach), F.lit(reach))
    places = marks.select(*CELL).select(
        "doc_id", "sheet", F.col("row").alias("mark_row"), F.col("col").alias("mark_col"), F.explode(around).alias("dr")
    ).select("*", F.explode(around).alias("dc")).select(
        "doc_id", "sheet", "mark_row", "mark_col", (F.col("mark_row") + F.col("dr")).alias("row"),
        (F.col("mark_col") + F.col("dc")).alias("col")).filter((F.col("row") >= 0) & (F.col("col") >= 0))
    return places.join(not_broadcast(cells), list(CELL))


def promote_header(cells: DataFrame, columns: Mapping[str, str], header_row: int = 0) -> DataFrame:
    """A sheet with a header row as a table: one row per grid row, ``columns`` maps header texts
    to ``string``, ``double`` or ``bigint``."""
    heads = cells.filter((F.col("row") == header_row) & (F.col("vtype") == "str")).select(
        *SHEET, "col", F.btrim("sval").alias("__name")).filter(F.col("__name").isin(*columns))
    body = cells.filter(F.col("row") > header_row).join(not_broadcast(heads), [*SHEET, "col"])

    def cell(name: str, kind: str) -> Column:
        here = F.col("__name") == name
        if kind == "string":
            return F.max(F.when(here, F.coalesce("sval", F.col("nval").cast("string")))).alias(name)
        number = F.coalesce("nval", F.regexp_replace("sval", ",", "").try_cast("double"))
        return F.max(F.when(here, number)).cast(kind).alias(name)

    return body.groupBy(*SHEET, "row").agg(*[cell(n, k) for n, k in columns.items()])


def patch_cells(cells: DataFrame, cell_map: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write changed values back to their cells.

    ``cell_map``: doc_id, key, sheet, row, col.  ``changes``: doc_id, key, value (double).
    Mirrored keys (``key@sheet``) of the sync keys follow unless changed themselves.  Returns the
    patched cells and the skipped changes with a reason.
    """
    origin = F.split_part(F.col("key"), F.lit("@"), F.lit(1))
    mirrors = cell_map.filter(F.contains(F.col("key"), F.lit("@")) & origin.isin(*fixed.SYNC_KEYS)).select(
        "doc_id", origin.alias("origin"), "key")
    followed = (
        changes.withColumnRenamed("key", "origin").join(not_broadcast(mirrors), ["doc_id", "origin"]).select("doc_id", "key", "value")
        .join(not_broadcast(changes.select("doc_id", "key")), ["doc_id", "key"], "left_anti")
    )
    placed = changes.select("doc_id", "key", "value").unionByName(followed).join(
        not_broadcast(cell_map.select("doc_id", "key", "sheet", "row", "col")), ["doc_id", "key"], "left")
    sheets = cells.select(*SHEET).distinct().withColumn("__sheet", F.lit(True))
    placed = placed.join(not_broadcast(sheets), list(SHEET), "left").join(
        not_broadcast(cells.select(*CELL, F.col("formula").alias("__formula"))), list(CELL), "left")
    reason = (
        F.when(F.col("sheet").isNull(), "조견표 내 위치가 기록되지 않음")
        .when(F.col("__sheet").isNull(), F.concat(F.lit("시트를 찾을 수 없음: "), "sheet"))
        .when(F.col("__formula").isNotNull(), "수식으로 계산되는 셀이기에 직접 수정 불가")
    )
    judged = placed.withColumn("reason", reason)
    new = judged.filter(F.col("reason").isNull()).select(*CELL, F.col("value").alias("__new"))
    merged = cells.join(not_broadcast(new), list(CELL), "full_outer")
    hit = F.col("__new").isNotNull()
    patched = merged.withColumns({
        "vtype": F.when(hit, "num").otherwise(F.col("vtype")),
        "sval": F.when(~hit, F.col("sval")),
        "nval": F.coalesce("__new", "nval"),
    }).drop("__new")
    return patched, judged.filter(F.col("reason").isNotNull()).select("doc_id", "key", "reason")
