"""Tables inside sheets: segmentation by blank lines, fingerprints and structure alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.numbers import looks_numeric
from tariffloom.functions.text import is_blank, normalize_label
from tariffloom.operators.cells import SHEET, filled, find_texts
from tariffloom.operators.ordered import PIECE, row_numbers
from tariffloom.session import cut_lineage

REGION = ("doc_id", "sheet", "table_idx")
MIN_CELLS = 2


def segment(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(regions, tagged)``: tables of every sheet, and the filled cells with ``table_idx``.

    Rows split first, columns inside row blocks second.  In a sorted list of distinct
    positions ``position - rank`` is constant within a run, so it names the block and grows
    from block to block.  The tagged cells are checkpointed: every later step reads them.
    """
    full = filled(cells)
    rows = row_numbers(full.select(*SHEET, "row").distinct(), list(SHEET), "row", "__rn")
    rows = rows.select(*SHEET, "row", (F.col("row") - F.col("__rn")).alias("__rb"))
    in_rows = full.join(rows, [*SHEET, "row"])
    # a sheet has at most 16,384 columns, so a row block's distinct columns fit one window
    across = Window.partitionBy(*SHEET, "__rb").orderBy("col")
    cols = in_rows.select(*SHEET, "__rb", "col").distinct().withColumn(
        "__cb", F.col("col") - F.row_number().over(across))
    boxed = in_rows.join(cols, [*SHEET, "__rb", "col"])
    boxes = boxed.groupBy(*SHEET, "__rb", "__cb").agg(
        F.min("row").alias("row0"), F.min("col").alias("col0"), F.max("row").alias("row1"),
        F.max("col").alias("col1"), F.count("*").alias("n_filled"),
    ).filter(F.col("n_filled") >= MIN_CELLS).withColumn("__at", F.struct("__rb", "__cb"))
    numbered = row_numbers(boxes, list(SHEET), "__at", "__n", F.floor(F.col("__rb") / PIECE)).withColumn(
        "table_idx", (F.col("__n") - 1).cast("int"))
    box = ("row0", "col0", "row1", "col1")
    tagged = cut_lineage(boxed.join(
        numbered.select(*SHEET, "__rb", "__cb", "table_idx", *box), [*SHEET, "__rb", "__cb"]).drop("__rb", "__cb"))
    regions = tagged.groupBy(*REGION, *box).agg(F.count("*").alias("n_filled")).select(
        *REGION, F.concat("sheet", F.lit("#"), (F.col("table_idx") + 1).cast("string")).alias("table_id"), *box, "n_filled")
    return regions, tagged


def is_numeric_cell() -> Column:
    return (F.col("vtype") != "str") | looks_numeric(F.col("sval"))


def column_profiles(tagged: DataFrame) -> DataFrame:
    """Kind of every column of a table by its share of numbers: num, text or mixed."""
    share = F.avg(is_numeric_cell().cast("double"))
    return tagged.groupBy(*REGION, (F.col("col") - F.col("col0")).alias("c")).agg(
        F.when(share > 0.8, "num").when(share < 0.2, "text").otherwise("mixed").alias("kind"))


def fingerprints(regions: DataFrame, tagged: DataFrame) -> DataFrame:
    """Shape, header sequence and column kinds of every table (arrays bounded by its width)."""
    kinds = column_profiles(tagged).groupBy(*REGION).agg(
        F.map_from_entries(F.collect_list(F.struct("c", "kind"))).alias("__kinds"))
    first = tagged.filter((F.col("row") == F.col("row0")) & (F.col("vtype") == "str")).select(
        *REGION, "col", normalize_label(F.col("sval")).alias("norm"))
    heads = first.groupBy(*REGION).agg(F.array_sort(F.collect_list(F.struct("col", "norm"))).alias("__heads"))
    width = F.col("col1") - F.col("col0") + 1
    joined = regions.join(kinds, list(REGION), "left").join(heads, list(REGION), "left")
    return joined.select(
        *REGION, "table_id", (F.col("row1") - F.col("row0") + 1).alias("n_rows"), width.alias("n_cols"),
        F.coalesce(F.transform("__heads", lambda h: h["norm"]), F.array().cast("array<string>")).alias("headers"),
        F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.coalesce(F.col("__kinds")[c], F.lit("empty"))).alias("kinds"))


def _sides(pairs: DataFrame, df: DataFrame, side: str, rename: str) -> DataFrame:
    """``df`` of a pair's side keyed by ``pair_id``; other columns get a suffix."""
    keyed = pairs.select("pair_id", F.col(f"{side}_doc").alias("doc_id")).join(df, "doc_id").drop("doc_id")
    return keyed.select(*[F.col(c) if c in ("pair_id", "sheet", "table_idx") else F.col(c).alias(c + rename)
                          for c in keyed.columns])


def comparable_tables(pairs: DataFrame, per_table: DataFrame) -> DataFrame:
    """Tables of both sides by position, for sheets that kept their number of tables."""
    base, target = _sides(pairs, per_table, "base", "_b"), _sides(pairs, per_table, "target", "_t")
    n = lambda df, name: df.groupBy("pair_id", "sheet").agg(F.count_distinct("table_idx").alias(name))
    stable = n(base, "n_b").join(n(target, "n_t"), ["pair_id", "sheet"]).filter("n_b = n_t").drop("n_b", "n_t")
    return base.join(target, ["pair_id", "sheet", "table_idx"]).join(stable, ["pair_id", "sheet"], "left_semi")


KIND_NAMES = {"num": "숫자", "text": "문자", "mixed": "혼합", "empty": "빈칸"}


def fingerprint_diffs(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """What changed between last year's and this year's form of a table."""
    both = comparable_tables(pairs, prints)
    korean = F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv])
    num = lambda c: F.col(c).cast("string")
    shape = F.when((F.col("n_rows_b") != F.col("n_rows_t")) | (F.col("n_cols_b") != F.col("n_cols_t")), F.struct(
        F.lit("TABLE_SHAPE_CHANGED").alias("code"),
        F.concat(F.lit("표 크기 "), num("n_rows_b"), F.lit("행 "), num("n_cols_b"), F.lit("열 → "),
                 num("n_rows_t"), F.lit("행 "), num("n_cols_t"), F.lit("열")).alias("detail")))
    reordered = F.array_sort("headers_b") == F.array_sort("headers_t")
    heads = F.when(F.col("headers_b") != F.col("headers_t"), F.struct(
        F.when(reordered, "HEADER_ORDER_CHANGED").otherwise("TABLE_SHAPE_CHANGED").alias("code"),
        F.when(reordered, F.concat(F.lit("머리글 순서 바뀜: "), F.array_join("headers_b", " · "), F.lit(" → "),
                                   F.array_join("headers_t", " · ")))
        .otherwise("머리글 구성이 달라짐").alias("detail")))
    zipped = F.arrays_zip(F.col("kinds_b").alias("b"), F.col("kinds_t").alias("t"))
    changed = F.filter(
        F.transform(F.slice(zipped, F.lit(1), F.least("n_cols_b", "n_cols_t")), lambda z, i: F.when(
            z["b"] != z["t"], F.concat((i + 1).cast("string"), F.lit("번째 "), korean[z["b"]], F.lit("→"), korean[z["t"]]))),
        lambda x: x.isNotNull())
    n = F.size(changed)
    same_width = F.col("n_cols_b") == F.col("n_cols_t")
    kinds_detail = F.when(~same_width, F.concat(
        F.lit("열이 "), num("n_cols_b"), F.lit("개에서 "), num("n_cols_t"), F.lit("개로, "),
        F.when(n > 0, F.array_join(F.slice(changed, 1, 2), ", ")).otherwise("내용 종류도 달라짐"))).otherwise(F.concat(
            F.lit("열 내용 종류 바뀜: "), F.array_join(F.slice(changed, 1, 3), ", "),
            F.when(n > 3, F.concat(F.lit(" 외 "), (n - 3).cast("string"), F.lit("개 열"))).otherwise("")))
    kinds = F.when(F.col("kinds_b") != F.col("kinds_t"),
                   F.struct(F.lit("TABLE_SHAPE_CHANGED").alias("code"), kinds_detail.alias("detail")))
    found = F.filter(F.array(shape, heads, kinds), lambda x: x.isNotNull())
    return both.select("pair_id", "sheet", F.col("table_id_t").alias("table_id"), F.inline(found)).withColumn(
        "fatal", F.lit(False))


def sheet_alerts(pairs: DataFrame, cells: DataFrame, regions: DataFrame,
                 required: Sequence[str] = fixed.SHEETS) -> DataFrame:
    """Sheets added, removed or missing, and sheets whose number of tables changed."""
    counts = cells.select(*SHEET).distinct().join(
        regions.groupBy(*SHEET).agg(F.count("*").alias("n")), list(SHEET), "left").fillna(0, ["n"])
    base, target = _sides(pairs, counts, "base", "_b"), _sides(pairs, counts, "target", "_t")
    joined = base.join(target, ["pair_id", "sheet"], "full_outer")
    need = F.col("sheet").isin(*required)
    code = (
        F.when(F.col("n_b").isNull(), "SHEET_ADDED")
        .when(F.col("n_t").isNull() & need, "SHEET_MISSING")
        .when(F.col("n_t").isNull(), "SHEET_REMOVED")
        .when(F.col("n_b") != F.col("n_t"), "TABLE_COUNT_CHANGED")
    )
    detail = (
        F.when(F.col("n_b").isNull(), "작년에 없던 시트입니다.")
        .when(F.col("n_t").isNull() & need, "값을 읽어야 하는 시트인데 올해 파일에 없습니다.")
        .when(F.col("n_t").isNull(), "작년 파일에만 있던 시트 (값 추출에 쓰지 않음)")
        .otherwise(F.concat(F.lit("표가 "), F.col("n_b").cast("string"), F.lit("개에서 "), F.col("n_t").cast("string"),
                            F.lit("개로 늘거나 줄어, 이 시트는 값 비교를 건너뜁니다.")))
    )
    return joined.select("pair_id", "sheet", F.lit(None).cast("string").alias("table_id"), code.alias("code"),
                         detail.alias("detail"), F.coalesce(code == "SHEET_MISSING", F.lit(False)).alias("fatal")
                         ).filter(F.col("code").isNotNull())


def repeated_anchors(text_cells: DataFrame, anchors: Sequence[str] = fixed.SCALAR_ANCHORS) -> DataFrame:
    """Anchors that occur in several rows of one table, so no row can be chosen (fatal).

    ``text_cells`` carry ``norm``; several hits in one row are fine.
    """
    keys = [(a, "".join(a.split())) for a in anchors]
    hits = find_texts(text_cells, F.col("norm"), keys)
    per = hits.groupBy(*REGION, "anchor").agg(F.count_distinct("row").alias("n_rows"))
    return per.filter(F.col("n_rows") > 1).withColumn("detail", F.concat(
        F.lit("'"), "anchor", F.lit("' 를 포함한 셀이 서로 다른 "), F.col("n_rows").cast("string"),
        F.lit("개 행에 있습니다. 어느 행에서 값을 읽을지 결정할 수 없어 값 추출이 실패합니다.")))


def text_cells(tagged: DataFrame) -> DataFrame:
    """Cells that can be labels: texts neither blank nor numeric, trimmed as ``text``."""
    text = F.regexp_replace("sval", r"(?U)^\s+|\s+$", "")
    return tagged.filter((F.col("vtype") == "str") & ~is_blank(F.col("sval")) & ~looks_numeric(F.col("sval"))).withColumn(
        "text", text)
