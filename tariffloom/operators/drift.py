"""Value drift between two years of a table: broken order and shifted units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.operators.ordered import exact_median, previous_value
from tariffloom.operators.segment import REGION, comparable_tables

COLUMN = (*REGION, "c")


def numeric_columns(tagged: DataFrame) -> DataFrame:
    """Numbers of table columns with their column ``c`` counted from the table's left edge."""
    return tagged.filter(F.col("vtype") == "num").select(
        *REGION, (F.col("col") - F.col("col0")).alias("c"), "row", F.col("nval").alias("v"))


def directions(values: DataFrame, keys, order: str, value: str) -> DataFrame:
    """Strict direction of a value sequence: -1 falling, 1 rising, 0 neither; with its length."""
    stepped = previous_value(values, keys, order, value, "__prev")
    step = lambda test: F.bool_and(F.coalesce(test, F.lit(True)))
    return stepped.groupBy(*keys).agg(
        F.when(step(F.col("__prev") > F.col(value)), -1).when(step(F.col("__prev") < F.col(value)), 1)
        .otherwise(0).alias("direction"), F.count("*").alias("n"))


def column_stats(tagged: DataFrame) -> DataFrame:
    """Direction, length, exact median and header of every numeric table column."""
    values = numeric_columns(tagged)
    stats = directions(values, list(COLUMN), "row", "v").join(
        exact_median(values, list(COLUMN), "v", "median"), list(COLUMN))
    heads = tagged.filter((F.col("row") == F.col("row0")) & (F.col("vtype") == "str")).select(
        *REGION, (F.col("col") - F.col("col0")).alias("c"), F.btrim("sval").alias("header"))
    return stats.join(heads, list(COLUMN), "left")


def value_anomalies(pairs: DataFrame, stats: DataFrame, regions: DataFrame) -> DataFrame:
    """Columns whose order broke or whose unit seems changed against last year."""
    stable = comparable_tables(pairs, regions.select(*REGION)).select("pair_id", "sheet", "table_idx").distinct()
    side = lambda name, s: pairs.select("pair_id", F.col(f"{name}_doc").alias("doc_id")).join(
        stats, "doc_id").select("pair_id", "sheet", "table_idx", "c", *[
            F.col(n).alias(n + s) for n in ("direction", "n", "median", "header")])
    both = side("base", "_b").join(side("target", "_t"), ["pair_id", "sheet", "table_idx", "c"]).join(
        stable, ["pair_id", "sheet", "table_idx"], "left_semi").filter("n_b >= 3 and n_t >= 3")
    ratio = F.coalesce(F.col("median_t") / F.nullif("median_b", F.lit(0.0)), F.lit(0.0))
    name = F.coalesce(F.nullif("header_t", F.lit("")), F.concat((F.col("c") + 1).cast("string"), F.lit("번째 열")))
    broken = (F.col("direction_b") != 0) & (F.col("direction_b") != F.col("direction_t"))
    shifted = (ratio != 0) & ((ratio > fixed.UNIT_SHIFT) | (ratio < 1 / fixed.UNIT_SHIFT))
    found = F.array_compact(F.array(
        F.when(broken, F.struct(F.lit("MONOTONICITY_BROKEN").alias("code"), F.concat(
            F.lit("'"), name, F.lit("' 열은 작년에 계속 "), F.when(F.col("direction_b") < 0, "감소").otherwise("증가"),
            F.lit("했는데 올해는 그렇지 않습니다. 행 순서나 값 배치가 바뀌었을 수 있습니다.")).alias("detail"))),
        F.when(shifted, F.struct(F.lit("UNIT_SHIFT_SUSPECTED").alias("code"), F.concat(
            F.lit("'"), name, F.lit("' 열 값이 작년의 "), F.format_string("%.0f", ratio),
            F.lit("배입니다. 단위가 바뀌었을 수 있습니다(예: 시간 → 분).")).alias("detail"))),
    ))
    return both.select("pair_id", "sheet", "table_idx", "c", F.inline(found))
