"""Edits of table cells and rows, and confirmed label decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffloom.operators.ordered import PIECE, row_numbers

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def coerced(value: Column, dtype: T.DataType) -> Column:
    """Edited text as the column's type: numbers lose separators and whole columns fractions;
    null where it cannot be read (such an edit is rejected)."""
    if isinstance(dtype, T.StringType):
        return F.nullif(F.btrim(value), F.lit(""))
    number = F.btrim(F.regexp_replace(value, ",", "")).try_cast("double")
    if isinstance(dtype, WHOLE):
        return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast(dtype)
    return number.cast(dtype)


def apply_edits(df: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest valid edit per cell over the table.

    ``edits``: key columns, ``column``, ``value`` (text), ``seq``.  Edits are folded to one row
    per table row first, so the table joins once.
    """
    names = [c for c in df.columns if c not in keys]
    latest = edits.groupBy(*keys).agg(*[
        F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(f"__{n}")
        for n in names
        for value in [F.when(F.col("column") == n, coerced(F.col("value"), df.schema[n].dataType))]])
    joined = df.join(latest, list(keys), "left")
    return joined.select(*keys, *[F.coalesce(F.col(f"__{n}"), F.col(f"`{n}`")).alias(n) for n in names])


def latest_edits(edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last value per cell."""
    return edits.groupBy(*keys, "column").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def apply_row_edits(df: DataFrame, table_keys: Sequence[str], deleted: DataFrame, inserted: DataFrame) -> DataFrame:
    """Delete rows and insert new ones before given positions, then number the rows anew.

    ``deleted``: table keys and ``row_id``.  ``inserted``: the table's columns, with ``row_id``
    the position to insert before and ``seq`` ordering inserts at one place.
    """
    kept = df.join(deleted, [*table_keys, "row_id"], "left_anti").withColumns(
        {"__own": F.lit(1), "__seq": F.lit(0).cast("bigint")})
    added = inserted.withColumn("__own", F.lit(0)).withColumn("__seq", F.col("seq").cast("bigint")).drop("seq")
    both = kept.unionByName(added).withColumn("__at", F.struct("row_id", "__own", "__seq"))
    numbered = row_numbers(both, list(table_keys), "__at", "__n", F.floor(F.col("row_id") / PIECE))
    return numbered.withColumn("row_id", F.col("__n") - 1).select(*df.columns)


def resolved_labels(decisions: DataFrame) -> DataFrame:
    """Chosen label per item: the selected candidate or the manual text; the latest decision
    wins and empty choices are left out.

    Decisions are ordered by their time; those without a readable time come first, in the order of
    their text, so that an item with no other decision keeps one.
    """
    chosen = F.coalesce(F.nullif("selected_label", F.lit("")), F.nullif("manual_input", F.lit("")))
    last = decisions.groupBy("run_id", "item_id").agg(
        F.max_by(F.struct("input_label", chosen.alias("chosen")), F.struct(F.try_to_timestamp("reviewed_at"), "reviewed_at")).alias("d"))
    return last.select("run_id", "item_id", "d.*").filter(F.col("chosen").isNotNull())
