"""Order-dependent operators that never put a whole group into one task.

Each works in two steps over pieces of a group: a window inside pieces of bounded length,
and a window over one summary row per piece.  A group holding a third of all rows is thus
spread over many tasks.  A piece is ``order div piece`` for an integer ``order``; any other
column that grows with the order (a prefix of a text, say) can be given instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffloom.session import cut_lineage, not_broadcast

PIECE = 65_536
_P = "__piece"


def _pieces(df: DataFrame, order: str, piece: int | Column) -> DataFrame:
    cut = piece if isinstance(piece, Column) else F.floor(F.col(order) / piece)
    return df.withColumn(_P, cut)


def range_pieces(df: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, Column]:
    """Rows laid out in ranges of ``keys`` and ``order`` whose bounds are sampled, and the piece column.

    For orders that have no length to divide by (codes, names): pieces are of about equal size
    however alike the values begin.  The layout is written once, since it must not change.
    """
    laid = df.repartitionByRange(*keys, order).withColumn("__range", F.spark_partition_id())
    return cut_lineage(laid), F.col("__range")


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
                  piece: int | Column = PIECE) -> DataFrame:
    """``out`` = the latest non-null ``value`` at or before the row within ``keys``."""
    cut = _pieces(df, order, piece)
    inside = Window.partitionBy(*keys, _P).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__v", value).withColumn(out, F.last("__v", ignorenulls=True).over(inside))
    heads = local.groupBy(*keys, _P).agg(
        F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__end")
    )
    before = Window.partitionBy(*keys).orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(*keys, _P, F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    return (
        local.join(not_broadcast(carried.filter(F.col("__carry").isNotNull()), unique=True), [*keys, _P], "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("__carry")))
        .drop(_P, "__v", "__carry")
    )


def previous_value(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                   piece: int | Column = PIECE) -> DataFrame:
    """``out`` = ``value`` of the row before within ``keys`` (order values are distinct)."""
    cut = _pieces(df, order, piece)
    inside = Window.partitionBy(*keys, _P).orderBy(order)
    local = cut.withColumn(out, F.lag(value).over(inside)).withColumn(
        "__first", F.lag(F.lit(1)).over(inside).isNull()
    )
    ends = local.groupBy(*keys, _P).agg(F.max_by(value, order).alias("__end"))
    carried = ends.select(
        *keys, _P, F.lag("__end").over(Window.partitionBy(*keys).orderBy(_P)).alias("__carry")
    )
    return (
        local.join(not_broadcast(carried, unique=True), [*keys, _P], "left")
        .withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col(out)))
        .drop(_P, "__first", "__carry")
    )


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
                  piece: int | Column = PIECE) -> DataFrame:
    """``out`` = sum of ``value`` up to and including the row (order values are distinct)."""
    cut = _pieces(df, order, piece)
    inside = Window.partitionBy(*keys, _P).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__v", value).withColumn(out, F.sum("__v").over(inside))
    totals = local.groupBy(*keys, _P).agg(F.sum("__v").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _P, F.sum("__sum").over(before).alias("__offset"))
    return (
        local.join(not_broadcast(offsets, unique=True), [*keys, _P], "left")
        .withColumn(out, F.col(out) + F.coalesce("__offset", F.lit(0)))
        .drop(_P, "__v", "__offset")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, out: str, piece: int | Column = PIECE) -> DataFrame:
    """Number rows 1.. by ``order`` within ``keys``."""
    return running_total(df, keys, order, F.lit(1), out, piece).withColumn(out, F.col(out).cast("bigint"))


#: rows of a bracket that may meet in one row of a result
BRACKET = 1_000_000
_ACCURACY = 10_000
_CUTS = 100


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str, bracket: int = BRACKET) -> DataFrame:
    """Exact median per group, for groups of any size.

    A sketch brackets the middle with a guarantee on ranks, and a second pass counts what lies below
    and how often each value of the bracket occurs; the two middle ranks are then looked up in the row.
    A group whose bracket could hold more than ``bracket`` rows has it narrowed first: a pass over its
    rows tells the rank inside the bracket and a hundred cuts of it, of which the ones around the
    middle stay.  No step orders a group in one task.
    """
    keys = list(keys)
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    around = F.percentile_approx("__x", [0.5 - 2 / _ACCURACY, 0.5 + 2 / _ACCURACY], _ACCURACY)
    # ranks are off by one in _ACCURACY at most, on either side
    found = cut_lineage(values.groupBy(*keys).agg(F.count("*").alias("__n"), around.alias("__b")).select(
        *keys, "__n", F.col("__b")[0].alias("__low"), F.col("__b")[1].alias("__high"), F.ceil(F.col("__n") * 6 / _ACCURACY).alias("__most")))
    x, inside = F.col("__x"), F.col("__x").between(F.col("__low"), F.col("__high"))
    while found.filter(F.col("__most") > bracket).limit(1).count():
        cuts = F.percentile_approx(F.when(inside, x), [n / _CUTS for n in range(_CUTS + 1)], _ACCURACY)
        held = values.join(found.filter(F.col("__most") > bracket), keys).groupBy(*keys, "__n", "__low", "__high", "__most").agg(
            F.count_if(x < F.col("__low")).alias("__below"), F.count_if(inside).alias("__m"), cuts.alias("__c"))
        percent = lambda rank: (rank - F.col("__below")) / F.col("__m") * _CUTS
        low = F.get("__c", F.greatest(F.floor(percent(F.floor((F.col("__n") - 1) / 2) - 1)).cast("int") - 1, F.lit(0)))
        high = F.get("__c", F.least(F.ceil(percent(F.floor(F.col("__n") / 2) + 2)).cast("int") + 1, F.lit(_CUTS)))
        # a bracket that stays as it is holds one value or is cut as far as the sketch can
        same = (low == F.col("__low")) & (high == F.col("__high"))
        most = F.when(same | (low == high), 1).otherwise(F.ceil(F.col("__m") * (5 / _CUTS)))
        narrowed = held.select(*keys, "__n", low.alias("__low"), high.alias("__high"), F.least(most.cast("bigint"), F.col("__most") - 1).alias("__most"))
        found = cut_lineage(found.filter(F.col("__most") <= bracket).unionByName(narrowed))
    counted = values.join(found, keys).filter(x <= F.col("__high")).groupBy(
        *keys, "__n", F.when(inside, x).alias("__x")).agg(F.count("*").alias("__c"))
    runs = counted.groupBy(*keys, "__n").agg(
        F.coalesce(F.sum(F.when(x.isNull(), F.col("__c"))), F.lit(0)).alias("__below"),
        F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("__x", "__c")))).alias("__runs"))

    def at_rank(rank: Column) -> Column:
        def step(state: Column, run: Column) -> Column:
            to = state["to"] + run["__c"]
            hit = (state["to"] <= rank) & (rank < to)
            return F.struct(to.alias("to"), F.when(hit, run["__x"]).otherwise(state["x"]).alias("x"))

        start = F.struct(F.col("__below").alias("to"), F.lit(None).cast("double").alias("x"))
        return F.aggregate("__runs", start, step)["x"]

    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    return runs.select(*keys, ((at_rank(low) + at_rank(high)) / 2).alias(out))


def carry_forward_nested(df: DataFrame, keys: Sequence[str], order: str, outer: Column, inner: Column,
                         outer_out: str, inner_out: str, piece: int | Column = PIECE) -> DataFrame:
    """Running context of two levels: a new outer value clears the inner one."""
    mark = F.when(outer.isNotNull(), F.struct(outer.alias("o"), F.lit(None).cast("string").alias("i"),
                                              F.col(order).alias("at")))
    with_outer = carry_forward(df, keys, order, mark, "__outer", piece)
    note = F.when(inner.isNotNull() & outer.isNull(),
                  F.struct(inner.alias("i"), F.col(order).alias("at")))
    both = carry_forward(with_outer, keys, order, note, "__inner", piece)
    alive = F.col("__inner.at") > F.coalesce(F.col("__outer.at"), F.lit(-1))
    return (
        both.withColumn(outer_out, F.col("__outer.o"))
        .withColumn(inner_out, F.when(alive, F.col("__inner.i")))
        .drop("__outer", "__inner")
    )
