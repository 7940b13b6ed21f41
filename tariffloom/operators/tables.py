"""Checks that look at a whole table: counts, completeness, duplicates, growth.

Group questions are answered by aggregates with partial sums and joined back; no window
spans a whole group, except where keys have few rows each (``later_copies``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.session import cut_lineage, not_broadcast


def row_counts(df: DataFrame, keys: Sequence[str], expected: Column | int, blank: Column | None = None) -> DataFrame:
    """Tables whose number of rows is unexpected; blank rows are tolerated on top.  ``expected``
    may be an aggregate over the rows of the table."""
    spare = F.lit(0) if blank is None else F.count_if(blank)
    wanted = expected if isinstance(expected, Column) else F.lit(expected)
    counted = df.groupBy(*keys).agg((wanted + spare).cast("bigint").alias("expected"), F.count("*").alias("actual"))
    return counted.filter(F.col("expected") != F.col("actual"))


def category_gaps(df: DataFrame, keys: Sequence[str], category: Column, wanted: Sequence[str]) -> DataFrame:
    """Groups that lack some of the wanted categories, with the absent ones in wanted order."""
    all_of = F.array(*map(F.lit, wanted))
    seen = F.collect_set(F.when(category.isin(*wanted), category))  # at most len(wanted) values
    return df.groupBy(*keys).agg(F.array_except(all_of, seen).alias("absent")).filter(F.size("absent") > 0)


def count_gaps(df: DataFrame, keys: Sequence[str], category: str, expected: dict[str, int]) -> DataFrame:
    """Per group, categories whose number of rows differs from the expected map."""
    spec = F.array(*[F.struct(F.lit(c).alias(category), F.lit(n).cast("bigint").alias("expected"))
                     for c, n in expected.items()])
    want = df.select(*keys).distinct().select(*keys, F.inline(spec))
    have = df.groupBy(*keys, category).agg(F.count("*").alias("actual"))
    return want.join(have, [*keys, category], "full_outer").filter(
        ~F.col("expected").eqNullSafe(F.col("actual"))
    )


def later_duplicates(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows whose key occurred before, with ``first_row``, the order of the first occurrence.

    Hashes that occur twice are counted first, so only rows of likely duplicates move with their keys;
    what is kept of them is decided by the keys themselves.
    """
    hashed = df.withColumn("__h", F.xxhash64(*keys))
    repeated = cut_lineage(hashed.groupBy("__h").agg(F.count("*").alias("__n")).filter(F.col("__n") > 1).select("__h"))
    df = hashed.join(repeated, "__h", "left_semi").drop("__h")
    firsts = df.groupBy(*keys).agg(F.min(order).alias("first_row"), F.count("*").alias("__n")).filter(
        F.col("__n") > 1
    ).drop("__n")
    return df.join(not_broadcast(firsts, unique=True), list(keys)).filter(F.col(order) > F.col("first_row"))


def later_copies(df: DataFrame, keys: Sequence[str], order: str, hashed: bool = False) -> DataFrame:
    """:func:`later_duplicates` for keys of few rows each, such as the codes of a document.

    Rows are compared with their neighbours: they move once by their keys, or not at all if they are dealt out by some of
    them, and nothing is joined or written.  ``hashed`` sorts them by a hash first, as the keys of a long table begin alike.
    """
    first = ["__h"] if hashed else []
    same = Window.partitionBy(*first, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.dropna(subset=list(keys)).withColumns({n: F.xxhash64(*keys) for n in first})
    return df.withColumn("first_row", F.min(order).over(same)).filter(F.col(order) > F.col("first_row")).drop(*first)


def duplicate_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of a key that occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1).drop("__n")
    return df.join(not_broadcast(repeated, unique=True), list(keys), "left_semi")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``: an aggregate, so duplicates vanish before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def growth(current: DataFrame, prior: DataFrame, keys: Sequence[str], columns: Sequence[str],
           order: str) -> DataFrame:
    """Change in percent against the prior period by key; ``is_new`` marks keys without one.
    Of duplicate prior keys the last row counts."""
    from tariffloom.functions.numbers import growth_percent

    before = last_rows(prior.select(*keys, order, *columns), keys, [order]).select(
        *keys, F.lit(True).alias("__had"), *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    joined = current.join(not_broadcast(before, unique=True), list(keys), "left")
    return joined.withColumns({
        **{f"growth_{c}": growth_percent(F.col(f"prev_{c}"), F.col(c)) for c in columns},
        "is_new": F.col("__had").isNull(),
    }).drop("__had")


def growth_text(columns: dict[str, Column], is_new: Column) -> Column:
    """Growth line of a row; ``columns`` maps display names to growth columns."""
    parts = [F.concat(F.lit(name + " "), F.coalesce(F.concat(F.format_string("%+.2f", g), F.lit("%")), F.lit("-")))
             for name, g in columns.items()]
    known = F.concat(F.lit("증가율(비교단가): "), F.concat_ws(" · ", *parts))
    return F.when(is_new, "증가율: 작년 단가표에 없던 항목").otherwise(known)


def integrity_problems(basic: DataFrame, keys: Sequence[str] = ("doc_id", "등급구분")) -> DataFrame:
    """Basic-table integrity: unique codes, support = parts, support above zero."""
    total, parts = F.col("지원량"), F.col("정부지원금") + F.col("본인부담금")
    codes = duplicate_members(basic, keys).withColumn("code", F.lit("DUP_CODE"))
    rows = basic.withColumn("code", F.explode(F.array_compact(F.array(
        F.when(total != parts, "IDENTITY"), F.when(total <= 0, "NOT_POSITIVE")))))
    return codes.unionByName(rows)


def issue_texts(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings per cell: how many, and their reasons in order."""
    entry = F.array_sort(F.collect_list(F.struct("ord", "reason")))
    return issues.filter(F.col("column").isNotNull()).groupBy(*keys, "column").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(entry, lambda e: e["reason"]), " / ").alias("reasons"),
    )


def first_issues(issues: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 8) -> DataFrame:
    """The first ``n`` findings per table and how many more there are."""
    ranked = issues.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    top = ranked.filter(F.col("rank") <= n)  # planned as a per-task group limit
    totals = issues.groupBy(*keys).agg(F.count("*").alias("total"))
    return top.join(totals, list(keys)).withColumn("remaining", F.greatest(F.col("total") - n, F.lit(0)))


def tier_messages(gaps: DataFrame) -> DataFrame:
    """Message of groups that lack income tiers."""
    label = F.concat("base", F.when(F.col("variant") == "기본형", "").otherwise("_주간확장"))
    names = F.array_join(F.transform("absent", lambda t: F.concat(t, F.lit("형"))), ", ")
    return gaps.withColumn("reason", F.concat(F.lit("'"), label, F.lit("' 그룹에 소득형이 빠짐: "), names))


EXPECTED_BASIC_ROWS = (4 + 15 + 60) * len(fixed.LETTERS) * 2 + 2
EXPECTED_ADD_ROWS = len(fixed.ADD_CODES) * len(fixed.LETTERS)
