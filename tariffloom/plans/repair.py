"""Repairing tables to a fixpoint of their checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.operators.checks import Check, explode_findings
from tariffloom.session import cut_lineage

#: rounds after which a row that still changes is given up
ROUNDS = 100


def repair(df: DataFrame, prepare: Callable[[DataFrame], DataFrame], checks: Sequence[Check], editable: Sequence[str],
           rounds: int = ROUNDS, unfinished: str = "unfinished") -> DataFrame:
    """Apply the first expected value per cell and check again, until nothing changes.

    ``prepare`` adds what the checks need (references, recomputed values) and must keep the
    columns of ``df``.  Checks look at one row only, so rows without a fixable finding are done:
    each round handles just the rows the last one changed.  A round prepares its rows once: the
    fixes are written with the rows, and both outcomes are read from there.

    ``unfinished`` is a boolean column that tells rows that never come to rest: those that a fix
    brings back to an earlier state, and those that still change after ``rounds`` rounds.
    """
    columns, types = df.columns, {f.name: f.dataType for f in df.schema}
    state = F.xxhash64(*[F.col(f"`{c}`") for c in editable])
    done, active = None, df.withColumn("__seen", F.array().cast("array<bigint>"))
    for _ in range(rounds):
        fixes = [F.coalesce(F.lit(None).cast("double"), *[F.when(k.test, k.expected) for k in checks if k.column == c]).cast(types[c]).alias(c)
                 for c in editable]
        seen = active.select(*[F.col(f"`{c}`") for c in columns], "__seen")
        judged = cut_lineage(prepare(seen).select(*[F.col(f"`{c}`") for c in columns], "__seen", F.struct(*fixes).alias("__fix")))
        changes = reduce(lambda a, b: a | b, [F.col(f"__fix.`{c}`").isNotNull() & ~F.col(f"__fix.`{c}`").eqNullSafe(F.col(f"`{c}`")) for c in editable])
        circling = F.array_contains("__seen", state)
        still = judged.filter(~changes | circling).select(*columns, (changes & circling).alias(unfinished))
        done = still if done is None else done.unionByName(still)
        active = judged.filter(changes & ~circling).select(*[
            F.coalesce(F.col(f"__fix.`{c}`"), F.col(f"`{c}`")).alias(c) if c in editable else F.col(f"`{c}`") for c in columns],
            F.array_append("__seen", state).alias("__seen"))
        if active.isEmpty():
            return done
    return done.unionByName(active.drop("__seen").withColumn(unfinished, F.lit(True)))


def repair_tables(df: DataFrame, keys: Sequence[str], prepare: Callable[[DataFrame], DataFrame], checks: Sequence[Check],
                  editable: Sequence[str], table_fixes: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS,
                  unfinished: str = "unfinished") -> DataFrame:
    """:func:`repair` together with fixes that follow from whole tables.

    ``table_fixes`` looks at all rows and returns ``keys``, ``column`` (one of ``editable``) and
    ``expected`` (a number) of cells to change, as duplicate codes or counters ask for.  When the rows
    are at rest its fixes are applied, and just the rows that they change go back to the row checks; this
    ends when it asks for nothing new.  Rows that a table fix still changes after ``rounds`` turns, or brings
    back to an earlier state, are unfinished.
    """
    keys, columns, types = list(keys), df.columns, {f.name: f.dataType for f in df.schema}
    rows = cut_lineage(repair(df, prepare, checks, editable, rounds, unfinished).withColumn("__past", F.array().cast("array<bigint>")))
    state = F.xxhash64(*[F.col(f"`{c}`") for c in editable])
    for turn in range(rounds):
        asked = table_fixes(rows.select(*columns)).groupBy(*keys).agg(
            *[F.min(F.when(F.col("column") == c, F.col("expected"))).cast(types[c]).alias(f"__to_{n}") for n, c in enumerate(editable)])
        judged = rows.join(asked, keys, "left")
        new = [F.when(~F.col(unfinished), F.col(f"__to_{n}")) for n in range(len(editable))]
        changes = reduce(lambda a, b: a | b, [v.isNotNull() & ~v.eqNullSafe(F.col(f"`{c}`")) for v, c in zip(new, editable, strict=True)])
        judged = cut_lineage(judged.withColumn("__changes", F.coalesce(changes, F.lit(False))))
        moved = judged.filter("__changes")
        if moved.isEmpty():
            break
        give_up = F.array_contains("__past", state) | F.lit(turn == rounds - 1)
        stuck = moved.filter(give_up).withColumn(unfinished, F.lit(True)).select(*columns, unfinished, "__past")
        changed = moved.filter(~give_up).select(*[
            F.coalesce(F.col(f"__to_{editable.index(c)}"), F.col(f"`{c}`")).alias(c) if c in editable else F.col(f"`{c}`") for c in columns],
            F.array_append("__past", state).alias("__past"))
        past = changed.select(*keys, "__past")
        again = repair(changed.select(*columns), prepare, checks, editable, rounds, unfinished).join(past, keys)
        rest = judged.filter("not __changes").select(*columns, unfinished, "__past")
        rows = cut_lineage(rest.unionByName(stuck).unionByName(again.select(*columns, unfinished, "__past")))
    return rows.drop("__past")


def remaining_findings(df: DataFrame, prepare: Callable[[DataFrame], DataFrame], checks: Sequence[Check],
                       keys: Sequence[str]) -> DataFrame:
    """What the row checks leave after a repair and needs a person."""
    return explode_findings(prepare(df), keys, checks)


def leftovers(df: DataFrame, suite: Callable[[DataFrame], DataFrame], keys: Sequence[str], unfinished: str = "unfinished") -> DataFrame:
    """``keys, code`` of all that is left after a repair: the suite's findings on the repaired rows, those about whole
    tables (duplicates, missing tiers, row counts) included, and ``UNFINISHED`` for rows that never came to rest.

    ``suite`` returns findings with a ``code``; keys that a finding about a table lacks are null.
    """
    found = suite(df.drop(unfinished))
    types = {f.name: f.dataType for f in df.schema}
    named = found.select(*[F.col(k) if k in found.columns else F.lit(None).cast(types[k]).alias(k) for k in keys], "code")
    return named.unionByName(df.filter(F.col(unfinished)).select(*keys, F.lit("UNFINISHED").alias("code")))
