"""Named constants of reference sheets: long form, map form, selections and edits.

Long form: ``doc_id, key, value`` with keys ``group.item`` or ``group``.  A document's constants are few,
so checks gather them by document: rows that are dealt out by document stay in their tasks, where joins by
document and key would shuffle them anew into a fixed number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.session import not_broadcast


def flatten_map(df: DataFrame, keys: Sequence[str], nested: str) -> DataFrame:
    """``map<group,map<item,value>>`` to long form; a group whose item is empty is a plain key."""
    return df.select(*keys, F.explode(nested).alias("grp", "items")).select(
        *keys, "grp", F.explode("items").alias("item", "value")
    ).withColumn("key", F.when(F.col("item") == "", F.col("grp")).otherwise(F.concat_ws(".", "grp", "item")))


def split_key(constants: DataFrame) -> DataFrame:
    """Adds ``grp`` and ``item`` (empty for plain keys)."""
    dot = F.instr("key", ".")
    return constants.withColumn(
        "grp", F.when(dot > 0, F.substring_index("key", ".", 1)).otherwise(F.col("key"))
    ).withColumn("item", F.when(dot > 0, F.expr("substring(key, instr(key, '.') + 1)")).otherwise(""))


def nested_map(constants: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row per document: ``map<group,map<item,value>>`` of all its keys, or of the named ones.

    A document's constants are those of its sheets, so the map is as small as they are.  Of a
    repeated key the greatest value is kept; :func:`repeated_keys` lists them.
    """
    named = (constants if keys is None else constants.filter(F.col("key").isin(*keys))).groupBy("doc_id", "key").agg(F.max("value").alias("value"))
    groups = split_key(named).groupBy("doc_id", "grp").agg(
        F.map_from_entries(F.collect_list(F.struct("item", "value"))).alias("items")
    )
    return groups.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("grp", "items"))).alias("nested")
    )


def repeated_keys(constants: DataFrame) -> DataFrame:
    """Keys that a document gives more than one value, with the least and the greatest."""
    return constants.groupBy("doc_id", "key").agg(F.count_distinct("value").alias("values"), F.min("value").alias("least"),
                                                  F.max("value").alias("greatest")).filter("values > 1")


def selected(key: Column, kind: str) -> Column:
    """Whether a constant belongs to a table part; special cases name their keys."""
    if kind == "산정":
        return F.exists(F.array(*map(F.lit, fixed.SPECIAL_CASE_KEYS)), lambda k: F.contains(key, k)) | key.isin(
            fixed.K_YEAR, fixed.K_CHASU
        )
    return F.contains(key, F.lit(kind)) | key.isin(fixed.K_YEAR, fixed.K_CHASU)


def table_keys() -> list[str]:
    """The keys price tables read: a list of fixed length."""
    keys = [fixed.BASE_PRICE, fixed.A_VALUE, fixed.K_IJ_CAP, fixed.K_SJ_CAP, fixed.K_YEAR, fixed.K_CHASU]
    for rates in (fixed.K_IJ_RATES, fixed.K_ADD_RATES, fixed.K_SJ_RATES):
        keys += [f"{rates}.{letter}" for letter in fixed.LETTERS]
    for variant in fixed.VARIANTS:
        keys += [f"{fixed.K_IJ_LIMITS} ({variant}).{g}" for g in fixed.GRADES]
        keys += [f"{fixed.K_JH_LIMITS} ({variant}).{z}" for z in fixed.ZONES]
    return keys + [f"{fixed.K_ADD_LIMITS}.{item}" for item in fixed.ADD_ITEMS]


def constant_map(constants: DataFrame, keys: Sequence[str] | None = None, in_place: bool = False) -> DataFrame:
    """One row per document with a map ``c`` of the named keys (the greatest value of a
    repeated key).  The key list bounds the map's size.

    A document's constants are tiny but its tables are not: the explicit partition count keeps
    adaptive execution from merging them into a few tasks before they multiply.  ``in_place``: the
    constants are dealt out by document already, and stay in their tasks.
    """
    keys = table_keys() if keys is None else keys
    one = constants.filter(F.col("key").isin(*keys)).groupBy("doc_id", "key").agg(F.max("value").alias("value"))
    if not in_place:
        one = one.repartition(int(constants.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("c"))


def missing_keys(docs: DataFrame, constants: DataFrame, needed: Sequence[str]) -> DataFrame:
    """One row per document and needed key (or group) that has no constant."""
    names = F.array(*map(F.lit, needed))
    have = split_key(constants).select("doc_id", F.explode(F.array_intersect(F.array("key", "grp"), names)).alias("need"))
    held = have.groupBy("doc_id").agg(F.collect_set("need").alias("held"))
    lacking = F.filter(names, lambda n: F.col("held").isNull() | ~F.array_contains("held", n))
    return docs.join(not_broadcast(held, unique=True), "doc_id", "left").select("doc_id", F.explode(lacking).alias("need")).withColumn(
        "reason", F.concat(F.lit("검증에 필요한 값이 없습니다: '"), "need", F.lit("'"))
    )


def changed_values(old: DataFrame, new: DataFrame, valid: Column) -> DataFrame:
    """Constants whose new value differs from the old and is valid; ``new`` has key, value.

    A document's old values are one row, looked up by key.
    """
    each = old.filter(F.col("key").isNotNull()).groupBy("doc_id", "key").agg(F.collect_list(F.struct(F.col("value").alias("old"))).alias("olds"))
    held = each.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "olds"))).alias("__held"))
    met = new.join(not_broadcast(held, unique=True), "doc_id", "left").withColumn("__old", F.explode_outer(F.col("__held")[F.col("key")]))
    return met.withColumn("old", F.col("__old.old")).drop("__held", "__old").filter(~F.col("value").eqNullSafe(F.col("old")) & valid)


def merge_overrides(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """User edits over extracted values.  Edits equal to the base are no edits; keys known only
    to the edits are added."""
    joined = base.select("doc_id", "key", F.col("value").alias("base")).join(
        overrides.select("doc_id", "key", F.col("value").alias("edit")), ["doc_id", "key"], "full_outer"
    )
    edited = F.col("edit").isNotNull() & ~F.col("edit").eqNullSafe(F.col("base"))
    return joined.select("doc_id", "key", F.coalesce("edit", "base").alias("value"), edited.alias("edited"))


def group_sizes(constants: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Items per constant group against the expected number."""
    expected = fixed.GROUP_SIZES if expected is None else expected
    spec = F.create_map(*[x for k, n in expected.items() for x in (F.lit(k), F.lit(n))])
    listed = F.col("grp").isin(*expected) & (F.col("item") != "")
    sizes = split_key(constants).groupBy("doc_id").agg(F.collect_set(F.when(listed, F.struct("grp", "item"))).alias("items"))
    return sizes.select("doc_id", F.explode(spec).alias("grp", "expected"), "items").select(
        "doc_id", "grp", "expected", F.size(F.filter("items", lambda x: x["grp"] == F.col("grp"))).cast("bigint").alias("actual"))


def zone_order_breaks(constants: DataFrame) -> DataFrame:
    """Zone limits that do not fall strictly from zone to zone: the next zone not below."""
    groups = [f"{fixed.K_JH_LIMITS} ({v})" for v in fixed.VARIANTS]
    zones = split_key(constants).filter(F.col("grp").isin(*groups)).select(
        "doc_id", "grp", F.regexp_extract("item", "([0-9]+)", 1).cast("int").alias("zone"), "value"
    )
    held = zones.groupBy("doc_id").agg(F.collect_list(F.struct("grp", "zone", "value")).alias("own"))
    each = held.select("doc_id", "own", F.inline("own"))
    after = F.filter("own", lambda z: (z["grp"] == F.col("grp")) & (z["zone"] == F.col("zone") + 1) & (F.col("value") <= z["value"]))
    return each.withColumn("__after", F.explode(after)).select("doc_id", "grp", "zone", "value", F.col("__after.value").alias("next_value"))


def non_positive(constants: DataFrame) -> DataFrame:
    """Amounts that are not above zero: the four scalars and every monthly limit."""
    amount = F.col("key").isin(fixed.BASE_PRICE, fixed.A_VALUE, fixed.K_IJ_CAP, fixed.K_SJ_CAP) | F.contains(
        F.col("key"), F.lit("월한도액")
    )
    return constants.filter(amount & (F.col("value") <= 0))
