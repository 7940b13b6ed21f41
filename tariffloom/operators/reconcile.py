"""Notices against reference sheets, and the sanity of notices by themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.numbers import segment_number
from tariffloom.functions.text import key_form
from tariffloom.operators.drift import directions
from tariffloom.session import not_broadcast


def comparable_items(amounts: DataFrame) -> DataFrame:
    """Notice amounts under the keys reference sheets use; others are not compared."""
    s, key = F.col("service"), F.col("key")
    zone, variant = F.split_part(key, F.lit("."), F.lit(1)), F.split_part(key, F.lit("."), F.lit(2))
    full = F.concat_ws(".", s, key)
    name = (
        F.when(s == "주간활동", F.concat(F.lit(f"{fixed.K_JH_LIMITS} ("), variant, F.lit(")."), zone))
        .when(s == "인정조사기본급여", F.concat(F.lit(f"{fixed.K_IJ_LIMITS} (기본형)."), key))
        .when(s == "추가급여", F.concat(F.lit(f"{fixed.K_ADD_LIMITS}."), key))
        .when(full.isin(*fixed.PRICE_ALIASES), full)
    )
    return amounts.withColumn("key", name).filter(F.col("key").isNotNull())


def compare_with_reference(items: DataFrame, reference: DataFrame, aliases: dict[str, str] = fixed.PRICE_ALIASES,
                           ignored: Sequence[str] = fixed.REFERENCE_IGNORED) -> tuple[DataFrame, DataFrame]:
    """``(rows, leftovers)``: every notice item with its reference value and state, and the
    reference keys nothing was compared with.

    ``items``: doc_id, key, amount.  ``reference``: doc_id, key, value (BIGINT), pos.  A key is
    looked up as it is, by its alias, by its normal form and by the alias's normal form; the
    four lookups are one join.  Of several reference keys with one normal form the first counts.
    """
    lookup = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    alias = lookup[F.col("key")]
    probes = F.array(F.concat(F.lit("is:"), "key"), F.concat(F.lit("is:"), alias),
                     F.concat(F.lit("like:"), key_form(F.col("key"))), F.concat(F.lit("like:"), key_form(alias)))
    asked = items.select("doc_id", "key", F.posexplode(probes).alias("prio", "probe")).filter(F.col("probe").isNotNull())
    offered = reference.select("doc_id", F.struct("pos", F.col("key").alias("ref_key"), "value").alias("r"), F.explode(F.array(
        F.concat(F.lit("is:"), "key"), F.concat(F.lit("like:"), key_form(F.col("key"))))).alias("probe"))
    offered = offered.groupBy("doc_id", "probe").agg(F.min_by("r", "r.pos").alias("r"))
    best = asked.join(not_broadcast(offered), ["doc_id", "probe"]).groupBy("doc_id", "key").agg(F.min_by("r", "prio").alias("r"))
    state = F.when(F.col("r.ref_key").isNull() | F.col("r.value").isNull(), fixed.ABSENT).when(
        F.col("r.value") == F.col("amount"), fixed.AGREE).otherwise(fixed.DIFFER)
    rows = items.join(not_broadcast(best), ["doc_id", "key"], "left").select(
        *items.columns, F.col("r.ref_key").alias("ref_key"), F.col("r.value").alias("ref_value"), state.alias("state"))
    used = best.select("doc_id", F.col("r.ref_key").alias("key"))
    leftovers = reference.filter(~F.col("key").isin(*ignored)).select("doc_id", "key").join(not_broadcast(used), ["doc_id", "key"], "left_anti")
    return rows, leftovers


def sort_keys(key: Column) -> list[Column]:
    """Natural order: by group, then by segment number."""
    group = F.when(F.contains(key, F.lit(".")), F.regexp_replace(key, r"\.[^.]*$", "")).otherwise(key)
    return [group.asc(), F.coalesce(segment_number(key), F.lit(0)).asc(), key.asc()]


def totals(rows: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    state = F.col("state")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(state == fixed.AGREE).alias("agree"),
        F.count_if(state == fixed.DIFFER).alias("differ"), F.count_if(state == fixed.ABSENT).alias("absent"))


def only_differences(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("state") != fixed.AGREE)


def price_problems(amounts: DataFrame) -> DataFrame:
    """Service prices that cannot be: not positive, night or holiday below day, a surcharge not
    below its amount, nursing not rising with its duration."""
    full = F.concat_ws("/", "service", "key")
    amount = F.col("amount")
    single = amounts.select("doc_id", F.explode(F.array_compact(F.array(
        F.when(amount <= 0, F.struct(F.lit("NOT_POSITIVE").alias("code"), full.alias("what"))),
        F.when((F.col("service") == "활동보조") & (F.col("surcharge") >= amount), F.struct(F.lit("SURCHARGE").alias("code"), full.alias("what")))))).alias("p")
    ).select("doc_id", "p.code", "p.what")
    at = lambda service, key: F.max(F.when((F.col("service") == service) & (F.col("key") == key), amount))
    per_doc = amounts.groupBy("doc_id").agg(
        at("활동보조", "일반").alias("day"), at("활동보조", "심야").alias("night"), at("활동보조", "공휴일").alias("holiday"),
        at("방문간호", "30분미만").alias("n1"), at("방문간호", "30분이상60분미만").alias("n2"), at("방문간호", "60분이상").alias("n3"))
    between = per_doc.select("doc_id", F.explode(F.array_compact(F.array(
        F.when((F.col("night") < F.col("day")) | (F.col("holiday") < F.col("day")),
               F.struct(F.lit("NIGHT_BELOW_DAY").alias("code"), F.lit("활동보조").alias("what"))),
        F.when((F.col("n1") >= F.col("n2")) | (F.col("n2") >= F.col("n3")), F.struct(F.lit("NOT_RISING").alias("code"), F.lit("방문간호").alias("what")))))).alias("p")
    ).select("doc_id", "p.code", "p.what")
    return single.unionByName(between)


def limit_problems(amounts: DataFrame) -> DataFrame:
    """Monthly limits that contradict each other inside one notice."""
    s, key = F.col("service"), F.col("key")
    number = F.regexp_extract(key, "^([0-9]+)", 1).cast("int")
    base = amounts.filter(s == "월한도액").select("doc_id", number.alias("n"), F.col("amount").alias("base"))
    day = amounts.filter(s == "주간활동").groupBy("doc_id", number.alias("n")).agg(
        F.max(F.when(key.endswith("기본형"), F.col("amount"))).alias("basic"),
        F.max(F.when(key.endswith("확장형"), F.col("amount"))).alias("extended"))
    what = F.concat(F.col("n").cast("string"), F.lit("구간"))
    apart = base.join(not_broadcast(day), ["doc_id", "n"]).filter("base <> basic").select("doc_id", F.lit("TABLES_DIFFER").alias("code"), what.alias("what"))
    larger = day.filter("extended > basic").select("doc_id", F.lit("EXTENDED_ABOVE_BASIC").alias("code"), what.alias("what"))
    ordered = amounts.filter(s.isin("월한도액", "인정조사기본급여")).select(
        "doc_id", "service", number.alias("n"), F.col("amount").cast("double").alias("v"))
    falling = directions(ordered, ["doc_id", "service"], "n", "v").filter("n > 1 and direction <> -1").select(
        "doc_id", F.lit("NOT_FALLING").alias("code"), F.col("service").alias("what"))
    return apart.unionByName(larger).unionByName(falling)
