"""Tables, rules, decisions and file registries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_TABLE_SCHEMA = "`등급구분` string, `등급명` string, `지원량` bigint, `정부지원금` bigint, `본인부담금` bigint"
DECISION_SCHEMA = ("run_id string, item_id string, action string, input_label string, selected_label string, "
                   "selected_rank int, manual_input string, reviewed_at string")


def read_price_tables(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = PRICE_TABLE_SCHEMA) -> DataFrame:
    """Price tables with a header, by explicit schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Export; the number of files follows the partitions of ``df``."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def checked_rules(rules: dict) -> dict:
    """``{rule_id: {name, inputs, formula}}``; fails loudly."""
    for rule_id, rule in rules.items():
        if not isinstance(rule, dict) or not {"inputs", "formula"} <= set(rule):
            raise ValueError(f"rule {rule_id} lacks inputs or formula")
    return rules


def load_rules(path: str | Path) -> dict:
    """A rule file of one set of rules, on the driver."""
    return checked_rules(json.loads(Path(path).read_text(encoding="utf-8")))


def load_rule_sets(path: str | Path) -> dict[int, dict]:
    """A rule file of several years: ``{year: {rule_id: ...}}``; entries that are no year are notes."""
    sets = json.loads(Path(path).read_text(encoding="utf-8"))
    return {int(year): checked_rules(rules) for year, rules in sets.items() if year.isdigit()}


def write_rule_files(spark: SparkSession, sets: dict[int, dict], path: str) -> None:
    """One JSON file a year, in folders ``year=...`` that every executor can reach."""
    for year, rules in sets.items():
        text = spark.createDataFrame([(json.dumps(checked_rules(rules), ensure_ascii=False),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/year={year}")


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a folder as rows: ``year, rule_id, rule`` (JSON text)."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("year").cast("int").alias("year"), F.explode(F.from_json("value", "map<string,string>")).alias("rule_id", "rule"))


def rule_sets_of(rows: DataFrame) -> dict[int, dict]:
    """Rule rows as sets by year, to compile into columns; rules are a handful of texts written by people."""
    sets: dict[int, dict] = {}
    for row in rows.select("year", "rule_id", "rule").toLocalIterator():
        sets.setdefault(row["year"], {})[row["rule_id"]] = json.loads(row["rule"])
    return {year: checked_rules(rules) for year, rules in sorted(sets.items())}


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Append decisions as JSON lines."""
    stamped = decisions.withColumn("reviewed_at", F.coalesce("reviewed_at", F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")))
    stamped.write.mode("append").option("ignoreNullFields", False).json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of a log; damaged and blank lines are left out."""
    return spark.read.schema(DECISION_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def latest_before(targets: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """For every target year the latest registered file of an earlier year.

    ``targets``: keys, ``year``.  ``registry``: keys, ``year``, ``path``; later ``seq`` replaces
    an entry of the same year.
    """
    current = registry.groupBy(*keys, "year").agg(F.max_by("path", "seq").alias("path")).filter(F.col("path").isNotNull())
    earlier = current.withColumnsRenamed({"year": "found_year"})
    hits = targets.join(earlier, keys, "left").filter(F.col("found_year").isNull() | (F.col("found_year") < F.col("year")))
    best = hits.groupBy(*keys, "year").agg(F.max(F.struct("found_year", "path")).alias("b"))
    return targets.join(best, [*keys, "year"], "left").select(*keys, "year", "b.found_year", "b.path")
