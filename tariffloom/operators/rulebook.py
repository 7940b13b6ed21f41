"""The nine price rules of a year: expression trees from a data file, and their choice by year."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffloom.operators.formulas import rule_column
from tariffloom.sources.files import load_rule_sets


#: fixed values: the rules of each year
RULE_SETS = load_rule_sets(Path(__file__).resolve().parents[1] / "rules.json")
RULES_2025, RULES_2026 = RULE_SETS[2025], RULE_SETS[2026]


def copay_column(rules: dict, limit: Column, cap: Column, letter: Column, rate: Column,
                 variant: Column) -> Column:
    """Copayment by variant: the extended form waives tier 나."""
    bound = {"monthly_limit": limit, "cap": cap, "income_range": letter, "copayment_rate": rate}
    return F.when(variant == "확장형", rule_column(rules["copayment_extended"], bound)).otherwise(
        rule_column(rules["copayment"], bound)
    )


def by_year(rule_id: str, sets: dict[int, dict], year: Column, bindings: dict) -> Column:
    """Per row, the rule of the latest rule set not after the row's year."""
    chosen = None
    for first_year in sorted(sets, reverse=True):
        value = rule_column(sets[first_year][rule_id], bindings)
        chosen = F.when(year >= first_year, value) if chosen is None else chosen.when(year >= first_year, value)
    return chosen


def rule_registry(spark: SparkSession, sets: dict[str, dict]) -> DataFrame:
    """The rules as a table: rule set, id, name, inputs and the formula as JSON text."""
    import json

    rows = [
        (set_id, rule_id, rule["name"],
         [(i["var"], i["name"], i["type"], None if "default" not in i else json.dumps(i["default"]))
          for i in rule["inputs"]],
         json.dumps(rule["formula"], ensure_ascii=False))
        for set_id, rules in sets.items() for rule_id, rule in rules.items()
    ]
    return spark.createDataFrame(
        rows,
        "rule_set string, rule_id string, name string, "
        "inputs array<struct<var:string,name:string,type:string,default_json:string>>, formula string",
    )
