"""Price formulas: JSON expression trees compiled to Spark columns.

A rule is ``{name, inputs: [{var, name, type, default?}], formula: {op, args}}``.  Compiling
happens once on the driver; Catalyst folds and generates code for the result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARITY = {"+": 2, "-": 2, "*": 2, "/": 2, "MIN": 2, "MAX": 2, "ROUNDUP": 2, "ROUNDDOWN": 2, "IF": 4}
ACCEPTS = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
              T.DecimalType),
    "str": (T.StringType,),
    "bool": (T.BooleanType,),
}
DEFAULT_TYPES = {"int": int, "float": (int, float), "str": str, "bool": bool}


class RuleError(ValueError):
    """A rule cannot be compiled or bound."""


def _stepped(rounder, args: list) -> Column:
    digits = args[1]
    if isinstance(digits, Column):
        raise RuleError("rounding digits must be a constant")
    step = 10 ** -digits
    return rounder(F.lit(args[0]) / step) * step


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def compile_formula(formula: Mapping, names: Mapping[str, Column]) -> Column:
    """The column of one expression tree; strings that are not input names are literals."""
    op, args = formula.get("op"), formula.get("args")
    if op not in ARITY:
        raise RuleError(f"unknown operation: {op!r}")
    if args is None or len(args) != ARITY[op]:
        raise RuleError(f"{op} takes {ARITY[op]} operands")

    operands = [
        compile_formula(a, names) if isinstance(a, Mapping)
        else names[a] if isinstance(a, str) and a in names else a
        for a in args
    ]
    if op == "ROUNDUP":
        return _stepped(F.ceil, operands)
    if op == "ROUNDDOWN":
        return _stepped(F.floor, operands)
    a, b = _column(operands[0]), _column(operands[1])
    if op == "IF":
        return F.when(a == b, _column(operands[2])).otherwise(_column(operands[3]))
    return {
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b,
        "MIN": lambda: F.least(a, b), "MAX": lambda: F.greatest(a, b),
    }[op]()


def rule_column(rule: Mapping, bindings: Mapping[str, Column | int | float | str | bool],
                rows: DataFrame | None = None) -> Column:
    """A rule applied to bound inputs.

    ``bindings`` maps input variables to columns, column names (as ``F.col``) or constants.
    Missing inputs take their default; unknown, missing or wrongly typed ones fail here.  Columns
    are checked by the type that they have in ``rows``, if it is given.
    """
    inputs = rule["inputs"]
    known = {i["var"]: i for i in inputs}
    unknown = set(bindings) - set(known)
    if unknown:
        raise RuleError(f"unknown inputs: {sorted(unknown)}")

    names: dict[str, Column] = {}
    for var, spec in known.items():
        if "default" in spec:
            wanted = DEFAULT_TYPES.get(spec.get("type"), object)
            bad_bool = isinstance(spec["default"], bool) and spec.get("type") != "bool"
            if bad_bool or not isinstance(spec["default"], wanted):
                raise RuleError(f"default of {var} is not {spec['type']}")
        if var in bindings:
            bound = bindings[var]
            if not isinstance(bound, Column):
                wanted = DEFAULT_TYPES.get(spec.get("type"), object)
                if isinstance(bound, bool) != (spec.get("type") == "bool") or not isinstance(bound, wanted):
                    raise RuleError(f"{var} must be {spec['type']}: {bound!r}")
            elif rows is not None and spec.get("type") in ACCEPTS:
                dtype = rows.select(bound).schema[0].dataType
                if not isinstance(dtype, ACCEPTS[spec["type"]]):
                    raise RuleError(f"{var} must be {spec['type']}, {bound} is {dtype.simpleString()}")
            names[spec["name"]] = _column(bound)
        elif "default" in spec:
            names[spec["name"]] = F.lit(spec["default"])
        else:
            raise RuleError(f"missing input: {var}({spec['name']})")
    return compile_formula(rule["formula"], names)


def apply_rule(df: DataFrame, rule: Mapping, bindings: Mapping[str, str | Column], out: str) -> DataFrame:
    """``df`` with the rule's result; strings name columns, and all columns are checked by type."""
    bound = {}
    for var, source in bindings.items():
        if isinstance(source, str):
            if source not in df.columns:
                raise RuleError(f"no column {source!r} for {var}")
            source = F.col(f"`{source}`")
        bound[var] = source
    return df.withColumn(out, rule_column(rule, bound, df))
