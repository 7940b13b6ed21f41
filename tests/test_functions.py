"""Case tables of the scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from tariffloom.functions import labels as lf
from tariffloom.functions import numbers as nf
from tariffloom.functions import text as tf
from tariffloom.operators import checks as ck
from tariffloom.operators.formulas import RuleError, apply_rule, compile_formula, rule_column
from tariffloom.operators.rulebook import RULES_2025, RULES_2026

ZWSP, BOM, LRM, WJ, SHY, NBSP = "​", "﻿", "‎", "⁠", "­", " "

# one case a property: unit notes, decoration, spaces, width, invisible characters, digits that stay
NORMAL_FORMS = [
    ("시간 당 금액(원)", "시간당금액"), ("【하루 한도】", "하루한도"), ("총액 (단위: 원)", "총액"), (f"하{ZWSP}루", "하루"), (f"한도{NBSP}액", "한도액"),
    ("\uff22형 70\uff05", "B형70%"), ("7 등급", "7등급"), ("둘 째\t줄", "둘째줄"),
]
# bands by sign and number, ordinals by unit and number, forms by name; other texts have no structure
SAME_STRUCTURE = [
    ("70%이하", "70.0%이하", True), ("070%초과", "70%초과", True), ("70%이하", "71%이하", False), ("70%초과", "70%이하", False), ("8구간", "08구간", True),
    ("8구간", "8등급", False), ("주간활동확장형", "주간활동확장형", True), ("돌봄종류", "70%이하", None), ("쪽수", "비고", None),
]
RELATIONS = [
    ("7구간", "9구간", "conflict", False), ("7구간", "7구간금액", "same", False), ("2031비고", "2033비고", "same", False), ("3구간금액", "3구간5회금액", "extra", False),
    ("70%이하", "70%초과", "same", True), ("쪽수", "비고", "same", False),
]
GRADE_NAMES = [
    ("1등급(다형)", ("ij", "1등급", "다", "기본형")), ("3구간(가형)_주간확장", ("jh", "3구간", "가", "확장형")), ("특례12(바형)", ("sj", "특례12", "바", "기본형")),
    ("출산가구_가형", ("add", "출산가구", "가", "기본형")), ("긴급활동지원", ("special", "긴급활동지원", "", "기본형")), ("1등급(사형)", ("unknown", "1등급(사형)", "", "기본형")),
    ("아무말", ("unknown", "아무말", "", "기본형")),
]


def column(spark, values, types):
    return spark.createDataFrame(values, types)


def test_normal_forms(spark):
    df = column(spark, NORMAL_FORMS, "raw string, want string").select("raw", "want", tf.normalize_label(F.col("raw")).alias("got"))
    assert [(r["raw"], r["got"]) for r in df.collect()] == NORMAL_FORMS


@pytest.mark.parametrize("char", [ZWSP, BOM, LRM, WJ, SHY])
def test_invisible_characters_go(spark, char):
    got = column(spark, [(f"기본{char}단가",)], "s string").select(tf.sanitize(F.col("s"))).first()[0]
    assert got == "기본단가"


def test_structure(spark):
    df = column(spark, SAME_STRUCTURE, "l string, r string, want boolean").select("l", "r", lf.same_structure(F.col("l"), F.col("r")))
    assert [tuple(r) for r in df.collect()] == SAME_STRUCTURE


def test_relations(spark):
    left, right = F.col("l"), F.col("r")
    df = column(spark, RELATIONS, "l string, r string, rel string, anti boolean").select(
        "l", "r", lf.numeric_relation(lf.plain_numbers(left), lf.plain_numbers(right)),
        lf.opposite(lf.opposite_mask(left), lf.opposite_mask(right), lf.negated(left), lf.negated(right)))
    assert [tuple(r) for r in df.collect()] == RELATIONS


def test_grade_names_both_ways(spark):
    df = column(spark, [(n,) for n, _ in GRADE_NAMES], "`등급명` string")
    by_column = [tuple(r["g"]) for r in df.select(lf.grade_name(F.col("등급명")).alias("g")).collect()]
    by_steps = [tuple(r) for r in ck.with_grade(df).select("kind", "base", "letter", "variant").collect()]
    assert by_column == by_steps == [want for _, want in GRADE_NAMES]


def test_numbers(spark):
    rows = [("12.7", 12.0, 12.7, True), ("-3.9", -3.0, -3.9, True), ("1,234", 1234.0, 1234.0, True), ("5%", None, 5.0, True), ("", None, None, False),
            ("1d", None, None, False), ("nan", None, None, False)]
    none = F.lit(None).cast("double")
    df = column(spark, [(r[0],) for r in rows], "s string").select(
        "s", nf.checked_number(F.col("s"), none), nf.constant_number(F.col("s"), none), nf.looks_numeric(F.col("s")))
    assert [tuple(r) for r in df.collect()] == rows
    digits = column(spark, [("1.5",), ("-12원",), ("없음",)], "s string").select(nf.amount_of(F.col("s"), none, "digits")).collect()
    assert [r[0] for r in digits] == [15, 12, None]


def test_a1_and_bigrams(spark):
    df = column(spark, [(0, 0), (9, 25), (0, 26), (4, 701), (0, 702), (0, 16383)], "r int, c int").select(tf.a1_name(F.col("r"), F.col("c")))
    assert [r[0] for r in df.collect()] == ["A1", "Z10", "AA1", "ZZ5", "AAA1", "XFD1"]
    grams = column(spark, [("본인부담금",), ("가",), ("",)], "s string").select(tf.bigrams(F.col("s"))).collect()
    assert [r[0] for r in grams] == [["본인", "인부", "부담", "담금"], ["가"], []]


def test_rules_compile_and_check(spark):
    df = column(spark, [(2041000, 154400, "다", 0.06), (2041000, 154400, "나", 0.0), (3000000, 154400, "바", 0.15)],
                "lim bigint, cap bigint, letter string, rate double")
    names = {"monthly_limit": "lim", "cap": "cap", "income_range": "letter", "copayment_rate": "rate"}
    assert [r["out"] for r in apply_rule(df, RULES_2025["copayment"], names, "out").collect()] == [122400, 20000, 154400]
    with pytest.raises(RuleError):
        apply_rule(df, RULES_2025["copayment"], {**names, "cap": "letter"}, "out")
    with pytest.raises(RuleError):
        rule_column(RULES_2025["copayment"], {"monthly_limit": 1})
    with pytest.raises(RuleError):
        rule_column(RULES_2025["copayment"], {"monthly_limit": 1, "cap": 1, "extra": 1})
    with pytest.raises(RuleError):
        compile_formula({"op": "IF", "args": [1, 2]}, {})
    json.dumps(RULES_2026)  # rules stay plain data


def test_untaken_branch_does_not_divide(spark):
    ast = {"op": "IF", "args": ["x", 0, 7, {"op": "/", "args": [1, "x"]}]}
    got = column(spark, [(0,), (2,)], "x int").select(compile_formula(ast, {"x": F.col("x")}).cast("double")).collect()
    assert [r[0] for r in got] == [7.0, 0.5]
