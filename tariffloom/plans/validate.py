"""Validation suites: findings, metrics and warnings of many price tables in one plan.

Tables carry ``doc_id`` and ``row_id`` (0-based position in the table).  References are joined
once by key, then all row checks run in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.operators import checks as ck
from tariffloom.operators import tables as tb
from tariffloom.operators.constants import constant_map, missing_keys
from tariffloom.operators.formulas import rule_column
from tariffloom.operators.rulebook import RULES_2025, copay_column
from tariffloom.plans.generate import block_place, document_terms, service_bundles
from tariffloom.session import not_broadcast

KEYS = ("doc_id", "row_id")
ISSUE_COLUMNS = ("doc_id", "row_id", "ord", "code", "column", "reason", "expected", "actual", "fixes")
BASIC_NEEDS = (fixed.K_IJ_CAP, fixed.K_SJ_CAP, fixed.K_IJ_RATES, fixed.K_SJ_RATES)
ADD_NEEDS = (fixed.K_ADD_RATES, fixed.K_ADD_LIMITS)


def _table_level(df: DataFrame, code: str, reason: Column, expected=None, actual=None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "doc_id", F.lit(-1).cast("bigint").alias("row_id"), F.lit(1000).alias("ord"), F.lit(code).alias("code"),
        none.cast("string").alias("column"), reason.alias("reason"),
        (none if expected is None else expected).cast("double").alias("expected"),
        (none if actual is None else actual).cast("double").alias("actual"),
        F.array().cast("array<string>").alias("fixes"),
    )


def _row_level(df: DataFrame, ord_: int, code: str, column: str, reason: Column, fix: Column) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select("doc_id", F.col("row_id").cast("bigint").alias("row_id"), F.lit(ord_).alias("ord"),
                     F.lit(code).alias("code"),
                     F.lit(column).alias("column"), reason.alias("reason"), none.alias("expected"),
                     none.alias("actual"), F.array(fix).alias("fixes"))


def _whole_table(table: DataFrame, parsed: DataFrame, expected_rows: int) -> DataFrame:
    blank = F.coalesce(F.btrim("등급명"), F.lit("")) == ""
    counts = tb.row_counts(table, ["doc_id"], expected_rows, blank)
    out = _table_level(counts, "ROW_COUNT",
                       ck.message("ROW_COUNT", F.format_number("expected", 0), F.format_number("actual", 0)),
                       F.col("expected"), F.col("actual"))
    graded = parsed.filter(F.col("kind").isin("ij", "jh", "sj", "add")).select("doc_id", "base", "variant", "letter")
    gaps = tb.tier_messages(tb.category_gaps(graded, ["doc_id", "base", "variant"], F.col("letter"), fixed.LETTERS))
    out = out.unionByName(_table_level(gaps, "TIER", F.col("reason")))
    for ord_, code, column in ((900, "DUP_CODE", "등급구분"), (901, "DUP_NAME", "등급명")):
        keyed = table.select("doc_id", "row_id", F.btrim(column).alias("k")).filter(F.col("k") != "")
        again = tb.later_copies(keyed, ["doc_id", "k"], "row_id")
        here, there = (F.col("row_id") + 1).cast("string"), (F.col("first_row") + 1).cast("string")
        tail = F.lit("행의 등급구분을 수정" if code == "DUP_CODE" else "행 중 하나를 확인/삭제")
        out = out.unionByName(_row_level(again, ord_, code, column, ck.message(code, F.col("k"), there),
                                         F.concat(here, F.lit("행 또는 "), there, tail)))
    return out


def basic_with_terms(table: DataFrame, constants: DataFrame, rules: dict = RULES_2025) -> DataFrame:
    """Rows of basic tables with parsed grade, reference limit, rate, cap and recomputed copay.

    ``emergency`` is the limit of the thirteenth zone.  A document's terms are one small row; limit,
    rate and cap are looked up in it by the grade's place.
    """
    parsed = ck.pinned(ck.with_grade(table), {
        "__at": block_place(F.col("base"), F.col("variant")),
        "__tier": F.nullif(F.array_position(F.array(*map(F.lit, fixed.LETTERS)), F.col("letter")), F.lit(0)).cast("int") - 1})
    held = parsed.join(not_broadcast(document_terms(constants, rules), unique=True), "doc_id", "left")
    known, first = F.col("__at").isNotNull() & F.col("__tier").isNotNull(), F.col("kind") == "ij"
    joined = ck.pinned(held, {
        "limit": F.when(known, F.get("limits", F.col("__at"))),
        "rate": F.when(known, F.get(F.when(first, F.col("ij_rates")).otherwise(F.col("sj_rates")), F.col("__tier"))),
        "cap": F.when(known, F.when(first, F.col("ij_cap")).otherwise(F.col("sj_cap")))}).drop(
        "limits", "ij_rates", "sj_rates", "ij_cap", "sj_cap", "__at", "__tier")
    expected = copay_column(rules, F.col("지원량"), F.col("cap"), F.col("letter"), F.col("rate"), F.col("variant"))
    known = F.col("rate").isNotNull() & F.col("cap").isNotNull() & F.col("지원량").isNotNull()
    return ck.pinned(joined, {"expected_copay": F.when(known, expected).cast("bigint")})


def basic_row_checks() -> list[ck.Check]:
    """Row checks of the basic table in their reporting order."""
    kind, base = F.col("kind"), F.col("base")
    support, gov, copay = F.col("지원량"), F.col("정부지원금"), F.col("본인부담금")
    graded = kind.isin("ij", "jh", "sj")
    named = F.coalesce(F.btrim("등급명"), F.lit("")) != ""
    urgent = (kind == "special") & (base == "긴급활동지원") & F.col("emergency").isNotNull()
    zero = (kind == "special") & (base == "부적합")

    def to_zero(test: Column, code: str, column: str, value: Column) -> ck.Check:
        return ck.finding(test & (value != 0), code, column, F.lit(0), value, [ck.change(column, value, F.lit(0))])

    special = [
        ck.finding(urgent & ~support.eqNullSafe(F.col("emergency")), "EMERGENCY_LIMIT", "지원량", F.col("emergency"),
                   support, [ck.change("지원량", support, F.col("emergency"))]),
        to_zero(urgent, "EMERGENCY_COPAY", "본인부담금", copay),
        to_zero(zero, "INELIGIBLE", "지원량", support),
        to_zero(zero, "INELIGIBLE", "정부지원금", gov),
        to_zero(zero, "INELIGIBLE", "본인부담금", copay),
    ]
    limit, expected = F.col("limit"), F.col("expected_copay")
    regular = [
        ck.finding(named & (kind.isin("unknown", "add")), "NAME", "등급명"),
        ck.limit_check("LIMIT_BASIC", "지원량", limit, support),
        ck.recompute_check("COPAY", "본인부담금", "정부지원금", expected, copay, support),
        *[c.where(named & (graded | (kind == "special"))) for c in ck.sum_check(
            "지원량", "정부지원금", "본인부담금", support, gov, copay, support == limit, copay == expected)],
        ck.granularity_check("GRANULARITY", "본인부담금", copay).where(graded),
        ck.cap_check("본인부담금", "정부지원금", copay, F.when(graded, F.col("cap")), support, gov),
    ]
    return special + regular


def _metrics(rows: DataFrame, graded: Column) -> DataFrame:
    args = [F.col(n) for n in ("base", "letter", "variant", "지원량", "본인부담금", "rate", "cap")]
    return rows.filter(graded).select(*KEYS, ck.rate_metric(*args).alias("metric"))


def _warnings(rows: DataFrame, graded: Column, checks: list[ck.Check]) -> DataFrame:
    """Share warnings of rows whose copayment has no finding of its own; both are seen in the row itself."""
    flagged = ck.sure(ck.any_of([c for c in checks if c.column == "본인부담금"]))
    text = ck.rate_deviation(*[F.col(n) for n in ("letter", "지원량", "본인부담금", "rate", "cap")])
    judged = ck.pinned(rows.filter(graded), {"warning": text, "__flagged": flagged})
    return judged.filter(F.col("warning").isNotNull() & ~F.col("__flagged")).select(*KEYS, "warning")


def validate_basic(table: DataFrame, constants: DataFrame, rules: dict = RULES_2025) -> dict[str, DataFrame]:
    """The basic suite: ``issues``, ``metrics`` and ``warnings``."""
    rows = basic_with_terms(table, constants, rules)
    checks = basic_row_checks()
    row_issues = ck.explode_findings(rows, KEYS, checks).select(*ISSUE_COLUMNS)
    needs = missing_keys(table.select("doc_id").distinct(), constants, BASIC_NEEDS)
    issues = (
        row_issues.unionByName(_table_level(needs, "NEED", F.col("reason")))
        .unionByName(_whole_table(table, ck.with_grade(table), tb.EXPECTED_BASIC_ROWS))
    )
    graded = F.col("kind").isin("ij", "jh", "sj")
    return {"issues": issues, "metrics": _metrics(rows, graded), "warnings": _warnings(rows, graded, checks)}


def validate_supplement(table: DataFrame, constants: DataFrame, rules: dict = RULES_2025) -> dict[str, DataFrame]:
    """The supplementary suite; there is no cap."""
    item_of = F.create_map(*[F.lit(x) for item, (_, name, _) in fixed.ADD_CODES.items() for x in (name, item)])
    docs = constant_map(constants)
    parsed = ck.with_grade(table).withColumn("item", F.when(F.col("kind") == "add", item_of[F.col("base")]))
    terms = docs.select("doc_id", "c", F.explode(F.array(*map(F.lit, fixed.ADD_ITEMS))).alias("item")).select(
        "doc_id", "item", F.col("c")[F.concat(F.lit(fixed.K_ADD_LIMITS + "."), "item")].cast("bigint").alias("limit"))
    rates = docs.select("doc_id", "c", F.explode(F.array(*map(F.lit, fixed.LETTERS))).alias("letter")).select(
        "doc_id", "letter", F.col("c")[F.concat(F.lit(fixed.K_ADD_RATES + "."), "letter")].alias("rate"))
    rows = parsed.join(not_broadcast(terms, unique=True), ["doc_id", "item"], "left").join(
        not_broadcast(rates, unique=True), ["doc_id", "letter"], "left")
    support, gov, copay = F.col("지원량"), F.col("정부지원금"), F.col("본인부담금")
    expected = rule_column(rules["add_copayment"], {
        "monthly_limit": support, "income_range": F.col("letter"), "copayment_rate": F.col("rate")})
    add = F.col("kind") == "add"
    rows = ck.pinned(rows, {
        "cap": F.lit(None).cast("bigint"),
        "expected_copay": F.when(add & F.col("rate").isNotNull() & support.isNotNull(), expected).cast("bigint"),
    })
    expected = F.col("expected_copay")
    checks = [
        ck.finding((F.coalesce(F.btrim("등급명"), F.lit("")) != "") & ~add, "NAME", "등급명"),
        ck.limit_check("LIMIT_ADD", "지원량", F.col("limit"), support),
        ck.recompute_check("COPAY", "본인부담금", "정부지원금", expected, copay, support),
        *[c.where(add) for c in ck.sum_check("지원량", "정부지원금", "본인부담금", support, gov, copay,
                                             support == F.col("limit"), copay == expected)],
        ck.granularity_check("GRANULARITY", "본인부담금", copay).where(add),
    ]
    found = ck.explode_findings(rows, KEYS, checks).select(*ISSUE_COLUMNS)
    needs = missing_keys(table.select("doc_id").distinct(), constants, ADD_NEEDS)
    issues = found.unionByName(_table_level(needs, "NEED", F.col("reason"))).unionByName(
        _whole_table(table, ck.with_grade(table), tb.EXPECTED_ADD_ROWS))
    return {"issues": issues, "metrics": _metrics(rows, add), "warnings": _warnings(rows, add, checks)}


def payment_row_checks() -> list[ck.Check]:
    """Checks of payment rows joined with ``ref_*`` (basic table) and ``unit_*`` (services)."""
    support, gov, copay = F.col("지원량"), F.col("정부지원금액"), F.col("본인부담금액")
    gov_rate, copay_rate = F.col("정부지원금율"), F.col("본인부담금율")
    ref_s, ref_g, ref_c, code = F.col("ref_support"), F.col("ref_gov"), F.col("ref_copay"), F.col("등급구분")
    complete = support.isNotNull() & gov.isNotNull() & copay.isNotNull()
    has_ref = complete & ref_s.isNotNull()
    matched = has_ref & (support == ref_s)
    found = [
        ck.finding(has_ref & (support != ref_s), "PAY_SUPPORT", "지원량", ref_s, support,
                   [ck.change("지원량", support, ref_s)], ck.message("PAY_SUPPORT", code)),
        ck.finding(matched & (gov != ref_g), "PAY_GOV", "정부지원금액", ref_g, gov,
                   [ck.change("정부지원금액", gov, ref_g)], ck.message("PAY_GOV", code)),
        ck.finding(matched & (copay != ref_c), "PAY_COPAY", "본인부담금액", ref_c, copay,
                   [ck.change("본인부담금액", copay, ref_c)], ck.message("PAY_COPAY", code)),
    ]
    for column, rate, part in (("정부지원금율", gov_rate, ref_g), ("본인부담금율", copay_rate, ref_c)):
        wanted = F.round(part / F.nullif(ref_s, F.lit(0)), 10)
        found.append(ck.finding(
            matched & (F.abs(rate - wanted) > 1e-9), "PAY_RATE", column, wanted, rate,
            [F.concat(F.lit(column + " "), rate.cast("string"), F.lit(" → "), wanted.cast("string"))],
            ck.message("PAY_RATE", F.lit(column))))
    found += [c.where(complete & ref_s.isNull())
              for c in ck.five_value_checks()]
    found.append(ck.granularity_check("PAY_GRANULARITY", "본인부담금액", copay).where(complete))
    for code_, column, wanted in (("UNIT_DAY", "단위기준단가", F.col("unit_day")),
                                  ("UNIT_NIGHT", "단위기준심야단가", F.col("unit_night"))):
        found.append(ck.finding(F.col(column) != wanted, code_, column, wanted, F.col(column),
                                [ck.change(column, F.col(column), wanted)]))
    return found


#: lists that a document's codes are dealt to
BUCKETS = 256


def _bucket(code: Column) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(BUCKETS)).cast("int")


def _by_code(ref: DataFrame) -> DataFrame:
    """One row per document: ``__refs``, for each bucket of codes a map from code to ``r``.

    Rows of a document find their code without a join by it, which would move them all.
    """
    lists = ref.groupBy("doc_id", _bucket(F.col("등급구분")).alias("b")).agg(
        F.map_from_entries(F.collect_list(F.struct("등급구분", "r"))).alias("m"))
    return lists.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("own")).select(
        "doc_id", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.col("own")[b]).alias("__refs"))


def payment_with_references(table: DataFrame, basic: DataFrame | None, prices: DataFrame | None,
                            rules: dict = RULES_2025, in_place: bool = False) -> DataFrame:
    """Payment rows with the basic table by code (last row of a code) and unit prices by service.

    A document's prices are one row of fixed length (25 services), looked up by the service, and its grades
    are one row too, looked up by code: both joins are by document, so inputs that are dealt out by it stay.
    """
    out = table.withColumn("등급구분", F.btrim("등급구분"))
    if prices is None:
        out = out.withColumns({n: F.lit(None).cast("bigint") for n in ("unit_day", "unit_night")})
    else:
        service = F.struct("서비스종유명", "서비스시간명")
        units = service_bundles(prices, rules, in_place).select("doc_id", F.map_from_entries(F.transform("services", lambda s: F.struct(
            F.struct(s["서비스종유명"].alias("서비스종유명"), s["서비스시간명"].alias("서비스시간명")),
            F.struct(s["단위기준단가"].alias("unit_day"), s["단위기준심야단가"].alias("unit_night"))))).alias("__units"))
        out = out.join(not_broadcast(units, unique=True), "doc_id", "left")
        unit = F.col("__units")[service]
        out = out.withColumns({n: unit[n] for n in ("unit_day", "unit_night")}).drop("__units")
    if basic is None:
        out = out.withColumns({n: F.lit(None).cast("bigint") for n in ("ref_support", "ref_gov", "ref_copay")})
    else:
        full = basic.filter(F.coalesce(F.btrim("등급구분"), F.lit("")) != "").dropna(
            subset=["지원량", "정부지원금", "본인부담금"])
        ref = full.groupBy("doc_id", F.btrim("등급구분").alias("등급구분")).agg(F.max_by(
            F.struct(F.col("지원량").alias("ref_support"), F.col("정부지원금").alias("ref_gov"),
                     F.col("본인부담금").alias("ref_copay")), "row_id").alias("r"))
        out = out.join(not_broadcast(_by_code(ref), unique=True), "doc_id", "left")
        held = F.get("__refs", _bucket(F.col("등급구분")))[F.col("등급구분")]
        out = out.withColumns({n: held[n] for n in ("ref_support", "ref_gov", "ref_copay")}).drop("__refs")
    return out


def validate_payment(table: DataFrame, basic: DataFrame | None = None, prices: DataFrame | None = None,
                     rules: dict = RULES_2025, in_place: bool = False) -> dict[str, DataFrame]:
    """The payment suite: references first, value consistency where there is none.

    ``in_place``: the inputs are dealt out by document, into equally many tasks, and no row leaves its task.
    """
    need = {"지원량", "정부지원금액", "본인부담금액"}
    if not need <= set(table.columns):
        raise ValueError(f"missing columns in the payment table: {sorted(need - set(table.columns))}")
    for rate in ("정부지원금율", "본인부담금율"):
        if rate not in table.columns:
            table = table.withColumn(rate, F.lit(None).cast("double"))
    rows = ck.with_five_value_terms(payment_with_references(table, basic, prices, rules, in_place), *[
        F.col(n) for n in ("지원량", "정부지원금액", "본인부담금액", "정부지원금율", "본인부담금율")])
    issues = ck.explode_findings(rows, KEYS, payment_row_checks()).select(*ISSUE_COLUMNS)
    again = tb.later_copies(
        table.select("doc_id", "row_id", "등급구분", "서비스종유명", "서비스시간명"),
        ["doc_id", "등급구분", "서비스종유명", "서비스시간명"], "row_id", hashed=in_place)
    here, there = (F.col("row_id") + 1).cast("string"), (F.col("first_row") + 1).cast("string")
    dup = _row_level(again, 900, "DUP_ROW", "등급구분", ck.message("DUP_ROW", there),
                     F.concat(here, F.lit("행 또는 "), there, F.lit("행 중 하나 삭제")))
    return {"issues": issues.unionByName(dup)}


def validate(flow: str, tab: int, table: DataFrame, constants: DataFrame | None = None,
             basic: DataFrame | None = None, prior: DataFrame | None = None,
             prices: DataFrame | None = None, rules: dict = RULES_2025, in_place: bool = False) -> dict[str, DataFrame]:
    """Dispatch by flow (``unit_price`` or ``notice_verify``) and tab; growth against a prior
    table is added where one is given.  Documents without constants get a notice, not issues.
    ``in_place`` goes to :func:`validate_payment`."""
    if flow != "unit_price":
        out = validate_payment(table, basic, prices, rules, in_place)
        columns = ("지원량", "정부지원금액", "본인부담금액")
    else:
        if constants is None:
            raise ValueError("the unit_price flow needs constants")
        suite = validate_basic if tab == 0 else validate_supplement
        docs = table.select("doc_id").distinct()
        empty = docs.join(not_broadcast(constants.select("doc_id").distinct(), unique=True), "doc_id", "left_anti")
        out = suite(table.join(empty, "doc_id", "left_anti"), constants, rules)
        out["notices"] = empty.withColumn("notice", F.lit("조견표에서 추출한 값이 없어 검증을 건너뛰었습니다."))
        columns = ("지원량", "정부지원금", "본인부담금")
    if prior is not None:
        grown = tb.growth(table.withColumn("등급구분", F.btrim("등급구분")),
                          prior.withColumn("등급구분", F.btrim("등급구분")),
                          ["doc_id", "등급구분"], columns, "row_id")
        text = tb.growth_text({c: F.col(f"growth_{c}") for c in columns}, F.col("is_new"))
        out["growth"] = grown.select(*KEYS, text.alias("growth"), *[f"growth_{c}" for c in columns], "is_new")
    return out
