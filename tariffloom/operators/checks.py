"""Row checks of price tables.

A check is a test and the finding it gives.  A suite first filters rows by the plain tests,
which stay in generated code, and spells out findings (with their texts) only for the few rows
that fail.  Tables are checked in a single pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.numbers import floor_100
from tariffloom.functions.text import grouped_number

@dataclass(frozen=True)
class Check:
    """Where ``test`` holds, ``column`` is wrong; ``expected`` is the suggested value if any."""

    test: Column
    code: str
    column: str | None
    reason: Column
    expected: Column
    actual: Column
    fixes: Column

    def where(self, condition: Column) -> Check:
        """The same check on fewer rows."""
        return Check(sure(condition) & self.test, self.code, self.column, self.reason, self.expected, self.actual, self.fixes)


def sure(test: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(test, F.lit(False))


def any_of(checks: Sequence[Check]) -> Column:
    return reduce(lambda a, b: a | b, [c.test for c in checks])


def first_of(*checks: Check) -> list[Check]:
    """Of several explanations the first that holds."""
    out: list[Check] = []
    for check in checks:
        out.append(check.where(~any_of(out)) if out else check)
    return out


def change(column: str, old: Column, new: Column) -> Column:
    """Fix text ``column old → new``."""
    return F.concat(F.lit(column + " "), grouped_number(old.cast("double")), F.lit(" → "),
                    grouped_number(new.cast("double")))


def finding(test: Column, code: str, column: str | None, expected: Column | None = None,
            actual: Column | None = None, fixes: Sequence[Column] = (), reason: Column | None = None) -> Check:
    none = F.lit(None)
    return Check(
        sure(test), code, column, F.lit(fixed.MESSAGES[code]) if reason is None else reason,
        (none if expected is None else expected).cast("double"), (none if actual is None else actual).cast("double"),
        (F.array(*fixes) if fixes else F.array()).cast("array<string>"))


def message(code: str, *parts: Column) -> Column:
    """A message text with its ``{}`` places filled."""
    pieces = fixed.MESSAGES[code].split("{}")
    out = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        out += [part, F.lit(piece)]
    return F.concat(*out)


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once per row.

    The optimizer copies a projected expression into every later filter and projection that
    names it; nested conditions then grow beyond what code generation takes.  A generator of
    exactly one row keeps them apart.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(one))


def with_grade(df: DataFrame, name: str = "등급명") -> DataFrame:
    """Adds ``kind, base, letter, variant`` of grade names, each pattern matched once per row."""
    text = F.btrim(F.coalesce(F.col(name), F.lit("")))
    df = pinned(df, {"__text": text})
    part = lambda pattern, n: F.regexp_extract("__text", pattern, n)
    df = pinned(df, {
        "__base": part(fixed.GRADE_NAME, 1), "__letter": part(fixed.GRADE_NAME, 2), "__ext": part(fixed.GRADE_NAME, 3),
        "__add": part(fixed.ADD_NAME, 1), "__add_letter": part(fixed.ADD_NAME, 2)})
    base, tiered = F.col("__base"), F.col("__letter").isin(*fixed.LETTERS)
    kind = (
        F.when(F.col("__text").isin(*fixed.SPECIAL_GRADES), "special")
        .when((base != "") & ~tiered, "unknown")
        .when(base.rlike("^[0-9]등급$"), "ij").when(base.rlike("^[0-9]+구간$"), "jh").when(base.rlike("^특례[0-9]+$"), "sj")
        .when((base == "") & F.col("__add_letter").isin(*fixed.LETTERS), "add")
        .otherwise("unknown")
    )
    df = pinned(df, {"kind": kind})
    graded, add = F.col("kind").isin("ij", "jh", "sj"), F.col("kind") == "add"
    return pinned(df, {
        "base": F.when(graded, base).when(add, F.col("__add")).otherwise(F.col("__text")),
        "letter": F.when(graded, F.col("__letter")).when(add, F.col("__add_letter")).otherwise(""),
        "variant": F.when(graded & (F.col("__ext") != ""), "확장형").otherwise("기본형"),
    }).drop("__text", "__base", "__letter", "__ext", "__add", "__add_letter")


def explode_findings(df: DataFrame, keys: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """One row per finding, ``ord`` keeping the order of the checks.

    All tests are evaluated once; rows that pass them go no further.
    """
    tested = pinned(df, {f"__t{n}": c.test for n, c in enumerate(checks)})
    failing = tested.filter(reduce(lambda a, b: a | b, [F.col(f"__t{n}") for n in range(len(checks))]))
    failed = F.array_compact(F.array(*[F.when(F.col(f"__t{n}"), F.lit(n)) for n in range(len(checks))]))
    found = failing.withColumn("ord", F.explode(failed))

    def chosen(part: Callable[[Check], Column]) -> Column:
        return reduce(lambda case, n: case.when(F.col("ord") == n, part(checks[n])), range(1, len(checks)),
                      F.when(F.col("ord") == 0, part(checks[0])))

    # each part of a finding is a column of its own, so what is not asked for is not worked out
    return found.select(*keys, "ord", *[chosen(part).alias(name) for name, part in (
        ("code", lambda c: F.lit(c.code)), ("column", lambda c: F.lit(c.column).cast("string")), ("reason", lambda c: c.reason),
        ("expected", lambda c: c.expected), ("actual", lambda c: c.actual), ("fixes", lambda c: c.fixes))])


def limit_check(code: str, column: str, limit: Column, support: Column) -> Check:
    return finding(limit.isNotNull() & (support != limit), code, column, limit, support,
                   [change(column, support, limit)])


def recompute_check(code: str, column: str, other: str, expected: Column, actual: Column,
                    total: Column) -> Check:
    """Stored value against its formula; the counterpart follows from the total."""
    follow = F.concat(F.lit(f"동시에 {other} → "),
                      grouped_number((F.coalesce(total, F.lit(0)) - expected).cast("double")))
    return finding(actual != expected, code, column, expected, actual,
                   [change(column, actual, expected), follow])


def sum_check(total_col: str, part_col: str, share_col: str, total: Column, part: Column, share: Column,
              total_ok: Column | None = None, share_ok: Column | None = None) -> list[Check]:
    """total = part + share; the blame falls on what is not confirmed otherwise."""
    off = (part + share) != total
    total_ok = F.lit(False) if total_ok is None else sure(total_ok)
    share_ok = F.lit(False) if share_ok is None else sure(share_ok)
    fix_part = change(part_col, part, total - share)
    fix_share = change(share_col, share, total - part)
    fix_total = change(total_col, total, part + share)
    return first_of(
        finding(off & total_ok & share_ok, "SUM_GOV", part_col, total - share, part, [fix_part]),
        finding(off & total_ok, "SUM_RIGHT", part_col, total, part + share, [fix_part, fix_share]),
        finding(off, "SUM_ANY", total_col, total, part + share, [fix_part, fix_share, fix_total]),
    )


def granularity_check(code: str, column: str, value: Column) -> Check:
    whole = floor_100(value)
    return finding(value != whole, code, column, whole, value, [change(column, value, whole)])


def cap_check(column: str, other: str, value: Column, cap: Column, total: Column, part: Column) -> Check:
    both = F.concat(change(column, value, cap), F.lit(" (동시에 "),
                    change(other, part, F.coalesce(total, F.lit(0)) - cap), F.lit(")"))
    return finding(value > cap, "CAP", column, cap, value, [both],
                   message("CAP", grouped_number(cap.cast("double"))))


def rate_deviation(letter: Column, support: Column, copay: Column, rate: Column, cap: Column) -> Column:
    """Warning text where the paid share strays from the stated rate by more than cutting to
    hundreds explains; capped rows are exempt."""
    stated, actual = rate * 100, copay / F.nullif(support, F.lit(0)) * 100
    tolerance = F.lit(10000.0) / F.nullif(support, F.lit(0))
    applies = (
        ~letter.isin("가", "나") & (rate < 1) & (support != 0) & copay.isNotNull()
        & ~F.coalesce(floor_100(support * rate) >= cap, F.lit(False))
    )
    text = F.concat(
        F.lit("본인부담률이 조견표와 다름 (조견표 "), short_number(stated), F.lit("% · 실제 "),
        F.format_string("%.2f", actual), F.lit("%)"),
    )
    return F.when(applies & (F.abs(actual - stated) > tolerance + 1e-9), text)


def short_number(value: Column) -> Column:
    """Number without trailing zeros, at most six significant decimals."""
    return F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", "")


def rate_text(rate: Column) -> Column:
    return F.when(rate.isNull(), "?").when(rate < 1, F.concat(short_number(rate * 100), F.lit("%"))).otherwise(
        F.concat(F.lit("정액 "), F.format_number(rate, 0), F.lit("원"))
    )


def rate_metric(base: Column, letter: Column, variant: Column, support: Column, copay: Column,
                rate: Column, cap: Column) -> Column:
    """Metric lines of a row: stated and actual share, their gap, and whether the cap applied."""
    head = F.concat(base, F.lit("("), letter, F.lit("형)"),
                    F.when(variant == "기본형", "").otherwise(" · 주간확장"))
    actual = F.coalesce(copay, F.lit(0)) / F.nullif(support, F.lit(0)) * 100
    capped = F.coalesce((rate < 1) & (floor_100(support * rate) >= cap), F.lit(False))
    share = F.concat(
        F.lit("부담률: 조견표 "), rate_text(rate), F.lit(" · 실제 "), F.format_string("%.2f", actual), F.lit("%"),
        F.when(rate < 1, F.concat(F.lit(" · 차이 "), F.format_string("%+.2f", actual - rate * 100), F.lit("%")))
        .otherwise(""),
        F.when(capped, "  ← 상한 적용").otherwise(""),
        F.lit("\n※ 100원 절사로 실제가 조금 낮게 나오는 것은 정상"),
    )
    second = F.concat(
        F.lit("부담률: "),
        F.when(variant == "확장형", "면제 (확장형 차상위)").otherwise(F.concat(rate_text(rate), F.lit(" (차상위)"))),
    )
    body = (
        F.when(letter == "가", "부담률: 면제 (기초수급자)")
        .when(letter == "나", second)
        .when(rate.isNotNull() & (support != 0), share)
    )
    return F.concat_ws("\n", head, body)


def copay_steps(letter: Column, variant: Column, support: Column, rate: Column, cap: Column) -> Column:
    """How a copayment is computed, step by step."""
    raw = support * rate
    cut = floor_100(raw)
    money = lambda c: F.format_number(c, 0)
    fixed_sum = F.concat(
        F.lit("나형(차상위)은 비율이 아니라 정액으로 부담합니다.\n · 정액 "), money(rate), F.lit("원과 상한액 "),
        F.coalesce(money(cap), F.lit("-")), F.lit("원 중 작은 금액\n∴ 본인부담금 = "),
        money(F.least(rate, F.coalesce(cap, rate))), F.lit("원"),
    )
    steps = F.concat(
        F.lit("계산 과정\n ① 지원량 × 부담률 "), short_number(rate * 100), F.lit("% = "), money(support), F.lit(" × "),
        short_number(rate), F.lit(" = "), money(raw), F.lit("원\n ② 100원 미만 버림 → "), money(cut), F.lit("원"),
        F.when(cap.isNull(), F.concat(F.lit("\n∴ 본인부담금 = "), money(cut), F.lit("원")))
        .when(cut >= cap, F.concat(F.lit("\n ③ 상한액 "), money(cap),
                                   F.lit("원과 비교 → 상한액이 더 작으므로 상한액 적용\n∴ 본인부담금 = "), money(cap),
                                   F.lit("원 (상한 적용)")))
        .otherwise(F.concat(F.lit("\n ③ 상한액 "), money(cap),
                            F.lit("원과 비교 → 계산값이 더 작으므로 그대로 적용\n∴ 본인부담금 = "), money(cut), F.lit("원"))),
    )
    return (
        F.when(letter == "가", "가형(기초수급자)은 본인부담금이 면제되어 0원입니다.")
        .when((letter == "나") & (variant == "확장형"),
              "나형(차상위)은 확장형(주간확장)에서 본인부담금이 면제되어 0원입니다.")
        .when(letter == "나", fixed_sum)
        .otherwise(steps)
    )


def with_five_value_terms(df: DataFrame, support: Column, gov: Column, copay: Column, gov_rate: Column,
                          copay_rate: Column, tolerance: float = 1e-6) -> DataFrame:
    """Adds what the five-value checks decide by, as columns ``v_*``."""
    df = pinned(df, {"v_s": support, "v_g": gov, "v_c": copay, "v_gr": gov_rate, "v_cr": copay_rate})
    s, g, c, gr, cr = (F.col(f"v_{n}") for n in ("s", "g", "c", "gr", "cr"))
    whole, alt = F.nullif(s, F.lit(0)), F.nullif(g + c, F.lit(0))
    near = lambda rate, share: F.abs(rate - share) <= tolerance
    df = pinned(df, {
        "v_use": sure(s != 0), "v_sum_ok": sure(g + c == s), "v_gr_ok": near(gr, g / whole), "v_cr_ok": near(cr, c / whole),
        "v_by_gov": sure(near(cr, (s - g) / whole)), "v_by_copay": sure(near(gr, (s - c) / whole)),
        "v_by_sum": sure(near(gr, g / alt) & near(cr, c / alt)),
    })
    gr_ok, cr_ok = F.col("v_gr_ok"), F.col("v_cr_ok")
    rated = gr_ok.isNotNull() & cr_ok.isNotNull()
    off = F.col("v_use") & ~F.col("v_sum_ok")
    # 1 copay wrong, 2 government share wrong, 3 support wrong, 4 undecided
    cause = (
        F.when(~off, 0).when(rated & sure(gr_ok) & F.col("v_by_gov"), 1).when(rated & sure(cr_ok) & F.col("v_by_copay"), 2)
        .when(rated & F.col("v_by_sum"), 3).otherwise(4)
    )
    return pinned(df, {"v_cause": cause, "v_rated": rated})


def five_value_checks() -> list[Check]:
    """Which of support, two amounts and two rates is wrong, judged by their relations.

    At most one explanation of an off sum applies; the rate findings follow when several
    values are off together.  Rows come from :func:`with_five_value_terms`.
    """
    s, g, c, gov_rate, copay_rate = (F.col(f"v_{n}") for n in ("s", "g", "c", "gr", "cr"))
    whole = F.nullif(s, F.lit(0))
    cause, use, sum_ok = F.col("v_cause"), F.col("v_use"), F.col("v_sum_ok")
    gr_ok, cr_ok = F.col("v_gr_ok"), F.col("v_cr_ok")
    exp_gr, exp_cr = F.round(g / whole, 10), F.round(c / whole, 10)

    def rate_fix(column: str, old: Column, new: Column) -> Column:
        return F.concat(F.lit(column + " "), old.cast("string"), F.lit(" → "), new.cast("string"))

    fix_gr = [rate_fix("정부지원금율", gov_rate, exp_gr)]
    fix_cr = [rate_fix("본인부담금율", copay_rate, exp_cr)]
    open_ = use & ((cause == 0) | (cause == 4))
    lone_gr = F.col("v_rated") & sum_ok & sure(cr_ok)
    lone_cr = F.col("v_rated") & sum_ok & sure(gr_ok)
    return [
        finding(cause == 1, "FIVE_COPAY", "본인부담금액", s - g, c, [change("본인부담금액", c, s - g)]),
        finding(cause == 2, "FIVE_GOV", "정부지원금액", s - c, g, [change("정부지원금액", g, s - c)]),
        finding(cause == 3, "FIVE_SUPPORT", "지원량", g + c, s, [change("지원량", s, g + c)]),
        finding(cause == 4, "FIVE_SUM", "지원량", s, g + c,
                [change("정부지원금액", g, s - c), change("본인부담금액", c, s - g), change("지원량", s, g + c)]),
        finding(open_ & lone_gr & ~gr_ok, "FIVE_GOV_RATE", "정부지원금율", exp_gr, gov_rate, fix_gr),
        finding(open_ & ~lone_gr & ~gr_ok, "GOV_RATE_OFF", "정부지원금율", exp_gr, gov_rate, fix_gr),
        finding(open_ & lone_cr & ~cr_ok, "FIVE_COPAY_RATE", "본인부담금율", exp_cr, copay_rate, fix_cr),
        finding(open_ & ~lone_cr & ~cr_ok, "COPAY_RATE_OFF", "본인부담금율", exp_cr, copay_rate, fix_cr),
    ]
