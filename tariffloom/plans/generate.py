"""Price tables of many documents at once.

Constants arrive as one bounded map per document; rows come from literal dimension arrays
that are exploded in place, so generating needs no join and no cross product of tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.literals import literal_rows
from tariffloom.operators.checks import pinned
from tariffloom.operators.constants import constant_map
from tariffloom.operators.formulas import rule_column
from tariffloom.operators.rulebook import RULES_2025, copay_column
from tariffloom.session import not_broadcast


def _grade_dimension() -> list[dict]:
    """The 158 (kind, variant, base) blocks of a basic table in their order."""
    out = []
    for variant in fixed.VARIANTS:
        out += [dict(kind="ij", variant=variant, base=g, at=n,
                     limit_key=f"{fixed.K_IJ_LIMITS} ({variant}).{g}") for n, g in enumerate(fixed.GRADES)]
        out += [dict(kind="jh", variant=variant, base=z, at=n,
                     limit_key=f"{fixed.K_JH_LIMITS} ({variant}).{z}") for n, z in enumerate(fixed.ZONES)]
    cases = [(grade, main, school, work) for grade, mains in fixed.SPECIAL_CASES
             for main in mains for school, work in fixed.SCHOOL_WORK]
    for variant in fixed.VARIANTS:
        out += [dict(kind="sj", variant=variant, base=f"특례{n + 1}", at=n,
                     limit_key=f"{fixed.K_IJ_LIMITS} (기본형).{grade}",
                     main_key=main and f"{fixed.K_ADD_LIMITS}.{main}", school=school, work=work)
                for n, (grade, main, school, work) in enumerate(cases)]
    return out


def _dimension_array() -> Column:
    rows = [
        (n, d["kind"], d["variant"], d["base"], d["at"], d["limit_key"], d.get("main_key"), d.get("school", False),
         d.get("work", False), fixed.SORT_START[d["kind"], d["variant"]])
        for n, d in enumerate(_grade_dimension())
    ]
    return literal_rows(rows, "block int, kind string, variant string, base string, at int, limit_key string, "
                              "main_key string, school boolean, work boolean, sort_start int")


def special_limit(c: Column, d: Column, rules: dict) -> Column:
    """Monthly limit of a special case: grade, main supplement, school and work allowances."""
    return rule_column(rules["sj_monthly_limit"], {
        "basic_monthly_limit": c[d["limit_key"]].cast("bigint"),
        "main_add_monthly_limit": F.when(d["main_key"].isNull(), 0).otherwise(c[d["main_key"]]).cast("bigint"),
        "is_school": d["school"],
        "school_monthly_limit": c[f"{fixed.K_ADD_LIMITS}.학교생활"].cast("bigint"),
        "is_work": d["work"],
        "work_monthly_limit": c[f"{fixed.K_ADD_LIMITS}.직장생활"].cast("bigint"),
    })


def block_limit(c: Column, d: Column, rules: dict) -> Column:
    """Monthly limit of one block of the basic table."""
    case = special_limit(c, d, rules)
    extended = rule_column(rules["extended_monthly_limit"],
                           {"monthly_limit": case, "unit_price": c[fixed.BASE_PRICE].cast("bigint")})
    return (
        F.when((d["kind"] == "sj") & (d["variant"] == "확장형"), extended)
        .when(d["kind"] == "sj", case)
        .otherwise(c[d["limit_key"]])
        .cast("bigint")
    )


def letter_rates(c: Column, group: str) -> Column:
    return F.array(*[c[f"{group}.{letter}"] for letter in fixed.LETTERS])


def _with_terms(docs: DataFrame, rules: dict) -> DataFrame:
    """Rows (document, block, letter) with limit, rate and cap.

    Limits are looked up before the blocks are exploded, so the map of constants stays behind.
    """
    c, d = F.col("c"), F.col("d")
    blocks = F.transform(_dimension_array(), lambda x: F.struct(
        *[x[n].alias(n) for n in ("block", "kind", "variant", "base", "at", "sort_start")],
        block_limit(c, x, rules).alias("limit")))
    rows = docs.select(
        "doc_id", c[fixed.K_YEAR].cast("int").alias("사업년도"), c[fixed.K_CHASU].cast("int").alias("차수"),
        c[fixed.K_IJ_CAP].cast("bigint").alias("ij_cap"), c[fixed.K_SJ_CAP].cast("bigint").alias("sj_cap"),
        letter_rates(c, fixed.K_IJ_RATES).alias("ij_rates"), letter_rates(c, fixed.K_SJ_RATES).alias("sj_rates"),
        F.explode(blocks).alias("d"),
    )
    first = d["kind"] == "ij"
    rows = rows.select(
        "doc_id", "사업년도", "차수", "d", d["limit"].alias("limit"),
        F.when(first, F.col("ij_cap")).otherwise(F.col("sj_cap")).alias("cap"),
        F.posexplode(F.arrays_zip(
            F.array(*map(F.lit, fixed.LETTERS)).alias("letter"),
            F.when(first, F.col("ij_rates")).otherwise(F.col("sj_rates")).alias("rate"))).alias("k", "l"),
    )
    return rows.select("doc_id", "사업년도", "차수", "d", "limit", "cap", "k", F.col("l.letter").alias("letter"),
                       F.col("l.rate").alias("rate"))


def document_terms(constants: DataFrame, rules: dict = RULES_2025) -> DataFrame:
    """One row a document: the limit of each of its blocks, the rates of its tiers, its caps, and ``emergency``,
    the limit of the thirteenth zone.  :func:`block_place` finds a grade's block."""
    c = F.col("c")
    return constant_map(constants).select(
        "doc_id", F.transform(_dimension_array(), lambda x: block_limit(c, x, rules)).alias("limits"),
        letter_rates(c, fixed.K_IJ_RATES).alias("ij_rates"), letter_rates(c, fixed.K_SJ_RATES).alias("sj_rates"),
        c[fixed.K_IJ_CAP].cast("bigint").alias("ij_cap"), c[fixed.K_SJ_CAP].cast("bigint").alias("sj_cap"),
        c[f"{fixed.K_JH_LIMITS} (기본형).13구간"].cast("bigint").alias("emergency"))


def block_place(base: Column, variant: Column) -> Column:
    """0-based place of a grade in the blocks of a basic table, null if there is none."""
    places: dict[str, dict[str, int]] = {}
    for n, d in enumerate(_grade_dimension()):
        places.setdefault(d["variant"], {})[d["base"]] = n
    # both variants name the same grades in the same order, so one list of names serves
    names = list(places[fixed.VARIANTS[0]])
    at = F.array_position(F.array(*map(F.lit, names)), base).cast("int") - 1
    chosen = None
    for variant_name, own in places.items():
        place = F.get(F.array(*[F.lit(own[name]) for name in names]), at)
        chosen = F.when(variant == variant_name, place) if chosen is None else chosen.when(variant == variant_name, place)
    return chosen


def expected_terms(constants: DataFrame, rules: dict = RULES_2025) -> DataFrame:
    """What a basic table must contain: limit, rate and cap by base, variant and letter."""
    rows = _with_terms(constant_map(constants), rules)
    return rows.select(
        "doc_id", F.col("d.kind").alias("kind"), F.col("d.base").alias("base"),
        F.col("d.variant").alias("variant"), "letter", "limit", "rate", "cap",
    )


def basic_table(constants: DataFrame, rules: dict = RULES_2025, in_place: bool = False) -> DataFrame:
    """The basic price table: 950 rows per document, in the tasks of its constants if ``in_place``."""
    docs = constant_map(constants, in_place=in_place)
    d, k, c = F.col("d"), F.col("k"), F.col("c")
    rows = _with_terms(docs, rules)
    copay = copay_column(rules, F.col("limit"), F.col("cap"), F.col("letter"), F.col("rate"), d["variant"])
    prefix = F.when(d["variant"] == "기본형", "D").otherwise("C")
    step = d["at"] * 6 + k
    code = (
        F.when(d["kind"] == "ij", F.lpad((step + 1).cast("string"), 3, "0"))
        .when(d["kind"] == "jh", (step + 501).cast("string"))
        .otherwise(F.concat(
            F.substring(F.lit("ABCD"), F.floor(d["at"] / 15).cast("int") + 1, F.lit(1)),
            F.lpad(((d["at"] % 15) * 6 + k + 1).cast("string"), 2, "0"),
        ))
    )
    label = {n: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for n, m in
             (("ij", fixed.IJ_INCOME), ("jh", fixed.JH_INCOME))}
    year, chasu = c[fixed.K_YEAR].cast("int"), c[fixed.K_CHASU].cast("int")
    # worked out ahead: together with the rest it is more code than the JVM compiles
    rows = pinned(rows, {"__copay": copay.cast("bigint")})
    rows = pinned(rows, {"__code": F.concat(prefix, code)})
    regular = rows.select(
        "doc_id",
        (d["block"] * 6 + k + 1).alias("안"),
        "사업년도", "차수",
        F.col("__code").alias("등급구분"),
        F.concat(d["base"], F.lit("("), "letter", F.lit("형)"),
                 F.when(d["variant"] == "기본형", "").otherwise("_주간확장")).alias("등급명"),
        F.col("limit").alias("지원량"),
        F.col("__copay").alias("본인부담금"),
        F.when(d["kind"] == "ij", label["ij"][F.col("letter")]).otherwise(label["jh"][F.col("letter")]).alias("소득구분"),
        (d["sort_start"] + step).alias("정렬순서"),
    )
    emergency = c[f"{fixed.K_JH_LIMITS} (기본형).13구간"].cast("bigint")
    extra = F.array(
        F.struct(F.lit(949).alias("안"), F.lit("D599").alias("등급구분"), F.lit("긴급활동지원").alias("등급명"),
                 emergency.alias("지원량"), F.lit(1441).alias("정렬순서")),
        F.struct(F.lit(950).alias("안"), F.lit("9999").alias("등급구분"), F.lit("부적합").alias("등급명"),
                 F.lit(0).cast("bigint").alias("지원량"), F.lit(1443).alias("정렬순서")),
    )
    special = docs.select("doc_id", year.alias("사업년도"), chasu.alias("차수"), F.explode(extra).alias("x")).select(
        "doc_id", "x.안", "사업년도", "차수", "x.등급구분", "x.등급명", "x.지원량",
        F.lit(0).cast("bigint").alias("본인부담금"), F.lit(fixed.NO_INCOME).alias("소득구분"), "x.정렬순서",
    )
    table = regular.unionByName(special).withColumn("정부지원금", rule_column(
        rules["government_support"], {"monthly_limit": F.col("지원량"), "copayment": F.col("본인부담금")}))
    none = F.lit(None).cast("string")
    return table.withColumns({
        "사업유형ID": F.lit(fixed.BUSINESS_ID), "바우처구분": F.lit(fixed.VOUCHER), "": none,
        "재판정여부": F.lit(fixed.NO_REJUDGE), "재판정기간": none, "소득기준ID": none, "소득기준년도": none,
        "물품코드": none,
    }).select("doc_id", *[F.col(f"`{n}`") for n in fixed.BASIC_COLUMNS])


def supplement_table(constants: DataFrame, rules: dict = RULES_2025) -> DataFrame:
    """The supplementary price table: 72 rows per document."""
    items = literal_rows(
        [(n, key, *spec) for n, (key, spec) in enumerate(fixed.ADD_CODES.items())],
        "at int, item string, code int, name string, category string")
    c, x, k = F.col("c"), F.col("x"), F.col("k")
    limited = F.transform(items, lambda i: F.struct(
        *[i[n].alias(n) for n in ("at", "code", "name", "category")],
        c[F.concat(F.lit(fixed.K_ADD_LIMITS + "."), i["item"])].cast("bigint").alias("limit")))
    lettered = F.arrays_zip(F.array(*map(F.lit, fixed.LETTERS)).alias("letter"), F.col("rates").alias("rate"))
    rows = constant_map(constants).select(
        "doc_id", letter_rates(c, fixed.K_ADD_RATES).alias("rates"), F.explode(limited).alias("x")
    ).select("doc_id", "x", F.posexplode(lettered).alias("k", "l")).select(
        "doc_id", "x", F.col("x.limit").alias("limit"), "k", F.col("l.letter").alias("letter"),
        F.col("l.rate").alias("rate"))
    rate = F.col("rate")
    income = F.create_map(*[F.lit(v) for kv in fixed.IJ_INCOME.items() for v in kv])
    copay = rule_column(rules["add_copayment"], {
        "monthly_limit": F.col("limit"), "income_range": F.col("letter"), "copayment_rate": rate})
    return rows.select(
        "doc_id", (x["at"] * 6 + k + 1).alias("순번"),
        F.concat(F.lit("A"), F.lpad((x["code"] + k).cast("string"), 3, "0")).alias("등급구분"),
        F.concat(x["name"], F.lit("_"), "letter", F.lit("형")).alias("등급명"),
        F.col("limit").alias("지원량"), copay.cast("bigint").alias("본인부담금"),
        income[F.col("letter")].alias("소득구분"), x["category"].alias("추가급여구분"),
    ).withColumn("정부지원금", F.col("지원량") - F.col("본인부담금")).select("doc_id", *fixed.ADD_COLUMNS)


def _service_dimension() -> list[tuple]:
    """The 25 services: (type, kind, minutes, price key, night key, mode)."""
    out = [("활동보조", kind, minutes, "활동보조.일반", night, mode)
           for minutes, night, mode in ((30, "활동보조.일반", "half"), (60, "활동보조.심야", "full"))
           for kind in fixed.HELP_KINDS]
    out += [("방문간호", kind, minutes, f"방문간호.{slot}", f"방문간호.{slot}", "full")
            for slot, minutes in fixed.NURSE_TIMES.items() for kind in fixed.NURSE_KINDS]
    out += [("방문목욕", kind, minutes, f"방문목욕.{kind}", f"방문목욕.{kind}", mode)
            for minutes, mode in ((40, "bath"), (60, "full")) for kind in ("차량내입욕", "가정내입욕")]
    return out + [("방문간호지시서", kind, 60, key, key, "full")
                  for kind in list(fixed.SERVICE_KIND)[9:]
                  for key in [f"방문간호지시서.{kind.replace(' ', '_')}"]]


def service_keys() -> list[str]:
    return sorted({key for s in _service_dimension() for key in s[3:5]})


def service_bundles(prices: DataFrame, rules: dict = RULES_2025, in_place: bool = False) -> DataFrame:
    """One row per document: ``services``, its 25 (type, kind, time) entries with day and night prices."""
    per_type: dict[str, int] = {}
    entries = []
    for kind_type, kind, minutes, day_key, night_key, mode in _service_dimension():
        type_id = fixed.SERVICE_TYPE[kind_type]
        at = per_type.setdefault(type_id, 0)
        per_type[type_id] += 1
        entries.append((type_id, kind_type, fixed.SERVICE_KIND[kind], kind, minutes, fixed.TIME_NAME[minutes],
                        day_key, night_key, mode, at))
    dimension = literal_rows(entries, "`서비스유형ID` string, `서비스유형명` string, `서비스종류` string, `서비스종유명` string, "
                                      "`서비스시간` int, `서비스시간명` string, day_key string, night_key string, "
                                      "mode string, svc_at int")
    c = F.col("c")
    names = ("서비스유형ID", "서비스유형명", "서비스종류", "서비스종유명", "서비스시간", "서비스시간명", "svc_at")
    looked_up = F.transform(dimension, lambda e: F.struct(
        *[e[n].alias(n) for n in (*names, "mode")], c[e["day_key"]].cast("bigint").alias("day"),
        c[e["night_key"]].cast("bigint").alias("night")))

    def priced(s: Column) -> Column:
        def by(rule_id: str, var: str) -> Column:
            return rule_column(rules[rule_id], {var: s["day"]})

        bath = by("bath_40min", "price_60min")
        unit = F.when(s["mode"] == "half", by("activity_support_30min", "unit_price")).when(
            s["mode"] == "bath", bath).otherwise(s["day"])
        unit_night = F.when(s["mode"] == "half", by("activity_support_30min_night", "unit_price")).when(
            s["mode"] == "bath", bath).otherwise(F.coalesce(s["night"], s["day"]))
        return F.struct(*[s[n].alias(n) for n in names], unit.cast("bigint").alias("단위기준단가"),
                        unit_night.cast("bigint").alias("단위기준심야단가"))

    return constant_map(prices, service_keys(), in_place).select("doc_id", F.transform(looked_up, priced).alias("services"))


def service_rows(prices: DataFrame, rules: dict = RULES_2025) -> DataFrame:
    """25 (type, kind, time) rows with day and night prices per document."""
    return service_bundles(prices, rules).select("doc_id", F.inline("services"))


def payable_grades(basic: DataFrame) -> DataFrame:
    """Grades that can be paid, by code; fails on missing columns."""
    need = ["등급구분", "등급명", "지원량", "정부지원금", "본인부담금"]
    missing = [n for n in need if n not in basic.columns]
    if missing:
        raise ValueError(f"missing columns in the basic table: {missing}")
    return basic.select("doc_id", *need).filter(~F.col("등급구분").isin(*fixed.EXCLUDED_GRADES))


def payment_parts(basic: DataFrame, prices: DataFrame, rules: dict = RULES_2025,
                  in_place: bool = False) -> tuple[DataFrame, DataFrame]:
    """The payment table before it multiplies: its grades, and one row of ``services`` a document.

    A service's rows have the numbers ``start * n_grades + offset + (grade_no - 1) * width``, where a document's
    ``n_grades`` grades are numbered from 1 by code.  Tables that are dealt out by document stay in their tasks.
    """
    share = {n: F.round(F.col(n) / F.nullif(F.col("지원량"), F.lit(0)), 10) for n in ("정부지원금", "본인부담금")}
    # rounded once a grade, before the services multiply it
    grades = payable_grades(basic).withColumns({"정부지원금율": share["정부지원금"], "본인부담금율": share["본인부담금"]})
    sizes = fixed.SERVICE_COUNTS
    before = F.create_map(*[F.lit(x) for n, t in enumerate(sorted(sizes))
                            for x in (t, sum(sizes[u] for u in sorted(sizes)[:n]))])
    width = F.create_map(*[F.lit(x) for t, n in sizes.items() for x in (t, n)])
    services = service_bundles(prices, rules, in_place).withColumn("services", F.transform("services", lambda s: s.withField(
        "start", before[s["서비스유형ID"]]).withField("width", width[s["서비스유형ID"]]).withField("offset", s["svc_at"] + 1)))
    return grades, services


def payment_table(basic: DataFrame, prices: DataFrame, year: Column | None = None, chasu: Column | None = None,
                  rules: dict = RULES_2025, in_place: bool = False) -> DataFrame:
    """The payment table: every payable grade with every service of its document.

    Running numbers are arithmetic: only the grades are numbered, before they multiply.  ``in_place``: both inputs
    are dealt out by document, into equally many tasks, and the table grows there without a shuffle.
    """
    grades, services = payment_parts(basic, prices, rules, in_place)
    document = Window.partitionBy("doc_id")
    grades = grades.withColumns({"grade_no": F.row_number().over(document.orderBy("등급구분")).cast("bigint"),
                                 "n_grades": F.count("*").over(document)})
    year = F.lit(None).cast("int") if year is None else year
    chasu = F.lit(1) if chasu is None else chasu
    rows = grades.join(not_broadcast(services, unique=True), "doc_id").select(*grades.columns, F.inline("services"))
    return rows.withColumns({
        "순번": F.col("start") * F.col("n_grades") + F.col("offset") + (F.col("grade_no") - 1) * F.col("width"),
        "사업년도": year, "차수": chasu,
        **{n: F.lit(v) for n, v in fixed.BUSINESS.items()},
        "정부지원금액": F.col("정부지원금"), "본인부담금액": F.col("본인부담금"),
        "사용여부": F.lit("Y"),
        "서비스시작일자": year * 10000 + 101, "서비스종료일자": year * 10000 + 1231,
        "단가관리레벨": F.lit(0), "비고": F.lit(" "),
    }).select("doc_id", *fixed.PAYMENT_COLUMNS)


def service_row_problems(services: DataFrame) -> DataFrame:
    """Service types with an unexpected number of rows, and rows with impossible prices."""
    expected = F.array(*[F.struct(F.lit(t).alias("서비스유형ID"), F.lit(n).alias("expected"))
                         for t, n in fixed.SERVICE_COUNTS.items()])
    want = services.select("doc_id").distinct().select("doc_id", F.inline(expected))
    have = services.groupBy("doc_id", "서비스유형ID").agg(F.count("*").alias("actual"))
    counts = want.join(have, ["doc_id", "서비스유형ID"], "full_outer").filter(
        ~F.col("expected").eqNullSafe(F.col("actual"))
    ).select("doc_id", F.lit("COUNT").alias("code"), "서비스유형ID",
             F.col("expected").cast("bigint").alias("expected"), "actual")
    day, night = F.col("단위기준단가"), F.col("단위기준심야단가")
    prices = services.select(
        "doc_id", F.when(day <= 0, "NOT_POSITIVE").when(night < day, "NIGHT_BELOW_DAY").alias("code"),
        "서비스유형ID", day.alias("expected"), night.alias("actual"),
    ).filter(F.col("code").isNotNull())
    return counts.unionByName(prices)
