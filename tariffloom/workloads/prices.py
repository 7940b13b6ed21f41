"""Rules, row checks and whole-table checks on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.labels import grade_name
from tariffloom.functions.numbers import floor_100
from tariffloom.operators import checks as ck
from tariffloom.operators import tables as tb
from tariffloom.operators.formulas import rule_column
from tariffloom.operators.rulebook import RULES_2025, RULES_2026, by_year, copay_column
from tariffloom.workloads.registry import table, workload

# lineitem read as price rows: support, rate, letter, variant; the letter follows the quantity
PRICE_SQL = """
price as (
  select l_orderkey, l_linenumber, l_returnflag,
         cast(floor(l_extendedprice) as bigint) as support,
         l_discount as rate, l_tax as tax,
         substr('가나다라마바', 1 + cast(l_quantity as bigint) % 6, 1) as letter,
         case when l_linestatus = 'O' then '확장형' else '기본형' end as variant
  from lineitem),
copay as (
  select *, case when letter = '가' then 0
       when letter = '나' then case when variant = '확장형' then 0 else 20000 end
       else least(cast(floor(support * rate / 100) * 100 as bigint), 3000) end as copay
  from price)
"""


def price_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.floor("l_extendedprice").alias("support"), F.col("l_discount").alias("rate"), F.col("l_tax").alias("tax"),
        F.substring(F.lit("가나다라마바"), (1 + F.col("l_quantity").cast("bigint") % 6).cast("int"), F.lit(1)).alias("letter"),
        F.when(F.col("l_linestatus") == "O", "확장형").otherwise("기본형").alias("variant"),
    )


def with_copay(rows):
    return ck.pinned(rows, {"copay": copay_column(
        RULES_2025, F.col("support"), F.lit(3000), F.col("letter"), F.col("rate"), F.col("variant")).cast("bigint")})


@workload("flagship_recompute", "R1 R2 R3 R5 V4 V5", f"""
with {PRICE_SQL},
stored as (select *, copay + case when l_orderkey % 97 = 0 then 100 else 0 end as stored,
                  support - copay as gov from copay)
select l_returnflag, count(*) as n_rows,
       cast(sum(case when stored <> copay then 1 else 0 end) as bigint) as copay_issues,
       cast(sum(case when gov + stored <> support then 1 else 0 end) as bigint) as sum_issues,
       cast(sum(copay) as bigint) as total_copay
from stored group by l_returnflag""")
def flagship_recompute(spark, sf):
    """Recompute every copayment, find rows off their formula or identity, count by flag."""
    rows = with_copay(price_rows(spark, sf)).withColumns({
        "stored": F.col("copay") + F.when(F.col("l_orderkey") % 97 == 0, 100).otherwise(0),
        "gov": F.col("support") - F.col("copay"),
    })
    wrong = ck.recompute_check("COPAY", "본인부담금", "정부지원금", F.col("copay"), F.col("stored"), F.col("support"))
    off = ck.sum_check("지원량", "정부지원금", "본인부담금", F.col("support"), F.col("gov"), F.col("stored"))
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.count_if(wrong.test).alias("copay_issues"),
        F.count_if(ck.any_of(off)).alias("sum_issues"), F.sum("copay").alias("total_copay"))


@workload("rule_copay", "R1 R2 R3 R5", f"""
with {PRICE_SQL} select l_orderkey, l_linenumber, support, letter, variant, copay from copay""")
def rule_copay(spark, sf):
    return with_copay(price_rows(spark, sf)).select(
        "l_orderkey", "l_linenumber", "support", "letter", "variant", "copay")


@workload("rule_roundup_extended", "R1 R4", """
with o as (select o_orderkey, cast(floor(o_totalprice) as bigint) as lim,
                  15000 + o_custkey % 4000 as price, cast(year(o_orderdate) as integer) as y from orders),
f as (select *, cast(ceil((floor(lim / price) - 22) * price / 1000) * 1000 as bigint) as form_2025,
             cast(ceil((lim - price * 22) / 1000) * 1000 as bigint) as form_2026 from o)
select o_orderkey, form_2025, form_2026, case when y >= 1998 then form_2026 else form_2025 end as by_year from f""")
def rule_roundup_extended(spark, sf):
    o = table(spark, sf, "orders")
    bound = {"monthly_limit": F.floor("o_totalprice"), "unit_price": 15000 + F.col("o_custkey") % 4000}
    return o.select(
        "o_orderkey",
        rule_column(RULES_2025["extended_monthly_limit"], bound).cast("bigint").alias("form_2025"),
        rule_column(RULES_2026["extended_monthly_limit"], bound).cast("bigint").alias("form_2026"),
        by_year("extended_monthly_limit", {0: RULES_2025, 1998: RULES_2026}, F.year("o_orderdate"), bound)
        .cast("bigint").alias("by_year"),
    )


@workload("rule_unit_prices", "R4", """
with p as (select p_partkey, cast(floor(p_retailprice * 10) as bigint) as price from part)
select p_partkey, cast(floor(price * 0.5::double / 10) * 10 as bigint) as half_hour,
       cast(floor(floor(price * 0.5::double / 10) * 10 * 1.5::double / 10) * 10 as bigint) as half_hour_night,
       cast(floor(price * 0.8::double / 10) * 10 as bigint) as bath_40min from p""")
def rule_unit_prices(spark, sf):
    price = F.floor(F.col("p_retailprice") * 10)
    return table(spark, sf, "part").select(
        "p_partkey",
        rule_column(RULES_2025["activity_support_30min"], {"unit_price": price}).cast("bigint").alias("half_hour"),
        rule_column(RULES_2025["activity_support_30min_night"], {"unit_price": price}).cast("bigint").alias("half_hour_night"),
        rule_column(RULES_2025["bath_40min"], {"price_60min": price}).cast("bigint").alias("bath_40min"),
    )


@workload("identity_blame", "V5", f"""
with {PRICE_SQL},
bad as (select *, support - copay + case when l_orderkey % 97 = 0 then 100 else 0 end as gov,
               copay + case when l_orderkey % 89 = 0 then 100 else 0 end as stored,
               (l_linenumber % 2 = 0) as support_ok from copay),
off as (select *, (stored = copay) as copay_ok from bad where gov + stored <> support)
select l_orderkey, l_linenumber,
  case when support_ok and copay_ok then 'SUM_GOV' when support_ok then 'SUM_RIGHT' else 'SUM_ANY' end as code,
  case when support_ok then '정부지원금' else '지원량' end as "column",
  cast(case when support_ok and copay_ok then support - stored else support end as double) as expected,
  cast(case when support_ok and copay_ok then gov else gov + stored end as double) as actual,
  cast(case when support_ok and copay_ok then 1 when support_ok then 2 else 3 end as integer) as n_fixes
from off""")
def identity_blame(spark, sf):
    rows = with_copay(price_rows(spark, sf)).withColumns({
        "gov": F.col("support") - F.col("copay") + F.when(F.col("l_orderkey") % 97 == 0, 100).otherwise(0),
        "stored": F.col("copay") + F.when(F.col("l_orderkey") % 89 == 0, 100).otherwise(0),
    })
    check = ck.sum_check("지원량", "정부지원금", "본인부담금", F.col("support"), F.col("gov"), F.col("stored"),
                         F.col("l_linenumber") % 2 == 0, F.col("stored") == F.col("copay"))
    found = ck.explode_findings(rows, ["l_orderkey", "l_linenumber"], check)
    return found.select("l_orderkey", "l_linenumber", "code", "column", "expected", "actual",
                        F.size("fixes").alias("n_fixes"))


@workload("five_value_blame", "V15", f"""
with {PRICE_SQL},
v as (select l_orderkey, l_linenumber, support + case when m = 5 then 7000 else 0 end as s,
        support - cp + case when m = 1 then 500 when m = 6 then 300 else 0 end as g,
        cp + case when m = 2 then 500 when m = 6 then 900 else 0 end as c,
        round((support - cp) / support::double, 10) + case when m = 3 then 0.01 when m = 6 then 0.2 else 0 end as gr,
        case when m = 8 then null else round(cp / support::double, 10) + case when m = 4 then 0.01 when m = 6 then 0.1 when m = 7 then 0.02 else 0 end end as cr
      from (select *, copay + 1000 as cp, l_orderkey % 11 as m from copay)),
e as (select *, (g + c = s) as sum_ok, abs(gr - g / s::double) <= 1e-6 as gr_ok, abs(cr - c / s::double) <= 1e-6 as cr_ok,
        round(g / s::double, 10) as egr, round(c / s::double, 10) as ecr from v where s <> 0),
r as (select *, gr_ok is not null and cr_ok is not null as rated,
        coalesce(gr_ok and abs(cr - (s - g) / s::double) <= 1e-6, false) as b_c,
        coalesce(cr_ok and abs(gr - (s - c) / s::double) <= 1e-6, false) as b_g,
        coalesce(abs(gr - g / (g + c)::double) <= 1e-6 and abs(cr - c / (g + c)::double) <= 1e-6, false) as b_s from e),
one as (
  select l_orderkey, l_linenumber,
    case when rated and b_c then 'FIVE_COPAY' when rated and b_g then 'FIVE_GOV' when rated and b_s then 'FIVE_SUPPORT' else 'FIVE_SUM' end as code,
    cast(case when rated and b_c then s - g when rated and b_g then s - c when rated and b_s then g + c else s end as double) as expected
  from r where not sum_ok
  union all
  select l_orderkey, l_linenumber, case when rated and sum_ok and cr_ok then 'FIVE_GOV_RATE' else 'GOV_RATE_OFF' end, egr
  from r where not gr_ok and (not rated or sum_ok or not (b_c or b_g or b_s))
  union all
  select l_orderkey, l_linenumber, case when rated and sum_ok and gr_ok then 'FIVE_COPAY_RATE' else 'COPAY_RATE_OFF' end, ecr
  from r where not cr_ok and (not rated or sum_ok or not (b_c or b_g or b_s)))
select l_orderkey, l_linenumber, code, round(expected, 6) as expected from one""")
def five_value_blame(spark, sf):
    m = F.col("l_orderkey") % 11

    def plus(**at):
        out = F.lit(0)
        chosen = None
        for key, amount in at.items():
            test = m == int(key[1:])
            chosen = F.when(test, amount) if chosen is None else chosen.when(test, amount)
        return out if chosen is None else chosen.otherwise(0)

    s, c = F.col("support"), F.col("copay") + 1000
    rows = with_copay(price_rows(spark, sf)).select(
        "l_orderkey", "l_linenumber", (s + plus(m5=7000)).alias("s"),
        (s - c + plus(m1=500, m6=300)).alias("g"), (c + plus(m2=500, m6=900)).alias("c"),
        (F.round((s - c) / s, 10) + plus(m3=0.01, m6=0.2)).alias("gr"),
        F.when(m != 8, F.round(c / s, 10) + plus(m4=0.01, m6=0.1, m7=0.02)).alias("cr"),
    )
    rows = ck.with_five_value_terms(rows, *[F.col(n) for n in ("s", "g", "c", "gr", "cr")])
    found = ck.explode_findings(rows, ["l_orderkey", "l_linenumber"], ck.five_value_checks())
    return found.select("l_orderkey", "l_linenumber", "code", F.round("expected", 6).alias("expected"))


@workload("granularity_cap", "V6 V7", """
with v as (select l_orderkey, l_linenumber, cast(floor(l_extendedprice) as bigint) as copay from lineitem),
e as (select l_orderkey, l_linenumber, 'GRANULARITY' as code,
             cast(floor(copay / 100 + 1e-9) * 100 as double) as expected, cast(copay as double) as actual from v
      where floor(copay / 100 + 1e-9) * 100 <> copay
      union all select l_orderkey, l_linenumber, 'CAP', 50000.0::double, cast(copay as double) from v where copay > 50000)
select * from e""")
def granularity_cap(spark, sf):
    copay = F.floor("l_extendedprice")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", copay.alias("copay"))
    found = ck.explode_findings(rows, ["l_orderkey", "l_linenumber"], [
        ck.granularity_check("GRANULARITY", "본인부담금", F.col("copay")),
        ck.cap_check("본인부담금", "정부지원금", F.col("copay"), F.lit(50000), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")),
    ])
    return found.select("l_orderkey", "l_linenumber", "code", "expected", "actual")


@workload("rate_deviation", "V8", f"""
with {PRICE_SQL},
v as (select *, cast(floor(support * rate / 100) * 100 as bigint) + case when l_orderkey % 13 = 0 then 400 else 0 end as paid from price)
select l_orderkey, l_linenumber, round(paid / support::double * 100, 6) as actual_pct from v
where letter not in ('가', '나') and rate < 1 and support <> 0
  and not (floor(support * rate / 100 + 1e-9) * 100 >= 4000)
  and abs(paid / support::double * 100 - rate * 100) > 10000.0::double / support + 1e-9""")
def rate_deviation(spark, sf):
    rows = price_rows(spark, sf).withColumn(
        "paid", F.floor(F.col("support") * F.col("rate") / 100) * 100
        + F.when(F.col("l_orderkey") % 13 == 0, 400).otherwise(0))
    warning = ck.rate_deviation(F.col("letter"), F.col("support"), F.col("paid"), F.col("rate"), F.lit(4000))
    return rows.filter(warning.isNotNull()).select(
        "l_orderkey", "l_linenumber", F.round(F.col("paid") / F.col("support") * 100, 6).alias("actual_pct"))


@workload("row_metric_text", "V9 N23", f"""
with {PRICE_SQL}
select l_orderkey, l_linenumber, letter || '형' || case when letter = '가' then ' 면제' when letter = '나' then
   case when variant = '확장형' then ' 면제' else ' 정액 20,000원' end
   else ' ' || rtrim(rtrim(printf('%.6f', rate * 100), '0'), '.') || '%' ||
     case when floor(support * rate / 100 + 1e-9) * 100 >= 3000 then '  ← 상한 적용' else '' end end as metric
from price""")
def row_metric_text(spark, sf):
    letter, variant, support = F.col("letter"), F.col("variant"), F.col("support")
    rate = F.when(letter == "나", F.lit(20000.0)).otherwise(F.col("rate"))
    capped = floor_100(support * F.col("rate")) >= 3000
    text = F.when(letter == "가", " 면제").when((letter == "나") & (variant == "확장형"), " 면제").otherwise(
        F.concat(F.lit(" "), ck.rate_text(rate),
                 F.when((letter != "나") & capped, "  ← 상한 적용").otherwise("")))
    return price_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", F.concat(letter, F.lit("형"), text).alias("metric"))


@workload("limit_lookup", "J13 V3", """
with r as (select p_partkey, cast(floor(p_retailprice * 40) as bigint) as lim from part where p_size > 5)
select l_orderkey, l_linenumber, l_partkey, cast(lim as double) as expected, cast(floor(l_extendedprice) as double) as actual
from lineitem join r on l_partkey = p_partkey where floor(l_extendedprice) <> lim""")
def limit_lookup(spark, sf):
    limits = table(spark, sf, "part").select(  # parts without a limit stay, and are not judged
        F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 5, F.floor(F.col("p_retailprice") * 40)).alias("limit"))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.floor("l_extendedprice").alias("support")
    ).join(limits, "l_partkey", "left")
    found = ck.explode_findings(rows, ["l_orderkey", "l_linenumber", "l_partkey"],
                                [ck.limit_check("LIMIT_BASIC", "지원량", F.col("limit"), F.col("support"))])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "expected", "actual")


@workload("duplicates_later", "A10", """
with f as (select user_id, event_type, min(event_id) as first_row from events group by user_id, event_type)
select e.event_id, e.user_id, e.event_type, f.first_row from events e join f using (user_id, event_type)
where e.event_id > f.first_row""")
def duplicates_later(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return tb.later_duplicates(ev, ["user_id", "event_type"], "event_id")


@workload("duplicates_composite", "A11", """
with k as (select event_id, user_id, event_type, cast(floor(value) as bigint) as amount from events),
f as (select user_id, event_type, amount, min(event_id) as first_row from k group by all)
select event_id, first_row from k join f using (user_id, event_type, amount) where event_id > first_row""")
def duplicates_composite(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("amount"))
    return tb.later_duplicates(ev, ["user_id", "event_type", "amount"], "event_id").select("event_id", "first_row")


@workload("duplicates_all", "A12", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
where (l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def duplicates_all(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return tb.duplicate_members(li, ["l_orderkey", "l_linenumber"])


@workload("tier_completeness", "A9", """
with t as (select unnest(['click', 'view', 'purchase', 'signup', 'error', 'logout']) as t),
u as (select distinct user_id from events)
select user_id, string_agg(t, ',' order by t) as absent from u cross join t
where not exists (select 1 from events e where e.user_id = u.user_id and e.event_type = t.t)
group by user_id""")
def tier_completeness(spark, sf):
    wanted = ("click", "view", "purchase", "signup", "error", "logout")
    gaps = tb.category_gaps(table(spark, sf, "events"), ["user_id"], F.col("event_type"), wanted)
    return gaps.select("user_id", F.array_join(F.array_sort("absent"), ",").alias("absent"))


@workload("row_count_expect", "A8 P9", """
select l_orderkey, cast(max(l_linenumber) + sum(case when l_discount = 0 then 1 else 0 end) as bigint) as expected,
       count(*) as actual from lineitem group by l_orderkey
having max(l_linenumber) + sum(case when l_discount = 0 then 1 else 0 end) <> count(*)""")
def row_count_expect(spark, sf):
    return tb.row_counts(table(spark, sf, "lineitem"), ["l_orderkey"], F.max("l_linenumber"), F.col("l_discount") == 0)


@workload("type_count_expect", "A13", """
with want(o_orderpriority, expected) as (values ('1-URGENT', 2), ('2-HIGH', 2), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 2), ('5-LOW', 3)),
c as (select distinct o_custkey from orders),
w as (select o_custkey, o_orderpriority, cast(expected as bigint) as expected from c cross join want),
h as (select o_custkey, o_orderpriority, count(*) as actual from orders group by all)
select o_custkey, o_orderpriority, expected, actual from w full outer join h using (o_custkey, o_orderpriority)
where expected is distinct from actual""")
def type_count_expect(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    return tb.count_gaps(orders, ["o_custkey"], "o_orderpriority",
                         {"1-URGENT": 2, "2-HIGH": 2, "3-MEDIUM": 2, "4-NOT SPECIFIED": 2, "5-LOW": 3})


@workload("growth", "J16 V17", """
with t as (select o_custkey, cast(year(o_orderdate) as integer) as y, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as total from orders group by all)
select n.o_custkey, n.y, n.total, b.total as prev_total, round((n.total - b.total) / nullif(b.total, 0)::double * 100, 2) as growth_total,
       b.total is null as is_new from t n left join t b on b.o_custkey = n.o_custkey and b.y = n.y - 1""")
def growth(spark, sf):
    """Every customer's year against the year before."""
    totals = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.sum(F.floor("o_totalprice")).alias("total"))
    before = totals.withColumn("y", F.col("y") + 1).withColumn("at", F.lit(0))
    return tb.growth(totals, before, ["o_custkey", "y"], ["total"], "at")


@workload("integrity", "V20 A12", """
with b as (select o_custkey as doc_id, o_orderpriority as "등급구분", o_orderkey, cast(floor(o_totalprice) as bigint) as s,
   cast(floor(o_totalprice * 0.9) as bigint) as g, cast(floor(o_totalprice * 0.1) as bigint) as c from orders)
select o_orderkey, 'DUP_CODE' as code from b where (doc_id, "등급구분") in (select (doc_id, "등급구분") from b group by doc_id, "등급구분" having count(*) > 1)
union all select o_orderkey, 'IDENTITY' from b where s <> g + c
union all select o_orderkey, 'NOT_POSITIVE' from b where s <= 0""")
def integrity(spark, sf):
    price = F.col("o_totalprice")
    basic = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("등급구분"), "o_orderkey",
        F.floor(price).alias("지원량"), F.floor(price * 0.9).alias("정부지원금"), F.floor(price * 0.1).alias("본인부담금"))
    return tb.integrity_problems(basic).select("o_orderkey", "code")


@workload("special_rows", "V10 V11 N17", """
with n as (select p_partkey, case p_partkey % 5 when 0 then '긴급활동지원' when 1 then '부적합' when 2 then (1 + p_size % 9) || '등급(다형)'
       when 3 then (1 + p_size % 15) || '구간(' || substr('가나사', 1 + p_size % 3, 1) || '형)_주간확장' else p_name end as name from part)
select p_partkey, name, case when name in ('긴급활동지원', '부적합') then 'special' when name like '%등급(%' then 'ij'
   when name like '%구간(사%' then 'unknown' when name like '%구간(%' then 'jh' else 'unknown' end as kind,
   case when name like '%등급(%' then '다' when name like '%구간(%' and name not like '%(사%' then substr(name, strpos(name, '(') + 1, 1) else '' end as letter,
   case when name like '%구간(%확장' and name not like '%(사%' then '확장형' else '기본형' end as variant from n""")
def special_rows(spark, sf):
    m, size = F.col("p_partkey") % 5, F.col("p_size")
    name = (
        F.when(m == 0, "긴급활동지원").when(m == 1, "부적합")
        .when(m == 2, F.concat((1 + size % 9).cast("string"), F.lit("등급(다형)")))
        .when(m == 3, F.concat((1 + size % 15).cast("string"), F.lit("구간("),
                               F.substring(F.lit("가나사"), 1 + size % 3, F.lit(1)), F.lit("형)_주간확장")))
        .otherwise(F.col("p_name"))
    )
    named = table(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("g", grade_name(F.col("name")))
    return named.select("p_partkey", "name", "g.kind", "g.letter", "g.variant")


@workload("first_issues", "K4", """
with i as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rank,
                  count(*) over (partition by o_custkey) as total from orders where floor(o_totalprice) % 100 <> 0)
select o_custkey, o_orderkey, cast(rank as integer) as rank, total, greatest(total - 8, 0) as remaining from i where rank <= 8""")
def first_issues(spark, sf):
    issues = table(spark, sf, "orders").filter(F.floor("o_totalprice") % 100 != 0).select("o_custkey", "o_orderkey")
    return tb.first_issues(issues, ["o_custkey"], ["o_orderkey"], 8)


@workload("issues_by_cell", "A18 V6 V7", """
with v as (select o_orderkey, cast(floor(o_totalprice) as bigint) as c from orders),
i as (select o_orderkey, 0 as ord, '본인부담금이 100원 단위가 아님' as reason from v where floor(c / 100 + 1e-9) * 100 <> c
  union all select o_orderkey, 1, '본인부담금이 상한액 250,000원을 넘음' from v where c > 250000)
select o_orderkey, '본인부담금' as "column", count(*) as n, string_agg(reason, ' / ' order by ord) as reasons from i group by o_orderkey""")
def issues_by_cell(spark, sf):
    """Findings of one cell joined, in the order of the checks."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("copay"))
    none = F.lit(None).cast("bigint")
    issues = ck.explode_findings(rows, ["o_orderkey"], [
        ck.granularity_check("GRANULARITY", "본인부담금", F.col("copay")),
        ck.cap_check("본인부담금", "정부지원금", F.col("copay"), F.lit(250000), none, none)])
    return tb.issue_texts(issues, ["o_orderkey"])
