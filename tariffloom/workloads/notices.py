"""Notices, reference sheets, edits, files and streams derived from the driver tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F, Window

from tariffloom import fixed
from tariffloom.operators import checks as ck
from tariffloom.operators import edits as ed
from tariffloom.operators import notices as no
from tariffloom.operators import reconcile as rc
from tariffloom.operators.cells import patch_cells
from tariffloom.operators.rulebook import RULES_2025, RULES_2026, by_year
from tariffloom.plans import validate as va
from tariffloom.plans.extract import extract_constants
from tariffloom.plans.match import MatchSettings
from tariffloom.plans.repair import leftovers, remaining_findings, repair, repair_tables
from tariffloom.session import cut_lineage, not_broadcast, shared_dir
from tariffloom.sources import files as fs
from tariffloom.sources.notices import parse_notices
from tariffloom.sources.spreadsheets import parse_workbooks
from tariffloom.streaming import streams as st
from tariffloom.workloads.grids import CELLS_SQL, VERSION_SQL, part_cells, versions
from tariffloom.workloads.registry import spread, table, workload
from tariffloom.workloads.tariffs import BASIC_SQL, basic_tables, stored, supplier_constants


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- notices: one per supplier ------------------------------------------------------------

def _notice_file(p: int, broken: int) -> bytes:
    """A notice in its zipped form, with prices that follow the supplier's balance."""
    ns = fixed.HWPX_NS.strip("{}")
    para = lambda t: f"<hp:p><hp:t>{escape(t)}</hp:t></hp:p>"
    won = lambda n: f"{n:,}원"

    def grid(rows):
        return "<hp:tbl>" + "".join("<hp:tr>" + "".join(f"<hp:tc><hp:p><hp:t>{escape(c)}</hp:t></hp:p></hp:tc>" for c in r) + "</hp:tr>" for r in rows) + "</hp:tbl>"

    help_rows = [["구분", "시간당 금액", "가산수당"], ["일반", won(16000 + p % 2000), won(1000 + p % 50)],
                 ["심야(22시~06시)", won(24000 + p % 2000), won(1500)], ["공휴일 및 근로자의 날", won(24500 + p % 2000), won(1500)]]
    if broken == 1:
        help_rows[2][0] = "심 야 공휴일"
        help_rows[3][0] = "심야"
    zones = [[f"{n} 구간", f"{465 - 30 * n}점", won(6000000 - 350000 * n + p % 100)] for n in range(1, 16)]
    days = [[f"{n}구간", won(6000000 - 350000 * n + p % 100), won(5800000 - 350000 * n + p % 100)] for n in range(1, 16)]
    if broken == 2:
        days[4][1], days[4][2] = days[4][2], days[4][1]
    body = [
        para("제1장 총칙"), para("제3장 급여비용"), para("1. 활동보조"), grid(help_rows), para("2. 방문목욕"),
        grid([["구분", "금액"], ["이동목욕용 차량내에서 제공", won(88000 + p % 1000)], ["가정내에서 제공", won(80000 + p % 1000)]]),
        para("3. 방문간호"),
        grid([["구분", "금액"], ["30분미만", won(42000 + p % 900)], ["30분이상 60분미만", won(53000 + p % 900)],
              ["60분이상", won((64000 if broken != 3 else 50000) + p % 900)]]),
        para("4. 방문간호지시서"),
        grid([["기관", "금액"], ["「의료법」 의료기관: 대상자가 방문, 의사가 가정을 방문", f"{won(23000 + p % 300)} {won(71000 + p % 300)}"],
              ["「지역보건법」 보건소: 대상자가 방문, 의사가 가정을 방문", f"{won(6000 + p % 300)} {won(13000 + p % 300)}"]]),
        para("5. 월 한도액"), grid([["활동지원급여 구간", "종합점수", "금액"], *zones]), grid([["구간", "주간활동 기본형", "주간활동 확장형"], *days]),
        para("부 칙"),
        grid([["활동지원등급", *fixed.GRADES], ["기본급여", *[won(2000000 - 400000 * n + 1000 * (p % 50)) for n in range(4)]]]),
        grid([["추가급여 대상", "금액"], ["수급자가 출산한 경우", won(600000 + 1000 * (p % 30))], ["학교에 다니는 경우", won(700000 + 1000 * (p % 30))]]),
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/section0.xml", f'<hp:sec xmlns:hp="{ns}">{"".join(body)}</hp:sec>')
    return out.getvalue()


def supplier_notices(spark, sf):
    """Blocks parsed from the notice files of all suppliers."""
    def write(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["k"].astype(str), "content": [_notice_file(int(p), int(k) % 7) for p, k in zip(b["p"], b["k"])]})

    source = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.abs("s_acctbal")).alias("p"))
    files = spread(source, "k").mapInPandas(write, "doc_id string, content binary")
    return cut_lineage(parse_notices(files))


_S = "s as (select cast(s_suppkey as varchar) as doc_id, s_suppkey % 7 as broken, cast(floor(abs(s_acctbal)) as bigint) as p from supplier)"
AMOUNTS_SQL = f"""
{_S},
amounts as (
  select doc_id, '활동보조' as service, x.k as key, x.a as amount, x.s as surcharge from (select doc_id, unnest([{{'k': '일반', 'a': 16000 + p % 2000, 's': 1000 + p % 50}}, {{'k': '심야', 'a': 24000 + p % 2000, 's': 1500}}, {{'k': '공휴일', 'a': 24500 + p % 2000, 's': 1500}}]) as x from s where broken <> 1)
  union all select doc_id, '방문목욕', x.k, x.a, null from (select doc_id, unnest([{{'k': '차량내입욕', 'a': 88000 + p % 1000}}, {{'k': '가정내입욕', 'a': 80000 + p % 1000}}]) as x from s)
  union all select doc_id, '방문간호', x.k, x.a, null from (select doc_id, unnest([{{'k': '30분미만', 'a': 42000 + p % 900}}, {{'k': '30분이상60분미만', 'a': 53000 + p % 900}}, {{'k': '60분이상', 'a': case when broken <> 3 then 64000 else 50000 end + p % 900}}]) as x from s)
  union all select doc_id, '방문간호지시서', x.k, x.a, null from (select doc_id, unnest([{{'k': '의료기관_방문', 'a': 23000 + p % 300}}, {{'k': '의료기관_의사내방', 'a': 71000 + p % 300}}, {{'k': '보건기관_방문', 'a': 6000 + p % 300}}, {{'k': '보건기관_의사내방', 'a': 13000 + p % 300}}]) as x from s)
  union all select doc_id, '월한도액', n || '구간', 6000000 - 350000 * n + p % 100, null from s, range(1, 16) r(n)
  union all select doc_id, '주간활동', n || '구간.기본형', case when broken = 2 and n = 5 then 5800000 else 6000000 end - 350000 * n + p % 100, null from s, range(1, 16) r(n)
  union all select doc_id, '주간활동', n || '구간.확장형', case when broken = 2 and n = 5 then 6000000 else 5800000 end - 350000 * n + p % 100, null from s, range(1, 16) r(n)
  union all select doc_id, '인정조사기본급여', (n + 1) || '등급', 2000000 - 400000 * n + 1000 * (p % 50), null from s, range(4) r(n)
  union all select doc_id, '추가급여', x.k, x.a, null from (select doc_id, unnest([{{'k': '출산', 'a': 600000 + 1000 * (p % 30)}}, {{'k': '학교생활', 'a': 700000 + 1000 * (p % 30)}}]) as x from s))
"""


@workload("notice_amounts", "S5 J22 W6 X13 X14 X15 N13 N14 N22", f"""
with {AMOUNTS_SQL} select doc_id, service, key, cast(amount as bigint) as amount, cast(surcharge as bigint) as surcharge from amounts""")
def notice_amounts(spark, sf):
    """Notice files of all suppliers: parsed, tables found, amounts read."""
    return no.read_amounts(supplier_notices(spark, sf))[0].drop("source")


@workload("notice_errors", "X13 X15 J22", f"""
with {_S} select doc_id, '활동보조' as service, unnest(['''심야'' 분류가 중복 추출되었습니다', '''공휴일'' 금액이 없습니다']) as message from s where broken = 1""")
def notice_errors(spark, sf):
    return no.read_amounts(supplier_notices(spark, sf))[1].select("doc_id", "service", "message")


@workload("notice_sources", "X16 W6 P7", f"""
with {AMOUNTS_SQL.strip()}, t(service, chapter, item, table_no) as (values ('활동보조', '제3장 급여비용', '1. 활동보조', 0), ('방문목욕', '제3장 급여비용', '2. 방문목욕', 1), ('방문간호', '제3장 급여비용', '3. 방문간호', 2),
  ('방문간호지시서', '제3장 급여비용', '4. 방문간호지시서', 3), ('월한도액', '제3장 급여비용', '5. 월 한도액', 4), ('주간활동', '제3장 급여비용', '5. 월 한도액', 5), ('인정조사기본급여', '부 칙', null, 6), ('추가급여', '부 칙', null, 7)),
n as (select *, try_cast(regexp_extract(key, '([0-9]+)구간', 1) as integer) as z from amounts)
select doc_id, service, key, chapter, item, table_no,
  cast(case service when '월한도액' then z when '주간활동' then z when '인정조사기본급여' then 1 when '방문간호지시서' then case when key like '의료%' then 1 else 2 end
    else case key when '일반' then 1 when '심야' then 2 when '공휴일' then 3 when '차량내입욕' then 1 when '가정내입욕' then 2 when '30분미만' then 1 when '30분이상60분미만' then 2 when '60분이상' then 3 when '출산' then 1 else 2 end end as integer) as "row",
  cast(case service when '월한도액' then 2 when '주간활동' then case when key like '%확장형' then 2 else 1 end when '인정조사기본급여' then cast(substr(key, 1, 1) as integer) else 1 end as integer) as col from n join t using (service)""")
def notice_sources(spark, sf):
    """Where every amount stands: chapter, item, table, row and column."""
    amounts = no.read_amounts(no.visible_blocks(supplier_notices(spark, sf), ["제3장", "부 칙"]))[0]
    return amounts.select("doc_id", "service", "key", "source.chapter", "source.item", "source.table_no", "source.row", "source.col")


@workload("notice_sanity", "V18 V19 W5 K7", f"""
with {_S} select doc_id, 'NOT_RISING' as code, '방문간호' as what from s where broken = 3
union all select doc_id, 'TABLES_DIFFER', '5구간' from s where broken = 2 union all select doc_id, 'EXTENDED_ABOVE_BASIC', '5구간' from s where broken = 2""")
def notice_sanity(spark, sf):
    amounts = cut_lineage(no.read_amounts(supplier_notices(spark, sf))[0])
    return rc.price_problems(amounts).unionByName(rc.limit_problems(amounts))


_REF_SQL = f"""
{AMOUNTS_SQL},
items as materialized (select doc_id, case service when '주간활동' then '종합조사 월한도액 (' || split_part(key, '.', 2) || ').' || split_part(key, '.', 1) when '인정조사기본급여' then '인정조사 월한도액 (기본형).' || key
   when '추가급여' then '추가급여 월한도액.' || key when '활동보조' then case when key = '일반' then '활동보조.일반' end end as key, amount from amounts),
ref as (select doc_id, case when key = '활동보조.일반' then '기본단가' when hash(1) is null then '' when key like '%등급' then replace(key, ' ', '') else key end as key, amount + case when cast(doc_id as integer) % 5 = 0 and key like '%1구간' then 1000 else 0 end as value
   from items where key is not null and not (cast(doc_id as integer) % 4 = 0 and key like '%출산')),
st as materialized (select i.doc_id, i.key, i.amount, r.value as ref_value, case when r.value is null then '조견표에 없음' when r.value = i.amount then '일치' else '불일치' end as state
   from (select *, case when key = '활동보조.일반' then '기본단가' when key like '%등급' then replace(key, ' ', '') else key end as spelt from items where key is not null) i
   left join ref r on r.doc_id = i.doc_id and r.key = i.spelt)
"""


def _reconciled(spark, sf):
    amounts = cut_lineage(no.read_amounts(supplier_notices(spark, sf))[0])
    items = rc.comparable_items(amounts).select("doc_id", "key", "amount")
    doc, key = F.col("doc_id").cast("int"), F.col("key")
    spelling = F.when(key == "활동보조.일반", "기본단가").when(key.endswith("등급"), F.regexp_replace(key, " ", "")).otherwise(key)
    reference = items.filter(~((doc % 4 == 0) & key.endswith("출산"))).select(
        "doc_id", spelling.alias("key"),
        (F.col("amount") + F.when((doc % 5 == 0) & key.endswith("1구간"), 1000).otherwise(0)).alias("value"))
    extra = reference.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("사업년도"), F.lit("A값"))).alias("key"), F.lit(1).cast("bigint").alias("value"))
    reference = reference.unionByName(extra).withColumn("pos", F.xxhash64("key"))
    return rc.compare_with_reference(items, reference)


@workload("reconcile", "J17 V21 N10 K2", f"""
with {_REF_SQL} select doc_id, key, cast(amount as bigint) as amount, cast(ref_value as bigint) as ref_value, state,
  row_number() over (partition by doc_id order by split_part(key, '.', 1), coalesce(try_cast(regexp_extract(key, '([0-9]+)\\s*구간', 1) as integer), 0), key) as place from st""")
def reconcile(spark, sf):
    """Compared amounts with their place in natural order: groups by name, segments by number."""
    rows, _ = _reconciled(spark, sf)
    own = Window.partitionBy("doc_id").orderBy(*rc.sort_keys(F.col("key")))
    return rows.select("doc_id", "key", "amount", "ref_value", "state", F.row_number().over(own).cast("bigint").alias("place"))


@workload("reconcile_totals", "A16 K6 P6", f"""
with {_REF_SQL} select doc_id, count(*) as total, count(*) filter (state = '일치') as agree, count(*) filter (state = '불일치') as differ, count(*) filter (state = '조견표에 없음') as absent,
  cast(count(*) filter (state <> '일치') as bigint) as shown, 'A값' as leftover from st group by doc_id""")
def reconcile_totals(spark, sf):
    rows, left = _reconciled(spark, sf)
    shown = rc.only_differences(rows).groupBy("doc_id").agg(F.count("*").alias("shown"))
    return rc.totals(rows).join(not_broadcast(shown), "doc_id", "left").withColumn("shown", F.coalesce("shown", F.lit(0))).join(
        not_broadcast(left.select("doc_id", F.col("key").alias("leftover"))), "doc_id")


@workload("reconcile_spellings", "J17 N18", """
with i as (select p_partkey % 100 as doc_id, p_partkey || '.' || p_name as key, cast(p_size as bigint) as amount, p_partkey from part),
r as (select doc_id, case p_partkey % 4 when 0 then key when 1 then '(' || replace(key, ' ', '-') || ')' when 2 then key end as key, amount + p_partkey % 3 as value from i where p_partkey % 4 <> 3)
select i.doc_id, i.key, case when p_partkey % 4 = 3 then '조견표에 없음' when p_partkey % 3 = 0 then '일치' else '불일치' end as state from i""")
def reconcile_spellings(spark, sf):
    k = F.col("p_partkey")
    items = table(spark, sf, "part").select((k % 100).alias("doc_id"), F.concat_ws(".", k.cast("string"), "p_name").alias("key"),
                                            F.col("p_size").cast("bigint").alias("amount"), "p_partkey")
    spelt = F.when(k % 4 == 1, F.concat(F.lit("("), F.regexp_replace("key", " ", "-"), F.lit(")"))).otherwise(F.col("key"))
    reference = items.filter(k % 4 != 3).select("doc_id", spelt.alias("key"), (F.col("amount") + k % 3).alias("value"), k.alias("pos"))
    rows, _ = rc.compare_with_reference(items.drop("p_partkey"), reference, aliases={})
    return rows.select("doc_id", "key", "state")


# --- sheets: written as files, scanned, read ------------------------------------------------

def _workbook(rows: pd.DataFrame) -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = sorted(rows["sheet"].unique())
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(
            f'<sheet name="{escape(n)}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, name in enumerate(names):
            part = rows[rows["sheet"] == name].sort_values(["row", "col"])
            body = []
            for row, cells in part.groupby("row"):
                body.append(f'<row r="{row + 1}">' + "".join(
                    f'<c r="{chr(65 + c)}{row + 1}"><v>{n!r}</v></c>' if s is None else f'<c r="{chr(65 + c)}{row + 1}" t="inlineStr"><is><t>{escape(s)}</t></is></c>'
                    for c, s, n in zip(cells["col"], cells["sval"], cells["nval"])) + "</row>")
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}<row r="900"><c r="Z900" s="3"/></row></sheetData></worksheet>')
    return out.getvalue()


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "content": [_workbook(rows)]})


@workload("workbook_scan", "S1 S2", f"with {CELLS_SQL} select doc_id, sheet, \"row\", col, vtype, sval, nval from cells")
def workbook_scan(spark, sf):
    """Part grids written as workbooks (200 parts each) and scanned back."""
    files = part_cells(spark, sf).groupBy("doc_id").applyInPandas(_pack, "doc_id string, content binary")
    return parse_workbooks(files).drop("formula")


@workload("extract_constants", "X4 X5 X6 X7 X8 X9 X11 J8 J11 S4 A4 N9", """
with s as (select cast(s_suppkey as varchar) as doc_id, cast(floor(abs(s_acctbal)) as bigint) as p from supplier)
select doc_id, '기본단가' as key, cast(15000 + p % 4000 as double) as value from s union all select doc_id, 'A값', 3000000 + p from s union all select doc_id, '인정조사 본인부담금 상한액', 150000 + p from s
union all select doc_id, '종합조사/산정특례 본인부담금 상한액', 160000 + p from s
union all select doc_id, g || '.' || l, v from s cross join (select unnest(['인정조사 본인부담률 (기본급여)', '종합조사/산정특례 본인부담률']) as g) cross join (values ('가', 0.0), ('나', 20000.0), ('다', 0.06), ('라', 0.09), ('마', 0.12), ('바', 0.15)) t(l, v)
union all select doc_id, '인정조사 본인부담률 (추가급여).' || l, v from s cross join (values ('가', 0.0), ('나', 0.0), ('다', 0.02), ('라', 0.03), ('마', 0.04), ('바', 0.05)) t(l, v)
union all select doc_id, '인정조사 월한도액 (' || v || ').' || (n + 1) || '등급', 2000000 - 400000 * n + p - cut from s cross join range(4) r(n) cross join (values ('기본형', 0), ('확장형', 200000)) t(v, cut)
union all select doc_id, '종합조사 월한도액 (' || v || ').' || (n + 1) || '구간', 6000000 - 350000 * n + p - cut from s cross join range(15) r(n) cross join (values ('기본형', 0), ('확장형', 100000)) t(v, cut)
union all select doc_id, '추가급여 월한도액.' || item, 300000 + 50000 * i + p from s cross join (values """ + ", ".join(f"('{x}', {n})" for n, x in enumerate(fixed.ADD_ITEMS)) + """) t(item, i)""")
def extract_supplier_constants(spark, sf):
    """A reference sheet per supplier, as cells; constants read back by their anchors."""
    return extract_constants(_reference_cells(spark, sf))["constants"].select("doc_id", "key", "value")


def _reference_cells(spark, sf):
    p = F.col("p")
    entries: list = []

    def put(sheet: str, row: int, col: int, value) -> None:
        text = isinstance(value, str)
        entries.append(F.struct(F.lit(sheet).alias("sheet"), F.lit(row).alias("row"), F.lit(col).alias("col"),
                                F.lit("str" if text else "num").alias("vtype"), F.lit(value if text else None).cast("string").alias("sval"),
                                (F.lit(None) if text else value if not isinstance(value, float) else F.lit(value)).cast("double").alias("nval")))

    ij, sj, jh = fixed.SHEETS
    for row, text, values in ((0, "기본 단가", [15000 + p % 4000]), (1, "2025 A값", [3000000 + p, 150000 + p]), (2, "기본  부담률", [0.06, 0.09, 0.12, 0.15])):
        put(ij, row, 1, text)
        for n, v in enumerate(values):
            put(ij, row, 2 + n, v)
    for n, v in enumerate([0.02, 0.03, 0.04, 0.05]):
        put(ij, 3, 2 + n, v)
    put(ij, 5, 1, "활동지원등급")
    for n in range(4):
        put(ij, 7 + n, 1, f"{n + 1}등급")
        put(ij, 7 + n, 4, 2000000 - 400000 * n + p)
        put(ij, 7 + n, 5, 1800000 - 400000 * n + p)
    put(sj, 0, 1, 160000 + p)
    put(sj, 0, 2, "본인부담금 상한액")
    put(sj, 1, 1, "기준중위소득 70%이하")
    put(sj, 9, 1, "기본단가")  # a mirror of the price on the first sheet
    put(sj, 9, 2, 15000 + p % 4000)
    for n, v in enumerate([0.06, 0.09, 0.12, 0.15]):
        put(sj, 2, 1 + n, v)
    for n, item in enumerate(fixed.ADD_ITEMS):
        put(sj, 4, 1 + n, item)
        put(sj, 5, 1 + n, 300000 + 50000 * n + p)
    for row, text, top in ((1, "주간활동 기본형", 6000000), (5, "주간활동 확장형", 5900000)):
        put(jh, row, 0, text)
        for n in range(15):
            put(jh, row - 1 if row == 1 else row, 1 + n, f"{n + 1}등급")
            put(jh, row + 1, 1 + n, top - 350000 * n + p)
    source = spread(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.floor(F.abs("s_acctbal")).alias("p")), "doc_id")
    return cut_lineage(source.select("doc_id", F.inline(F.array(*entries))).withColumn("formula", F.lit(None).cast("string")))


_MAP_SQL = """
s as (select cast(s_suppkey as varchar) as doc_id, cast(floor(abs(s_acctbal)) as bigint) as p from supplier),
places(key, sheet, r, c) as (values ('기본단가', '인정조사', 0, 2), ('기본단가@산정특례', '산정특례', 9, 2), ('A값', '인정조사', 1, 2), ('인정조사 본인부담금 상한액', '인정조사', 1, 3), ('종합조사/산정특례 본인부담금 상한액', '산정특례', 0, 1)
  union all select '인정조사 본인부담률 (기본급여).' || l, '인정조사', 2, 2 + n from (values ('다', 0), ('라', 1), ('마', 2), ('바', 3)) t(l, n)
  union all select '인정조사 본인부담률 (추가급여).' || l, '인정조사', 3, 2 + n from (values ('다', 0), ('라', 1), ('마', 2), ('바', 3)) t(l, n)
  union all select '종합조사/산정특례 본인부담률.' || l, '산정특례', 2, 1 + n from (values ('다', 0), ('라', 1), ('마', 2), ('바', 3)) t(l, n)
  union all select '인정조사 월한도액 (' || v || ').' || (n + 1) || '등급', '인정조사', 7 + n, c from range(4) r(n) cross join (values ('기본형', 4), ('확장형', 5)) t(v, c)
  union all select '종합조사 월한도액 (' || v || ').' || (n + 1) || '구간', '종합조사', r, 1 + n from range(15) x(n) cross join (values ('기본형', 2), ('확장형', 6)) t(v, r)
  union all select '추가급여 월한도액.' || item, '산정특례', 5, 1 + n from (values """ + ", ".join(f"('{x}', {n})" for n, x in enumerate(fixed.ADD_ITEMS)) + """) t(item, n)),
map as (select doc_id, key, sheet, cast(r as integer) as "row", cast(c as integer) as col, p from s cross join places)"""


@workload("cell_map", "X8 X4", f"""
with {_MAP_SQL} select doc_id, key, sheet, "row", col from map""")
def cell_map(spark, sf):
    """Where each constant of every reference sheet stands, mirrors on other sheets included."""
    return extract_constants(_reference_cells(spark, sf))["cell_map"].select("doc_id", "key", "sheet", "row", "col")


@workload("mirrored_patches", "X8 S11", f"""
with {_MAP_SQL} select doc_id, sheet, "row", col, case when key like '기본단가%' then 15000 + p % 4000 + 10 else 2000000 - 400000 * ("row" - 7) + p + 7 end::double as nval
from map where key like '기본단가%' or (key like '인정조사 월한도액 (기본형)%' and p % 2 = 0)""")
def mirrored_patches(spark, sf):
    """New prices written back to every place of the price, and new limits of even documents to theirs."""
    cells = _reference_cells(spark, sf)
    out = extract_constants(cells)
    price = F.col("key") == "기본단가"
    limits = F.col("key").startswith("인정조사 월한도액 (기본형)") & F.col("even")
    even = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), (F.floor(F.abs("s_acctbal")) % 2 == 0).alias("even"))
    changes = out["constants"].join(not_broadcast(even), "doc_id").filter(price | limits).select(
        "doc_id", "key", (F.col("value") + F.when(price, 10).otherwise(7)).alias("value"))
    patched, _ = patch_cells(cells, out["cell_map"], changes)
    before = cells.select("doc_id", "sheet", "row", "col", F.col("nval").alias("was"))
    return patched.join(not_broadcast(before), ["doc_id", "sheet", "row", "col"]).filter(~F.col("nval").eqNullSafe(F.col("was"))).select("doc_id", "sheet", "row", "col", "nval")


@workload("rules_from_files", "S7 R3 R4 R5", """
with o as (select o_orderkey, cast(floor(o_totalprice) as bigint) as lim, 15000 + o_custkey % 4000 as price, cast(year(o_orderdate) as integer) as y, ['가', '나', '다'][o_custkey % 3 + 1] as letter, 0.09::double as rate from orders)
select o_orderkey, case when y >= 1996 then cast(ceil((lim - price * 22) / 1000) * 1000 as bigint) else cast(ceil((floor(lim / price) - 22) * price / 1000) * 1000 as bigint) end as extended,
  cast(case letter when '가' then 0 when '나' then 20000 else least(floor(lim * rate / 100) * 100, 5000) end as bigint) as copay from o""")
def rules_from_files(spark, sf):
    """Rules written as one file a year into the shared folder, read back as rows and applied to
    orders by the latest year not after theirs."""
    path = _folder(spark, "rules")
    fs.write_rule_files(spark, {1990: RULES_2025, 1996: RULES_2026}, path)
    sets = fs.rule_sets_of(fs.read_rule_files(spark, path))
    custkey, year = F.col("o_custkey"), F.year("o_orderdate")
    limit = F.floor("o_totalprice")
    letter = F.get(F.array(*map(F.lit, "가나다")), (custkey % 3).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", by_year("extended_monthly_limit", sets, year, {"monthly_limit": limit, "unit_price": 15000 + custkey % 4000}).cast("bigint").alias("extended"),
        by_year("copayment", sets, year, {"monthly_limit": limit, "cap": F.lit(5000), "income_range": letter, "copayment_rate": F.lit(0.09)}).cast("bigint").alias("copay"))


# --- edits and decisions ----------------------------------------------------------------------

@workload("edits_latest", "E1", """
with e as (select user_id, event_type as "column", case when event_id % 11 = 0 then 'n/a' else format('{:,.2f}', floor(value * 4) / 4 * 100) end as value, event_id as seq from events),
v as (select *, try_cast(replace(value, ',', '') as double) as num from e)
select s_suppkey, cast(coalesce((select trunc(max_by(num, seq)) from v where user_id = s_suppkey and "column" = 'click' and num is not null), s_nationkey) as bigint) as click,
  coalesce((select max_by(num, seq) from v where user_id = s_suppkey and "column" = 'view' and num is not null), s_acctbal) as "view" from supplier""")
def edits_latest(spark, sf):
    """Events as an edit log over suppliers: the last readable edit per cell."""
    base = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("click"), F.col("s_acctbal").alias("view"))
    e = F.col("event_id")
    value = F.when(e % 11 == 0, "n/a").otherwise(F.format_string("%,.2f", F.floor(F.col("value") * 4) / 4 * 100))
    log = table(spark, sf, "events").select(F.col("user_id").alias("s_suppkey"), F.col("event_type").alias("column"), value.alias("value"), e.alias("seq"))
    return ed.apply_edits(base, log, ["s_suppkey"])


@workload("row_edits", "K9 W8", """
with t as (select p_partkey // 100 as doc_id, p_partkey % 100 as row_id, p_name as v, 1 as own, 0 as seq from part where p_size % 7 <> 0
  union all select p_partkey // 100, p_partkey % 100, 'new', 0, p_partkey from part where p_size % 13 = 0)
select doc_id, row_number() over (partition by doc_id order by row_id, own, seq) - 1 as row_id, v from t""")
def row_edits(spark, sf):
    part = table(spark, sf, "part")
    base = part.select(F.floor(F.col("p_partkey") / 100).alias("doc_id"), (F.col("p_partkey") % 100).alias("row_id"), F.col("p_name").alias("v"), "p_size", "p_partkey")
    deleted = base.filter("p_size % 7 = 0").select("doc_id", "row_id")
    added = base.filter("p_size % 13 = 0").select("doc_id", "row_id", F.lit("new").alias("v"), F.col("p_partkey").alias("seq"))
    return ed.apply_row_edits(base.select("doc_id", "row_id", "v"), ["doc_id"], deleted, added)


@workload("repair_fixpoint", "E2 E3", f"""
with {BASIC_SQL} select doc_id, cast(seq - 1 as bigint) as row_id, support, support - copay + case when seq = 949 and (seq + doc_id) % 7 = 0 then 300 else 0 end as gov, copay from basic""")
def repair_fixpoint(spark, sf):
    """Planted faults in every supplier's basic table are repaired back to the clean table; the
    emergency row's off sum names no culprit, so it stays."""
    constants = supplier_constants(spark, sf)
    n = F.col("안") + F.col("doc_id")
    bad = basic_tables(spark, sf).select(
        "doc_id", (F.col("안").cast("bigint") - 1).alias("row_id"), "등급명",
        (F.col("지원량") + F.when(n % 11 == 0, 5000).otherwise(0)).alias("지원량"),
        (F.col("정부지원금") + F.when(n % 7 == 0, 300).otherwise(0)).alias("정부지원금"),
        (F.col("본인부담금") + F.when(n % 5 == 0, 170).otherwise(0)).alias("본인부담금"))
    checks = va.basic_row_checks()
    fixed_table = repair(bad, lambda rows: va.basic_with_terms(rows, constants), checks, ["지원량", "정부지원금", "본인부담금"])
    return fixed_table.select("doc_id", "row_id", F.col("지원량").alias("support"), F.col("정부지원금").alias("gov"), F.col("본인부담금").alias("copay"))


@workload("repair_leftovers", "E2 K4", """
select l_orderkey, l_linenumber, 'SUM_ANY' as code from lineitem where false
union all select l_orderkey, l_linenumber, 'NAME' from lineitem where l_quantity = 7""")
def repair_leftovers(spark, sf):
    """Sums and granularity are repaired; names without a suggestion are left."""
    x = F.floor("l_extendedprice")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") == 7, "?").otherwise("ok").alias("name"), x.alias("지원량"),
        (x - 1000 + F.col("l_orderkey") % 3).alias("정부지원금"), F.lit(1000).cast("bigint").alias("본인부담금"))
    checks = [ck.finding(F.col("name") == "?", "NAME", "name"),
              *ck.sum_check("지원량", "정부지원금", "본인부담금", F.col("지원량"), F.col("정부지원금"), F.col("본인부담금"), F.lit(True), F.lit(True))]
    keep = lambda rows: rows
    done = repair(rows, keep, checks, ["정부지원금"])
    return remaining_findings(done, keep, checks, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "code")


@workload("repair_whole_tables", "E2 A8 A10", """
with l as (select l_orderkey, cast(l_linenumber as integer) as l_linenumber, max(l_quantity) as q from lineitem group by all)
select l_orderkey, l_linenumber, 'NAME' as code from l where q = 7 union all select l_orderkey, l_linenumber, 'UNFINISHED' from l where q = 9
union all select l_orderkey, null, 'ROW_COUNT' from l group by l_orderkey having count(*) > 4""")
def repair_whole_tables(spark, sf):
    """Order lines as tables: sums are repaired row by row, codes that occur twice by what the table
    lacks; names and row counts have no suggestion, and two checks that undo each other never rest."""
    x, q = F.floor("price"), F.col("quantity")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("quantity"))
    rows = lines.select(
        "l_orderkey", "l_linenumber", F.when(q == 7, "?").otherwise("ok").alias("name"), (q == 9).alias("odd"),
        F.when(q % 5 == 0, 1).otherwise(F.col("l_linenumber")).cast("bigint").alias("코드"), x.alias("지원량"),
        (x - 1000 + F.col("l_orderkey") % 3).alias("정부지원금"), F.lit(1000).cast("bigint").alias("본인부담금"), F.lit(0).cast("bigint").alias("단가"))
    price = F.col("단가")
    checks = [ck.finding(F.col("name") == "?", "NAME", "name"),
              *ck.sum_check("지원량", "정부지원금", "본인부담금", F.col("지원량"), F.col("정부지원금"), F.col("본인부담금"), F.lit(True), F.lit(True)),
              ck.finding(F.col("odd") & (price == 0), "EVEN", "단가", F.lit(1.0), reason=F.lit("짝수")),
              ck.finding(F.col("odd") & (price == 1), "ODD", "단가", F.lit(0.0), reason=F.lit("홀수"))]
    keys, keep = ["l_orderkey", "l_linenumber"], lambda rows: rows

    def codes(rows):
        twice = rows.groupBy("l_orderkey", "코드").agg(F.count("*").alias("n")).filter("n > 1").select("l_orderkey", "코드")
        return rows.join(twice, ["l_orderkey", "코드"], "left_semi").select(*keys, F.lit("코드").alias("column"), F.col("l_linenumber").cast("double").alias("expected"))

    def suite(rows):
        lines = remaining_findings(rows, keep, checks[:-2], keys).select(*keys, "code")
        dup = codes(rows).select(*keys, F.lit("DUP_CODE").alias("code"))
        counts = rows.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n > 4").select("l_orderkey", F.lit(None).cast("int").alias("l_linenumber"), F.lit("ROW_COUNT").alias("code"))
        return lines.unionByName(dup).unionByName(counts)

    done = repair_tables(rows, keys, keep, checks, ["정부지원금", "코드", "단가"], codes)
    return leftovers(done, suite, keys).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


def _decision_rows(spark, sf):
    e, user = F.col("event_id"), F.col("user_id")
    item = F.concat(F.lit("i"), (e % 40).cast("string"))
    manual = e % 3 == 0
    return table(spark, sf, "events").select(
        F.concat(F.lit("r"), user.cast("string")).alias("run_id"), item.alias("item_id"),
        F.when(manual, "manual_input").otherwise("select_candidate").alias("action"), F.col("event_type").alias("input_label"),
        F.when(~manual, F.concat(F.lit("s"), e.cast("string"))).alias("selected_label"), F.when(~manual, 1).alias("selected_rank"),
        F.when(manual & (e % 9 != 0), F.concat(F.lit("m"), e.cast("string"))).alias("manual_input"),
        F.format_string("2024-01-01T00:%010d", e).alias("reviewed_at"))


_RESOLVED_SQL = """
with d as (select 'r' || user_id as run_id, 'i' || (event_id % 40) as item_id, event_type as input_label, case when event_id % 3 <> 0 then 's' || event_id when event_id % 9 <> 0 then 'm' || event_id end as chosen, event_id from events)
select run_id, item_id, max_by(input_label, event_id) as input_label, arg_max_null(chosen, event_id) as chosen from d group by run_id, item_id having arg_max_null(chosen, event_id) is not null"""


@workload("decisions_resolved", "E4", _RESOLVED_SQL)
def decisions_resolved(spark, sf):
    return ed.resolved_labels(_decision_rows(spark, sf))


@workload("decision_log", "S8 S9", _RESOLVED_SQL)
def decision_log(spark, sf):
    """Decisions appended as JSON lines next to damaged and blank ones, read back, resolved."""
    path = _folder(spark, "decisions")
    fs.write_decisions(_decision_rows(spark, sf), path)
    table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, '{"run_id": "r1", "item').otherwise("").alias("value")).write.mode(
        "append").text(path)
    return ed.resolved_labels(fs.read_decisions(spark, path))


@workload("latest_before", "S12", """
with r as (select o_custkey, cast(year(o_orderdate) as integer) as y, max_by('f' || o_orderkey, o_orderkey) as path from orders group by all), t as (select o_custkey, y + 1 as year from r union select o_custkey, y from r)
select t.o_custkey, cast(t.year as integer) as year, max(y) as found_year, max_by(path, y) as path from t left join r on r.o_custkey = t.o_custkey and r.y < t.year group by all""")
def latest_before(spark, sf):
    """The file before every year that a customer has orders in, and before the year after it."""
    orders = table(spark, sf, "orders")
    registry = orders.select("o_custkey", F.year("o_orderdate").alias("year"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"),
                             F.col("o_orderkey").alias("seq"))
    targets = registry.select("o_custkey", F.explode(F.array("year", F.col("year") + 1)).alias("year")).distinct()
    return fs.latest_before(targets, registry, ["o_custkey"])


@workload("table_export", "S6 S10 P1", """
select o_orderpriority as code, count(*) as n, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as total from orders group by o_orderpriority""")
def table_export(spark, sf):
    """Orders exported as CSV price tables and read back by schema."""
    path = _folder(spark, "export")
    price = F.floor("o_totalprice")
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("등급구분"), F.lit("x").alias("등급명"), price.alias("지원량"),
                                             price.alias("정부지원금"), F.lit(0).cast("bigint").alias("본인부담금"))
    fs.write_table(rows, path, "csv")
    return fs.read_price_tables(spark, path, "csv").groupBy(F.col("등급구분").alias("code")).agg(
        F.count("*").alias("n"), F.sum("지원량").alias("total"))


# --- streams --------------------------------------------------------------------------------------

_BATCH_PARTS = 3
#: rows of a file that a stream takes
_FILE_ROWS = 200_000


def _files(rows) -> int:
    """Files that each part of ``rows`` is written in, all of one batch: one task writes one file."""
    return max(1, -(-rows.count() // (_BATCH_PARTS * _FILE_ROWS)))


def _in_batches(spark, rows, late: bool = False):
    """Rows laid out in three parts that a stream takes one by one; ``late`` sends the newest first."""
    folder, files = _folder(spark, "source"), _files(rows)
    part = F.when(F.col("seq") % 5 < 2, 0).when(F.col("seq") % 5 < 4, 1).otherwise(2)
    for n in range(_BATCH_PARTS):
        rows.filter(part == (_BATCH_PARTS - 1 - n if late else n)).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@workload("stream_edits", "T2 E1", """
select user_id, event_type as "column", max(event_id) as seq, max_by(value, event_id) as value from events group by user_id, event_type""")
def stream_edits(spark, sf):
    """The events as an edit stream in several batches out of order; the current cells equal the batch result."""
    edits = table(spark, sf, "events").select("user_id", F.col("event_type").alias("column"), F.col("event_id").alias("seq"), "value")
    path = _folder(spark, "cells")
    st.append_batches(_in_batches(spark, edits, late=True), path, path + "-state").awaitTermination()
    return st.current_cells(spark, path, ["user_id"])


@workload("stream_revalidate", "T2 E3", """
with e as (select user_id as o_custkey, max_by(floor(value) * 100 + case when event_id % 4 = 0 then 7 else 0 end, event_id) as v from events group by user_id),
r as (select o_orderkey, o_custkey, v as c from orders join e using (o_custkey))
select o_custkey, o_orderkey, cast(c as double) as actual from r where floor(c / 100 + 1e-9) * 100 <> c""")
def stream_revalidate(spark, sf):
    """Edits of customers' amounts in three batches out of order, some mended by others; what is
    found at the end equals one check with all edits."""
    edits = table(spark, sf, "events").select(
        F.col("user_id").alias("o_custkey"), F.lit("amount").alias("column"), F.col("event_id").alias("seq"),
        (F.floor("value") * 100 + F.when(F.col("event_id") % 4 == 0, 7).otherwise(0)).cast("string").alias("value"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("amount"))

    def suite(rows):
        return ck.explode_findings(rows, ["o_custkey", "o_orderkey"], [ck.granularity_check("GRANULARITY", "amount", F.col("amount"))])

    path = _folder(spark, "findings")
    # the order key is no part of an edit, so edits apply to all rows of a customer
    st.revalidate_edited(_in_batches(spark, edits, late=True), orders, ["o_custkey"], "o_custkey", suite, path, path + "-state").awaitTermination()
    return st.current_findings(spark, path, "o_custkey").select("o_custkey", "o_orderkey", "actual")


@workload("stream_decisions", "T1", """
with d as (select 'r' || user_id as run_id, 'i' || (event_id % 40) as item_id, case when event_id % 3 = 0 then 'manual_input' else 'select_candidate' end as action, event_type as input_label, event_id from events)
select run_id, item_id, action, min_by(input_label, case when event_id % 17 = 0 then event_id + 1000000000 else event_id end) as input_label from d group by run_id, item_id, action""")
def stream_decisions(spark, sf):
    """Decision lines as a stream whose newest file comes first: damaged lines go, times that
    cannot be read stay, and the first of repeats counts."""
    log, out = _folder(spark, "log"), _folder(spark, "decided")
    e, files = F.col("event_id"), _files(table(spark, sf, "events"))
    rows = _decision_rows(spark, sf).withColumn("seq", F.regexp_extract("reviewed_at", "([0-9]+)$", 1).cast("bigint"))
    when = F.when(F.col("seq") % 17 == 0, F.format_string("no time %010d", "seq")).otherwise(
        F.date_format(F.timestamp_seconds(F.col("seq")), "yyyy-MM-dd'T'HH:mm:ss"))
    lines = rows.withColumn("reviewed_at", when).select(F.to_json(F.struct(*[c for c in rows.columns if c != "seq"])).alias("value"), "seq")
    for n in reversed(range(_BATCH_PARTS)):
        own = lines.filter(F.col("seq") % _BATCH_PARTS == n).select("value")
        own.unionByName(table(spark, sf, "events").filter(e % 50 == n).select(F.lit('{"run_id": "r1", "it').alias("value"))).repartition(files).write.mode("append").text(log)
    decisions = st.decision_stream(spark, log, files_per_batch=files)
    st.first_decisions(decisions, out, out + "-state").awaitTermination()
    return st.kept_rows(spark, out, decisions.schema).select("run_id", "item_id", "action", "input_label")


@workload("stream_workbooks", "T3 S1", f"with {CELLS_SQL} select doc_id, sheet, count(*) as n from cells group by doc_id, sheet")
def stream_workbooks(spark, sf):
    """Part workbooks arriving batch by batch and scanned."""
    inbox, out = _folder(spark, "inbox"), _folder(spark, "seen")
    packed = part_cells(spark, sf).groupBy("doc_id").applyInPandas(_pack, "doc_id string, content binary")
    packed.write.parquet(inbox)
    arriving = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 4).parquet(inbox)

    def handle(cells, batch_id):
        cells.groupBy("doc_id", "sheet").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    st.arriving_workbooks(arriving, handle, out + "-state").awaitTermination()
    return spark.read.parquet(out).select("doc_id", "sheet", "n")


@workload("match_on_arrival", "T3 S12 M11", f"""
with {VERSION_SQL}, bl as (select distinct doc_id, sheet, replace(sval, ' ', '') as norm from btagged where vtype = 'str'),
tl as (select distinct doc_id, sheet, replace(sval, ' ', '') as norm from ttagged where vtype = 'str'),
common as (select distinct doc_id, sheet from cells join (select distinct doc_id, sheet from tcells) using (doc_id, sheet)),
m as (select bl.doc_id, count(*) as n_base, count(tl.norm) as auto_passed from bl join common using (doc_id, sheet) left join tl using (doc_id, sheet, norm) group by all)
select 't' || doc_id as target_doc, case when cast(doc_id as integer) % 7 <> 0 then 'b' || doc_id end as base_doc, case when cast(doc_id as integer) % 7 <> 0 then n_base end as n_base,
   case when cast(doc_id as integer) % 7 <> 0 then auto_passed end as auto_passed from m""")
def match_on_arrival(spark, sf):
    """This year's part grids arrive in three batches: half have last year's in the archive, others
    get it a batch later, some documents come twice, and every seventh has no earlier year."""
    cells, _ = versions(spark, sf)
    side, number = F.left("doc_id", F.lit(1)), F.substring("doc_id", 2, 20).cast("int")
    old = side == "b"
    archived = old & (number % 2 == 0)
    inbox, out = _folder(spark, "arrivals"), _folder(spark, "matched")
    batches = (~old & (number % 3 != 1), (~old & (number % 3 == 1)) | (old & ~archived), ~old & (number % 4 == 0))
    # a document that comes again first came with other texts
    early = F.when(~old & (number % 4 == 0) & F.col("sval").isNotNull(), F.concat("sval", F.lit("?"))).otherwise(F.col("sval"))
    cells = cut_lineage(cells)
    for n, own in enumerate(batches):
        cells.filter(own).withColumn("sval", early if n < 2 else F.col("sval")).coalesce(1).write.mode("append").parquet(inbox)
    registry = cells.select("doc_id").distinct().select(
        number.alias("office"), F.when(old, 2024).otherwise(2025).alias("year"), F.col("doc_id").alias("path"), F.lit(1).alias("seq")).filter(
        ~((F.col("year") == 2024) & (F.col("office") % 7 == 0)))
    arriving = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    settings = MatchSettings(required_sheets=("S0", "S1"), required_labels=())
    st.match_cells_on_arrival(arriving, registry, cells.filter(archived), out, out + "-state", settings).awaitTermination()
    last_year = st.current_report(spark, out, "items").filter(~F.array_contains("flags", "NEW_IN_TARGET")).groupBy("pair_id").agg(
        F.count("*").alias("n_base"), F.count_if(F.col("status") == fixed.AUTO_PASS).alias("auto_passed"))
    bases = st.current_baselines(spark, out).filter(F.col("target_doc").startswith("t"))
    return bases.join(last_year.withColumnRenamed("pair_id", "target_doc"), "target_doc", "left").select("target_doc", "base_doc", "n_base", "auto_passed")
