"""Cell grids derived from ``part``: two sheets of 100 filled rows per 200 parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.operators import cells as ce
from tariffloom.operators import drift as dr
from tariffloom.operators import labels as lb
from tariffloom.operators import segment as sg
from tariffloom.operators.ordered import carry_forward_nested, exact_median
from tariffloom.workloads.registry import table, workload

# After every seventh and every eleventh part a row stays blank; columns 2 and 5 and some prices do as well.
CELLS_SQL = """
cells as (
  select cast(p_partkey // 200 as varchar) as doc_id, 'S' || (p_partkey // 100) % 2 as sheet, cast(p_partkey % 100 + p_partkey % 100 // 7 + p_partkey % 100 // 11 as integer) as "row",
         cast(x.col as integer) as col, x.sval as sval, x.nval as nval, case when x.sval is null then 'num' else 'str' end as vtype
  from (select *, unnest([{'col': 0, 'sval': p_name, 'nval': null}, {'col': 1, 'sval': p_brand, 'nval': null},
      {'col': 3, 'sval': null, 'nval': p_size::double}, {'col': 4, 'sval': null, 'nval': case when p_size % 4 <> 0 then p_retailprice end},
      {'col': 6, 'sval': p_type, 'nval': null}]) as x from part)
  where x.sval is not null or x.nval is not null),
rws as (select *, "row" - row_number() over (partition by doc_id, sheet order by "row") as rb from (select distinct doc_id, sheet, "row" from cells)),
in_rows as (select cells.*, rb from cells join rws using (doc_id, sheet, "row")),
cls as (select *, col - row_number() over (partition by doc_id, sheet, rb order by col) as cb from (select distinct doc_id, sheet, rb, col from in_rows)),
boxed as (select in_rows.*, cb from in_rows join cls using (doc_id, sheet, rb, col)),
boxes as (select doc_id, sheet, rb, cb, min("row") as row0, min(col) as col0, max("row") as row1, max(col) as col1, count(*) as n_filled from boxed group by all having count(*) >= 2),
regions as (select *, row_number() over (partition by doc_id, sheet order by rb, cb) - 1 as table_idx from boxes),
tagged as (select boxed.*, table_idx, row0, col0 from boxed join regions using (doc_id, sheet, rb, cb))
"""


def part_cells(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: F.col(c).cast("string")
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def cell(col: int, sval, nval):
        return F.struct(F.lit(col).alias("col"), sval.alias("sval"), nval.alias("nval"))

    entries = F.array(cell(0, text("p_name"), none_d), cell(1, text("p_brand"), none_d),
                      cell(3, none_s, F.col("p_size").cast("double")),
                      cell(4, none_s, F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice"))),
                      cell(6, text("p_type"), none_d))
    at = k % 100
    rows = table(spark, sf, "part").select(
        F.floor(k / 200).cast("string").alias("doc_id"),
        F.concat(F.lit("S"), (F.floor(k / 100) % 2).cast("string")).alias("sheet"),
        (at + F.floor(at / 7) + F.floor(at / 11)).cast("int").alias("row"), F.inline(entries))
    return rows.filter(F.col("sval").isNotNull() | F.col("nval").isNotNull()).withColumns({
        "vtype": F.when(F.col("sval").isNull(), "num").otherwise("str"), "formula": none_s})


@workload("segment_tables", "W1 A3", f"""
with {CELLS_SQL} select doc_id, sheet, cast(table_idx as integer) as table_idx, row0, col0, row1, col1, n_filled from regions""")
def segment_tables(spark, sf):
    regions, _ = sg.segment(part_cells(spark, sf))
    return regions.drop("table_id")


@workload("used_range", "S2 S3", f"""
with {CELLS_SQL} select doc_id, sheet, min("row") as row0, max("row") as row1, min(col) as col0, max(col) as col1, count(*) as n_cells from cells group by doc_id, sheet""")
def used_range(spark, sf):
    return ce.used_range(part_cells(spark, sf))


@workload("column_profiles", "A5", f"""
with {CELLS_SQL} select doc_id, sheet, cast(table_idx as integer) as table_idx, cast(col - col0 as integer) as c,
  case when avg(case when vtype = 'num' then 1.0 else 0.0 end) > 0.8 then 'num' when avg(case when vtype = 'num' then 1.0 else 0.0 end) < 0.2 then 'text' else 'mixed' end as kind
from tagged group by doc_id, sheet, table_idx, col, col0""")
def column_profiles(spark, sf):
    return sg.column_profiles(sg.segment(part_cells(spark, sf))[1])


@workload("fingerprints", "A5 A6", f"""
with {CELLS_SQL}, h as (select doc_id, sheet, table_idx, string_agg(replace(sval, ' ', ''), '|' order by col) as headers from tagged where "row" = row0 and vtype = 'str' group by all),
k as (select doc_id, sheet, table_idx, string_agg(case when vtype = 'num' then 'num' else 'text' end, '|' order by col) as kinds from (select distinct doc_id, sheet, table_idx, col, vtype from tagged) group by all)
select doc_id, sheet, cast(table_idx as integer) as table_idx, row1 - row0 + 1 as n_rows, col1 - col0 + 1 as n_cols, coalesce(headers, '') as headers, kinds
from regions left join h using (doc_id, sheet, table_idx) left join k using (doc_id, sheet, table_idx)""")
def fingerprints(spark, sf):
    regions, tagged = sg.segment(part_cells(spark, sf))
    prints = sg.fingerprints(regions, tagged)
    return prints.select("doc_id", "sheet", "table_idx", "n_rows", "n_cols", F.array_join("headers", "|").alias("headers"),
                         F.array_join("kinds", "|").alias("kinds"))


def versions(spark, sf):
    """Last year's cells and this year's: odd documents swap columns 3 and 4 and scale sizes by
    60, every third loses row 9, every fifth its second sheet; one sheet is new everywhere."""
    base = part_cells(spark, sf)
    d = F.col("doc_id").cast("int")
    odd = d % 2 == 1
    target = base.filter(~((d % 3 == 0) & (F.col("row") == 9)) & ~((d % 5 == 0) & (F.col("sheet") == "S1"))).withColumns({
        "nval": F.when(odd & (F.col("col") == 3), F.col("nval") * 60).otherwise(F.col("nval")),
        "col": F.when(odd & (F.col("col") == 3), 4).when(odd & (F.col("col") == 4), 3)
        .when(odd & (F.col("col") == 0), 1).when(odd & (F.col("col") == 1), 0).otherwise(F.col("col")),
    })
    extra = base.filter(F.col("row") < 5).withColumn("sheet", F.lit("NEW"))
    cells = base.withColumn("doc_id", F.concat(F.lit("b"), "doc_id")).unionByName(
        target.unionByName(extra).withColumn("doc_id", F.concat(F.lit("t"), "doc_id")))
    pairs = base.select(F.col("doc_id").alias("pair_id")).distinct().select(
        "pair_id", F.concat(F.lit("b"), "pair_id").alias("base_doc"), F.concat(F.lit("t"), "pair_id").alias("target_doc"))
    return cells, pairs


def _version_sql() -> str:
    def side(prefix: str, source: str) -> str:
        renamed = CELLS_SQL.split("rws as")[1]
        for name in ("rws", "in_rows", "cls", "boxed", "boxes", "regions", "tagged"):
            renamed = renamed.replace(f" {name} ", f" {prefix}{name} ").replace(f"\n{name} as", f"\n{prefix}{name} as").replace(f"({name}.", f"({prefix}{name}.")
            renamed = renamed.replace(f" {name})", f" {prefix}{name})").replace(f"select {name}.*", f"select {prefix}{name}.*").replace(f"from {name})", f"from {prefix}{name})")
        renamed = renamed.replace("cells.*", f"{source}.*").replace("from cells", f"from {source}")
        return f"{prefix}rws as" + renamed

    start = CELLS_SQL.split("rws as")[0]
    target = """
    tcells as (select doc_id, sheet, "row", cast(case when odd and col = 3 then 4 when odd and col = 4 then 3 when odd and col = 0 then 1 when odd and col = 1 then 0 else col end as integer) as col,
      sval, case when odd and col = 3 then nval * 60 else nval end as nval, vtype
      from (select *, cast(doc_id as integer) % 2 = 1 as odd, cast(doc_id as integer) as d from cells) where not (d % 3 = 0 and "row" = 9) and not (d % 5 = 0 and sheet = 'S1')
      union all select doc_id, 'NEW', "row", col, sval, nval, vtype from cells where "row" < 5),"""
    return start + target + side("b", "cells").rstrip() + "," + side("t", "tcells")


VERSION_SQL = _version_sql()


@workload("sheet_alerts", "J10 X2", f"""
with {VERSION_SQL},
nb as (select c.doc_id, c.sheet, count(table_idx) as n from (select distinct doc_id, sheet from cells) c left join bregions r using (doc_id, sheet) group by all),
nt as (select c.doc_id, c.sheet, count(table_idx) as n from (select distinct doc_id, sheet from tcells) c left join tregions r using (doc_id, sheet) group by all)
select doc_id as pair_id, sheet, case when nb.n is null then 'SHEET_ADDED' when nt.n is null and sheet = 'S1' then 'SHEET_MISSING' when nt.n is null then 'SHEET_REMOVED' else 'TABLE_COUNT_CHANGED' end as code,
  nt.n is null as fatal, case when nb.n is null then '작년에 없던 시트입니다.' when nt.n is null and sheet = 'S1' then '값을 읽어야 하는 시트인데 올해 파일에 없습니다.' when nt.n is null then '작년 파일에만 있던 시트 (값 추출에 쓰지 않음)'
    else '표가 ' || nb.n || '개에서 ' || nt.n || '개로 늘거나 줄어, 이 시트는 값 비교를 건너뜁니다.' end as detail
from nb full outer join nt using (doc_id, sheet) where nb.n is distinct from nt.n""")
def sheet_alerts(spark, sf):
    cells, pairs = versions(spark, sf)
    regions, _ = sg.segment(cells)
    return sg.sheet_alerts(pairs, cells, regions, ("S1",)).select("pair_id", "sheet", "code", "fatal", "detail")


@workload("fingerprint_diff", "J9 X1 A5 A6", f"""
with {VERSION_SQL},
stable as (select doc_id, sheet from (select doc_id, sheet, count(*) as n from bregions group by all) b join (select doc_id, sheet, count(*) as m from tregions group by all) t using (doc_id, sheet) where n = m),
bh as (select doc_id, sheet, table_idx, list(replace(sval, ' ', '') order by col) as h from btagged where "row" = row0 and vtype = 'str' group by all),
th as (select doc_id, sheet, table_idx, list(replace(sval, ' ', '') order by col) as h from ttagged where "row" = row0 and vtype = 'str' group by all),
p as (select b.doc_id, sheet, table_idx, b.row1 - b.row0 as hb, t.row1 - t.row0 as ht, b.col1 - b.col0 as wb, t.col1 - t.col0 as wt, coalesce(bh.h, []) as h1, coalesce(th.h, []) as h2
  from bregions b join tregions t using (doc_id, sheet, table_idx) join stable using (doc_id, sheet) left join bh using (doc_id, sheet, table_idx) left join th using (doc_id, sheet, table_idx)),
bk as (select doc_id, sheet, table_idx, col - col0 as c, case when avg(case when vtype = 'num' then 1.0 else 0.0 end) > 0.8 then '숫자' when avg(case when vtype = 'num' then 1.0 else 0.0 end) < 0.2 then '문자' else '혼합' end as kind from btagged group by all),
tk as (select doc_id, sheet, table_idx, col - col0 as c, case when avg(case when vtype = 'num' then 1.0 else 0.0 end) > 0.8 then '숫자' when avg(case when vtype = 'num' then 1.0 else 0.0 end) < 0.2 then '문자' else '혼합' end as kind from ttagged group by all),
chg as (select doc_id, sheet, table_idx, list((c + 1) || '번째 ' || k1 || '→' || k2 order by c) as ch from (
   select i.doc_id, i.sheet, i.table_idx, i.c, coalesce(bk.kind, '빈칸') as k1, coalesce(tk.kind, '빈칸') as k2 from (select p.*, unnest(range(0, least(wb, wt) + 1)) as c from p) i
   left join bk using (doc_id, sheet, table_idx, c) left join tk using (doc_id, sheet, table_idx, c)) where k1 <> k2 group by all)
select doc_id as pair_id, sheet, cast(table_idx as integer) as table_idx, case when list_sort(h1) = list_sort(h2) then 'HEADER_ORDER_CHANGED' else 'TABLE_SHAPE_CHANGED' end as code,
   case when list_sort(h1) = list_sort(h2) then '머리글 순서 바뀜: ' || array_to_string(h1, ' · ') || ' → ' || array_to_string(h2, ' · ') else '머리글 구성이 달라짐' end as detail from p where h1 <> h2
union all select doc_id, sheet, cast(table_idx as integer), 'TABLE_SHAPE_CHANGED', '표 크기 ' || (hb + 1) || '행 ' || (wb + 1) || '열 → ' || (ht + 1) || '행 ' || (wt + 1) || '열' from p where hb <> ht or wb <> wt
union all select doc_id, sheet, cast(table_idx as integer), 'TABLE_SHAPE_CHANGED', case when wb <> wt then '열이 ' || (wb + 1) || '개에서 ' || (wt + 1) || '개로, ' || coalesce(array_to_string(ch[1:2], ', '), '내용 종류도 달라짐')
   else '열 내용 종류 바뀜: ' || array_to_string(ch[1:3], ', ') || case when len(ch) > 3 then ' 외 ' || (len(ch) - 3) || '개 열' else '' end end from p left join chg using (doc_id, sheet, table_idx) where ch is not null or wb <> wt""")
def fingerprint_diff(spark, sf):
    cells, pairs = versions(spark, sf)
    regions, tagged = sg.segment(cells)
    diffs = sg.fingerprint_diffs(pairs, sg.fingerprints(regions, tagged))
    return diffs.select("pair_id", "sheet", (F.regexp_extract("table_id", "#([0-9]+)", 1).cast("int") - 1).alias("table_idx"), "code", "detail")


@workload("value_drift", "W2 W3 W4 A7 J9", f"""
with {VERSION_SQL},
stable as (select doc_id, sheet from (select doc_id, sheet, count(*) as n from bregions group by all) b join (select doc_id, sheet, count(*) as m from tregions group by all) t using (doc_id, sheet) where n = m),
bv as (select doc_id, sheet, table_idx, col - col0 as c, nval, lag(nval) over (partition by doc_id, sheet, table_idx, col order by "row") as pv from btagged where vtype = 'num'),
tv as (select doc_id, sheet, table_idx, col - col0 as c, nval, lag(nval) over (partition by doc_id, sheet, table_idx, col order by "row") as pv from ttagged where vtype = 'num'),
bs as (select doc_id, sheet, table_idx, c, count(*) as n, median(nval) as m, case when bool_and(coalesce(pv > nval, true)) then -1 when bool_and(coalesce(pv < nval, true)) then 1 else 0 end as d from bv group by all),
ts as (select doc_id, sheet, table_idx, c, count(*) as n, median(nval) as m, case when bool_and(coalesce(pv > nval, true)) then -1 when bool_and(coalesce(pv < nval, true)) then 1 else 0 end as d from tv group by all),
p as (select b.doc_id, b.sheet, b.table_idx, b.c, b.d as d1, t.d as d2, b.m as m1, t.m as m2 from bs b join ts t using (doc_id, sheet, table_idx, c) join stable using (doc_id, sheet) where b.n >= 3 and t.n >= 3)
select doc_id as pair_id, sheet, cast(table_idx as integer) as table_idx, cast(c as integer) as c, 'MONOTONICITY_BROKEN' as code from p where d1 <> 0 and d1 <> d2
union all select doc_id, sheet, cast(table_idx as integer), cast(c as integer), 'UNIT_SHIFT_SUSPECTED' from p where m1 <> 0 and m2 <> 0 and (m2 / m1 > 10 or m2 / m1 < 0.1)""")
def value_drift(spark, sf):
    cells, pairs = versions(spark, sf)
    regions, tagged = sg.segment(cells)
    return dr.value_anomalies(pairs, dr.column_stats(tagged), regions).select("pair_id", "sheet", "table_idx", "c", "code")


@workload("monotone_directions", "W2 W5", """
with v as (select user_id, event_id, value, lag(value) over (partition by user_id order by event_id) as p from (select user_id * 10 + event_id % 10 as user_id, event_id, case when user_id % 3 = 0 then event_id * 1.0::double when user_id % 3 = 1 then -event_id * 1.0::double else value end as value from events))
select user_id, cast(case when bool_and(coalesce(p > value, true)) then -1 when bool_and(coalesce(p < value, true)) then 1 else 0 end as integer) as direction, count(*) as n from v group by user_id""")
def monotone_directions(spark, sf):
    u, e = F.col("user_id"), F.col("event_id")
    values = table(spark, sf, "events").select(
        (u * 10 + e % 10).alias("user_id"), "event_id",
        F.when(u % 3 == 0, e.cast("double")).when(u % 3 == 1, -e.cast("double")).otherwise(F.col("value")).alias("v"))
    return dr.directions(values, ["user_id"], "event_id", "v")


@workload("exact_median", "A7", "select user_id, median(value) as med from events group by user_id")
def exact_median_query(spark, sf):
    return exact_median(table(spark, sf, "events"), ["user_id"], "value", "med")


@workload("exact_median_hot", "A7", "select l_returnflag, median(l_extendedprice) as med from lineitem group by l_returnflag")
def exact_median_hot(spark, sf):
    """Three groups with a third of all rows each, by the bracketed way for large groups."""
    return exact_median(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "med")


@workload("text_labels", "P3 P4 A1", f"""
with {CELLS_SQL}, l as (select doc_id, sheet, replace(sval, ' ', '') as norm, sval as raw, table_idx, "row", col from tagged where vtype = 'str' and not regexp_matches(sval, '^[0-9.,%]+$'))
select doc_id, sheet, norm, raw, "row", col from (select *, row_number() over (partition by doc_id, sheet, norm order by table_idx, "row", col) as rn from l) where rn = 1""")
def text_labels(spark, sf):
    _, tagged = sg.segment(part_cells(spark, sf))
    return lb.collect_labels(lb.label_cells(tagged)).select("doc_id", "sheet", "norm", "raw", "row", "col")


@workload("label_collisions", "N4", """
with l as (select p_brand as doc_id, p_type as sheet, case p_partkey % 3 when 0 then '[' || p_name || ']' when 1 then p_name || ' (원)' else p_name end as raw, replace(p_name, ' ', '') as norm from part),
d as (select distinct doc_id, sheet, norm, raw from l), s as (select doc_id, sheet, norm, count(*) as n_raw from d group by all having count(*) > 1)
select doc_id, sheet, norm, raw, n_raw from d join s using (doc_id, sheet, norm)""")
def label_collisions(spark, sf):
    from tariffloom.functions.text import normalize_label

    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("["), "p_name", F.lit("]"))).when(k == 1, F.concat("p_name", F.lit(" (원)"))).otherwise(F.col("p_name"))
    found = table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_type").alias("sheet"), raw.alias("text"))
    return lb.collisions(found.withColumn("norm", normalize_label(F.col("text"))))


ANCHORS = ("the", "tion", "eau", "the of", "ß", "und", "1", "absent-anchor")


@workload("anchor_unique", "J8 A4 X3", """
with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as "row" from documents),
a as (select unnest(['the', 'tion', 'eau', 'the of', 'ß', 'und', '1', 'absent-anchor']) as anchor)
select doc_id, anchor, count(distinct "row") as n_rows from lines join a on contains(regexp_replace(line, '[\\s\\p{Z}]', '', 'g'), replace(anchor, ' ', '')) group by all having count(distinct "row") > 1""")
def anchor_unique(spark, sf):
    """Anchors in several lines of a document, over whole texts."""
    from tariffloom.functions.text import squeeze

    lines = table(spark, sf, "documents").select("doc_id", F.lit("s").alias("sheet"), F.lit(0).alias("table_idx"),
                                                 F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return sg.repeated_anchors(lines.withColumn("norm", squeeze(F.col("line"))), ANCHORS).select("doc_id", "anchor", "n_rows")


@workload("anchor_scan", "A19 J8", f"""
with {CELLS_SQL}, a as (select unnest(['red', 'bolt', 'Brand#1', 'ECONOMY', 'nothing']) as anchor), docs as (select distinct doc_id from cells),
h as (select doc_id, anchor, sheet, count(*) as n from cells join a on contains(sval, anchor) group by all),
t as (select doc_id, anchor, sum(n) as total, count(*) as ns from h group by all)
select doc_id, anchor, cast(coalesce(total, 0) as bigint) as total, coalesce(ns, 0) as n_sheets, case when total > 1 or ns > 1 then 'risky' when total = 1 then 'safe' else 'absent' end as risk from docs cross join a left join t using (doc_id, anchor)""")
def anchor_scan(spark, sf):
    return ce.anchor_scan(part_cells(spark, sf), ("red", "bolt", "Brand#1", "ECONOMY", "nothing"))


@workload("context_window", "J12", f"""
with {CELLS_SQL} select m.doc_id, m.sheet, m."row" as mark_row, count(*) as n, cast(sum(coalesce(c.nval, 0)) as double) as total, min(c."row") as first_row, max(c.col) as last_col
from (select * from cells where col = 3 and nval = 7) m join cells c on m.doc_id = c.doc_id and m.sheet = c.sheet and c."row" between m."row" - 3 and m."row" + 3 and c.col between m.col - 3 and m.col + 3 group by all""")
def context_window(spark, sf):
    cells = part_cells(spark, sf)
    marks = cells.filter((F.col("col") == 3) & (F.col("nval") == 7))
    around = ce.context_window(marks, cells)
    return around.groupBy("doc_id", "sheet", "mark_row").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("nval", F.lit(0.0))).alias("total"), F.min("row").alias("first_row"), F.max("col").alias("last_col"))


@workload("relative_offsets", "J11", f"""
with {CELLS_SQL} select a.doc_id, a.sheet, a."row", o.k as key, c.sval as at_sval, c.nval as at_nval from cells a cross join (values ('right', 0, 3), ('below', 1, 0), ('left', 0, -1)) o(k, dr, dc)
join cells c on c.doc_id = a.doc_id and c.sheet = a.sheet and c."row" = a."row" + o.dr and c.col = a.col + o.dc where a.col = 1 and a.sval = 'Brand#7'""")
def relative_offsets(spark, sf):
    cells = part_cells(spark, sf)
    anchored = cells.filter((F.col("col") == 1) & (F.col("sval") == "Brand#7")).select("doc_id", "sheet", "row", "col")
    return ce.at_offsets(anchored, cells, [("right", 0, 3), ("below", 1, 0), ("left", 0, -1)]).select(
        "doc_id", "sheet", "row", "key", "at_sval", "at_nval")


@workload("promote_header", "S6", f"""
with {CELLS_SQL} select doc_id, sheet, "row", max(sval) filter (where col = 0) as "이름", max(nval) filter (where col = 3) as "크기", max(nval) filter (where col = 4) as "가격" from cells group by doc_id, sheet, "row" """)
def promote_header(spark, sf):
    """A header row is put on top of every sheet, then promoted."""
    body = part_cells(spark, sf).withColumn("row", F.col("row") + 1)
    heads = body.select("doc_id", "sheet").distinct().select("doc_id", "sheet", F.inline(F.array(*[
        F.struct(F.lit(0).alias("row"), F.lit(c).alias("col"), F.lit("str").alias("vtype"), F.lit(n).alias("sval"))
        for c, n in ((0, "이름"), (3, "크기"), (4, "가격"))]))).withColumns({"nval": F.lit(None).cast("double"), "formula": F.lit(None).cast("string")})
    out = ce.promote_header(body.unionByName(heads), {"이름": "string", "크기": "double", "가격": "double"})
    rows = body.select("doc_id", "sheet", "row").distinct()
    return rows.join(out, ["doc_id", "sheet", "row"], "left").withColumn("row", F.col("row") - 1)


@workload("patch_cells", "S11", f"""
with {CELLS_SQL}, m as (select doc_id, '기본단가' as key, 'S0' as sheet, 0 as r, 3 as c from (select distinct doc_id from cells) union all select doc_id, '기본단가@S1', 'S1', 1, 3 from (select distinct doc_id from cells) union all select doc_id, 'X', 'S9', 0, 0 from (select distinct doc_id from cells)),
n as (select doc_id, sheet, r as "row", c as col, cast(doc_id as double) + 5 as v from m where sheet <> 'S9')
select coalesce(c.doc_id, n.doc_id) as doc_id, coalesce(c.sheet, n.sheet) as sheet, coalesce(c."row", n."row") as "row", coalesce(c.col, n.col) as col, case when v is null then sval end as sval, coalesce(v, nval) as nval
from cells c full outer join (select n.* from n join (select distinct doc_id, sheet from cells) using (doc_id, sheet)) n on c.doc_id = n.doc_id and c.sheet = n.sheet and c."row" = n."row" and c.col = n.col""")
def patch_cells(spark, sf):
    cells = part_cells(spark, sf)
    docs = cells.select("doc_id").distinct()
    places = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).alias("sheet"), F.lit(r).alias("row"), F.lit(c).alias("col"))
                       for k, s, r, c in (("기본단가", "S0", 0, 3), ("기본단가@S1", "S1", 1, 3), ("X", "S9", 0, 0))])
    cell_map = docs.select("doc_id", F.inline(places))
    changes = docs.select("doc_id", F.explode(F.array(F.lit("기본단가"), F.lit("X"), F.lit("unknown"))).alias("key")).withColumn(
        "value", F.col("doc_id").cast("double") + 5)
    patched, _ = ce.patch_cells(cells, cell_map, changes)
    return patched.select("doc_id", "sheet", "row", "col", "sval", "nval")


@workload("patch_skipped", "S11", """
with d as (select distinct cast(p_partkey // 200 as varchar) as doc_id from part)
select doc_id, 'X' as key, '시트를 찾을 수 없음: S9' as reason from d union all select doc_id, 'unknown', '조견표 내 위치가 기록되지 않음' from d union all select doc_id, 'F', '수식으로 계산되는 셀이기에 직접 수정 불가' from d""")
def patch_skipped(spark, sf):
    cells = part_cells(spark, sf)
    docs = cells.select("doc_id").distinct()
    formula = docs.select("doc_id", F.lit("S0").alias("sheet"), F.lit(500).alias("row"), F.lit(0).alias("col"), F.lit("num").alias("vtype"),
                          F.lit(None).cast("string").alias("sval"), F.lit(1.0).alias("nval"), F.lit("=A1").alias("formula"))
    cell_map = docs.select("doc_id", F.inline(F.array(
        F.struct(F.lit("X").alias("key"), F.lit("S9").alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col")),
        F.struct(F.lit("F").alias("key"), F.lit("S0").alias("sheet"), F.lit(500).alias("row"), F.lit(0).alias("col")))))
    changes = docs.select("doc_id", F.explode(F.array(F.lit("F"), F.lit("X"), F.lit("unknown"))).alias("key"), F.lit(1.0).alias("value"))
    return ce.patch_cells(cells.unionByName(formula), cell_map, changes)[1]


@workload("fill_context", "W6", """
with b as (select conv_id % 7 as doc_id, conv_id * 1000 + turn as ord, case when role = 'user' and turn % 4 = 0 then 'ch' || conv_id end as chapter, case when not (role = 'user' and turn % 4 = 0) and turn % 3 = 1 then 'it' || turn end as item from conversations),
c as (select *, last_value(chapter ignore nulls) over (partition by doc_id order by ord) as ch, last_value(case when chapter is not null then ord end ignore nulls) over (partition by doc_id order by ord) as at_c,
  last_value(item ignore nulls) over (partition by doc_id order by ord) as it, last_value(case when item is not null then ord end ignore nulls) over (partition by doc_id order by ord) as at_i from b)
select doc_id, ord, ch, case when at_i > coalesce(at_c, -1) then it end as it from c""")
def fill_context(spark, sf):
    """Chapter and item carried forward; few large groups, cut into pieces."""
    ord_ = F.col("conv_id") * 1000 + F.col("turn")
    opens = (F.col("role") == "user") & (F.col("turn") % 4 == 0)
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 7).alias("doc_id"), ord_.alias("ord"), F.when(opens, F.concat(F.lit("ch"), F.col("conv_id").cast("string"))).alias("c"),
        F.when(~opens & (F.col("turn") % 3 == 1), F.concat(F.lit("it"), F.col("turn").cast("string"))).alias("i"))
    out = carry_forward_nested(rows, ["doc_id"], "ord", F.col("c"), F.col("i"), "ch", "it", piece=5000)
    return out.select("doc_id", "ord", "ch", "it")
