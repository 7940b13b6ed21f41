"""Text, number and label functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tariffloom.functions import labels as lf
from tariffloom.functions import numbers as nf
from tariffloom.functions import text as tf
from tariffloom.workloads.registry import spread, table, workload

_DIRTY = "case doc_id % 4 when 0 then chr(8203) || text when 1 then '(원) ' || text || chr(160) else text end"


def _dirty(spark, sf):
    doc, text = F.col("doc_id"), F.col("text")
    spoiled = F.when(doc % 4 == 0, F.concat(F.lit("​"), text)).when(
        doc % 4 == 1, F.concat(F.lit("(원) "), text, F.lit(" "))).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", spoiled.alias("s"))


@workload("label_normalize", "N1 N3 N5 N7", f"""
with d as (select doc_id, {_DIRTY} as s from documents),
c as (select doc_id, regexp_replace(nfc_normalize(replace(s, chr(160), ' ')), '[\\p{{Cf}}\\p{{Cc}}]', '', 'g') as clean from d),
n as (select doc_id, clean, regexp_replace(translate(regexp_replace(clean, '[(\\[][\\s\\x{{a0}}]*(원|천원|백만원|pt|포인트|%|점|명|개|월|년)[\\s\\x{{a0}}]*[)\\]]', '', 'g'), '[]「」『』【】〔〕<>', ''), '[\\s\\p{{Z}}]', '', 'g') as norm from c)
select doc_id, md5(clean) as clean, md5(norm) as norm, norm = '' as blank from n""")
def label_normalize(spark, sf):
    """Whole document texts, cleaned and brought to canonical form."""
    d = _dirty(spark, sf)
    norm = tf.normalize_label(F.col("s"))
    return d.select("doc_id", F.md5(tf.sanitize(F.col("s"))).alias("clean"), norm.alias("n")).select(
        "doc_id", "clean", F.md5("n").alias("norm"), (F.col("n") == "").alias("blank"))


@workload("sanitize_audit", "N2", """
select p_partkey, case p_partkey % 3 when 0 then 'U+200B' when 1 then 'U+FEFF U+200E' else '' end as removed from part""")
def sanitize_audit(spark, sf):
    m = F.col("p_partkey") % 3
    raw = F.when(m == 0, F.concat(F.lit("​"), "p_name", F.lit("​"))).when(
        m == 1, F.concat(F.lit("﻿"), "p_name", F.lit("‎"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", tf.removed_codepoints(raw, tf.sanitize(raw)).alias("removed"))


@workload("number_parsing", "N6 N8 N9 N10", """
with t as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice as x, case l_orderkey % 6
  when 0 then cast(l_extendedprice as varchar) when 1 then ' ' || cast(cast(floor(l_extendedprice) as bigint) as varchar) || '% '
  when 2 then 'n/a' when 3 then format('{:,}', cast(floor(l_extendedprice) as bigint)) when 4 then '-' || cast(l_extendedprice as varchar) else '' end as s from lineitem),
p as (select *, try_cast(trim(replace(replace(s, ',', ''), '%', '')) as double) as loose, try_cast(trim(replace(s, ',', '')) as double) as tight from t)
select l_orderkey, l_linenumber, l_partkey, loose is not null as numeric_like, trunc(tight) as checked, loose as constant,
  case when l_orderkey % 6 in (2, 5) then null else try_cast(regexp_replace(s, '[^0-9]', '', 'g') as bigint) end as digits from p""")
def number_parsing(spark, sf):
    m, x = F.col("l_orderkey") % 6, F.col("l_extendedprice")
    whole = F.floor(x)
    s = (F.when(m == 0, x.cast("string")).when(m == 1, F.concat(F.lit(" "), whole.cast("string"), F.lit("% ")))
         .when(m == 2, "n/a").when(m == 3, F.format_number(whole, 0)).when(m == 4, F.concat(F.lit("-"), x.cast("string")))
         .otherwise(""))
    none = F.lit(None).cast("double")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.alias("s")).select(
        "l_orderkey", "l_linenumber", "l_partkey", nf.looks_numeric(F.col("s")).alias("numeric_like"),
        nf.checked_number(F.col("s"), none).alias("checked"), nf.constant_number(F.col("s"), none).alias("constant"),
        nf.amount_of(F.col("s"), none, "digits").alias("digits"))


@workload("field_values", "N12", """
with t as (select event_id, case event_id % 4 when 0 then 'int' when 1 then 'percent' when 2 then 'year' else 'text' end as kind,
   case event_id % 5 when 0 then format('{:,}', cast(floor(value * 100) as bigint)) when 1 then cast(cast(floor(value) as bigint) as varchar) || '%' when 2 then '' when 3 then event_type else '-5' end as s from events),
p as (select *, try_cast(regexp_replace(s, '[^0-9.-]', '', 'g') as double) as n from t)
select event_id, kind, case when kind = 'text' then nullif(trim(s), '') else
   case when (case when kind = 'percent' then n / 100 else n end) = floor(case when kind = 'percent' then n / 100 else n end) then cast(cast((case when kind = 'percent' then n / 100 else n end) as bigint) as varchar)
   else cast((case when kind = 'percent' then n / 100 else n end) as varchar) end end as v,
   case when s = '' or kind = 'text' then true else coalesce(n >= 0, false) end as ok from p""")
def field_values(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    kind = F.when(e % 4 == 0, "int").when(e % 4 == 1, "percent").when(e % 4 == 2, "year").otherwise("text")
    s = (F.when(e % 5 == 0, F.format_number(F.floor(v * 100), 0)).when(e % 5 == 1, F.concat(F.floor(v).cast("string"), F.lit("%")))
         .when(e % 5 == 2, "").when(e % 5 == 3, F.col("event_type")).otherwise("-5"))
    rows = table(spark, sf, "events").select("event_id", kind.alias("kind"), s.alias("s"))
    return rows.select("event_id", "kind", nf.field_value(F.col("kind"), F.col("s")).alias("v"),
                       nf.field_valid(F.col("kind"), F.col("s")).alias("ok"))


@workload("money_tokens", "N13 N14", """
with t as (select doc_id, text || ' ' || format('{:,}', doc_id * 1000 + 1234) || '원, ' || (doc_id % 15) || ' 구간 ' || (doc_id % 4) || '등급 ' || (1000 + n_chars) || '원' as s from documents),
m as (select doc_id, list_transform(regexp_extract_all(s, '([0-9,]{4,})원', 1), lambda x: try_cast(replace(x, ',', '') as bigint)) as a, s from t)
select doc_id, array_to_string(a, '|') as amounts, cast(regexp_extract(s, '([0-9]+)\\s*구간', 1) as integer) as seg, cast(regexp_extract(s, '([0-9]+)\\s*등급', 1) as integer) as grade from m""")
def money_tokens(spark, sf):
    doc = F.col("doc_id")
    s = F.concat("text", F.lit(" "), F.format_number(doc * 1000 + 1234, 0), F.lit("원, "), (doc % 15).cast("string"), F.lit(" 구간 "),
                 (doc % 4).cast("string"), F.lit("등급 "), (F.col("n_chars") + 1000).cast("string"), F.lit("원"))
    d = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.array_join(F.transform(nf.money_tokens(F.col("s")), lambda x: x.cast("string")), "|").alias("amounts"),
                    nf.segment_number(F.col("s")).alias("seg"), nf.grade_number(F.col("s")).alias("grade"))


@workload("structure_parse", "N15 N16", """
with t as (select p_partkey, case p_partkey % 5 when 0 then p_size || '등급' when 1 then '0' || p_size || '구간' when 2 then p_size || '.0%이하' when 3 then p_name || '기본형' else p_name end as l,
  case p_partkey % 5 when 0 then (p_size + p_partkey % 2) || '등급' when 1 then p_size || '구간' when 2 then p_size || case when p_partkey % 2 = 0 then '%이하' else '%초과' end when 3 then p_name || '확장형' else p_name end as r from part),
k as (select p_partkey, case when p_partkey % 5 = 0 then 'ordinal:' || cast(regexp_extract(l, '[0-9]+') as bigint) || ':등급' when p_partkey % 5 = 1 then 'ordinal:' || cast(regexp_extract(l, '[0-9]+') as bigint) || ':구간'
   when p_partkey % 5 = 2 then 'band:' || cast(cast(regexp_extract(l, '[0-9.]+') as double) as varchar) || ':이하' when p_partkey % 5 = 3 then 'form:' || replace(l, '기본형', '') || ':기본형' end as key,
   case p_partkey % 5 when 0 then p_partkey % 2 = 0 when 1 then true when 2 then p_partkey % 2 = 0 when 3 then false end as same from t)
select * from k""")
def structure_parse(spark, sf):
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    txt = size.cast("string")
    left = (F.when(k % 5 == 0, F.concat(txt, F.lit("등급"))).when(k % 5 == 1, F.concat(F.lit("0"), txt, F.lit("구간")))
            .when(k % 5 == 2, F.concat(txt, F.lit(".0%이하"))).when(k % 5 == 3, F.concat(name, F.lit("기본형"))).otherwise(name))
    right = (F.when(k % 5 == 0, F.concat((size + k % 2).cast("string"), F.lit("등급"))).when(k % 5 == 1, F.concat(txt, F.lit("구간")))
             .when(k % 5 == 2, F.concat(txt, F.when(k % 2 == 0, "%이하").otherwise("%초과")))
             .when(k % 5 == 3, F.concat(name, F.lit("확장형"))).otherwise(name))
    rows = table(spark, sf, "part").select("p_partkey", left.alias("l"), right.alias("r"))
    return rows.select("p_partkey", lf.structure_key(F.col("l")).alias("key"), lf.same_structure(F.col("l"), F.col("r")).alias("same"))


@workload("key_forms", "N18 N19", """
select l_orderkey, l_linenumber, l_partkey, regexp_replace(l_returnflag || ' (기본형).' || l_linestatus || '-·/' || l_linenumber, '[\\s()（）\\[\\]「」『』·・,.\\-_/]', '', 'g') as k,
  case when c >= 702 then chr(cast(65 + ((c - 702) // 676) % 26 as integer)) else '' end || case when c >= 26 then chr(cast(65 + ((c - 26) // 26) % 26 as integer)) else '' end || chr(cast(65 + c % 26 as integer)) || (l_orderkey + 1) as a1
from (select *, l_partkey % 18278 as c from lineitem)""")
def key_forms(spark, sf):
    k = F.concat("l_returnflag", F.lit(" (기본형)."), "l_linestatus", F.lit("-·/"), F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tf.key_form(k).alias("k"),
        tf.a1_name(F.col("l_orderkey"), F.col("l_partkey") % 18278).alias("a1"))


@workload("phrase_classes", "N22", """
select p_partkey, case when p_partkey % 7 = 0 then '학교생활' when p_partkey % 7 = 1 then '나머지가구구성원의직장생활등' when p_partkey % 7 = 2 then '최중증1인가구' when p_partkey % 7 = 3 then '2등급이하1인가구'
  when p_partkey % 7 = 4 then '1등급취약가구' when p_partkey % 7 = 5 then '출산' end as item from part""")
def phrase_classes(spark, sf):
    k = F.col("p_partkey") % 7
    texts = ["학교에 다니는 경우", "나머지 가구구성원의 직장에 다니는 경우", "독거 가구, 400점 이상", "독거 가구, 380점 미만", "가구구성원이 있는 390점", "수급자가 출산한 경우"]
    label = F.concat("p_name", F.element_at(F.array(*map(F.lit, [*texts, "기타"])), (k + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", lf.supplement_item(label).alias("item"))


@workload("display_texts", "N23", """
select doc_id, case when length(t) <= 20 then t else substr(t, 1, 20) || '…' end as short, '제1장 › 표' || doc_id || ' 행' || (doc_id % 9) || ' › ' || case when length(t) <= 20 then t else substr(t, 1, 20) || '…' end as place,
  format('{:,}', n_chars * 1000) || '원' as money from (select *, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) as t from documents)""")
def display_texts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tf.one_line(F.col("text")).alias("short"),
        tf.locator_text(F.lit("제1장"), F.lit(""), F.col("doc_id"), F.col("doc_id") % 9, F.col("text")).alias("place"),
        tf.money_text(F.col("n_chars") * 1000).alias("money"))


@workload("business_year", "N24", """
select o_orderkey, cast(year(o_orderdate) + case when month(o_orderdate) = 12 then 1 else 0 end as integer) as y from orders""")
def business_year(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", nf.business_year(F.col("o_orderdate")).alias("y"))


@workload("bigram_counts", "N25", """
with t as (select doc_id, unnest(case when length(text) < 2 then [text] else list_transform(range(1, length(text)), lambda i: substr(text, i, 2)) end) as g from documents)
select g, count(*) as n, count(distinct doc_id) as docs from t group by g""")
def bigram_counts(spark, sf):
    """Tokens are counted by document where its rows met; one row a token and task is shuffled, not one a
    token and document."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    own = d.select("doc_id", F.explode(tf.bigrams(F.col("text"))).alias("g")).groupBy("doc_id", "g").agg(F.count("*").alias("n"))
    return own.groupBy("g").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


@workload("numeric_relation", "N26 M5 K8", """
with t as (select p_partkey, (case when p_partkey % 3 = 0 then '2024 ' else '' end) || p_name || ' ' || p_size as l,
   case p_partkey % 4 when 0 then '2025 ' || p_name || ' ' || p_size when 1 then p_name || ' ' || (p_size + 1) when 2 then p_name || ' ' || p_size || ' ' || p_size else p_name end as r from part),
n as (select p_partkey, list_filter(regexp_extract_all(l, '[0-9]+(\\.[0-9]+)?'), lambda x: not regexp_matches(x, '^(19|20)[0-9]{2}$')) as a,
  list_filter(regexp_extract_all(r, '[0-9]+(\\.[0-9]+)?'), lambda x: not regexp_matches(x, '^(19|20)[0-9]{2}$')) as b from t),
u as (select p_partkey, x, sum(s) as d from (select p_partkey, unnest(a) as x, 1 as s from n union all select p_partkey, unnest(b), -1 from n) group by all),
c as (select p_partkey, coalesce(bool_or(d > 0), false) as more_l, coalesce(bool_or(d < 0), false) as more_r from u group by p_partkey)
select p_partkey, case when more_l and more_r then 'conflict' when more_l or more_r then 'extra' else 'same' end as relation from n left join c using (p_partkey)""")
def numeric_relation(spark, sf):
    k, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_name")
    sp = F.lit(" ")
    left = F.concat(F.when(k % 3 == 0, "2024 ").otherwise(""), name, sp, size)
    right = (F.when(k % 4 == 0, F.concat(F.lit("2025 "), name, sp, size)).when(k % 4 == 1, F.concat(name, sp, (F.col("p_size") + 1).cast("string")))
             .when(k % 4 == 2, F.concat(name, sp, size, sp, size)).otherwise(name))
    rows = table(spark, sf, "part").select("p_partkey", lf.plain_numbers(left).alias("a"), lf.plain_numbers(right).alias("b"))
    return rows.select("p_partkey", lf.numeric_relation(F.col("a"), F.col("b")).alias("relation"))


@workload("antonym_conflict", "M6", """
select p_partkey, p_partkey % 6 in (0, 2, 3, 4) as clash from part""")
def antonym_conflict(spark, sf):
    k = F.col("p_partkey") % 6
    ends = [("90%이하", "90%초과"), ("최소", "최소"), ("재판정가능", "재판정불가능"), ("해당없음", "해당"), ("가산포함", "감산포함"), ("이전", "제외")]
    pick = lambda n: F.concat("p_name", F.element_at(F.array(*[F.lit(e[n]) for e in ends]), (k + 1).cast("int")))
    rows = table(spark, sf, "part").select("p_partkey", pick(0).alias("l"), pick(1).alias("r"))
    left, right = F.col("l"), F.col("r")
    return rows.select("p_partkey", lf.opposite(
        lf.opposite_mask(left), lf.opposite_mask(right), lf.negated(left), lf.negated(right)).alias("clash"))
