"""Label matching inside blocks of part names: brands hold the blocks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.text import normalize_label
from tariffloom.operators.ordered import previous_value
from tariffloom.operators.similarity import HybridConfig, cosine_of, dense_score, rank_candidates, score_pairs
from tariffloom.plans import match as mt
from tariffloom.workloads.grids import VERSION_SQL, versions
from tariffloom.workloads.registry import WORKLOADS, table, workload

# last year: part names with their size; this year some are respelt, swapped or renumbered
BASE_SQL = r"""
b0 as (select p_brand as block, p_name || ' ' || p_size as raw, min(p_partkey) as pos from part group by all),
t0 as (select p_brand as block, case p_size % 6 when 0 then '[' || p_name || '] ' || p_size when 1 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' ' || p_size
    when 2 then p_name || ' ' || (p_size + 50) when 3 then p_name || 's ' || p_size || ' ２０２４' else p_name || ' ' || p_size end as raw, min(p_partkey) as pos from part group by all),
base as (select block, replace(raw, ' ', '') as norm, raw, pos from b0),
targ as (select block, translate(translate(replace(raw, ' ', ''), '[]', ''), '２０４', '204') as norm, raw, pos from t0),
sure as (select b.block, b.norm, min_by(p, prio) as path, min_by(t_norm, prio) as t_norm, min_by(t_raw, prio) as t_raw from (
   select b.block, b.norm, 0 as prio, 'exact' as p, t.norm as t_norm, t.raw as t_raw from base b join targ t on b.block = t.block and b.raw = t.raw
   union all select b.block, b.norm, 1, 'normalized', t.norm, t.raw from base b join targ t on b.block = t.block and b.norm = t.norm) b group by all),
rest as (select * from base b where not exists (select 1 from sure s where s.block = b.block and s.norm = b.norm))
"""

# what follows from targ (block, pos, norm, raw) and rest (block, norm): counts, weights, scores of all pairs and their ranks
RANK_SQL = r"""
tt as (select block, pos, norm, unnest(list_transform(range(1, length(norm)), lambda i: substr(norm, i, 2))) as g from targ),
tf as (select block, pos, norm, g, count(*) as tf from tt group by all),
dl as (select block, pos, norm, length(norm) - 1 as len from targ),
st as (select block, count(*) as n, avg(len) as al from dl group by block),
dfr as (select block, g, count(*) as d from tf group by all),
qt as (select block, norm, g, count(*) as qtf, length(norm) - 1 as len from (select block, norm, unnest(list_transform(range(1, length(norm)), lambda i: substr(norm, i, 2))) as g from rest) group by all),
qi as (select q.*, n, al, case when d is null then ln((n + 0.5) / 0.5 + 1) else greatest(ln((n - d + 0.5) / (d + 0.5) + 1), 0.01) end as idf from qt q join st using (block) left join dfr using (block, g)),
own as (select block, norm, sum(qtf * idf * qtf * 2.5 / (qtf + 1.5 * (0.25 + 0.75 * len / al))) as self from qi group by all),
hit as (select q.block, q.norm as qn, t.pos, sum(q.qtf * q.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * dl.len / q.al))) as raw from qi q join tf t on t.block = q.block and t.g = q.g join dl on dl.block = t.block and dl.pos = t.pos group by all),
pairs as (select r.block, r.norm as qn, t.pos, t.norm as tn, t.raw as t_raw, least(coalesce(h.raw, 0) / o.self, 1) as bm25 from rest r join own o using (block, norm) join targ t on t.block = r.block left join hit h on h.block = r.block and h.qn = r.norm and h.pos = t.pos),
num as (select *, list_filter(regexp_extract_all(qn, '[0-9]+'), lambda x: not regexp_matches(x, '^(19|20)[0-9]{2}$')) as a, list_filter(regexp_extract_all(tn, '[0-9]+'), lambda x: not regexp_matches(x, '^(19|20)[0-9]{2}$')) as b from pairs),
veto as (select *, case when list_sort(a) = list_sort(b) then 1.0 when len(list_intersect(a, b)) = len(a) or len(list_intersect(a, b)) = len(b) then 0.6 else 0.15 end as factor from num),
rk as (select *, 0.6 * bm25 * factor as final, row_number() over (partition by block, qn order by round(0.6 * bm25 * factor, 9) desc, pos) as rank from veto)
"""


LABELS_SQL = BASE_SQL.rstrip() + "," + RANK_SQL


def part_labels(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    size, name, sp = F.col("p_size"), F.col("p_name"), F.lit(" ")
    text = size.cast("string")
    m = size % 6
    renamed = (
        F.when(m == 0, F.concat(F.lit("["), name, F.lit("] "), text))
        .when(m == 1, F.concat(F.split_part(name, sp, F.lit(2)), sp, F.split_part(name, sp, F.lit(1)), sp, text))
        .when(m == 2, F.concat(name, sp, (size + 50).cast("string"))).when(m == 3, F.concat(name, F.lit("s "), text, F.lit(" ２０２４")))
        .otherwise(F.concat(name, sp, text)))

    def side(raw):
        return part.groupBy(F.col("p_brand").alias("block"), raw.alias("raw")).agg(F.min("p_partkey").alias("pos")).select(
            "block", normalize_label(F.col("raw")).alias("norm"), "raw", "pos")

    return side(F.concat(name, sp, text)), side(renamed)


@workload("deterministic_match", "J1 J2 J4", f"with {LABELS_SQL} select block, norm, path as match_path, t_norm, t_raw from sure")
def deterministic_match(spark, sf):
    base, target = part_labels(spark, sf)
    return mt.deterministic_matches(base, target, ["block"]).drop("pos")


@workload("structure_match", "J3 J4", """
with p as (select distinct p_brand as block, p_size as n from part)
select block, (n || '.0%이하') as norm, 'rule_parser' as match_path, n || '%이하' as t_raw from p""")
def structure_match(spark, sf):
    """Labels that differ in text but not in structure."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("block"), F.col("p_size").alias("n")).distinct()

    def side(suffix):
        raw = F.concat(F.col("n").cast("string"), F.lit(suffix))
        return p.select("block", raw.alias("norm"), raw.alias("raw"), F.col("n").cast("bigint").alias("pos"))

    return mt.deterministic_matches(side(".0%이하"), side("%이하"), ["block"]).select("block", "norm", "match_path", "t_raw")


@workload("bm25_top3", "N25 M1 M2 K1 J5 M5 M7 W7", f"""
with {LABELS_SQL} select block, qn as norm, cast(rank as integer) as rank, tn as t_norm, round(bm25, 6) as bm25, round(final, 6) as final from rk where rank <= 3""")
def bm25_top3(spark, sf):
    base, target = part_labels(spark, sf)
    sure = mt.deterministic_matches(base, target, ["block"])
    rest = base.join(sure.select("block", "norm"), ["block", "norm"], "left_anti")
    ranked = rank_candidates(rest, target.select("block", "norm", "pos"), ["block"])
    return ranked.select("block", F.col("q_norm").alias("norm"), "rank", "t_norm", F.round("bm25", 6).alias("bm25"), F.round("final", 6).alias("final"))


# the items that follow from base, targ, sure and the ranks
ITEMS_SQL = r"""
top as (select *, count(*) over (partition by block, pos) > 1 as contested from rk where rank = 1),
nxt as (select block, qn, final as second from rk where rank = 2),
j as (select top.*, final - second < 0.05 as low from top left join nxt using (block, qn)),
old as (select b.block, b.norm, case when s.path is not null then 'auto_pass' when j.final >= 0.28 then 'needs_review' else 'unmatched' end as status, coalesce(s.path, 'hybrid') as match_path, s.t_raw as matched_label,
   concat_ws('|', case when low then 'LOW_MARGIN' end, case when contested then 'CONTESTED' end) as flags, coalesce(s.t_norm, case when j.final >= 0.28 then j.tn end) as claimed
   from base b left join sure s using (block, norm) left join j on j.block = b.block and j.qn = b.norm),
items as (select block, norm, status, match_path, matched_label, flags from old
   union all select block, norm, 'unmatched', 'hybrid', null, 'NEW_IN_TARGET' from targ t where not exists (select 1 from old i where i.block = t.block and i.claimed = t.norm) and not exists (select 1 from base b where b.block = t.block and b.norm = t.norm))
"""


@workload("hybrid_match", "J4 J6 M4 M7 M8 M11 A14 W7 K1 P5", f"""
with {LABELS_SQL.rstrip()},{ITEMS_SQL} select * from items""")
def hybrid_match(spark, sf):
    base, target = part_labels(spark, sf)
    items = mt.match_labels(base, target, ["block"], piece=1000)["items"]
    return items.select("block", "norm", "status", "match_path", "matched_label", F.array_join("flags", "|").alias("flags"))


@workload("match_summary", "A2 P5", f"""
with {LABELS_SQL}, top as (select *, count(*) over (partition by block, pos) > 1 as contested from rk where rank = 1),
items as (select b.block, b.norm, s.path, j.final, j.contested, coalesce(s.t_norm, case when j.final >= 0.28 then j.tn end) as claimed from base b left join sure s using (block, norm) left join top j on j.block = b.block and j.qn = b.norm),
fresh as (select block, count(*) as n_new from targ t where not exists (select 1 from items i where i.block = t.block and i.claimed = t.norm) and not exists (select 1 from base b where b.block = t.block and b.norm = t.norm) group by block)
select block, cast(count(*) + coalesce(max(n_new), 0) as bigint) as total_labels, count(*) filter (path is not null) as auto_passed, count(*) filter (path is null and final >= 0.28) as needs_review,
  cast(count(*) filter (path is null and not final >= 0.28) + coalesce(max(n_new), 0) as bigint) as unmatched, count(*) filter (contested) as contested from items left join fresh using (block) group by block""")
def match_summary(spark, sf):
    base, target = part_labels(spark, sf)
    return mt.summarize(mt.match_labels(base, target, ["block"], piece=1000)["items"], ["block"])


@workload("dense_rescale", "M3", """
with q as (select vec_id, embedding, label from embeddings where vec_id % 2 = 0), t as (select vec_id as t_id, embedding as t_emb, label as t_label from embeddings where vec_id % 2 = 1)
select vec_id, t_id, round(least(greatest((list_sum(list_transform(list_zip(embedding, t_emb), lambda z: z[1]::double * z[2]::double)) - 0.1) / 0.9, 0), 1), 6) as dense from q join t on t_id = vec_id + 1""")
def dense_rescale(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 2 = 0").select("vec_id", "embedding")
    t = e.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("t_id"), F.col("embedding").alias("t_emb"))
    cosine = cosine_of(F.col("embedding"), F.col("t_emb"))
    return q.join(t, "vec_id").select("vec_id", "t_id", F.round(dense_score(cosine, 0.1), 6).alias("dense"))


@workload("dense_top3", "M3 M4 K1", """
with q as (select vec_id, embedding, label from embeddings where vec_id % 5 = 0), t as (select vec_id as t_id, embedding as t_emb, label from embeddings where vec_id % 5 <> 0),
p as (select label, vec_id, t_id, least(greatest((list_sum(list_transform(list_zip(embedding, t_emb), lambda z: z[1]::double * z[2]::double)) - 0.05) / 0.95, 0), 1) as d from q join t using (label)),
r as (select *, row_number() over (partition by label, vec_id order by round(d, 9) desc, t_id) as rank from p)
select label, vec_id, t_id, cast(rank as integer) as rank, round(d, 6) as dense from r where rank <= 3""")
def dense_top3(spark, sf):
    """Nearest labels by vector alone (alpha 0); every fifth vector asks within its label's block."""
    e = table(spark, sf, "embeddings")
    named = e.select("label", F.col("vec_id").alias("pos"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("norm"),
                     F.col("embedding").alias("vec"))
    queries = named.filter("pos % 5 = 0").select("label", "norm")
    targets = named.filter("pos % 5 <> 0").select("label", "norm", "pos")
    ranked = rank_candidates(queries, targets, ["label"], HybridConfig(alpha=0.0, cosine_floor=0.05, vetoes=False, tile=64),
                             named.select("norm", "vec"))
    return ranked.select("label", F.substring("q_norm", 2, 20).cast("bigint").alias("vec_id"), F.col("pos").alias("t_id"), "rank",
                         F.round("embedding", 6).alias("dense"))


@workload("blended_top3", "M3 M4 K1 W7", f"""
with v as (select label as block, translate(cast(vec_id as varchar), '0123456789', 'abcdefghij') || '값' as norm, vec_id as pos, embedding from embeddings),
targ as (select block, norm, norm as raw, pos from v where pos % 5 <> 0), rest as (select block, norm from v where pos % 5 = 0),{RANK_SQL.rstrip()},
d as (select rk.*, least(greatest((list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) - 0.05) / 0.95, 0), 1) as dense
   from rk join v a on a.block = rk.block and a.norm = rk.qn join v b on b.block = rk.block and b.pos = rk.pos),
f as (select *, 0.6 * bm25 + 0.4 * dense as blend, row_number() over (partition by block, qn order by round(0.6 * bm25 + 0.4 * dense, 9) desc, pos) as place from d)
select block, qn as norm, pos as t_id, cast(place as integer) as rank, round(bm25, 6) as bm25, round(dense, 6) as dense, round(blend, 6) as final from f where place <= 3""")
def blended_top3(spark, sf):
    """Every fifth vector asks by its name and its vector together, six parts to four; tiles that can
    hold nothing better are left out by their tokens and their distances to pivots."""
    e = table(spark, sf, "embeddings")
    name = F.concat(F.translate(F.col("vec_id").cast("string"), "0123456789", "abcdefghij"), F.lit("값"))
    named = e.select(F.col("label").alias("block"), name.alias("norm"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    ranked = rank_candidates(named.filter("pos % 5 = 0").select("block", "norm"), named.filter("pos % 5 <> 0").select("block", "norm", "pos"), ["block"],
                             HybridConfig(alpha=fixed.ALPHA, cosine_floor=0.05, tile=8, chunk=16), named.select("norm", "vec"))
    return ranked.select("block", F.col("q_norm").alias("norm"), F.col("pos").alias("t_id"), "rank", F.round("bm25", 6).alias("bm25"),
                         F.round("embedding", 6).alias("dense"), F.round("final", 6).alias("final"))


@workload("matcher_evaluation", "M12", f"""
with {LABELS_SQL.rstrip()}, near as (select block, pos, norm, lead(norm) over (partition by block order by pos) as other, lag(norm) over (partition by block order by pos) as third from targ),
gold as (select b.block, b.norm as qn, t.norm as gold, t.pos as gpos, b.pos % 6 as kind, s.path is not null as sure, list_filter([t.other, t.third], lambda x: x is not null) as others
   from base b join near t using (block, pos) left join sure s on s.block = b.block and s.norm = b.norm),
sc as (select gold.block, gold.qn, max(case when rk.tn = gold then round(final, 9) end) as gs, max(case when rk.tn <> gold and list_contains(others, rk.tn) then round(final, 9) end) as os,
   max(case when rank = 1 then final end) as best, min(case when rk.tn = gold then rank end) as gr, max(case when rank = 1 then rk.tn end) as top1 from gold join rk on rk.block = gold.block and rk.qn = gold.qn group by all),
j as (select gold.*, case kind when 0 then coalesce(gr, 99) <= 3 when 1 then coalesce(top1 = gold and coalesce(os, case when len(others) > 0 then 0 else -1 end) < coalesce(gs, 0), false)
   when 2 then coalesce(best, 0) < 0.28 when 3 then qn = gold or coalesce(gr, 99) <= 3 when 4 then not list_contains(others, gold) else qn = gold end as passed
   from gold left join sc using (block, qn) where not sure or kind in (3, 4, 5))
select ['review_top3', 'top1_strict', 'no_match', 'never_silent_fail', 'pairwise_distinct', 'auto_pass_after_norm'][kind + 1] as subtype, count(*) as n, round(avg(passed::integer), 6) as pass_rate from j group by kind""")
def matcher_evaluation(spark, sf):
    """Judge the ranking against the labels known to belong together, by all six rules; the labels
    next to the right one distract, and their scores count whatever their rank."""
    rules = ("review_top3", "top1_strict", "no_match", "never_silent_fail", "pairwise_distinct", "auto_pass_after_norm")
    base, target = part_labels(spark, sf)
    sure = mt.deterministic_matches(base, target, ["block"]).select("block", "norm", F.lit(True).alias("sure"))
    rest = base.join(sure, ["block", "norm"], "left_anti")
    labels = target.select("block", "norm", "pos")
    ranked = rank_candidates(rest, labels, ["block"])
    following = previous_value(labels.withColumn("down", -F.col("pos")), ["block"], "down", "norm", "other", 1000)
    around = previous_value(following, ["block"], "pos", "norm", "third", 1000).select(
        "block", "pos", F.col("norm").alias("gold_norm"), F.array_compact(F.array("other", "third")).alias("distractors"))
    kind = (F.col("pos") % 6).cast("int")
    rule = F.get(F.array(*map(F.lit, rules)), kind)
    case_id = F.concat_ws("|", "block", F.col("q_norm")).alias("case_id")
    gold = base.join(around, ["block", "pos"]).join(sure, ["block", "norm"], "left").filter(F.col("sure").isNull() | (kind >= 3)).select(
        "block", F.concat_ws("|", "block", "norm").alias("case_id"), rule.alias("subtype"), rule.alias("expect"), F.col("norm").alias("q_norm"), "gold_norm", "distractors")
    asked = gold.select("block", "q_norm", F.explode(F.array_append("distractors", F.col("gold_norm"))).alias("t_norm"))
    scores = score_pairs(asked, rest, labels, ["block"]).select(case_id, "t_norm", "final")
    rates = mt.pass_rates(mt.judge_ranking(gold.drop("block"), ranked.select(case_id, "rank", "t_norm", "final"), scores))
    return rates.withColumn("pass_rate", F.round("pass_rate", 6))


_MISSING_SQL = """
d as (select distinct 'd' || (p_partkey // 200) as doc from part), l as (select 'd' || (p_partkey // 200) as doc, replace(p_name, ' ', '') as norm, cast(min(p_partkey % 200) as integer) as "row" from part group by all),
r(req_no, find, exact, tables) as (values (0, 'red', false, ['TABLE_BASIC']), (1, 'redbolt', true, ['TABLE_ADD', 'TABLE_BASIC']), (2, 'bluegizmo', true, ['TABLE_ADD']), (3, 'zzz', false, ['TABLE_BASIC']), (4, 'zz', true, ['TABLE_BASIC'])),
h as (select doc, req_no, count(distinct "row") as n from l join r on case when exact then norm = find else contains(norm, find) end group by all),
m as (select doc as pair_id, req_no, find, tables, case when n is null then '올해 파일에서 찾지 못했습니다' else '서로 다른 ' || n || '개 행에 나뉘어 있어 어디서 읽을지 정할 수 없습니다' end as reason
  from d cross join r left join h using (doc, req_no) where n is null or (not exact and n > 1))""".replace("TABLE_BASIC", fixed.TABLE_BASIC).replace("TABLE_ADD", fixed.TABLE_ADD)


def _missing(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    doc = F.concat(F.lit("d"), F.floor(F.col("p_partkey") / 200).cast("string")).alias("doc_id")
    labels = part.groupBy(doc, F.regexp_replace("p_name", " ", "").alias("norm")).agg(
        F.min(F.col("p_partkey") % 200).cast("int").alias("row")).withColumns({"sheet": F.lit("s"), "col": F.lit(0)})
    pairs = part.select(doc).distinct().select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("base_doc"), F.col("doc_id").alias("target_doc"))
    wanted = [("red", "s", "v", (fixed.TABLE_BASIC,), False), ("red bolt", "s", "v", (fixed.TABLE_ADD, fixed.TABLE_BASIC), True),
              ("blue gizmo", "s", "v", (fixed.TABLE_ADD,), True), ("zzz", "s", "v", (fixed.TABLE_BASIC,), False), ("zz", "s", "v", (fixed.TABLE_BASIC,), True)]
    return mt.missing_labels(pairs, labels, wanted), labels


@workload("required_missing", "J7 J8 X12", f"""
with {_MISSING_SQL} select pair_id, req_no, reason, array_to_string(tables, '|') as tables, l."row" as base_row, case when l.norm is not null then 0 end as base_col
from m left join l on l.doc = m.pair_id and l.norm = m.find""")
def required_missing(spark, sf):
    """Required labels that are absent or ambiguous, with the tables they block and their cell last year."""
    missing, _ = _missing(spark, sf)
    return missing.select("pair_id", "req_no", "reason", F.array_join("tables", "|").alias("tables"), "base_row", "base_col")


@workload("missing_suggestions", "M9 M1 K1", f"""
with {_MISSING_SQL.rstrip()}, targ as (select doc as block, norm, norm as raw, "row" as pos from l), rest as (select distinct pair_id as block, find as norm from m),{RANK_SQL.rstrip()}
select block as pair_id, qn as find, cast(rank as integer) as rank, tn as t_norm, round(bm25, 6) as bm25, round(final, 6) as final from rk where rank <= 3""")
def missing_suggestions(spark, sf):
    """For every required label that is missing or ambiguous the three likeliest of this year's labels."""
    missing, labels = _missing(spark, sf)
    found = labels.select(F.col("doc_id").alias("pair_id"), "sheet", "norm", F.col("row").cast("bigint").alias("pos"))
    ranked = mt.suggestions(missing, found)
    return ranked.select("pair_id", F.col("q_norm").alias("find"), "rank", "t_norm", F.round("bm25", 6).alias("bm25"), F.round("final", 6).alias("final"))


@workload("blocked_tables", "A15", f"""
with {_MISSING_SQL}, t as (select pair_id, req_no, unnest(tables) as "table", generate_subscripts(tables, 1) - 1 as k from m)
select pair_id, "table", cast(min(req_no * 1000 + k) as bigint) as first_at from t group by pair_id, "table\"""")
def blocked_tables(spark, sf):
    """Price tables that missing labels block, with the place that names each first."""
    missing, _ = _missing(spark, sf)
    at = F.col("first_seen.req_no").cast("bigint") * 1000 + F.col("first_seen.k")
    return mt.blocked_tables(missing).select("pair_id", "table", at.alias("first_at"))


@workload("item_ids", "M11", """
select 'L' || p_partkey as norm, 'sheet-' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as item_id
from (select p_partkey, row_number() over (order by p_partkey) - 1 as n from part)""")
def item_ids(spark, sf):
    """Ids of one sheet's items stay apart however many labels it has."""
    part = table(spark, sf, "part")
    cells = part.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("doc_id"), F.lit("sheet").alias("sheet"),
                        F.col("p_partkey").cast("int").alias("row"), F.lit(0).alias("col"), F.lit("str").alias("vtype"),
                        F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("sval"), F.lit(None).cast("double").alias("nval"),
                        F.lit(None).cast("string").alias("formula"))
    pairs = part.limit(1).select(F.lit("p").alias("pair_id"), F.lit("a").alias("base_doc"), F.lit("b").alias("target_doc"))
    return mt.match_documents(cells, pairs)["items"].select("norm", "item_id")


def _report(spark, sf) -> Mapping[str, DataFrame]:
    cells, pairs = versions(spark, sf)
    settings = mt.MatchSettings(required_sheets=("S1",), required_labels=(("bolt", "S0", "v", (fixed.TABLE_BASIC,), False),))
    return mt.match_documents(cells, pairs, settings)


@workload("match_documents", "M10 M11 A2 P3 P4", f"""
with {VERSION_SQL}, common as (select distinct doc_id, sheet from cells join (select distinct doc_id, sheet from tcells) using (doc_id, sheet)),
bl as (select *, replace(sval, ' ', '') as norm, table_idx * 4398046511104 + "row" * 262144 + col as pos from btagged join common using (doc_id, sheet) where vtype = 'str'),
tl as (select *, replace(sval, ' ', '') as norm, table_idx * 4398046511104 + "row" * 262144 + col as pos from ttagged join common using (doc_id, sheet) where vtype = 'str'),
base as (select doc_id || '|' || sheet as block, norm, min_by(sval, pos) as raw, min(pos) as pos from bl group by all),
targ as (select doc_id || '|' || sheet as block, norm, min_by(sval, pos) as raw, min(pos) as pos from tl group by all),
sure as (select b.block, b.norm, case when b.raw = t.raw then 'exact' else 'normalized' end as path, t.norm as t_norm, t.raw as t_raw from base b join targ t using (block, norm)),
rest as (select block, norm from base b where not exists (select 1 from sure s where s.block = b.block and s.norm = b.norm)),{RANK_SQL.rstrip()},{ITEMS_SQL}
select split_part(block, '|', 1) as pair_id, split_part(block, '|', 2) as sheet, norm, status, match_path, matched_label, flags from items""")
def match_documents(spark, sf):
    """The full matching plan over last year's and this year's part grids: every item of every sheet."""
    items = _report(spark, sf)["items"]
    return items.select("pair_id", "sheet", "norm", "status", "match_path", "matched_label", F.array_join("flags", "|").alias("flags"))


@workload("match_report", "M10 X1 X2 X12 W3 W4", f"""
with {VERSION_SQL}, tl as (select doc_id, replace(sval, ' ', '') as norm, min_by("row", table_idx * 4398046511104 + "row" * 262144 + col) as r from ttagged where vtype = 'str' and sheet = 'S0' group by all),
found as (select doc_id, count(distinct r) as n from tl where contains(norm, 'bolt') group by doc_id)
select 'alert' as part, pair_id, sheet, code, detail from ({WORKLOADS['sheet_alerts'].sql})
union all select 'alert', pair_id, sheet, code, detail from ({WORKLOADS['fingerprint_diff'].sql})
union all select 'anomaly', pair_id, sheet, code, table_idx || '.' || c from ({WORKLOADS['value_drift'].sql})
union all select 'missing', doc_id, 'S0', 'bolt', case when n is null then '올해 파일에서 찾지 못했습니다' else '서로 다른 ' || n || '개 행에 나뉘어 있어 어디서 읽을지 정할 수 없습니다' end
  from (select distinct doc_id from cells) left join found using (doc_id) where n is null or n > 1""")
def match_report(spark, sf):
    """What else the report of every pair says: alerts, anomalies, and required labels that are missing or ambiguous."""
    report = _report(spark, sf)
    columns = ["pair_id", "sheet", "code", "detail"]
    anomalies = report["anomalies"].withColumn("detail", F.concat_ws(".", F.col("table_idx").cast("string"), F.col("c").cast("string")))
    missing = report["missing"].select("pair_id", "sheet", F.col("label").alias("code"), F.col("reason").alias("detail"))
    parts = {"alert": report["alerts"], "anomaly": anomalies, "missing": missing}
    named = [df.select(F.lit(name).alias("part"), *columns) for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])
