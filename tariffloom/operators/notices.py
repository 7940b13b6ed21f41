"""Notices: running context, table lookup and amounts read from grids.

Blocks: ``doc_id, ord, kind ('문단'|'표'), text, section, table_no, grid``; ``ord`` is the
position in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.labels import classify_by_phrases, supplement_rules
from tariffloom.functions.literals import literal_rows
from tariffloom.functions.numbers import money_tokens, segment_number
from tariffloom.functions.text import squeeze
from tariffloom.operators.ordered import PIECE, carry_forward_nested
from tariffloom.session import cut_lineage, dealt, not_broadcast


#: tables, with their grids, that a task holds
TABLES = 5_000


def with_context(blocks: DataFrame, piece: int = PIECE) -> DataFrame:
    """Adds the running ``chapter`` and numbered ``item``; a new chapter clears the item.

    ``item`` is cut for display; ``heading`` is the whole text, in which titles are looked up.
    """
    text = F.col("text")
    opens = (F.col("kind") == "문단") & text.rlike("(?U)" + fixed.CHAPTER)
    numbered = (F.col("kind") == "문단") & ~opens & text.rlike(fixed.ITEM)
    whole = F.col("heading")
    short = F.when(F.length(whole) <= fixed.ITEM_MAX, whole).otherwise(
        F.concat(F.substring(whole, 1, fixed.ITEM_MAX), F.lit("…")))
    return carry_forward_nested(blocks, ["doc_id"], "ord", F.when(opens, text), F.when(numbered, text),
                                "chapter", "heading", piece).withColumn("item", short)


def padded(grid: Column) -> Column:
    """Rows of a grid filled up to equal width."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def visible_blocks(blocks: DataFrame, chapters: list[str]) -> DataFrame:
    """Blocks of the chapters whose heading contains one of the given texts."""
    return blocks.filter(F.exists(F.array(*map(F.lit, chapters)), lambda c: F.contains(F.col("chapter"), c)))


def matching_tables(blocks: DataFrame, tables: dict = fixed.NOTICE_TABLES) -> DataFrame:
    """Tables times the services they could belong to.

    A service's title must be in the heading, no more specific title may be, and the words
    expected inside must all occur.  The services are a constant array in the row.
    """
    flat = lambda s: "".join(s.split())
    rows = [(name, flat(title), "|".join(map(flat, inner)),
             "|".join(flat(t) for n, (t, _) in tables.items() if n != name and t != title and title in t))
            for name, (title, inner) in tables.items()]
    spec = literal_rows(rows, "service string, title string, inner string, wider string")
    none = lambda text, joined: ~F.exists(F.split(joined, "[|]"), lambda w: (w != "") & F.contains(text, w))
    every = lambda text, joined: F.forall(F.split(joined, "[|]"), lambda w: F.contains(text, w))
    heading, inside = F.col("__heading"), F.col("__inside")
    hits = F.filter(spec, lambda s: F.contains(heading, s["title"]) & none(heading, s["wider"]) & every(inside, s["inner"]))
    return (
        blocks.filter(F.col("kind") == "표")
        .withColumn("__heading", squeeze(F.concat_ws(" ", "chapter", "heading")))
        .withColumn("__inside", squeeze(F.array_join(F.flatten("grid"), " ")))
        .withColumn("__hits", F.transform(hits, lambda s: s["service"]))
        .withColumn("service", F.explode("__hits")).drop("__heading", "__inside", "__hits")
    )


def locate_tables(blocks: DataFrame, tables: dict = fixed.NOTICE_TABLES) -> tuple[DataFrame, DataFrame]:
    """``(located, errors)``: exactly one table per service and document is required."""
    hits = dealt(cut_lineage(matching_tables(blocks, tables)), "doc_id", "service", rows=TABLES)
    counts = hits.groupBy("doc_id", "service").agg(F.count("*").alias("n"))
    docs = blocks.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, tables))).alias("service"))
    judged = docs.join(not_broadcast(counts), ["doc_id", "service"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    errors = judged.filter("n <> 1").select("doc_id", "service", F.concat(
        F.lit("'"), "service", F.lit("' 표가 "), F.col("n").cast("string"), F.lit("개 발견되었습니다 (1개여야 함).")).alias("message"))
    return hits.join(not_broadcast(judged.filter("n = 1").select("doc_id", "service")), ["doc_id", "service"], "left_semi"), errors


ENTRY = "array<struct<key:string,amount:bigint,surcharge:bigint,col:int>>"
# service: (amounts per row, ordered phrase rules, class of other rows)
ROW_READERS = {
    "활동보조": (2, [(("심야",), "심야"), (("공휴일",), "공휴일"), (("근로자의날",), "공휴일")], "일반"),
    "방문목욕": (1, [(("이동목욕용", "차량내에서"), "차량내입욕"), (("가정내에서",), "가정내입욕")], None),
    "방문간호": (1, [(("30분미만",), "30분미만"), (("60분미만",), "30분이상60분미만"), (("60분이상",), "60분이상")], None),
    "추가급여": (1, supplement_rules(), None),
}
COMPLETE = {
    "활동보조": ("일반", "심야", "공휴일"), "방문목욕": ("차량내입욕", "가정내입욕"),
    "방문간호": ("30분미만", "30분이상60분미만", "60분이상"),
    "방문간호지시서": ("의료기관_방문", "의료기관_의사내방", "보건기관_방문", "보건기관_의사내방"),
}


def _entry(key: Column, amount: Column, surcharge: Column | None, col: int) -> Column:
    return F.struct(key.alias("key"), amount.alias("amount"),
                    (F.lit(None) if surcharge is None else surcharge).cast("bigint").alias("surcharge"),
                    F.lit(col).alias("col"))


def _expects(n: int, nums: Column) -> Column:
    return F.when(F.size(nums) != n, F.concat(F.lit(f"금액 {n}개를 기대했으나 "), F.size(nums).cast("string"), F.lit("개")))


def read_rows(located: DataFrame) -> DataFrame:
    """Amounts of row-wise tables: one row per grid row with ``entries`` and a ``problem``."""
    rows = located.filter(F.col("service") != "인정조사기본급여").select(
        "doc_id", "service", "section", "table_no", "chapter", "item", F.posexplode("grid").alias("row", "cells"))
    label = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    rows = rows.withColumns({"label": label, "raw": F.array_join("cells", " ")}).withColumns(
        {"nums": money_tokens(F.col("raw")), "flat": squeeze(F.col("label")), "segment": segment_number(F.col("label"))}
    ).filter(F.size("nums") > 0)
    nums, flat, service = F.col("nums"), F.col("flat"), F.col("service")
    at = lambda n: F.get(nums, F.lit(n))
    entries, problem = None, None

    def case(test: Column, made: Column, wrong: Column):
        nonlocal entries, problem
        made = made.cast(ENTRY)
        entries = F.when(test, made) if entries is None else entries.when(test, made)
        problem = F.when(test, wrong) if problem is None else problem.when(test, wrong)

    for name, (n, rules, other) in ROW_READERS.items():
        key = classify_by_phrases(flat, rules, other)
        wrong = F.coalesce(_expects(n, nums), F.when(key.isNull(), F.concat(F.lit("분류를 인식할 수 없습니다: "), "label")))
        case(service == name, F.array(_entry(key, at(0), at(1) if n == 2 else None, 1)), wrong)
    org = classify_by_phrases(flat, [(("의료법",), "의료기관"), (("의료기관",), "의료기관"), (("지역보건법",), "보건기관"), (("보건소",), "보건기관")])
    said = F.regexp_extract_all(F.regexp_replace("label", r"(?U)\s+", " "), F.lit(fixed.ORDER_WAYS), 1)
    ways = F.transform(said, lambda w: F.when(w.startswith("대상자"), "방문").otherwise("의사내방"))
    paired = F.zip_with(ways, nums, lambda w, n: _entry(F.concat_ws("_", org, w), n, None, 1))
    case(service == "방문간호지시서", paired, F.coalesce(
        F.when(org.isNull(), F.concat(F.lit("발급기관을 인식할 수 없습니다: "), "label")),
        F.when(F.size(ways) != F.size(nums), "경우와 금액의 개수가 일치하지 않습니다")))
    seg = F.col("segment").cast("string")
    case((service == "월한도액") & seg.isNotNull(), F.array(_entry(F.concat(seg, F.lit("구간")), at(0), None, 2)), _expects(1, nums))
    case((service == "주간활동") & seg.isNotNull(), F.array(
        _entry(F.concat(seg, F.lit("구간.기본형")), at(0), None, 1), _entry(F.concat(seg, F.lit("구간.확장형")), at(1), None, 2)), _expects(2, nums))
    return rows.withColumns({"entries": entries, "problem": problem}).filter(
        F.col("entries").isNotNull()).drop("nums", "flat", "segment")


def read_grades(located: DataFrame) -> DataFrame:
    """Basic allowances by grade: the first row naming two grades heads the columns."""
    grade_in = lambda cell: F.regexp_extract(squeeze(cell), fixed.GRADE, 1)
    named = F.transform("grid", lambda row: F.filter(
        F.transform(row, lambda cell, c: F.named_struct(F.lit("grade"), grade_in(cell), F.lit("col"), c)),
        lambda e: (e["grade"] != "") & (e["col"] > 0)))
    heads = F.get(F.filter(named, lambda r: F.size(F.array_distinct(F.transform(r, lambda e: e["grade"]))) >= 2), F.lit(0))
    first_of = F.filter(heads, lambda e, n: ~F.exists(F.slice(heads, F.lit(1), n), lambda x: x["grade"] == e["grade"]))
    rows = located.filter(F.col("service") == "인정조사기본급여").select(
        "doc_id", "service", "section", "table_no", "chapter", "item", first_of.alias("heads"), F.posexplode("grid").alias("row", "cells")
    ).filter(F.contains(squeeze(F.get("cells", F.lit(0))), F.lit("기본급여")))
    entries = F.transform("heads", lambda h: F.struct(
        F.concat(h["grade"], F.lit("등급")).alias("key"), F.get(money_tokens(F.get(F.col("cells"), h["col"])), F.lit(0)).alias("amount"),
        F.lit(None).cast("bigint").alias("surcharge"), h["col"].alias("col")))
    bad = F.exists("heads", lambda h: F.size(money_tokens(F.get(F.col("cells"), h["col"]))) != 1)
    problem = F.when(F.col("heads").isNull(), "등급 머리행을 찾지 못했습니다.").when(bad, "칸에서 금액 1개를 기대했으나 다릅니다")
    return rows.withColumns({"label": F.lit("기본급여"), "raw": F.array_join("cells", " "), "entries": entries.cast(ENTRY),
                             "problem": problem}).drop("heads")


def read_amounts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(amounts, errors)`` of notices with context.

    Amounts carry where they stand as ``source``.  A service with any error yields no
    amounts, only its errors.  The few located tables and their rows are checkpointed, since
    every check reads them.
    """
    located, errors = locate_tables(blocks)
    rows = dealt(cut_lineage(read_rows(located).unionByName(read_grades(located))), "doc_id", "service")
    source = F.struct("section", "table_no", "row", "label", "raw", "chapter", "item")
    found = rows.filter(F.col("problem").isNull()).select("doc_id", "service", source.alias("s"), F.inline("entries")).select(
        "doc_id", "service", "key", "amount", "surcharge",
        F.struct("s.section", "s.table_no", "s.row", "col", "s.label", "s.raw", "s.chapter", "s.item").alias("source"))
    wrong_rows = rows.filter(F.col("problem").isNotNull()).select("doc_id", "service", F.concat("problem", F.lit(": "), "raw").alias("message"))
    twice = found.groupBy("doc_id", "service", "key").agg(F.count("*").alias("n")).filter("n > 1").select(
        "doc_id", "service", F.concat(F.lit("'"), "key", F.lit("' 분류가 중복 추출되었습니다")).alias("message"))
    need = literal_rows([(s, k) for s, keys in COMPLETE.items() for k in keys], "service string, key string")
    readable = located.select("doc_id", "service").distinct()
    wanted = readable.select("doc_id", "service", F.explode(F.filter(need, lambda n: n["service"] == F.col("service"))).alias("n")).select(
        "doc_id", "service", F.col("n.key").alias("key"))
    lacking = wanted.join(not_broadcast(found.select("doc_id", "service", "key")), ["doc_id", "service", "key"], "left_anti").select(
        "doc_id", "service", F.concat(F.lit("'"), "key", F.lit("' 금액이 없습니다")).alias("message"))
    empty = readable.join(not_broadcast(rows.select("doc_id", "service")), ["doc_id", "service"], "left_anti").select(
        "doc_id", "service", F.lit("표에서 항목을 하나도 읽지 못했습니다.").alias("message"))
    for more in (wrong_rows, twice, lacking, empty):
        errors = errors.unionByName(more)
    return found.join(not_broadcast(errors.select("doc_id", "service").distinct()), ["doc_id", "service"], "left_anti"), errors.distinct()
