"""Constants read from cells located relative to anchor texts, for all documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.literals import literal_rows
from tariffloom.functions.numbers import constant_number
from tariffloom.functions.text import squeeze
from tariffloom.operators import constants as cn
from tariffloom.operators.cells import CELL, find_texts, with_search_text
from tariffloom.session import not_broadcast

IJ, SJ, JH = fixed.SHEETS

# (sheet, anchor, mode): "one" must stay in one row, "first" takes the first in reading order
ANCHORS = (
    (IJ, fixed.A_VALUE, "one"), (IJ, fixed.BASE_PRICE, "one"), (IJ, fixed.BASIC_RATE, "one"), (IJ, fixed.GRADE_HEADER, "one"),
    (SJ, fixed.CAP_LABEL, "one"), (SJ, fixed.INCOME_HEADER, "one"), (SJ, fixed.ADD_ITEMS[0], "first"),
    (JH, fixed.DAY_BASIC, "first"), (JH, fixed.DAY_EXTENDED, "first"),
)
MIRRORS = tuple((SJ, key, "mirror") for key in fixed.SYNC_KEYS)


def _offsets() -> list[tuple]:
    """(sheet, anchor, mode, key, row offset, column offset) of values at fixed distances."""
    out = [
        (IJ, fixed.A_VALUE, "one", "A값", 0, 1), (IJ, fixed.A_VALUE, "one", fixed.K_IJ_CAP, 0, 2),
        (IJ, fixed.BASE_PRICE, "one", "기본단가", 0, 1), (SJ, fixed.CAP_LABEL, "one", fixed.K_SJ_CAP, 0, -1),
    ]
    for n, letter in enumerate(fixed.RATED_LETTERS):
        out += [
            (IJ, fixed.BASIC_RATE, "one", f"{fixed.K_IJ_RATES}.{letter}", 0, n + 1),
            (IJ, fixed.BASIC_RATE, "one", f"{fixed.K_ADD_RATES}.{letter}", 1, n + 1),
            (SJ, fixed.INCOME_HEADER, "one", f"{fixed.K_SJ_RATES}.{letter}", 1, n),
        ]
    return out + [(sheet, anchor, mode, f"{anchor}@{sheet}", 0, 1) for sheet, anchor, mode in MIRRORS]


def locate(texts: DataFrame) -> DataFrame:
    """First cell and number of rows of every anchor per document; ``texts`` carry ``squeezed``."""
    spec = [(f"{sheet}|{anchor}|{mode}", "".join(anchor.split())) for sheet, anchor, mode in ANCHORS + MIRRORS]
    hits = find_texts(texts, F.col("squeezed"), spec).withColumn("__p", F.split("anchor", "[|]")).filter(
        F.col("__p")[0] == F.col("sheet")).select(
        "doc_id", "sheet", F.col("__p")[1].alias("anchor"), F.col("__p")[2].alias("mode"), "row", "col")
    return hits.groupBy("doc_id", "sheet", "anchor", "mode").agg(
        F.min(F.struct("row", "col")).alias("first"), F.count_distinct("row").alias("n_rows")
    ).select("doc_id", "sheet", "anchor", "mode", "first.*", "n_rows")


def anchor_errors(docs: DataFrame, located: DataFrame) -> DataFrame:
    """Anchors that are absent, or spread over rows where one is needed."""
    spec = literal_rows(list(ANCHORS), "sheet string, anchor string, mode string")
    wanted = docs.select("doc_id", F.inline(spec))
    found = wanted.join(not_broadcast(located.select("doc_id", "sheet", "anchor", "mode", "n_rows")), ["doc_id", "sheet", "anchor", "mode"], "left")
    reason = F.when(F.col("n_rows").isNull(), F.concat(F.lit("'"), "anchor", F.lit("'를 찾지 못했습니다."))).when(
        (F.col("mode") == "one") & (F.col("n_rows") > 1), F.concat(F.lit("'"), "anchor", F.lit("'가 여러 표에 있습니다")))
    return found.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "doc_id", "sheet", F.col("anchor").alias("key"), "reason")


def _targets(usable: DataFrame, texts: DataFrame) -> DataFrame:
    """Cells that hold constants: doc_id, sheet, key, row, col."""
    spec = literal_rows(_offsets(), "sheet string, anchor string, mode string, key string, dr int, dc int")
    mine = F.filter(spec, lambda o: (o["sheet"] == F.col("sheet")) & (o["anchor"] == F.col("anchor")) & (o["mode"] == F.col("mode")))
    direct = usable.select("doc_id", "sheet", "row", "col", F.explode(mine).alias("o")).select(
        "doc_id", "sheet", "o.key", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))

    # grade rows: up to five rows from two below the header, the first with a grade's name
    reach = usable.filter(F.col("anchor") == fixed.GRADE_HEADER).select(
        "doc_id", "sheet", F.col("col"), F.explode(F.sequence(F.col("row") + 2, F.col("row") + 6)).alias("row"))
    grades = reach.join(not_broadcast(texts.select(*CELL, "squeezed")), list(CELL)).filter(F.col("squeezed").isin(*fixed.GRADES))
    grades = grades.groupBy("doc_id", "sheet", "col", "squeezed").agg(F.min("row").alias("row"))
    limits = grades.select("doc_id", "sheet", F.inline(F.array(*[
        F.struct(F.concat(F.lit(f"{fixed.K_IJ_LIMITS} ({v})."), "squeezed").alias("key"), F.col("row").alias("row"),
                 (F.col("col") + 3 + n).alias("col")) for n, v in enumerate(fixed.VARIANTS)])))

    # header rows: supplements right of the first item, zones in the three rows about the label
    heads = texts.filter(F.col("squeezed").isin(*fixed.ADD_ITEMS, *fixed.ZONE_HEADERS)).select(*CELL, "squeezed")
    adds = usable.filter(F.col("anchor") == fixed.ADD_ITEMS[0]).select("doc_id", "sheet", "row", F.col("col").alias("from_col"))
    items = heads.join(not_broadcast(adds), ["doc_id", "sheet", "row"]).filter(
        (F.col("col") >= F.col("from_col")) & F.col("squeezed").isin(*fixed.ADD_ITEMS)
    ).groupBy("doc_id", "sheet", "row", "squeezed").agg(F.min("col").alias("col")).select(
        "doc_id", "sheet", F.concat(F.lit(fixed.K_ADD_LIMITS + "."), "squeezed").alias("key"), (F.col("row") + 1).alias("row"), "col")

    days = usable.filter(F.col("anchor").isin(fixed.DAY_BASIC, fixed.DAY_EXTENDED)).select(
        "doc_id", "sheet", "anchor", F.col("row").alias("label_row"),
        F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"))
    zones = heads.join(not_broadcast(days), ["doc_id", "sheet", "row"]).filter(F.col("squeezed").isin(*fixed.ZONE_HEADERS)).groupBy(
        "doc_id", "sheet", "anchor", "label_row", "squeezed").agg(F.min(F.struct("row", "col")).alias("at"))
    variant = F.when(F.col("anchor") == fixed.DAY_BASIC, "기본형").otherwise("확장형")
    zone_key = F.concat(F.lit(f"{fixed.K_JH_LIMITS} ("), variant, F.lit(")."), F.regexp_replace("squeezed", "등급", "구간"))
    zones = zones.select("doc_id", "sheet", zone_key.alias("key"), (F.col("label_row") + 1).alias("row"), F.col("at.col").alias("col"))
    return direct.unionByName(limits).unionByName(items).unionByName(zones)


def expected_keys() -> list[tuple[str, str]]:
    """(sheet, key) of every constant that must be found."""
    out = [(sheet, key) for sheet, _, mode, key, *_ in _offsets() if mode == "one"]
    out += [(IJ, f"{fixed.K_IJ_LIMITS} ({v}).{g}") for v in fixed.VARIANTS for g in fixed.GRADES]
    out += [(SJ, f"{fixed.K_ADD_LIMITS}.{i}") for i in fixed.ADD_ITEMS]
    return out + [(JH, f"{fixed.K_JH_LIMITS} ({v}).{z}") for v in fixed.VARIANTS for z in fixed.ZONES]


def extract_constants(cells: DataFrame, resolved: DataFrame | None = None) -> dict[str, DataFrame]:
    """Constants with the cells they came from, the cell map and every failure as a row.

    ``resolved`` (doc_id, sheet, input_label, chosen): confirmed renamings; a cell with the
    chosen text is read as if it still had last year's.
    """
    ours = cells.filter(F.col("sheet").isin(*fixed.SHEETS))
    texts = with_search_text(ours.filter(F.col("vtype") == "str"))
    if resolved is not None:
        renames = resolved.select("doc_id", "sheet", squeeze(F.col("chosen")).alias("squeezed"),
                                  squeeze(F.col("input_label")).alias("__was"))
        texts = texts.join(not_broadcast(renames), ["doc_id", "sheet", "squeezed"], "left").withColumn(
            "squeezed", F.coalesce("__was", "squeezed")).drop("__was")
    docs = cells.select("doc_id").distinct()
    located = locate(texts)
    usable = located.filter((F.col("mode") != "one") | (F.col("n_rows") == 1))
    targets = _targets(usable, texts)
    read = targets.join(not_broadcast(cells.select(*CELL, "vtype", "sval", "nval")), list(CELL), "left").select(
        "doc_id", "sheet", "key", "row", "col", "sval", constant_number(F.col("sval"), F.col("nval")).alias("value"))
    mirrored = F.contains(F.col("key"), F.lit("@"))
    constants = read.filter(~mirrored & F.col("value").isNotNull()).select("doc_id", "key", "value", "sheet", "row", "col")
    tiers = [(f"{group}.{letter}", float(rate)) for group, rates in (
        (fixed.K_IJ_RATES, fixed.FIXED_BASIC_RATE), (fixed.K_ADD_RATES, fixed.FIXED_ADD_RATE), (fixed.K_SJ_RATES, fixed.FIXED_BASIC_RATE))
        for letter, rate in rates.items()]
    given = docs.select("doc_id", F.inline(literal_rows(tiers, "key string, value double"))).withColumns(
        {"sheet": F.lit(None).cast("string"), "row": F.lit(None).cast("int"), "col": F.lit(None).cast("int")})

    unreadable = read.filter(~mirrored & F.col("value").isNull()).select(
        "doc_id", "sheet", "key", F.when(squeeze(F.coalesce("sval", F.lit(""))) == "", "값이 비어 있습니다").otherwise(
            F.concat(F.lit("수치로 읽을 수 없는 값: "), "sval")).alias("reason"))
    wanted = docs.select("doc_id", F.inline(literal_rows(expected_keys(), "sheet string, key string")))
    unplaced = wanted.join(not_broadcast(targets.select("doc_id", "key")), ["doc_id", "key"], "left_anti").select(
        "doc_id", "sheet", "key", F.lit("위치를 찾지 못했습니다").alias("reason"))
    errors = anchor_errors(docs, located).unionByName(unreadable).unionByName(unplaced)
    all_constants = constants.unionByName(given)
    return {
        "constants": all_constants, "errors": errors,
        "cell_map": read.select("doc_id", "key", "sheet", "row", "col"),
        "not_positive": cn.non_positive(all_constants), "order_breaks": cn.zone_order_breaks(all_constants),
        "group_sizes": cn.group_sizes(all_constants).filter("expected <> actual"),
    }
