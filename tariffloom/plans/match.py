"""Matching last year's labels with this year's, for any number of document pairs in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.labels import structure_key
from tariffloom.functions.literals import literal_rows
from tariffloom.operators import labels as lb
from tariffloom.operators import segment as sg
from tariffloom.operators.drift import column_stats, value_anomalies
from tariffloom.operators.ordered import row_numbers
from tariffloom.operators.similarity import SCORE_DIGITS, HybridConfig, rank_candidates
from tariffloom.session import cut_lineage

PATHS = ("exact", "normalized", "rule_parser")
POS_PIECE = 1 << 34  # 65,536 rows of 2^18 columns


def _keyed(df: DataFrame, block: Sequence[str], *kept: Column) -> DataFrame:
    """One row per label and kind of equality key, strongest first."""
    keys = F.array(
        F.concat(F.lit("raw:"), "raw"), F.concat(F.lit("norm:"), "norm"),
        F.concat(F.lit("shape:"), structure_key(F.col("norm"))))
    return df.select(*block, *kept, F.posexplode(keys).alias("path_no", "match_key")).filter(
        F.col("match_key").isNotNull())


def deterministic_matches(base: DataFrame, target: DataFrame, block: Sequence[str]) -> DataFrame:
    """Equality cascade raw text, canonical form, parsed structure: the first that hits wins.

    All three kinds of key go through one join; the target's first label in reading order
    answers for a key.
    """
    block = list(block)
    index = _keyed(target, block, F.struct("pos", F.col("norm").alias("t_norm"), F.col("raw").alias("t_raw")).alias("t"))
    index = index.groupBy(*block, "match_key").agg(F.min_by("t", "t.pos").alias("t"))
    hits = _keyed(base, block, F.col("norm")).join(index, [*block, "match_key"])
    best = hits.groupBy(*block, "norm").agg(F.min(F.struct("path_no", "t")).alias("m"))
    names = F.array(*map(F.lit, PATHS))
    return best.select(*block, "norm", names[F.col("m.path_no")].alias("match_path"), "m.t.*")


def match_labels(base: DataFrame, target: DataFrame, block: Sequence[str], config: HybridConfig = HybridConfig(),
                 vectors: DataFrame | None = None, piece: int = POS_PIECE) -> dict[str, DataFrame]:
    """Match the labels of blocks: ``items`` (one per base label, plus new target labels) and
    ranked ``candidates``.

    Both sides carry block columns, ``norm`` (distinct per block), ``raw`` and ``pos``.
    """
    block = list(block)
    # labels and sure matches feed the ranking and the items
    base, target = cut_lineage(base), cut_lineage(target)
    sure = cut_lineage(deterministic_matches(base, target, block))
    rest = base.join(sure.select(*block, "norm"), [*block, "norm"], "left_anti")
    ranked = rank_candidates(rest, target.select(*block, "norm", "pos", "raw"), block, config, vectors).withColumnRenamed(
        "q_norm", "norm")
    top = ranked.filter("rank = 1")
    shared = top.groupBy(*block, "pos").agg((F.count("*") > 1).alias("contested"))
    top = top.join(shared, [*block, "pos"])

    numbered = row_numbers(base, block, "pos", "item_no", piece).withColumn("item_no", F.col("item_no") - 1)
    low = F.coalesce(F.col("margin_to_next") < fixed.LOW_MARGIN, F.lit(False))
    judged = top.select(
        *block, "norm", F.when(F.col("final") >= config.cutoff, fixed.NEEDS_REVIEW).otherwise(fixed.UNMATCHED).alias("h_status"),
        F.when(F.col("final") >= config.cutoff, F.col("t_norm")).alias("h_norm"),
        F.array_compact(F.array(F.when(low, "LOW_MARGIN"), F.when(F.col("contested"), "CONTESTED"))).alias("h_flags"))
    items = (
        numbered.join(sure.drop("pos"), [*block, "norm"], "left").join(judged, [*block, "norm"], "left")
        .select(
            *block, "norm", "raw", "pos", "item_no",
            F.when(F.col("match_path").isNotNull(), fixed.AUTO_PASS)
            .otherwise(F.coalesce("h_status", F.lit(fixed.UNMATCHED))).alias("status"),
            F.coalesce("match_path", F.lit("hybrid")).alias("match_path"),
            F.col("t_raw").alias("matched_label"),
            F.coalesce("t_norm", "h_norm").alias("claimed_norm"),
            F.coalesce("h_flags", F.array().cast("array<string>")).alias("flags"))
    )
    # a target label is new when no base label claimed it and none has its canonical form
    taken = items.select(*block, F.explode(F.array_compact(F.array("norm", "claimed_norm"))).alias("norm")).distinct()
    fresh = target.join(taken, [*block, "norm"], "left_anti")
    counts = base.groupBy(*block).agg(F.count("*").alias("n_base"))
    fresh = row_numbers(fresh, block, "pos", "item_no", piece).join(counts, block, "left")
    new_items = fresh.select(
        *block, "norm", "raw", "pos", (F.coalesce("n_base", F.lit(0)) + F.col("item_no") - 1).alias("item_no"),
        F.lit(fixed.UNMATCHED).alias("status"), F.lit("hybrid").alias("match_path"),
        F.lit(None).cast("string").alias("matched_label"), F.lit(None).cast("string").alias("claimed_norm"),
        F.array(F.lit("NEW_IN_TARGET")).alias("flags"))
    return {"items": items.unionByName(new_items), "candidates": ranked}


def summarize(items: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Counts per status and of contested items."""
    status = F.col("status")
    return items.groupBy(*keys).agg(
        F.count("*").alias("total_labels"), F.count_if(status == fixed.AUTO_PASS).alias("auto_passed"),
        F.count_if(status == fixed.NEEDS_REVIEW).alias("needs_review"),
        F.count_if(status == fixed.UNMATCHED).alias("unmatched"),
        F.count_if(F.array_contains("flags", "CONTESTED")).alias("contested"))


def review_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status") != fixed.AUTO_PASS)


def new_labels(items: DataFrame) -> DataFrame:
    return items.filter(F.array_contains("flags", "NEW_IN_TARGET"))


def changed_items(items: DataFrame) -> DataFrame:
    """Labels of last year that read differently now."""
    return review_items(items).filter(~F.array_contains("flags", "NEW_IN_TARGET"))


def blocked_pairs(alerts: DataFrame) -> DataFrame:
    """Pairs that cannot go on because of a fatal alert."""
    return alerts.groupBy("pair_id").agg(F.bool_or("fatal").alias("blocked")).filter("blocked")


def blocked_tables(missing: DataFrame) -> DataFrame:
    """Price tables that cannot be made, in the order the missing labels name them."""
    named = missing.select("pair_id", "req_no", F.posexplode("tables").alias("k", "table"))
    return named.groupBy("pair_id", "table").agg(F.min(F.struct("req_no", "k")).alias("first_seen")).select(
        "pair_id", "table", "first_seen")


def missing_labels(pairs: DataFrame, labels: DataFrame, required: Sequence[tuple] = fixed.REQUIRED_LABELS) -> DataFrame:
    """Required labels this year's sheets lack, or spread over several rows.

    ``labels``: collected labels of all documents.  The requirements are a constant array per
    pair; labels are probed against it in place, so no nested-loop join is needed.
    """
    spec = [(n, label, "".join(label.split()), sheet, produces, "|".join(tables), exact)
            for n, (label, sheet, produces, tables, exact) in enumerate(required)]
    reqs = literal_rows(spec, "req_no int, label string, find string, sheet string, produces string, tables string, exact boolean")
    wanted = pairs.select("pair_id", "base_doc", "target_doc", F.inline(reqs))
    fits = F.filter(reqs, lambda r: (r["sheet"] == F.col("sheet")) & F.when(
        r["exact"], r["find"] == F.col("norm")).otherwise(F.contains(F.col("norm"), r["find"])))
    hits = labels.filter(F.col("sheet").isin(*sorted({s for _, s, *_ in required}))).select(
        "doc_id", "row", F.explode(F.transform(fits, lambda r: r["req_no"])).alias("req_no"))
    rows = hits.groupBy("doc_id", "req_no").agg(F.count_distinct("row").alias("n_rows")).withColumnRenamed("doc_id", "target_doc")
    judged = wanted.join(rows, ["target_doc", "req_no"], "left").withColumn("reason", F.when(
        F.col("n_rows").isNull(), "올해 파일에서 찾지 못했습니다").when(
        ~F.col("exact") & (F.col("n_rows") > 1),
        F.concat(F.lit("서로 다른 "), F.col("n_rows").cast("string"), F.lit("개 행에 나뉘어 있어 어디서 읽을지 정할 수 없습니다"))))
    was = labels.select(F.col("doc_id").alias("base_doc"), "sheet", F.col("norm").alias("find"),
                        F.col("row").alias("base_row"), F.col("col").alias("base_col"))
    return judged.filter(F.col("reason").isNotNull()).join(was, ["base_doc", "sheet", "find"], "left").select(
        "pair_id", "req_no", "sheet", "label", "find", "produces", F.split("tables", "[|]").alias("tables"), "reason",
        "base_row", "base_col")


def suggestions(missing: DataFrame, target: DataFrame, config: HybridConfig = HybridConfig(),
                vectors: DataFrame | None = None) -> DataFrame:
    """Likely replacements of missing required labels among this year's labels."""
    asked = missing.select("pair_id", "sheet", F.col("find").alias("norm")).distinct()
    return rank_candidates(asked, target.select("pair_id", "sheet", "norm", "pos"), ["pair_id", "sheet"], config, vectors)


@dataclass(frozen=True)
class MatchSettings:
    hybrid: HybridConfig = HybridConfig()
    required_sheets: tuple[str, ...] = fixed.SHEETS
    required_labels: tuple = fixed.REQUIRED_LABELS
    anchors: tuple[str, ...] = fixed.SCALAR_ANCHORS


class Report(Mapping):
    """Named parts of a report, each worked out when it is asked for first: ranking labels runs jobs."""

    def __init__(self, parts: dict[str, Callable[[Report], DataFrame]]):
        self._parts, self._made = parts, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._parts[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def match_documents(cells: DataFrame, pairs: DataFrame, settings: MatchSettings = MatchSettings(),
                    vectors: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """The full report of document pairs as DataFrames that share ``pair_id``.

    ``cells`` are sanitised grids; ``pairs``: pair_id, base_doc, target_doc.  Everything up to
    the labels is computed once per document, however many pairs it is in, and checkpointed,
    since most of the report reads it.  Labels are matched and suggestions ranked only when such
    a part is asked for.
    """
    regions, tagged = sg.segment(cells)
    found = lb.label_cells(tagged)
    labels = cut_lineage(lb.collect_labels(found))

    def side(name: str) -> DataFrame:
        return pairs.select("pair_id", F.col(f"{name}_doc").alias("doc_id")).join(labels, "doc_id").drop("doc_id")

    common = pairs.join(cells.select(F.col("doc_id").alias("base_doc"), "sheet").distinct(), "base_doc").join(
        cells.select(F.col("doc_id").alias("target_doc"), "sheet").distinct(), ["target_doc", "sheet"]
    ).select("pair_id", "sheet")
    shared = lambda df: df.join(common, ["pair_id", "sheet"], "left_semi")

    @cache
    def matched() -> dict[str, DataFrame]:
        return match_labels(shared(side("base")), shared(side("target")), ["pair_id", "sheet"], settings.hybrid, vectors)

    def items(_: Report) -> DataFrame:
        return cut_lineage(matched()["items"]).withColumn("item_id", F.concat(
            "sheet", F.when(F.array_contains("flags", "NEW_IN_TARGET"), "-new-").otherwise("-"),
            F.format_string("%03d", F.col("item_no"))))

    prints = sg.fingerprints(regions, tagged)
    anchors = pairs.select("pair_id", F.col("target_doc").alias("doc_id")).join(
        sg.repeated_anchors(found, settings.anchors), "doc_id").select(
        "pair_id", "sheet", F.concat("sheet", F.lit("#"), (F.col("table_idx") + 1).cast("string")).alias("table_id"),
        F.lit("ANCHOR_NOT_UNIQUE").alias("code"), "detail", F.lit(True).alias("fatal"))
    clashes = pairs.select("pair_id", F.col("base_doc").alias("doc_id")).join(lb.collisions(found), "doc_id").select(
        "pair_id", "sheet", F.lit(None).cast("string").alias("table_id"), F.lit("NORMALIZATION_COLLISION").alias("code"),
        F.concat(F.lit("서로 다른 라벨이 정규화 후 같아집니다: "), "raw", F.lit(" -> "), "norm").alias("detail"),
        F.lit(False).alias("fatal"))
    columns = ["pair_id", "sheet", "table_id", "code", "detail", "fatal"]
    alerts = sg.sheet_alerts(pairs, cells, regions, settings.required_sheets).select(*columns)
    for more in (sg.fingerprint_diffs(pairs, prints), anchors, clashes):
        alerts = alerts.unionByName(more.select(*columns))
    missing = missing_labels(pairs, labels, settings.required_labels)
    return Report({
        "items": items, "candidates": lambda r: matched()["candidates"], "summary": lambda r: summarize(r["items"]), "alerts": lambda r: alerts,
        "anomalies": lambda r: value_anomalies(pairs, column_stats(tagged), regions), "missing": lambda r: missing,
        "suggestions": lambda r: suggestions(missing, side("target"), settings.hybrid, vectors), "regions": lambda r: regions,
        "tagged": lambda r: tagged, "labels": lambda r: labels,
    })


def judge_ranking(gold: DataFrame, ranked: DataFrame, scores: DataFrame, cutoff: float = fixed.CUTOFF) -> DataFrame:
    """Judge ranked candidates against a gold corpus.

    ``gold``: case_id, subtype, expect, q_norm, gold_norm, distractors array (canonical forms).
    ``ranked``: case_id, rank, t_norm, final of the first three ranks.  ``scores``: case_id, t_norm,
    final of gold and distractors, whatever their rank (:func:`score_pairs` gives them).  A label
    without a score has none.  Returns pass or fail per case.
    """
    per_case = ranked.groupBy("case_id").agg(
        F.max_by("t_norm", F.when(F.col("rank") == 1, 1)).alias("top1"),
        F.max(F.when(F.col("rank") == 1, F.col("final"))).alias("top1_score"),
        F.collect_list(F.when(F.col("rank") <= 3, F.col("t_norm"))).alias("top3"))
    score = F.round(F.coalesce("final", F.lit(0.0)), SCORE_DIGITS)
    scored = gold.select("case_id", F.explode(F.array_append("distractors", F.col("gold_norm"))).alias("t_norm")).join(
        scores.select("case_id", "t_norm", "final"), ["case_id", "t_norm"], "left").join(
        gold.select("case_id", "gold_norm"), "case_id").groupBy("case_id").agg(
        F.max(F.when(F.col("t_norm") == F.col("gold_norm"), score)).alias("gold_score"),
        F.max(F.when(F.col("t_norm") != F.col("gold_norm"), score)).alias("rival_score"))
    joined = gold.join(per_case, "case_id", "left").join(scored, "case_id", "left")
    same = F.col("q_norm") == F.col("gold_norm")
    in_top3 = F.coalesce(F.array_contains("top3", F.col("gold_norm")), F.lit(False))
    strict = (F.col("top1") == F.col("gold_norm")) & (
        F.coalesce("rival_score", F.lit(-1.0)) < F.coalesce("gold_score", F.lit(0.0)))
    expect = F.col("expect")
    passed = (
        F.when(expect.isin("auto_pass", "auto_pass_after_norm", "auto_pass_BLINDSPOT"), same)
        .when(expect == "pairwise_distinct", ~F.array_contains("distractors", F.col("gold_norm")))
        .when(expect == "no_match", F.coalesce("top1_score", F.lit(0.0)) < cutoff)
        .when(expect == "review_top3", in_top3)
        .when(expect == "top1_strict", F.coalesce(strict, F.lit(False)))
        .when(expect == "never_silent_fail", same | in_top3)
        .otherwise(F.lit(True))
    )
    return joined.select("case_id", "subtype", "expect", passed.alias("passed"))


def pass_rates(judged: DataFrame) -> DataFrame:
    return judged.groupBy("subtype").agg(
        F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
