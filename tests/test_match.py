"""Two sheet sets with planted faults, matched end to end."""

import pytest
from pyspark.sql import functions as F

from support import block, cells_frame, year_pair
from tariffloom.operators.cells import sanitized
from tariffloom.operators.labels import label_cells
from tariffloom.plans import match as mt


@pytest.fixture(scope="module")
def report(spark):
    cells = sanitized(cells_frame(spark, year_pair()))
    pairs = spark.createDataFrame([("p", "old", "new")], "pair_id string, base_doc string, target_doc string")
    out = mt.match_documents(cells, pairs)
    return {name: [r.asDict(recursive=True) for r in out[name].collect()]
            for name in ("items", "candidates", "summary", "alerts", "anomalies", "missing", "regions", "suggestions")}


def item(report, sheet, norm):
    return next(i for i in report["items"] if i["sheet"] == sheet and i["norm"] == norm)


@pytest.mark.parametrize("sheet, norm, found", [
    ("인정조사", "기본단가", "기본 단가(원)"), ("인정조사", "A값", "A값"), ("인정조사", "한도", "한도"), ("인정조사", "일반층", "일반층 "),
    ("인정조사", "면제층", "면제층"), ("인정조사", "3등급", "3등급"), ("종합조사", "주간활동기본형", "주간활동 기본형"), ("부록", "쪽수", "쪽수"),
])
def test_equal_labels_pass(report, sheet, norm, found):
    got = item(report, sheet, norm)
    assert (got["status"], got["matched_label"].strip()) == ("auto_pass", found.strip())


def test_a_changed_label_is_offered_first(report):
    top = [c["t_norm"] for c in report["candidates"] if c["sheet"] == "인정조사" and c["norm"] == "이용시간"]
    assert len(top) == 3 and "이용가능시간" in top


def test_new_and_removed_labels(report):
    assert item(report, "인정조사", "휴일돌봄")["flags"] == ["NEW_IN_TARGET"]
    assert item(report, "인정조사", "야간돌봄")["status"] != "auto_pass"


def test_structure_and_value_findings(report):
    codes = {(a["code"], a["sheet"], a["fatal"]) for a in report["alerts"]}
    assert ("ANCHOR_NOT_UNIQUE", "산정특례", True) in codes
    assert ("HEADER_ORDER_CHANGED", "종합조사", False) in codes
    assert not any(a["code"] == "NORMALIZATION_COLLISION" for a in report["alerts"])
    drift = {(a["code"], a["sheet"]) for a in report["anomalies"]}
    assert {("UNIT_SHIFT_SUSPECTED", "인정조사"), ("MONOTONICITY_BROKEN", "부록")} <= drift


def test_adjacent_tables_are_separate(report):
    boxes = sorted((r["row0"], r["col0"], r["row1"], r["col1"]) for r in report["regions"] if r["doc_id"] == "old" and r["sheet"] == "부록")
    # rows split first, so the short table's box ends with its own last filled row
    assert boxes == [(0, 0, 1, 1), (0, 3, 8, 4)]


def test_missing_labels_and_suggestions(report):
    missing = {(m["sheet"], m["label"]): m["reason"] for m in report["missing"]}
    assert "2개 행" in missing["산정특례", "상한액"] and ("산정특례", "학교생활") in missing
    assert ("인정조사", "기본단가") not in missing
    asked = {(s["sheet"], s["q_norm"]) for s in report["suggestions"]}
    assert ("산정특례", "상한액") in asked


def test_item_ids_stay_apart_beyond_a_thousand_labels(spark):
    cells = cells_frame(spark, {d: {"목록": block("A1", [[f"항목{chr(0xAC00 + i)}{chr(0xAC00 + i // 7)}", i] for i in range(1103)])} for d in ("a", "b")})
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, base_doc string, target_doc string")
    ids = [r["item_id"] for r in mt.match_documents(cells, pairs)["items"].select("item_id").collect()]
    assert len(ids) == len(set(ids)) == 1103 and {"목록-000", "목록-1102"} <= set(ids)


def test_summary_adds_up(report):
    s = report["summary"][0]
    assert s["total_labels"] == s["auto_passed"] + s["needs_review"] + s["unmatched"] == len(report["items"])


def test_identity_pair_is_exact_and_doubles(spark):
    docs = year_pair()
    cells = sanitized(cells_frame(spark, {"a": docs["old"], "b": docs["old"]}))
    pairs = spark.createDataFrame([("p", "a", "b"), ("q", "b", "a")], "pair_id string, base_doc string, target_doc string")
    out = mt.match_documents(cells, pairs)
    assert {r["match_path"] for r in out["items"].select("match_path").collect()} == {"exact"}
    assert out["anomalies"].count() == 0
    assert out["alerts"].filter("code not in ('NORMALIZATION_COLLISION', 'ANCHOR_NOT_UNIQUE')").count() == 0
    sizes = {r["pair_id"]: r["total_labels"] for r in out["summary"].collect()}
    assert sizes["p"] == sizes["q"] > 30


def test_collisions_are_long_form(spark):
    from tariffloom.operators.labels import collisions
    from tariffloom.operators.segment import segment

    _, tagged = segment(cells_frame(spark, {"d": {"s": {"A1": "기본 단가", "A2": "기본단가", "A3": "[기본단가]", "B1": "다른"}}}))
    rows = collisions(label_cells(tagged)).select("raw", F.col("n_raw")).collect()
    assert sorted((r["raw"], r["n_raw"]) for r in rows) == [("[기본단가]", 3), ("기본 단가", 3), ("기본단가", 3)]


def test_parts_of_a_report_that_need_no_ranking_run_none(spark, monkeypatch):
    def ranked(*args):
        raise AssertionError("labels were ranked")

    cells = sanitized(cells_frame(spark, year_pair()))
    pairs = spark.createDataFrame([("p", "old", "new")], "pair_id string, base_doc string, target_doc string")
    monkeypatch.setattr(mt, "rank_candidates", ranked)
    out = mt.match_documents(cells, pairs)
    assert {"items", "suggestions"} <= set(out) and out["alerts"] is out["alerts"]
    assert out["alerts"].count() and out["missing"].count() and out["regions"].count()
    with pytest.raises(AssertionError, match="ranked"):
        out["suggestions"]
