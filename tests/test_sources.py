"""Files in, constants and amounts out."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from support import cells_frame, constants_book, grid_rows, notice_bytes, notice_parts, xlsx_bytes, year_pair
from tariffloom import fixed
from tariffloom.operators import notices as no
from tariffloom.operators import reconcile as rc
from tariffloom.operators.cells import missing_sheets, patch_cells
from tariffloom.operators.rulebook import RULES_2025, rule_registry
from tariffloom.plans.extract import extract_constants
from tariffloom.sources import files as fs
from tariffloom.sources.notices import notice_file_errors, parse_notices, read_notices
from tariffloom.sources.spreadsheets import parse_workbooks, read_workbooks, workbook_errors


def test_workbook_scan(spark, tmp_path):
    book = year_pair()["old"]
    (tmp_path / "a.xlsx").write_bytes(xlsx_bytes(book, styled_rows=5000))
    (tmp_path / "b.xlsx").write_bytes(xlsx_bytes({"인정조사": {"A1": True, "B2": "=A1*2", "C3": "N/A", "AA4": "멀리"}}))
    cells = read_workbooks(spark, str(tmp_path))
    got = {(r["sheet"], r["row"], r["col"], r["sval"], r["nval"]) for r in cells.filter(F.col("doc_id").endswith("a.xlsx")).collect()}
    assert got == {(s, r, c, sv, nv) for _, s, r, c, _, sv, nv, _ in grid_rows("a", book)}
    small = {(r["row"], r["col"]): (r["vtype"], r["formula"]) for r in cells.filter(F.col("doc_id").endswith("b.xlsx")).collect()}
    assert small == {(0, 0): ("bool", None), (1, 1): ("num", "=A1*2"), (3, 26): ("str", None)}
    absent = missing_sheets(cells.select("doc_id").distinct(), cells)
    assert sorted((r["doc_id"][-6:], r["sheet"]) for r in absent.collect()) == [("b.xlsx", "산정특례"), ("b.xlsx", "종합조사")]


def test_extract_constants(spark):
    broken = constants_book(rate_head="부담률")
    broken["종합조사"]["C2"] = "없음"
    broken["산정특례"]["C20"] = "본인부담금 상한액"
    out = extract_constants(cells_frame(spark, {"ok": constants_book(5), "bad": broken}))
    values = {r["key"]: r["value"] for r in out["constants"].filter("doc_id = 'ok'").collect()}
    assert values["기본단가"] == 16995 and values[fixed.K_IJ_CAP] == 151300 and values[fixed.K_SJ_CAP] == 158000
    assert values[f"{fixed.K_IJ_RATES}.바"] == 0.15 and values[f"{fixed.K_ADD_RATES}.다"] == 0.02
    assert values[f"{fixed.K_IJ_RATES}.나"] == 20000 and values[f"{fixed.K_ADD_RATES}.나"] == 0
    assert values[f"{fixed.K_IJ_LIMITS} (확장형).4등급"] == 1790000 - 1170000
    assert values[f"{fixed.K_JH_LIMITS} (기본형).15구간"] == 5870000 - 340000 * 14
    assert values[f"{fixed.K_ADD_LIMITS}.출산"] == 2900000 - 140000 * 6
    assert len(values) == 3 + 1 + 18 + 8 + 30 + 12
    errors = {(r["doc_id"], r["key"]) for r in out["errors"].collect()}
    assert all(doc == "bad" for doc, _ in errors)
    assert {"기본 부담률", "상한액", f"{fixed.K_JH_LIMITS} (기본형).2구간"} <= {k for _, k in errors}
    mirrors = {r["key"]: (r["row"], r["col"]) for r in out["cell_map"].filter("doc_id = 'ok' and key like '%@%'").collect()}
    assert mirrors == {"기본단가@산정특례": (7, 2)}


def test_confirmed_renaming_feeds_extraction(spark):
    renamed = cells_frame(spark, {"d": constants_book(rate_head="기본 요율")})
    chosen = spark.createDataFrame([("d", "인정조사", "기본 부담률", "기본 요율")], "doc_id string, sheet string, input_label string, chosen string")
    assert extract_constants(renamed)["errors"].count() > 0
    assert extract_constants(renamed, chosen)["errors"].count() == 0


def test_patch_follows_mirrors(spark):
    cells = cells_frame(spark, {"d": constants_book()})
    cell_map = extract_constants(cells)["cell_map"]
    changes = spark.createDataFrame([("d", "기본단가", 18000.0), ("d", "없는키", 1.0)], "doc_id string, key string, value double")
    patched, skipped = patch_cells(cells, cell_map, changes)
    new = {(r["sheet"], r["row"], r["col"]) for r in patched.filter("nval = 18000").collect()}
    assert new == {("인정조사", 0, 2), ("산정특례", 7, 2)}
    assert [r["key"] for r in skipped.collect()] == ["없는키"]


def test_notice_reading_and_comparison(spark, tmp_path):
    (tmp_path / "a.hwpx").write_bytes(notice_bytes())
    (tmp_path / "b.hwpx").write_bytes(notice_bytes([p for p in notice_parts() if p != "2. 방문목욕"]))
    blocks = read_notices(spark, str(tmp_path))
    ragged = blocks.filter("kind = '표' and item = '7. 덧붙임'").select("grid").first()["grid"]
    assert ragged == [["이름", ""], ["값", "긴 행"]]
    amounts, errors = no.read_amounts(blocks)
    got = {(r["service"], r["key"]): (r["amount"], r["surcharge"]) for r in amounts.filter(F.col("doc_id").endswith("a.hwpx")).collect()}
    assert got["활동보조", "일반"] == (15300, 1960) and got["방문간호지시서", "보건기관_의사내방"] == (51000, None)
    assert got["인정조사기본급여", "4등급"] == (600000, None) and got["추가급여", "학교생활"] == (91000, None)
    assert got["주간활동", "15구간.확장형"] == (3_300_000 - 110_000 * 14 - 60_000, None) and got["월한도액", "1구간"] == (3_300_000, None)
    bad = {(r["doc_id"][-6:], r["service"]) for r in errors.collect()}
    assert bad == {("b.hwpx", "방문목욕"), ("b.hwpx", "방문간호")}  # two tables now stand under one heading
    a = amounts.filter(F.col("doc_id").endswith("a.hwpx"))
    assert rc.price_problems(a).count() == 0 and rc.limit_problems(a).count() == 0
    source = a.filter("service = '방문목욕' and key = '가정내입욕'").first()["source"]
    assert (source["chapter"], source["item"], source["row"]) == ("제5장 금액", "2. 방문목욕", 1)


def test_a_title_far_into_a_heading_is_found(spark):
    long = "3. " + "아주 긴 설명이 앞에 붙은 제목 " * 4 + "활동보조"
    parts = [long if p == "3. 활동보조" else p for p in notice_parts()]
    amounts, errors = no.read_amounts(parse_notices(spark.createDataFrame([("d", bytearray(notice_bytes(parts)))], "doc_id string, content binary")))
    assert errors.count() == 0 and amounts.filter("service = '활동보조'").count() == 3
    assert amounts.filter("service = '활동보조'").first()["source"]["item"].endswith("…")


def test_nested_paragraphs_and_tables(spark):
    ns = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'
    p = lambda inner: f"<hp:p>{inner}</hp:p>"
    t = lambda text: f"<hp:run><hp:t>{text}</hp:t></hp:run>"
    inner = f"<hp:tbl><hp:tr><hp:tc>{p(t('c'))}</hp:tc></hp:tr></hp:tbl>"
    table = f"<hp:tbl><hp:tr><hp:tc>{p(t('a'))}{p(t('b'))}</hp:tc><hp:tc>{t('bare')}</hp:tc></hp:tr><hp:tr><hp:tc>{p(inner)}</hp:tc></hp:tr></hp:tbl>"
    body = p(t("one") + p(t("two"))) + p(t("lost") + p(t("kept")) + table) + p(t(" "))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("Contents/section0.xml", f"<hp:sec {ns}>{body}</hp:sec>")
    rows = parse_notices(spark.createDataFrame([("d", bytearray(out.getvalue()))], "doc_id string, content binary")).orderBy("ord").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("문단", "onetwo"), ("문단", "kept"), ("표", None)]
    assert rows[2]["grid"] == [["a\nb", "bare"], ["c\nc", "c"], ["c", ""]]


def test_unreadable_files_become_error_rows(spark):
    book = xlsx_bytes({"인정조사": {"A1": "말", "B1": 2}})
    files = spark.createDataFrame([("good", bytearray(book)), ("bad", bytearray(b"no zip")), ("cut", bytearray(book[:200]))], "doc_id string, content binary")
    assert {r["doc_id"] for r in parse_workbooks(files).collect()} == {"good"}
    assert {r["doc_id"] for r in workbook_errors(files).collect()} == {"bad", "cut"}
    assert parse_notices(files).count() == 0
    assert {r["doc_id"] for r in notice_file_errors(files).collect()} == {"good", "bad", "cut"}


def test_comparison_states(spark):
    items = spark.createDataFrame([("d", "활동보조.일반", 16150), ("d", f"{fixed.K_ADD_LIMITS}.출산", 800000), ("d", "종합조사 월한도액(기본형).1구간", 5), ("d", "없음", 1)],
                                  "doc_id string, key string, amount bigint")
    reference = spark.createDataFrame([("d", "기본단가", 16150, 0), ("d", f"{fixed.K_ADD_LIMITS}.출산", 1, 1), ("d", "종합조사 월한도액 (기본형).1구간", 5, 2),
                                       ("d", "사업년도", 2026, 3), ("d", "A값", 3, 4)], "doc_id string, key string, value bigint, pos int")
    rows, left = rc.compare_with_reference(items, reference)
    assert {r["key"]: r["state"] for r in rows.collect()} == {
        "활동보조.일반": "일치", f"{fixed.K_ADD_LIMITS}.출산": "불일치", "종합조사 월한도액(기본형).1구간": "일치", "없음": "조견표에 없음"}
    assert [r["key"] for r in left.collect()] == ["A값"]


def test_rules_and_decisions(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(RULES_2025, ensure_ascii=False), encoding="utf-8")
    assert fs.load_rules(str(path)) == RULES_2025
    assert rule_registry(spark, {"2025": RULES_2025}).count() == 9
    log = tmp_path / "log"
    rows = [("r", "i1", "select_candidate", "A", "B", 1, None, "2026-01-01T00:00:00"), ("r", "i2", "manual_input", "C", None, None, "D", None)]
    fs.write_decisions(spark.createDataFrame(rows, fs.DECISION_SCHEMA), str(log))
    (log / "extra.json").write_text('{"run_id": "r", "item_id"\n\n{"run_id": "r", "item_id": "i3", "action": "manual_input", "input_label": "E"}\n')
    got = {r["item_id"]: r["reviewed_at"] is not None for r in fs.read_decisions(spark, str(log)).collect()}
    assert got == {"i1": True, "i2": True, "i3": False}


def test_notices_are_parsed_once_and_dealt_out(spark):
    from tariffloom.session import dealt
    from tariffloom.workloads.notices import _notice_file

    files = spark.createDataFrame([(str(n), bytearray(_notice_file(n, 0))) for n in range(3)], "doc_id string, content binary")
    blocks = parse_notices(files)
    assert "MapInPandas" not in blocks._jdf.queryExecution().toString()
    assert blocks.select("doc_id").distinct().count() == 3
    rows = spark.range(1000).selectExpr("id % 50 as doc_id", "id")
    assert dealt(rows, "doc_id", rows=10).rdd.getNumPartitions() == 100
