"""Streams against batch results: workbooks, decisions and edits arriving out of order."""

from pyspark.sql import functions as F

from support import cells_frame, grid_rows, xlsx_bytes, year_pair
from tariffloom.streaming import streams as st


def test_arriving_workbooks(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    books = year_pair()

    def handle(cells, batch_id):
        cells.withColumn("name", F.regexp_extract("doc_id", r"([a-z]+)\.xlsx$", 1)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for name in books:  # the second file arrives after the first was handled
        (inbox / f"{name}.xlsx").write_bytes(xlsx_bytes(books[name]))
        st.arriving_workbooks(st.workbook_files(spark, str(inbox)), handle, state).awaitTermination()
    counts = {r["name"]: r["count"] for r in spark.read.parquet(out).groupBy("name").count().collect()}
    assert counts == {name: len(grid_rows(name, books[name])) for name in books}


def test_arriving_workbooks_are_matched_with_the_latest_earlier_year(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    books = year_pair()
    archive = cells_frame(spark, {"kept/2025": books["old"], "kept/2024": {"부록": {"A1": "다른 것"}}})
    name = (inbox / "2027.xlsx").as_uri().replace("file:///", "file:/")
    lone = (inbox / "lone.xlsx").as_uri().replace("file:///", "file:/")
    registry = spark.createDataFrame([("a", 2024, "kept/2024", 1), ("a", 2025, "kept/2025", 2), ("a", 2027, name, 3), ("b", 2027, lone, 4)],
                                     "office string, year int, path string, seq int")
    (inbox / "2027.xlsx").write_bytes(xlsx_bytes(books["new"]))
    st.match_on_arrival(st.workbook_files(spark, str(inbox)), registry, archive, out, state).awaitTermination()
    (inbox / "lone.xlsx").write_bytes(xlsx_bytes(books["old"]))
    st.match_on_arrival(st.workbook_files(spark, str(inbox)), registry, archive, out, state).awaitTermination()
    assert [r["pair_id"] for r in st.current_report(spark, out, "summary").collect()] == [name]
    assert {"UNIT_SHIFT_SUSPECTED", "MONOTONICITY_BROKEN"} <= {r["code"] for r in st.current_report(spark, out, "anomalies").collect()}
    assert {r["target_doc"]: r["base_doc"] for r in st.current_baselines(spark, out).collect()} == {name: "kept/2025", lone: None}


def test_late_files_bad_times_and_mended_rows(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    line = lambda item, label, at: f'{{"run_id": "r", "item_id": "{item}", "action": "a", "input_label": "{label}", "reviewed_at": "{at}"}}\n'
    for text in (line("i", "late", "2026-05-02T00:00:00") + line("j", "odd", "not a time") + "{\n", line("i", "early", "2026-05-01T00:00:00")):
        (log / f"{len(list(log.iterdir()))}.txt").write_text(text)  # the older decision comes a batch later
        decisions = st.decision_stream(spark, str(log))
        st.first_decisions(decisions, out, out + "-state", buckets=3).awaitTermination()
    assert {(r["item_id"], r["input_label"]) for r in st.kept_rows(spark, out, decisions.schema).collect()} == {("i", "early"), ("j", "odd")}

    rows = spark.createDataFrame([("t", 1, 10), ("t", 2, 20), ("u", 1, 30)], "doc string, row int, v bigint")
    source, path = str(tmp_path / "edits"), str(tmp_path / "found")
    schema = "doc string, row int, column string, value string, seq int"
    suite = lambda df: df.filter("v % 10 <> 0")
    for batch in ([("t", 1, "v", "11", 2), ("t", 2, "v", "22", 3), ("u", 1, "v", "33", 4)], [("t", 1, "v", "50", 9), ("t", 2, "v", "40", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        edits = spark.readStream.schema(schema).parquet(source)
        st.revalidate_edited(edits, rows, ["doc", "row"], "doc", suite, path, path + "-state").awaitTermination()
    assert {(r["doc"], r["row"], r["v"]) for r in st.current_findings(spark, path, "doc").collect()} == {("t", 2, 22), ("u", 1, 33)}


def test_first_decisions_do_not_hang_on_the_order_of_batches(spark, tmp_path):
    line = lambda item, label, at: f'{{"run_id": "r", "item_id": "{item}", "action": "a", "input_label": "{label}", "reviewed_at": "{at}"}}\n'
    files = [line("i", "x", "soon") + line("k", "two", "2026-05-01T00:00:00"), line("i", "y", "no time") + line("k", "one", "2026-05-01T00:00:00"),
             line("i", "z", "soon") + line("l", "alone", "2026-05-03T00:00:00")]
    got = []
    for n, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 2, 0])):
        log, out = tmp_path / f"log{n}", str(tmp_path / f"out{n}")
        log.mkdir()
        for k in order:
            (log / f"{k}.txt").write_text(files[k])
            decisions = st.decision_stream(spark, str(log))
            st.first_decisions(decisions, out, out + "-state", buckets=2).awaitTermination()
        got.append({(r["item_id"], r["input_label"]) for r in st.kept_rows(spark, out, decisions.schema).collect()})
    assert got[0] == got[1] == got[2] == {("i", "y"), ("k", "one"), ("l", "alone")}


def test_a_late_baseline_and_a_file_that_comes_again(spark, tmp_path):
    inbox, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    books = year_pair()
    empty = cells_frame(spark, {"kept": {"부록": {"A1": "다른 것"}}})
    registry = spark.createDataFrame([("a", 2024, "kept", 1), ("a", 2025, "late", 2), ("a", 2026, "new", 3), ("b", 2026, "lone", 4)], "office string, year int, path string, seq int")
    summaries = []
    for docs in ({"new": books["new"], "lone": books["old"]}, {"late": books["old"]}, {"new": books["old"]}):
        cells_frame(spark, docs).coalesce(1).write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(empty.schema).parquet(inbox)
        st.match_cells_on_arrival(arriving, registry, empty, out, state).awaitTermination()
        bases = {r["target_doc"]: r["base_doc"] for r in st.current_baselines(spark, out).collect()}
        summaries.append((bases, {r["pair_id"]: (r["total_labels"], r["auto_passed"]) for r in st.current_report(spark, out, "summary").collect()}))
    assert summaries[0][0] == {"new": "kept", "lone": None}
    assert summaries[1][0] == summaries[2][0] == {"new": "late", "lone": None, "late": "kept"}
    total, passed = summaries[1][1]["new"]
    assert passed < total and summaries[2][1]["new"][0] == summaries[2][1]["new"][1] > 30
