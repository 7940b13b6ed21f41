"""What keeps tasks bounded and few as the tables grow."""

from pyspark.sql import functions as F

from tariffloom.operators import similarity as si


def test_small_tiles_and_chunks_share_tasks(spark, monkeypatch):
    """A tile of eight labels and a chunk of sixteen queries are no group of their own."""
    groups, plain = [], si._cogrouped

    def counted(left, right, keys, run, schema):
        groups.append(left.select(*keys).distinct().count())
        return plain(left, right, keys, run, schema)

    monkeypatch.setattr(si, "_cogrouped", counted)
    labels = spark.range(600).select((F.col("id") % 3).alias("block"), F.concat(F.lit("n"), F.conv("id", 10, 5)).alias("norm"), F.col("id").alias("pos"))
    asked = labels.filter("pos % 5 = 0").select("block", "norm")
    ranked = si.rank_candidates(asked, labels.filter("pos % 5 <> 0"), ["block"], si.HybridConfig(tile=8, chunk=16))
    # 120 queries and 480 labels are one bundle and one part, not a group for each chunk and tile
    assert groups == [1]
    assert ranked.groupBy("block", "q_norm").count().filter("count = 3").count() == 120


def test_documents_are_dealt_to_more_tasks_as_they_grow(spark):
    from tariffloom.workloads.registry import spread

    sizes = spread(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 1500


def test_bigrams_are_counted_inside_documents(spark, tmp_path):
    from tariffloom.workloads import all_workloads

    rows = [(1, "abab"), (1, "ab"), (2, "b"), (3, None), (None, "ab"), (None, "abc"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = all_workloads()["bigram_counts"].build(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {("ab", 5, 1), ("ba", 1, 1), ("b", 1, 1), ("bc", 1, 0)}
    # no shuffle by token and document
    assert "hashpartitioning(g" in (plan := df._jdf.queryExecution().executedPlan().toString())
    assert not [line for line in plan.splitlines() if "hashpartitioning(g" in line and "doc_id" in line]


def test_constants_are_compared_inside_documents(spark, tmp_path):
    """Rows dealt out by document are not shuffled anew by key into a fixed number of partitions."""
    from tariffloom.workloads import all_workloads

    spark.createDataFrame([(n, 1000.0 * n) for n in range(30)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("constants_changed", "constants_checks"):
        plan = all_workloads()[name].build(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
        assert dealt and not [line for line in dealt if "REPARTITION" not in line]


def test_changed_values_with_repeated_and_missing_keys(spark):
    from tariffloom.operators import constants as cn

    schema = "doc_id long, key string, value double"
    old = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", None), (2, "a", 5.0), (1, None, 3.0)], schema)
    new = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (1, "c", 6.0), (2, "a", 5.0), (3, "a", 7.0), (1, None, 8.0)], schema)
    got = {(r.doc_id, r.key, r.value, r.old) for r in cn.changed_values(old, new, F.col("value") > 0).collect()}
    assert got == {(1, "a", 2.0, 1.0), (1, "b", 4.0, None), (1, "c", 6.0, None), (3, "a", 7.0, None), (1, None, 8.0, None)}


def test_a_large_part_of_a_stream_is_several_files_of_one_batch(spark, tmp_path, monkeypatch):
    from tariffloom.workloads import notices

    monkeypatch.setattr(notices, "_FILE_ROWS", 50)
    monkeypatch.setattr(notices, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    rows = spark.range(600).select(F.col("id").alias("seq"))
    batches = []
    stream = notices._in_batches(spark, rows, late=True)
    stream.writeStream.foreachBatch(lambda b, n: batches.append(sorted(r.seq for r in b.collect()))).trigger(availableNow=True).option(
        "checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    assert len(list(tmp_path.glob("source/part-*"))) == 12
    assert batches == [[x for x in range(600) if x % 5 == 4], [x for x in range(600) if x % 5 in (2, 3)], [x for x in range(600) if x % 5 in (0, 1)]]


def test_warnings_are_judged_in_their_row(spark, tmp_path):
    """A copayment's own findings are not worked out a second time and joined to the warnings."""
    from tariffloom.workloads import all_workloads

    spark.createDataFrame([(4, 77.0), (5, 1234.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    plan = all_workloads()["validate_basic_warnings"].build(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join") == 1


def test_payment_rows_stay_in_the_tasks_of_their_documents(spark, tmp_path):
    """25 services for each grade: the rows are not shuffled by code or service, and nothing is written between."""
    from tariffloom.workloads import all_workloads

    spark.createDataFrame([(n, 1000.0 * n) for n in range(3)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    plan = all_workloads()["validate_payment"].build(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [line for line in plan if "Exchange" in line]
    assert shuffles and not [line for line in shuffles if "hashpartitioning(doc_id" not in line or "REPARTITION_BY_NUM" not in line]
    assert all("s_suppkey" in line for line in plan if "FileScan" in line)


def test_later_copies_are_later_duplicates(spark):
    from tariffloom.operators import tables as tb

    rows = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "a", 2), (1, "b", 5), (2, "a", 4), (2, None, 1), (2, None, 2), (3, "a", 7), (3, "a", 7)],
                                 "d long, k string, o long")
    want = {tuple(r) for r in tb.later_duplicates(rows, ["d", "k"], "o").select("d", "k", "o", "first_row").collect()}
    for placed, hashed in ((rows.repartition(3, "d"), True), (rows, False)):
        found = tb.later_copies(placed, ["d", "k"], "o", hashed).select("d", "k", "o", "first_row")
        assert {tuple(r) for r in found.collect()} == want == {(1, "a", 2, 1), (1, "a", 3, 1)}


def test_references_are_found_by_code_inside_a_document(spark):
    from tariffloom.plans.validate import payment_with_references

    basic = spark.createDataFrame([(1, 0, "D1", 10, 6, 4), (1, 1, " D1", 20, 12, 8), (1, 2, "D2", 30, None, 3), (2, 0, "D1", 40, 30, 10), (1, 3, "", 50, 1, 1)],
                                  "doc_id long, row_id long, `등급구분` string, `지원량` long, `정부지원금` long, `본인부담금` long")
    table = spark.createDataFrame([(1, 0, "D1 "), (1, 1, "D2"), (1, 2, "X"), (1, 3, None), (2, 0, "D1"), (3, 0, "D1")], "doc_id long, row_id long, `등급구분` string")
    rows = payment_with_references(table, basic, None).select("doc_id", "row_id", "ref_support", "ref_gov", "ref_copay")
    assert {tuple(r) for r in rows.collect()} == {(1, 0, 20, 12, 8), (1, 1, None, None, None), (1, 2, None, None, None), (1, 3, None, None, None),
                                                  (2, 0, 40, 30, 10), (3, 0, None, None, None)}


def test_payment_digests_are_those_of_the_payment_rows(spark, tmp_path):
    """Rows are spelled out document by document: not shuffled, and not gathered again after they multiplied."""
    import hashlib

    from tariffloom.plans import generate as gen
    from tariffloom.workloads import all_workloads, tariffs

    spark.createDataFrame([(7, 1234.0), (8, -55.5)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = all_workloads()["generate_payment"].build(spark, str(tmp_path))
    columns = ("순번", "등급구분", "등급명", "서비스종류", "서비스종유명", "서비스시간", "서비스시간명", "단위기준단가", "단위기준심야단가", "지원량", "정부지원금액", "본인부담금액")
    million = [F.round(F.col(c) * 1000000).cast("bigint") for c in ("정부지원금율", "본인부담금율")]
    rows = gen.payment_table(tariffs.basic_tables(spark, str(tmp_path)), tariffs.supplier_prices(spark, str(tmp_path))).select(
        "doc_id", "서비스유형ID", *columns, *million).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: r["순번"]):
        texts.setdefault((r[0], r[1]), []).append(r[2:])
    want = {(doc, tid, len(of), of[0][0], of[-1][0], hashlib.md5("\n".join("|".join(str(v) for v in r if v is not None) for r in of).encode()).hexdigest())
            for (doc, tid), of in texts.items()}
    assert len(rows) == 2 * 949 * 25 and {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in plan if "Exchange" in line and "REPARTITION_BY_NUM" not in line]
    # the rows that are gathered are grades, 25 times fewer
    assert not [line for line in plan if "Aggregate(" in line and "서비스" in line]


def test_payment_digests_of_no_documents_and_unknown_prices(spark):
    from tariffloom.plans import generate as gen
    from tariffloom.workloads import tariffs

    basic = spark.createDataFrame([(1, "D2", None, 0, 0, 0), (1, "D1", "a", 10, 6, 4), (1, "9999", "b", 1, 1, 1), (2, "D1", "a", 1, 1, 0)],
                                  "doc_id long, `등급구분` string, `등급명` string, `지원량` long, `정부지원금` long, `본인부담금` long")
    prices = spark.createDataFrame([(1, "방문간호.30분미만", 42000.0)], "doc_id long, key string, value double")
    found = {r.tid: r for r in tariffs._payment_digests(*gen.payment_parts(basic, prices)).collect()}
    assert {t: (r.n, r.first_no, r.last_no) for t, r in found.items()} == {
        "ST0001": (16, 1, 16), "ST0002": (18, 17, 34), "ST0003": (8, 35, 42), "ST0004": (8, 43, 50)}
    assert tariffs._payment_digests(*gen.payment_parts(basic.limit(0), prices)).count() == 0
