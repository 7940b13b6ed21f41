"""Ordered scans, similarity and repair against plain Python on small data; plan shapes."""

import collections
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tariffloom.functions.text import bigrams, token_counts
from tariffloom.operators import ordered as od
from tariffloom.operators.similarity import HybridConfig, hashed_vector, rank_candidates


@pytest.fixture(scope="module")
def sequence(spark):
    rng = random.Random(7)
    rows = [(g, o, rng.choice([None, None, rng.randint(0, 9)])) for g in "ab" for o in rng.sample(range(400), 150)]
    return rows, spark.createDataFrame(rows, "g string, o long, v int").cache()


def test_ordered_scans(sequence):
    rows, df = sequence
    want = {}
    for g in "ab":
        last, prev, total = None, None, 0
        for n, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            last = v if v is not None else last
            total += v or 0
            want[g, o] = (last, prev, total, n + 1)
            prev = v
    out = od.carry_forward(df, ["g"], "o", F.col("v"), "last", piece=17)
    out = od.previous_value(out, ["g"], "o", "v", "prev", piece=17)
    out = od.running_total(out, ["g"], "o", F.coalesce("v", F.lit(0)), "total", piece=17)
    out = od.row_numbers(out, ["g"], "o", "n", piece=17)
    assert {(r["g"], r["o"]): (r["last"], r["prev"], r["total"], r["n"]) for r in out.collect()} == want


def test_exact_median(sequence):
    rows, df = sequence
    got = {r["g"]: r["m"] for r in od.exact_median(df, ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(v for h, _, v in rows if h == g and v is not None) for g in "ab"}


@pytest.mark.parametrize("bracket", [1_000_000, 10, 0])
def test_exact_median_of_wide_brackets(spark, bracket):
    rng = random.Random(2)
    groups = {"even": [rng.random() * 10 ** rng.randint(-30, 30) for _ in range(20_000)], "odd": [rng.gauss(0, 1) for _ in range(30_001)],
              "ties": [float(rng.randint(0, 3)) for _ in range(25_000)], "one": [4.5], "two": [1.0, 2.0], "edge": [0.0] * 9_999 + [1.0] * 9_999}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    got = {r["g"]: r["m"] for r in od.exact_median(df, ["g"], "v", "m", bracket=bracket).collect()}
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}


def grams(text):
    return [text[i:i + 2] for i in range(len(text) - 1)] if len(text) > 1 else [text]


def bm25_scores(query, corpus):
    docs = [collections.Counter(grams(d)) for d in corpus]
    lens = [len(grams(d)) for d in corpus]
    avg, n = sum(lens) / len(lens), len(docs)
    df = collections.Counter(t for d in docs for t in d)
    idf = lambda t: max(math.log((n - df[t] + .5) / (df[t] + .5) + 1), .01) if t in df else math.log((n + .5) / .5 + 1)

    def raw(tf, length):
        return sum(idf(t) * tf[t] * 2.5 / (tf[t] + 1.5 * (.25 + .75 * length / avg)) for t in grams(query) if tf[t])

    own = raw(collections.Counter(grams(query)), len(grams(query)))
    return [min(raw(d, k) / own, 1.0) for d, k in zip(docs, lens)]


@pytest.mark.parametrize("tile", [3, 1024])
def test_ranking_matches_plain_python(spark, tile):
    rng = random.Random(3)
    words = ["본인", "부담금", "상한액", "기본", "단가", "구간", "등급", "추가", "급여"]
    make = lambda: "".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    corpus, queries = sorted({make() for _ in range(25)}), sorted({make() for _ in range(8)})
    t = spark.createDataFrame([("b", x, n) for n, x in enumerate(corpus)], "block string, norm string, pos long")
    q = spark.createDataFrame([("b", x) for x in queries], "block string, norm string")
    vectors = t.select("norm").union(q.select("norm")).distinct().select("norm", hashed_vector(F.col("norm")).alias("vec"))
    vec = {r["norm"]: np.array(r["vec"]) for r in vectors.collect()}
    ranked = rank_candidates(q, t, ["block"], HybridConfig(tile=tile, vetoes=False), vectors)
    got = {(r["q_norm"], r["rank"]): (r["pos"], round(r["final"], 6)) for r in ranked.collect()}
    want = {}
    for query in queries:
        dense = [min(max((float(vec[query] @ vec[c]) - .76) / .24, 0), 1) for c in corpus]
        final = [.6 * s + .4 * d for s, d in zip(bm25_scores(query, corpus), dense)]
        order = sorted(range(len(corpus)), key=lambda i: (-round(final[i], 9), i))[:3]
        want.update({(query, n + 1): (i, round(final[i], 6)) for n, i in enumerate(order)})
    assert got == want


def test_vetoes_demote_but_keep(spark):
    t = spark.createDataFrame([("b", "11구간", 0), ("b", "10구간", 1)], "block string, norm string, pos long")
    q = spark.createDataFrame([("b", "010구간")], "block string, norm string")
    rows = rank_candidates(q.withColumn("norm", F.lit("10구간값")), t, ["block"]).orderBy("rank").collect()
    assert [r["t_norm"] for r in rows] == ["10구간", "11구간"]
    assert rows[1]["final"] > 0 and rows[1]["flags"] == ["NUMERIC_VETO_APPLIED"]


@pytest.mark.parametrize("name", ["flagship_recompute", "limit_lookup", "anchor_unique", "anchor_scan", "duplicates_later", "growth",
                                  "generate_payment", "reconcile_spellings", "required_missing", "context_window", "edits_latest"])
def test_plans_have_no_pairwise_joins(spark, name):
    from tariffloom.workloads import all_workloads

    plan = all_workloads()[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan


def test_flagship_reads_only_its_columns(spark):
    from tariffloom.workloads import all_workloads

    plan = all_workloads()["flagship_recompute"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_suppkey" not in plan


@pytest.mark.parametrize(("alpha", "vetoes"), [(1.0, True), (0.6, True), (0.0, False)])
def test_tiles_that_are_left_out_hold_nothing_better(spark, alpha, vetoes):
    rng = random.Random(8)
    words = ["본인", "부담금", "상한액", "기본", "단가", "구간", "등급", "추가", "급여", "zz", "12", "2024"]
    make = lambda: "".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    corpus, queries = sorted({make() for _ in range(150)} | {"ㄱ", "ㄴㄷ"}), sorted({make() for _ in range(30)} | {"qq", "ㄱ"})
    places = list(range(len(corpus)))
    rng.shuffle(places)
    t = spark.createDataFrame([("b", x, n) for n, x in zip(places, corpus)] + [("c", "홀로", 5)], "block string, norm string, pos long")
    q = spark.createDataFrame([("b", x) for x in queries] + [("c", "혼자")], "block string, norm string")
    vectors = t.select("norm").union(q.select("norm")).distinct().filter("norm <> 'ㄱ'").select("norm", hashed_vector(F.col("norm")).alias("vec"))
    run = lambda **own: {(r["q_norm"], r["rank"]): (r["pos"], round(r["final"], 8)) for r in rank_candidates(
        q, t, ["block"], HybridConfig(alpha=alpha, cosine_floor=0.3, vetoes=vetoes, **own), vectors).collect()}
    assert run(tile=4, chunk=3) == run(tile=4096)


def test_few_tiles_are_visited():
    from tariffloom.operators import similarity as si

    tiles = pd.DataFrame({"tile": [1, 2, 3], "n": [5, 5, 5], "first": [[1], [2], [3]], "toks": [["ab"], ["cd"], ["ab", "ef"]], "weights": [[2.0], [1.0], [1.0, 1.0]],
                          "low": [None] * 3, "high": [None] * 3, "square": [None] * 3, "number_sets": [[""], ["7#1"], ["", "12#1"]], "numbers": [[], ["7#1"], ["12#1"]]})
    q = pd.DataFrame({"b": ["x"], "q_norm": ["ab"], "chunk": [0], "toks": [["ab"]], "weights": [[1.0]], "self_score": [4.0], "nums": [[]], "dist": [None], "square": [None], "least": [0.4], "home": [1]})
    config = HybridConfig(alpha=1.0)
    assert np.round(si.promises(q, tiles, config), 6).tolist() == [[0.5, 0, 0.25]]
    assert np.round(si.promises(q.assign(nums=[["12#1"]]), tiles, config), 6).tolist() == [[0.3, 0, 0.25]]
    assert np.round(si.promises(q.assign(nums=[["7#1"]]), tiles.assign(number_sets=[["8#1"], ["7#1"], ["12#1"]]), config), 6).tolist() == [[0.075, 0, 0.0375]]
    assert si._visits(["b"], config, True)(q, tiles)["tile"].tolist() == [1]
    assert si._visits(["b"], config, False)(q, tiles)["tile"].tolist() == []
    assert si._visits(["b"], config, False)(q.assign(least=0.2), tiles)["tile"].tolist() == [3]


def test_token_counts_of_a_long_text(spark):
    import time

    text = "ab" * 50_000
    df = spark.createDataFrame([(text,), ("",), (None,), ("aba",)], "t string")
    start = time.time()
    got = [r["c"] for r in df.select(token_counts(bigrams(F.col("t"))).alias("c")).collect()]
    assert time.time() - start < 20
    assert [tuple(x) for x in got[0]] == [("ab", 50_000), ("ba", 49_999)] and got[1] == [] and [tuple(x) for x in got[3]] == [("ab", 1), ("ba", 1)]


def test_repair_marks_rows_that_never_rest(spark):
    from tariffloom.operators import checks as ck
    from tariffloom.plans.repair import repair, repair_tables

    rows = spark.createDataFrame([(1, 0, 5), (2, 3, 5), (3, 7, 5), (4, 9, 5)], "k int, a bigint, b bigint")
    a = F.col("a")
    find = lambda test, to: ck.finding(test, "X", "a", to, reason=F.lit("x"))
    checks = [find(a == 0, F.lit(1.0)), find(a == 1, F.lit(0.0)), find(a.between(3, 5), (a + 1).cast("double")),
              find(a >= 7, (a + 1).cast("double"))]
    keep = lambda df: df
    got = {r["k"]: (r["a"], r["unfinished"]) for r in repair(rows.filter("k < 3"), keep, checks, ["a"]).collect()}
    assert got[2] == (6, False) and got[1][1]
    got = {r["k"]: r["unfinished"] for r in repair(rows, keep, checks, ["a"], rounds=4).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}
    # the second of equal rows moves on, and the row check that it then breaks is repaired as well
    fixes = lambda df: df.groupBy("b").agg(F.max("k").alias("k"), F.count("*").alias("n")).filter("n > 1").select("k", F.lit("b").alias("column"), F.lit(6.0).alias("expected"))
    row = [find((F.col("b") == 6) & (a != 60), F.lit(60.0))]
    done = repair_tables(rows.filter("k in (2, 3)"), ["k"], keep, row, ["a", "b"], fixes)
    assert {tuple(r) for r in done.select("k", "a", "b", "unfinished").collect()} == {(2, 3, 5, False), (3, 60, 6, False)}


def test_joins_of_exploded_rows_are_not_broadcast(spark):
    from tariffloom.plans.validate import validate
    from tariffloom.operators.cells import patch_cells
    from tariffloom.operators.reconcile import compare_with_reference
    from tariffloom.plans.extract import extract_constants

    def planned(df):
        return df._jdf.queryExecution().sparkPlan().toString()

    # a few documents that an explode turns into many rows: Spark still expects a few
    docs = spark.range(3).select(F.col("id").cast("string").alias("doc_id"))
    cells = docs.select("doc_id", F.lit("인정조사").alias("sheet"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("row"), F.lit(0).alias("col"),
                        F.lit("str").alias("vtype"), F.lit("기본단가").alias("sval"), F.lit(None).cast("double").alias("nval"), F.lit(None).cast("string").alias("formula"))
    items = cells.select("doc_id", F.col("row").cast("string").alias("key"), F.lit(1).cast("bigint").alias("amount"))
    reference = items.select("doc_id", "key", F.col("amount").alias("value"), F.lit(1).alias("pos"))
    table = cells.select("doc_id", F.col("row").cast("bigint").alias("row_id"), F.lit("1등급(가형)").alias("등급명"), F.lit("D001").alias("등급구분"),
                         *[F.lit(0).cast("bigint").alias(c) for c in ("지원량", "정부지원금", "본인부담금")])
    constants = cells.select("doc_id", F.lit("기본단가").alias("key"), F.lit(1.0).alias("value"))
    extracted = extract_constants(cells)
    for df in (extracted["cell_map"], extracted["errors"], *compare_with_reference(items, reference),
               patch_cells(cells, extracted["cell_map"], constants)[0]):
        assert "Broadcast" not in planned(df)
    for tab in (0, 1):
        joins = [line for line in planned(validate("unit_price", tab, table, constants)["issues"]).split("\n") if "Broadcast" in line]
        # documents without constants are the only short list
        assert all("LeftAnti" in line for line in joins), joins


def test_small_tables_are_dealt_out_before_their_rows_multiply(spark):
    from tariffloom.workloads.tariffs import supplier_constants, supplier_prices

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (supplier_constants, supplier_prices):
        assert rows(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tasks


def test_later_duplicates_move_only_likely_ones(spark):
    from tariffloom.operators.tables import later_duplicates

    rows = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "a", 7), (1, "b", 2), (1, None, 4), (1, None, 5), (2, "a", 6)], "d int, k string, o int")
    out = later_duplicates(rows, ["d", "k"], "o")
    assert sorted((r["d"], r["k"], r["o"], r["first_row"]) for r in out.collect()) == [(1, "a", 3, 1), (1, "a", 7, 1)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
