"""Queries with SQL, against it."""

import pytest

from oracle import compare, connect
from tariffloom.llm.mixing import mix_sources, solve_dual
from tariffloom.llm.quality import host_verdicts
from tariffloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) == ""


def test_mix_meets_targets_and_limits(spark, texts):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50))) for i in range(400)]
    got = mix_sources(texts(rows)).collect()
    again = {(r.doc_id, r.taken) for r in mix_sources(texts(rows)).collect()}
    assert {(r.doc_id, r.taken) for r in got} == again
    assert all(r.taken <= 2 * r["size"] for r in got)
    for target in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == target) - target) <= 50
    assert abs(sum({r.target for r in got}) - 1.5 * sum(r["size"] for r in got)) < 1e-6


def test_newton_solves_the_dual(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(100.0, 200.0), (100.0, 3.0), (7.0, 7.0)], "s double, t double").select(
        "s", "t", F.exp(solve_dual(F.col("s"), F.col("t"))).alias("r")).collect()
    assert all(abs(r.s * r.r - r.t) < 1e-9 for r in got)


def test_mix_odd_rows(odd):
    got = mix_sources(odd).collect()
    assert len(got) == 8
    assert {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mix_sources(odd.limit(0)).count() == 0


def test_quality_odd_rows(odd):
    got = {r.doc_id: r for r in host_verdicts(odd).collect()}
    assert got[1].n_words == got[3].n_words == 0 and got[1].base_failed
    assert got[4].n_words == got[4].n_repeat_words == 30_000
    assert got[7].word_chars == 5000
    assert host_verdicts(odd.limit(0)).count() == 0


def test_repeated_windows_by_brute_force(texts):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in host_verdicts(texts(rows)).collect()}
    for i, text in rows:
        w = text.split()
        grams = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        assert got[i] == len({p for j, g in enumerate(grams) if grams.count(g) > 1 for p in (j, j + 1, j + 2)})


def test_a_bad_host_takes_its_documents_along(spark):
    good, bad = "alpha beta gamma delta epsilon " + " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, bad if i < 90 else good, "poor") for i in range(100)] + [(100 + h * 50 + i, good, f"h{h}") for h in range(6) for i in range(50)]
    got = {r.doc_id: r.kept for r in host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(100)) and all(got[i] for i in range(100, 400))
