"""The pipeline against plain versions of its stages, and its registration."""

from collections import defaultdict

import corpus_pipeline
from tariffloom.llm import secrets
from tariffloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text, words=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    start = {r.doc_id: r for r in docs.collect()}

    nice = stages["toxicity"](spark, docs, SF)
    assert nice.columns == docs.columns and 0.8 < nice.count() / len(start) <= 1

    kept = {r.doc_id for r in stages["near_duplicates"](spark, docs, SF).collect()}
    sets = {i: shingles(r.text) for i, r in start.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert kept == {i for i in sets if root(i) == i}

    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()}
    exact = {i for i, r in start.items() if any(x in " ".join(r.text.lower().split()) for x in items)}
    assert not clean & exact and len(start) - len(clean) <= len(exact) + 2

    hidden = {r.doc_id: r for r in stages["secrets"](spark, docs, SF).collect()}
    assert set(hidden) == set(start)
    assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in hidden.values())

    mixed = stages["mixing"](spark, docs, SF).collect()
    taken, target = defaultdict(int), {}
    for r in mixed:
        taken[start[r.doc_id].source] += r.taken
        target[start[r.doc_id].source] = r.target
    assert len(mixed) == len(start) and all(abs(taken[s] - t) <= 20_000 for s, t in target.items())


def test_run_and_registration(spark):
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and 100 < got.count() < 200


def test_the_library_stands_without_the_text_operators():
    import subprocess
    import sys

    code = ("import sys\n"
            "class No:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('tariffloom.llm', 'corpus_pipeline')):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert len(q) > 90 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)\n")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
