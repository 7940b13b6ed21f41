"""The similarity join against all pairs."""

import math
import random

import pytest

from tariffloom.llm.components import component_labels
from tariffloom.llm.jaccard import Scheme, folded, jaccard_components, one_of_each, parity_sketch


def shingles(text, words):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(docs, words, percent):
    sets = [shingles(t, words) for t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    names = [f"W{i}" for i in range(150)]
    docs = ["", None, "one", "One", "one two", "É one two three", "é one two three"]
    for size in (3, 4, 8, 12, 19, 20, 22, 28, 40, 90, 200):
        for _ in range(3):
            base = [rng.choice(names) for _ in range(size)]
            docs.append(" ".join(base))
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, max(1, size // 40)])):
                    i = rng.randrange(len(copy))
                    copy[i:i + 1] = rng.choice([[], [rng.choice(names)], [copy[i], rng.choice(names)]])
                docs.append("  ".join(copy))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_components_equal_all_pairs(texts, words, percent):
    docs = corpus(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(texts(enumerate(docs)), words, percent).collect()}
    assert got == brute(docs, words, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_every_linked_pair_meets(percent):
    """For random sets at the threshold, light or heavy, some key is shared."""
    import numpy as np

    rng = np.random.default_rng(percent)
    for light in (0, 12, 48):
        scheme = Scheme(percent)
        for _ in range(150):
            n = int(rng.integers(1, 80 if light < 48 else 30))
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = a.copy()
            for _ in range(int(rng.integers(1, 12))):
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 1 << 62).astype(np.uint64)))
                both = len(np.intersect1d(a, c))
                if 100 * both < percent * (len(a) + len(c) - both):
                    break
                b = c
            if light == 48 and sum(math.comb(len(x), s) for x in (a, b) for s in scheme.subset_sizes(len(x))) > 200_000:
                continue
            if len(a) != len(b) or (a != b).any():
                assert set(scheme.keys(a, light)) & set(scheme.keys(b, light)), (len(a), len(b), light)


def test_odd_rows(odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect()]
    assert len(got) == 8 and (5, 1, 5) in got and (None, 2, None) in got and (1, 0, 1) in got and (4, 1, 4) in got
    assert jaccard_components(odd.limit(0)).count() == 0


def test_one_of_each_keeps_clean_rows(texts):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(3, base), (1, base + " more"), (2, base), (9, "quite different words in this one here"), (10, None)]
    assert sorted(r.doc_id for r in one_of_each(texts(rows), 5, 80).collect()) == [1, 9, 10]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in component_labels(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_sketches_differ_in_no_more_bits_than_the_sets_in_elements():
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, int(rng.integers(0, 200))).astype(np.uint64)])
        x, y = parity_sketch(a, 80), parity_sketch(b, 80)
        words = min(len(x), len(y)) // 8
        differ = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


def test_a_large_group_of_near_copies_gives_a_forest(spark):
    """Sets that are all linked with each other give as many pairs as sets, not their square."""
    import numpy as np
    import pandas as pd

    from tariffloom.llm.jaccard import likely_pairs

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.r_[base, rng.integers(0, 1 << 62, 3).astype(np.uint64)]) for _ in range(60)]
    rows = pd.DataFrame({"key": np.repeat([5, 6], 60), "mark": [*range(60)] * 2, "label": [*range(60)] * 2,
                         "n": [len(s) for s in sets] * 2, "sketch": [parity_sketch(s, 90) for s in sets] * 2})
    assert len(pd.concat(likely_pairs(rows, 90))) == 2 * 60 * 59 // 2
    forest = pd.concat(likely_pairs(rows, 90, forest=True))
    assert len(forest) == 2 * 59
    links = spark.createDataFrame([*zip(forest["a"].tolist(), forest["b"].tolist(), strict=True)], "a long, b long")
    assert {r.label for r in component_labels(links).collect()} == {0}


@pytest.mark.parametrize(("rounds", "forests"), [(0, 0), (0, 1), (1, 1), (2, 0)])
def test_rounds_do_not_change_the_components(texts, rounds, forests):
    from tariffloom.llm.common import cut_lineage
    from tariffloom.llm.jaccard import document_sets, set_components

    docs = texts((i, t) for i, t in enumerate(corpus(4)))
    nodes = cut_lineage(document_sets(docs, 3))
    whole, some = (set_components(docs, nodes, 3, 90, *r) for r in ((2, 3), (rounds, forests)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, some.collect()))
