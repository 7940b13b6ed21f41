"""Fingerprints and their groups against plain loops."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tariffloom.llm import simhash as sh


def plain_print(text, words=4):
    own = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    rows = [" ".join(own[i:i + words]) for i in range(len(own) - words + 1)] if len(own) >= words else [" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance):
    """Smallest member of each fingerprint's group, over all pairs."""
    prints = list(prints)
    group = {p: {p} for p in prints}
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= distance and group[a] is not group[b]:
                group[a] |= group[b]
                for c in group[b]:
                    group[c] = group[a]
    return group


def expected(rows, distance=4):
    prints = {n: plain_print(t) for n, (_, t) in enumerate(rows)}
    group = plain_groups(set(prints.values()), distance)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m, p in prints.items() if p in group[prints[n]] and rows[m][0] is not None]
        out.append((i, f"{prints[n]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def copies(rng, n):
    words = [f"w{i}" for i in range(500)]
    rows = []
    while len(rows) < n:
        text = rng.choices(words, k=rng.choice([1, 3, 4, 30, 200]))
        for _ in range(rng.choice([1, 1, 2, 12])):
            own = list(text)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1000, " ".join(own).upper() if rng.random() < 0.1 else "\t".join(own)))
    return rows


@pytest.mark.parametrize(("hot", "tile"), [(4096, 200_000), (0, 200_000), (0, 3)])
def test_groups_equal_all_pairs(spark, texts, hot, tile):
    rows = copies(random.Random(5), 300)
    assert found(sh.near_copies(texts(rows), hot=hot, tile=tile)) == expected(rows)


def test_odd_tables(spark, odd, texts):
    from conftest import ODD

    got = found(sh.near_copies(odd))
    assert got == expected(ODD)
    assert (None, f"{plain_print("no id at all"):016x}", None) in got
    assert found(sh.near_copies(texts(ODD).limit(0))) == []


def test_spark_hash_is_the_same(spark):
    rows = ["a b c d", "ü 漢 x", ""]
    got = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(r,) for r in rows], "t string").select(F.xxhash64("t")).collect()]
    assert got == [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]


@pytest.mark.parametrize("distance", [2, 3, 4, 6])
@pytest.mark.parametrize(("hot", "tile"), [(4096, 200_000), (2, 4)])
def test_links_connect_what_all_pairs_connect(spark, distance, hot, tile):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) & ~0xFFF0 for _ in range(40)}
    for p in list(prints):
        for _ in range(rng.choice([0, 1, 30])):
            own = p
            for _ in range(rng.randrange(distance + 3)):
                own ^= 1 << rng.randrange(64)
            prints.add(own)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    links = sh.near_links(spark.createDataFrame([(p,) for p in signed], "print long").repartition(3), distance, hot, tile).collect()
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in links]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    want = {frozenset(g) for g in map(frozenset, plain_groups(prints, distance).values())}
    group = {p: {p} for p in prints}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for c in group[b]:
                group[c] = group[a]
    assert {frozenset(g) for g in map(frozenset, group.values())} == want


def test_thresholds_are_the_cheapest():
    from itertools import product

    rng = np.random.default_rng(3)
    costs = [np.vstack([np.zeros(50), np.sort(rng.integers(0, 1000, (3, 50)), axis=0)]) for _ in range(4)]
    chosen = sh.thresholds(costs, 4)
    assert (chosen.sum(axis=1) == 1).all()
    for n in range(50):
        price = lambda t: sum(c[e + 1, n] for c, e in zip(costs, t, strict=True))
        assert price(chosen[n]) == min(price(t) for t in product(range(-1, 3), repeat=4) if sum(t) == 1)


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 64), dtype=np.uint8)
    bits[:, [5, 21, 40, 63]] = bits[:, [5]] ^ (rng.random((4000, 4)) < 0.05)
    prints = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    *both, n = sh.together(prints)
    groups = sh.bit_groups(np.array(both), n)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({5, 21, 40, 63} <= set(g) for g in groups)
    assert sh.picker([3, 60, 9])(np.array([1 << 60 | 1 << 9, 8], np.uint64)).tolist() == [6, 1]


def test_a_dense_family_is_walked_once():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    family = np.array([base ^ np.uint64(int(1 << a) | int(1 << b)) for a in range(60) for b in range(60)], np.uint64)
    far = rng.integers(0, 2**63, 500, dtype=np.uint64)
    leaves, heads = sh.spread_links(np.concatenate([family, far]), 4)
    assert len(set(heads.tolist())) == 1 and len(leaves) == len(np.unique(family)) - 1
