"""Leaks: the banded alignment against a full table, and planted passages."""

import random

import numpy as np

from tariffloom.llm.decontamination import ItemBlock, banded_distance, find_leaks, gram_keys, normalized, without_leaks


def full(item, region):
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(region, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_distance_equals_the_full_table():
    rng = np.random.default_rng(5)
    for _ in range(300):
        item = rng.integers(0, 4, rng.integers(4, 25))
        region = rng.integers(0, 4, rng.integers(len(item), len(item) + 12))
        limit = int(rng.integers(0, 6))
        got, want = banded_distance(item, region, limit), full(item, region)
        assert (got is None) if want > limit else got[0] == want


def test_the_filter_loses_nothing():
    """Every region within the budget has enough shared grams on its diagonals."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghi") for _ in range(n))
    for _ in range(200):
        item = text(rng.randint(30, 200))
        block = ItemBlock([(7, item)])
        if not block.ids:
            continue
        copy = list(item)
        for _ in range(int(block.edits[0])):
            i = rng.randrange(len(copy))
            copy[i:i + 1] = rng.choice([[], ["z"], [copy[i], "z"]])
        found = block.leaks(text(80) + " " + "".join(copy) + " " + text(50))
        assert [f[0] for f in found] == [7] and found[0][3] <= block.edits[0]


def test_normalized_maps_back():
    codes, at = normalized("  Ab\n\t C İd ")
    assert "".join(map(chr, codes)) == "ab c İd" and at.tolist()[:2] == [2, 3]
    assert len(gram_keys(codes)) == 0


def test_leaks_and_clean_rows(spark, texts):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly vex the bold judge of the northern fjord."
    worn = item.replace("quick", "quikc").replace("bold ", "")
    rows = [(1, "before " + item.upper().replace(" ", "  \n") + " after"), (2, "x " + worn + " y"), (3, "nothing of the kind here at all"), (4, None), (5, ""),
            (6, item[:60] + " something else entirely follows here")]
    bench = spark.createDataFrame([(10, item), (11, None), (None, item), (12, "short"), (13, "")], "item_id long, text string")
    for chars in (500_000, 10):
        got = {r.doc_id: r for r in find_leaks(texts(rows), bench, block_chars=chars).collect()}
        assert sorted(got) == [1, 2] and got[1].edits == 0 and got[2].edits > 0
        assert rows[0][1][got[1].start:got[1].end].lower().split() == item.lower().split()
        assert sorted(r.doc_id for r in without_leaks(texts(rows), bench, block_chars=chars).collect()) == [3, 4, 5, 6]


def test_odd_rows(odd, spark):
    bench = spark.createDataFrame([(1, "no such passage in any of them at all")], "item_id long, text string")
    assert find_leaks(odd, bench).count() == 0 and without_leaks(odd, bench).count() == 8
    assert find_leaks(odd, bench.limit(0)).count() == 0 and without_leaks(odd, bench.limit(0)).count() == 8
    assert find_leaks(odd.limit(0), bench).count() == 0
