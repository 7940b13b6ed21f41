"""Removal of repeats against a dictionary of all strings."""

import random

import numpy as np
import pytest

from tariffloom.llm.suffixes import RunLengthIndex, anchors, cores, remove_repeats


def brute(bodies, length):
    seen, out = set(), []
    for body in bodies:
        covered = bytearray(len(body))
        for s in range(len(body) - length + 1):
            string = body[s:s + length]
            if string in seen:
                covered[s:s + length] = b"\x01" * length
            seen.add(string)
        spans = sum(1 for j, c in enumerate(covered) if c and (j == 0 or not covered[j - 1]))
        out.append((len(body), sum(covered), spans, bytes(c for c, m in zip(body, covered, strict=True) if not m)))
    return out


def corpus():
    rng = random.Random(8)
    letters = "abcdefgh ijkl é\n\0"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages, line = [text(rng.randint(60, 260)) for _ in range(5)], text(45)
    docs = ["", None, "short", "x" * 250, "ab" * 300, "ab" * 90]
    for _ in range(40):
        parts = [rng.choice([rng.choice(passages), line, text(rng.randint(1, 200)), "xyz " * rng.randint(10, 60)]) for _ in range(rng.randint(1, 6))]
        docs.append("".join(parts))
    return docs + docs[4:12]


@pytest.mark.parametrize(("hot", "grams"), [(256, 2_000_000), (1, 2_000_000), (256, 0), (1, 0)])
def test_removal_equals_brute_force(texts, hot, grams):
    docs = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(texts(enumerate(docs)), hot=hot, shipped_grams=grams).collect()}
    assert [got[i] for i in range(len(docs))] == brute([(t or "").encode() for t in docs], 100)


def test_index_marks_later_starts():
    rng = random.Random(2)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    origins, at = [], 0
    for c in contexts:
        origins.append(at)
        at += len(c) + 5
    marks, _ = RunLengthIndex(contexts, np.array(origins), 8).repeated()
    seen, want = set(), []
    for c in contexts:
        for s in range(len(c)):
            whole = s + 8 <= len(c)
            want.append(whole and c[s:s + 8] in seen)
            if whole:
                seen.add(c[s:s + 8])
    assert marks.tolist() == want


def test_every_string_holds_an_anchor():
    data = np.frombuffer(bytes(random.Random(1).choice(b"abc") for _ in range(2000)), np.uint8)
    at, _ = anchors(data)
    for s in range(len(data) - 99):
        assert ((at >= s) & (at <= s + 80)).any()


def test_odd_rows(odd):
    got = {r.doc_id: r for r in remove_repeats(odd).collect()}
    assert got[4].n_bytes == 150_000 and got[4].n_removed == 149_995 and got[4].n_spans == 1
    assert got[1].n_bytes == 0 and got[5].n_removed == 0
    assert remove_repeats(odd.limit(0)).count() == 0


def test_strings_over_an_anchor_hold_the_core_of_their_class():
    body = bytes(random.Random(3).choice(b"abcd") for _ in range(230))
    for at in (0, 5, 60, 81, 120, 199, 210):
        found = dict(cores(body, at, 100, 20))
        for s in range(max(0, at - 80), min(at, len(body) - 100) + 1):
            assert any(core in body[s:s + 100] and len(core) >= 79 for core in found.values())


@pytest.mark.parametrize(("hot", "grams"), [(256, 2_000_000), (1, 2_000_000), (256, 0), (1, 0)])
def test_equal_rows_are_one_document(texts, hot, grams):
    rng = random.Random(5)
    a, b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 180, 240, 150))
    # ids 1 and null stand on equal rows; parts of them come again elsewhere, with other text around
    rows = [(1, a + b), (1, a + b), (2, b + c), (2, b + c), (2, b + c), (3, d + a), (4, c[:120] + d), (None, b + d + c), (None, b + d + c), (5, a + b)]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0]))
    want = dict(zip(order, brute([t.encode() for _, t in order], 100), strict=True))
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in remove_repeats(texts(rows), hot=hot, shipped_grams=grams).collect()]
    assert len(got) == len(rows) and want[1, a + b][1] == 0
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted([(i, want[i, t]) for i, t in rows], key=key)


def test_suffixes_are_sorted_and_named_by_what_they_begin_with():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 300):
        text = rng.integers(0, 3, n).astype(np.int64)
        names, order = RunLengthIndex._sorted(text, 64)
        suffixes = [tuple(text[i:].tolist()) for i in range(n)]
        assert [suffixes[i] for i in order] == sorted(suffixes) and sorted(names) == [1, 2, 4, 8, 16, 32]
        for width, name in names.items():
            same = {}
            for i, s in enumerate(suffixes):
                same.setdefault(s[:width], set()).add(int(name[i]))
            assert all(len(v) == 1 for v in same.values()) and len(set().union(*same.values())) == len(same)


def test_later_strings_are_streamed_without_a_join(spark):
    from tariffloom.llm.suffixes import later_strings

    rows = [(k, d, 0, s) for k in range(40) for d in range(k % 5 + 1) for s in range(3)] + [(7, 0, 0, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = later_strings(spark.createDataFrame(rows, "key long, doc long, part long, start long"), 100)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((d, 0, s, s + 100) for k, d, _, s in rows[:-1] if (d, s) != (0, 0))
