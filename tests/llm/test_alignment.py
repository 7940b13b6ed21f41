"""Tokens, groups and link counts against plain loops over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tariffloom.llm import alignment as al

PATHS = public_tokenizers.path(al.FIRST), public_tokenizers.path(al.SECOND)
SIGNS = [*"ab c\n\t  é😀Z.'s<|▁　\xa0᠎漢1\x00\x1c\r", "<|endoftext|>", "<s>", "<0x0A>", " the", " '", "̈", "가나다", "🇰🇷", " word", " over"]


@pytest.fixture(scope="module")
def both():
    return al.vocabularies(*PATHS)


def plain_groups(both, text):
    """Groups of a whole text by decoded bytes only; None if a tokenizer does not give it back."""
    first, second = both
    full = (" " + (text or "")).encode()
    a = first.tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
    b = second.model.encode(text or "")
    parts = [[first.entries[i] for i in a], [second.entries[i] for i in b]]
    if not text or any(b"".join(p) != full for p in parts):
        return None
    a_ends, b_ends = (np.cumsum([len(x) for x in p]).tolist() for p in parts)
    out, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        group = ([], [])
        while i < len(a) and a_ends[i] <= cut:
            group[0].append(a[i])
            i += 1
        while j < len(b) and b_ends[j] <= cut:
            group[1].append(b[j])
            j += 1
        out.append(group)
    return out


def expected(both, rows):
    groups = [plain_groups(both, t) for _, t in rows]
    links = [Counter((a, b) for x, y in g or () for a in x for b in y) for g in groups]
    held = Counter(pair for own in links for pair in own)
    highest = Counter()
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    out = []
    for (i, _), g, own in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or ())
        out.append((i, sum(len(x) for x, _ in g or ()), sum(len(y) for _, y in g or ()), len(g or ()), sum(own.values()),
                    sum(n for p, n in own.items() if held[p] == highest[p[0]]), sum(n * held[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(*[f.split()[0] for f in al.DIGEST.split(", ")]).collect()), key=str)


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randint(1, 30))) for _ in range(n)]


def test_words_align_as_whole_texts(both):
    fit = 0
    for text in random_texts(4000, 1):
        words = al.split_words(text)
        distinct = list(dict.fromkeys(words))
        known = al.Words(distinct, *both)
        at = [distinct.index(w) for w in words]
        got = ";".join(known.groups[i] for i in at) if known.fits[at].all() else None
        want = plain_groups(both, text)
        fit += want is not None
        assert got == (want and ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want))
    assert fit > 2000


def test_spans_are_refined_to_decoded_bytes(both):
    first, second = both
    for text in ["😀 é漢字 \x00\n", "🇰🇷🇰🇷", "plain text", "ü\n\n\tx"]:
        for tokenizer in both:
            ids, ends = tokenizer.encode(text)
            assert ends.tolist() == np.cumsum(tokenizer.sizes[ids]).tolist()
    assert first.coarse.any() and second.coarse.any()


@pytest.mark.parametrize("chunk", [al.CHUNK_CHARS, 300])
def test_counts_equal_plain_loops(spark, both, chunk):
    rows = [(n % 150, t) for n, t in enumerate(random_texts(200, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(al.align(df, *PATHS, chunk_chars=chunk)) == expected(both, rows)


def test_odd_tables(spark, both, odd, texts):
    from conftest import ODD

    assert found(al.align(odd, *PATHS)) == expected(both, ODD)
    assert found(al.align(texts(ODD).limit(0), *PATHS)) == []


def test_groups_as_text(spark, both):
    rows = [(1, "Hello wörld"), (2, "a▁b"), (3, None)]
    got = {r["doc_id"]: r for r in al.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS, groups=True).collect()}
    assert hashlib.sha256(got[1]["groups"].encode()).hexdigest() == got[1]["groups_sha256"] and got[1]["groups"].count(";") == got[1]["n_groups"] - 1
    assert got[2]["groups"] == got[3]["groups"] == got[2]["groups_sha256"] == "" and got[2]["n_a"] == got[2]["count_sum"] == 0


def test_known_words_are_those_aligned_anew(both, monkeypatch):
    rng = random.Random(6)
    words = list(dict.fromkeys(w for t in random_texts(300, 5) for w in al.split_words(t)))
    monkeypatch.setattr(al, "MEMO", 150)
    memo = al.Known(*both)
    for _ in range(12):
        some = rng.sample(words, 60) if rng.random() < 0.7 else rng.sample(words, 200)
        got, want = memo.of(some), al.Words(some, *both)
        assert got.groups == want.groups and got.pairs.tolist() == want.pairs.tolist() and got.links_before.tolist() == want.links_before.tolist()
        assert [got.fits.tolist(), got.n_a.tolist(), got.n_b.tolist()] == [want.fits.tolist(), want.n_a.tolist(), want.n_b.tolist()]
