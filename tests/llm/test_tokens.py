"""Token counts against the tokenizer's own encoding of whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from tariffloom.llm.tokens import VOCABULARY, count_tokens, op7_token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(VOCABULARY)


def plain(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op7_token_counts(spark, sf).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    for i, text in texts.items():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)


def test_strange_texts(texts):
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>x", "don't", "we'll", "ÀÉ", "é", "J̌", "Ω", "İstanbul", " ", "　", "\x1c", "\u0085",
             "日本語", "\U0001f600", "123", "a1b2", "…", " ", "\n", "\t", "ΣΑΣ", "​", "word", ",", "\x00", "'s"]
    rows = list(enumerate("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)))
    for shards in (1, 7):
        got = {r.doc_id: r.n_tokens for r in count_tokens(texts(rows), PATH, shards=shards).collect()}
        assert got == {i: plain(t) for i, t in rows}


def test_frequent_words_and_large_counts(texts):
    rows = [(i, "the " * n + f"w{i}") for i, n in enumerate((70_000, 3, 500, 1))]
    got = {r.doc_id: r.n_tokens for r in count_tokens(texts(rows), PATH).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_odd_rows(odd):
    got = count_tokens(odd, PATH).collect()
    assert len(got) == 8 and sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert count_tokens(odd.limit(0), PATH).count() == 0
