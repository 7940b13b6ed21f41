"""Toxicity and language: decoding by brute force, held-out accuracy, odd rows."""

import itertools
import math
from zlib import crc32

import numpy as np
import pytest

from tariffloom.llm import language, toxicity
from tariffloom.llm.letters import trigrams

SF = "/root/testdata/sf0.01"


def test_viterbi_equals_all_readings():
    model = lambda a, b, c: math.log(0.5 + 0.001 * ((ord(a) * 7 + ord(b) * 3 + ord(c)) % 400))
    for text, spaced in (("id10t", False), ("looool5", False), ("$7up1d", False), ("i d.1 o t", True), ("a", False)):
        best, want = -math.inf, ""
        for reading in itertools.product(*toxicity.lattice(text, spaced)):
            out = "".join(o for o, _ in reading) + " "
            score, a, b = sum(c for _, c in reading), " ", " "
            for c in out:
                score += model(a, b, c)
                a, b = b, c
            if score > best + 1e-12:
                best, want = score, out.strip()
        assert toxicity.viterbi(text, model, spaced) == want


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.letter_model(docs)
    return model, *toxicity.word_weights(toxicity.training_rows(docs, labels), model)


def test_written_forms_are_restored(trained):
    model, weights, prior = trained
    assert {"idiot", "trash", "clown"} <= set(weights)
    own = toxicity.Restorer(model)
    for text in ("thing 1d10t here", "thing !diot here", "thing tra$h here", "thing clooown here", "thing t r a s h here", "thing c.l.o.w.n here"):
        assert any(w in weights for w in own.words(text)), toxicity.restore_text(text, model)
    for text in ("in 2024 there", "for 3 of the", "thing heer!", "le 10 et la"):
        assert not any(w in weights for w in own.words(text)), text


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.op8_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in own]) > 0.93
    assert all(a for a, b in own if b)


def test_toxicity_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1), (4, 7)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == 8 and len({r.score for r in got}) == 1
    assert toxicity.score_toxicity(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0


def test_trigrams_stay_within_their_text():
    both, owner = trigrams(["Ab cd", "", "é"], 16)
    one, _ = trigrams(["ab, CD!"], 16)
    assert both[owner == 0].tolist() == one.tolist() and (owner == 1).sum() == 0 and (owner == 2).sum() == 1


def test_mixture_shares_add_up():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(1 << language.BITS, 0.01), 3).astype(np.float32) + 1e-9
    shares, has = language.mixtures(["some words here", "", "x" * 50, "12 34"], p)
    assert has.tolist() == [True, False, True, False]
    assert np.allclose(shares.sum(0), [1, 0, 1, 0], atol=1e-4)


def test_language_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language.op10_language_id(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_a_mixed_text_has_two_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, p = language.learn(docs.select("lang", "text"))
    en, de = (docs.filter(f"lang = '{x}' and length(text) > 3000").first().text[:1500] for x in ("en", "de"))
    got = language.identify(spark.createDataFrame([(en + " " + de,)], "text string"), names, p).first()
    assert set(got.langs.split(",")) == {"en", "de"} and 0.3 < got.score < 0.7


def test_language_odd_rows(odd, spark):
    got = {r.doc_id: r for r in language.identify_languages(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert language.identify_languages(odd.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify_languages(unlabelled).first().lang_pred == "und"


def test_the_letter_model_takes_a_batch_in_slices():
    from tariffloom.llm.letters import slices

    texts = ["a" * 40, "", "b" * 70, "c" * 500, "d" * 30, "e" * 30, "f" * 50]
    parts = list(slices(texts, 100))
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(map(len, p)) <= 100 for p in parts) and list(slices([], 100)) == []
