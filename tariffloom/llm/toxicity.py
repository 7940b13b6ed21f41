"""Toxicity of texts after undoing leetspeak, spacing and repetition.

A noisy channel writes letters as look-alike signs, spreads a word over single characters or
repeats letters.  For every token that the channel can have changed, a lattice of the readings is
decoded by Viterbi under a letter trigram model counted over all documents.  The restored words
are then scored: a word counts as evidence when the training rows show it in toxic texts beyond
what chance gives any of so many words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, cut_lineage, table
from tariffloom.llm.letters import SPACE, gram_hash, letter_stream, slices

#: fixed values: signs that stand for letters
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou",
}
SIGNS = re.escape("".join(LOOK_ALIKE))
TOKEN = re.compile(rf"[\w{SIGNS}]*[^\W\d_][\w{SIGNS}]*")
TRAILING = re.compile(rf"^[*(]+|[{re.escape('@$!|+€(*')}]+$")
RUN = re.compile(r"([^\W\d_])\1\1+")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ ._*\-]{1,2}[^\W_]){2,}(?![^\W_])")

TRI_BITS, BI_BITS = 18, 16
#: channel: a sign stands for a letter, a sign is meant, a spacing is undone or kept
AS_LETTER, AS_SIGN, JOIN, KEEP = math.log(0.5), math.log(0.5), math.log(0.9), math.log(0.1)
UNSEEN = math.log(1e-4)
BACKOFF = 20.0

#: bound on the labelled rows that the word weights are fitted on
TRAIN_ROWS = 20_000
MEMO = 400_000


class LetterModel:
    """log p(letter | two before), from hashed counts of bounded size."""

    def __init__(self, three: np.ndarray, two: np.ndarray):
        self.three, self.two, self.memo = three, two, {}

    def __call__(self, a: str, b: str, c: str) -> float:
        got = self.memo.get((a, b, c))
        if got is None:
            if c != " " and not c.isalpha():
                got = UNSEEN
            else:
                codes = [np.array([SPACE if not x.isalpha() else ord(x)]) for x in (a, b, c)]
                n3 = self.three[gram_hash(*codes, bits=TRI_BITS)[0]]
                n2 = self.two[gram_hash(*codes[:2], bits=BI_BITS)[0]]
                got = math.log((n3 + BACKOFF / 200) / (n2 + BACKOFF))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[a, b, c] = got
        return got


def letter_model(docs: DataFrame, text_col: str = "text") -> LetterModel:
    """Letter trigrams and their contexts, counted over the whole texts of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        three, two = np.zeros(1 << TRI_BITS, np.int64), np.zeros(1 << BI_BITS, np.int64)
        for batch in batches:
            for texts in slices([t or "" for t in batch["text"]]):
                codes, owner = letter_stream(texts)
                ok = owner[2:] == owner[:-2]
                three += np.bincount(gram_hash(codes[:-2], codes[1:-1], codes[2:], bits=TRI_BITS)[ok], minlength=1 << TRI_BITS)
                two += np.bincount(gram_hash(codes[:-2], codes[1:-1], bits=BI_BITS)[ok], minlength=1 << BI_BITS)
        for kind, n in ((3, three), (2, two)):
            at = np.flatnonzero(n)
            yield pd.DataFrame({"kind": kind, "gram": at, "n": n[at]})

    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "kind int, gram long, n long")
    got = counts.groupBy("kind", "gram").agg(F.sum("n").alias("n")).toPandas()
    model = {kind: np.zeros(1 << bits, np.int64) for kind, bits in ((3, TRI_BITS), (2, BI_BITS))}
    for kind, n in model.items():
        own = got[got["kind"] == kind]
        n[own["gram"].to_numpy()] = own["n"].to_numpy()
    return LetterModel(model[3], model[2])


def lattice(text: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """For every place the readings and their channel log probabilities."""
    places, at = [], 0
    while at < len(text):
        c = text[at]
        run = 1
        while at + run < len(text) and text[at + run] == c and c.isalpha():
            run += 1
        if run >= 3:
            places.append([(c, math.log(0.5)), (c + c, math.log(0.5))])
        elif c in LOOK_ALIKE:
            letters = LOOK_ALIKE[c]
            places.append([(x, AS_LETTER - math.log(len(letters))) for x in letters] + [(c, AS_SIGN)])
        elif spaced and not c.isalnum():
            places.append([("", JOIN), (" ", KEEP)])
        else:
            places += [[(c, 0.0)]] * run
        at += run
    return places


def viterbi(text: str, model, spaced: bool = False) -> str:
    """The likeliest reading; ties go to the first reading in lattice order."""
    best: dict[tuple[str, str], tuple[float, tuple]] = {(" ", " "): (0.0, ())}
    for options in [*lattice(text, spaced), [(" ", 0.0)]]:
        step: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for out, channel in options:
                s, x, y = score + channel, a, b
                for c in out:
                    s += model(x, y, c)
                    x, y = y, c
                if (x, y) not in step or s > step[x, y][0]:
                    step[x, y] = (s, (path, out))
        best = step
    path = max(best.values(), key=lambda v: v[0])[1]
    parts = []
    while path:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts)).strip()


class Restorer(dict):
    """Token -> restored word, decoded once."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> str:
        word = TRAILING.sub("", token)
        if RUN.search(word) or not word.isalpha() and any(c in LOOK_ALIKE for c in word):
            word = viterbi(word, self.model)
        if len(self) >= MEMO:
            self.clear()
        self[token] = word
        return word

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        low = text.lower()
        found = set(map(self.__getitem__, set(TOKEN.findall(low))))
        for m in SPACED.finditer(low):
            found.update(viterbi(m[0], self.model, spaced=True).split(" "))
        return found


def restore_text(text: str, model) -> str:
    """The text as it is scored, for reading."""
    own = Restorer(model)
    joined = SPACED.sub(lambda m: viterbi(m[0], model, spaced=True), text.lower())
    return TOKEN.sub(lambda m: own[m[0]], joined)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, one for each different text.

    Both joins broadcast a table of at most ``rows`` short rows.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    each = marked.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("toxic").alias("toxic"))
    chosen = cut_lineage(each.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).alias("toxic")))
    return marked.join(F.broadcast(chosen), ["doc_id", "mark"]).select("toxic", "text")


def word_weights(train: DataFrame, model) -> tuple[dict[str, float], float]:
    """Log odds of the words that stand out in toxic texts, and the log odds before any word.

    A word stands out when most texts with it are toxic and the likelihood ratio against chance
    passes ``2 log V`` for ``V`` words.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = Restorer(model), {False: Counter(), True: Counter()}
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                seen[bool(toxic)].update([*own.words(text or ""), ""])
        words = list(seen[False] | seen[True])
        yield pd.DataFrame({"word": pd.Series(words, dtype=object), "clean": [seen[False][w] for w in words], "toxic": [seen[True][w] for w in words]})

    counts = train.mapInPandas(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = cut_lineage(counts.filter(F.col("clean") + F.col("toxic") > 1))
    total = counts.filter("word = ''").first()
    if not total or not total["toxic"] or not total["clean"]:
        return {}, math.log(((total["toxic"] if total else 0) + 0.5) / ((total["clean"] if total else 0) + 0.5)) if total else -1.0
    clean, toxic, words = total["clean"], total["toxic"], max(2, counts.count())
    a, b, base = F.col("toxic"), F.col("clean"), toxic / (toxic + clean)
    gain = 2 * (F.when(a > 0, a * F.log(a / ((a + b) * base))).otherwise(0) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0))
    strong = counts.filter((F.col("word") != "") & (a > b) & (gain > 2 * math.log(words)))
    weights = {r["word"]: math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1)) for r in strong.collect()}
    return weights, math.log(toxic / clean)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, score_col: str = "score",
                   predicted_col: str = "predicted") -> DataFrame:
    """The rows of ``docs`` with a score and a prediction; columns of those names are overwritten.

    Only ``text`` is scored; null and empty texts get the score of a text without evidence.
    Labels that are null or not 0 or 1, or have no id, are left out; several labels of one id count
    as toxic if one is.  Without labels of both kinds no text is called toxic unless most labels
    are.  Repeated rows are scored alike; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = letter_model(docs)
    weights, prior = word_weights(training_rows(docs, labels.select("doc_id", "toxic"), train_rows), model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Restorer(model)
        for texts in batches:
            odds = np.array([prior + math.fsum(weights[w] for w in own.words(t or "") if w in weights) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    scored = docs.withColumn(score_col, F.pandas_udf(score, "double")(F.col("text")))
    return scored.withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    return score_toxicity(docs, labels, train_rows, "__score", "__predicted").filter("__predicted = 0").select(*docs.columns)


def op8_toxicity(spark, sf):
    scored = score_toxicity(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
