"""Language identification as a mixture of languages.

Letter trigrams of all labelled training rows are counted by language.  A document is taken as a
mixture: expectation-maximisation estimates the share of each language from the trigram
likelihoods, and of the nested sets of its strongest languages the one with the best penalised
likelihood is kept.  The prediction is the language with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, table
from tariffloom.llm.letters import trigrams

BITS = 16
SMOOTHING = 0.1
EM_STEPS = 12
REFIT_STEPS = 4
#: a letter is in three trigrams, so their likelihood counts a third
OVERLAP = 3.0
MAX_LANGUAGES = 512
CELLS = 4_000_000
UNKNOWN = "und"


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``lang, text``; one partial row per gram and task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            parts = [pd.DataFrame({"lang": lang, "gram": np.flatnonzero(n), "n": n[np.flatnonzero(n)]}) for lang, n in sorted(seen.items())]
            return pd.concat(parts) if parts else pd.DataFrame({"lang": pd.Series(dtype=object), "gram": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                gram, _ = trigrams(list(texts), BITS)
                if lang not in seen:
                    if len(seen) >= 32:
                        yield rows()
                        seen.clear()
                    seen[lang] = np.zeros(1 << BITS, np.int64)
                seen[lang] += np.bincount(gram, minlength=1 << BITS)
        yield rows()

    return docs.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Language names in order, and log likelihoods by language and trigram bucket.

    The model has 65,536 buckets a language whatever the corpus; more than ``max_languages``
    languages are refused, since the model is shipped to every task.
    """
    counts = trigram_counts(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    got = counts.limit(max_languages * (1 << BITS) + 1).toPandas()
    names = sorted(got["lang"].unique())
    if len(names) > max_languages:
        raise ValueError(f"{len(names)} languages; the bound is {max_languages}")
    n = np.zeros((len(names), 1 << BITS))
    n[[names.index(x) for x in got["lang"]] if len(names) < 2 else np.searchsorted(names, got["lang"].to_numpy(str)), got["gram"].to_numpy()] = got["n"]
    p = (n + SMOOTHING) / (n.sum(1, keepdims=True) + SMOOTHING * (1 << BITS))
    return names, p.astype(np.float32)


def _em(p: np.ndarray, count: np.ndarray, owner: np.ndarray, starts: np.ndarray, size: np.ndarray, share: np.ndarray, steps: int):
    """Shares after ``steps`` of expectation-maximisation, and the log likelihood by text."""
    for _ in range(steps):
        joint = p * share[:, owner]
        joint *= count / joint.sum(0)
        share = np.add.reduceat(joint, starts, axis=1) / size
    mix = np.einsum("lt,lt->t", p, share[:, owner])
    return share, np.add.reduceat(count * np.log(np.maximum(mix, 1e-30)), starts)


def mixtures(texts: list[str], p_gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (languages x texts) within the selected set, and which texts have letters."""
    langs, n = len(p_gram), len(texts)
    gram, owner = trigrams(texts, BITS)
    key, count = np.unique(owner << BITS | gram, return_counts=True)
    owner, gram = key >> BITS, key & ((1 << BITS) - 1)
    has = np.zeros(n, bool)
    has[owner] = True
    best = np.zeros((langs, n))
    if not len(owner):
        return best, has
    owner = (np.cumsum(has) - 1)[owner]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = count.astype(np.float32)
    size = np.add.reduceat(count, starts)
    p = p_gram[:, gram]
    share, whole = _em(p, count, owner, starts, size, np.full((langs, len(starts)), 1 / langs, np.float32), EM_STEPS)
    order = np.argsort(-share, axis=0, kind="stable")
    rank = np.argsort(order, axis=0, kind="stable")
    chosen, top = share, np.full(len(starts), -np.inf)
    for k in range(1, langs + 1):
        part = np.where(rank < k, np.maximum(share, 1e-6), 0).astype(np.float32)
        part, like = _em(p, count, owner, starts, size, part / part.sum(0), REFIT_STEPS if 1 < k < langs else 0)
        value = like / OVERLAP - 0.5 * (k - 1) * np.log(size)
        better = value > top + 1e-9
        chosen, top = np.where(better, part, chosen), np.where(better, value, top)
        if k > 1 and not better.any():
            break
    best[:, has] = chosen
    return best, has


def identify(docs: DataFrame, names: list[str], p_gram: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred``, ``score`` and ``langs`` (the selected set, largest share first)."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = ["" if t is None else t for t in series]
            rows = [(UNKNOWN, 0.0, "")] * len(texts)
            at = 0
            while at < len(texts) and names:
                to, chars = at + 1, len(texts[at])
                while to < len(texts) and (chars + len(texts[to])) * len(names) <= CELLS:
                    chars += len(texts[to])
                    to += 1
                shares, has = mixtures(texts[at:to], p_gram)
                for i in np.flatnonzero(has):
                    order = np.argsort(-shares[:, i], kind="stable")
                    own = [names[k] for k in order if shares[k, i] > 0.01]
                    rows[at + i] = (names[order[0]], float(min(1.0, shares[order[0], i])), ",".join(own))
                at = to
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "langs"])

    udf = F.pandas_udf(predict, "lang_pred string, score double, langs string")
    return docs.withColumn("__p", udf(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "langs")], "__p.*")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Id, whether the row was held out, the predicted language, its share, and the language set.

    Training rows are those with a language, a text and an id outside the held-out fold.  A null
    text and a text without letters get ``und`` and 0, as does everything when nothing can be
    learned; equal shares go to the first name; repeated rows are treated alike; other columns
    are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    train = rows.filter(F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text")
    names, p_gram = learn(train)
    return identify(rows.select("doc_id", held_out().alias("held_out"), "text"), names, p_gram).drop("text")


def op10_language_id(spark, sf):
    return identify_languages(table(spark, sf, "documents"))
