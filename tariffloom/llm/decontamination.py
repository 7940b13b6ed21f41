"""Benchmark decontamination by q-gram filtering and banded alignment.

A benchmark item of ``m`` characters counts as leaked when some region of a document is within
``edits(m)`` edits of the whole item, both in lower case with white space collapsed.  By the q-gram
lemma such a region shares at least ``m - q + 1 - q * edits`` q-grams with the item, on diagonals
(document position minus item position) that lie within ``edits`` of each other.  Diagonals are cut
into bands that overlap by half, so that one band holds them all; bands with enough shared q-grams
are kept and checked by a banded alignment.

The benchmark is taken in blocks of bounded size, each shipped to all tasks; documents never
move, and what leaves a task is found leaks only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, table

Q = 10
EDIT_RATE = 0.08
#: characters of benchmark text shipped at a time
BLOCK_CHARS = 500_000
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with single spaces and none at the ends, and where each was."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    space = (codes == 32) | ((codes < 32) & (codes >= 9) & ((codes <= 13) | (codes >= 28)))
    if len(codes) and codes.max() > 127:
        space |= np.isin(codes, _SPACES)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    codes = np.where(space, 32, codes)[at]
    first, last = int(len(codes) > 0 and codes[0] == 32), len(codes) - int(len(codes) > 0 and codes[-1] == 32)
    return codes[first:last], at[first:last]


def gram_keys(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit key for every q-gram, by position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    values = codes.astype(np.uint64)
    for j in range(q):
        key *= np.uint64(_BASE)
        key += values[j:j + n]
    return key ^ (key >> np.uint64(31))


def edit_budget(m: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits allowed in an item of ``m`` characters: the rate, but so few that the lemma still filters."""
    return max(0, min(math.floor(rate * m), (m - q) // q))


def banded_distance(item: np.ndarray, region: np.ndarray, limit: int) -> tuple[int, int] | None:
    """Least edits between ``item`` and a stretch of ``region``, and where it ends; none above ``limit``.

    The stretch may begin at any of the first places and end anywhere; cells off the band are left
    out.  The band is as wide as the region is longer than the item, plus the limit on both sides.
    """
    m, n = len(item), len(region)
    width = max(n - m, 0) + 2 * limit + 1
    far = m + n + 1
    padded = np.concatenate([np.full(limit + 1, -1), region, np.full(width + m, -1)])
    column = np.arange(width)
    # row i, cell k stands for i item characters against the region up to i + k - limit
    real = lambda i: (column + i - limit >= 0) & (column + i - limit <= n)
    row = np.where(real(0), 0, far)
    for i in range(1, m + 1):
        diagonal = row + (padded[column + i] != item[i - 1])
        up = np.append(row[1:], far) + 1
        row = np.where(real(i), np.minimum(diagonal, up), far)
        row = np.minimum.accumulate(row - column) + column
        if row.min() > limit:
            return None
    best = int(row.argmin())
    return int(row[best]), best + m - limit


def exact_place(item: np.ndarray, region: np.ndarray) -> int:
    """Where ``item`` first stands unchanged in ``region``; -1 if nowhere."""
    small, large, at = item.astype("<u4").tobytes(), region.astype("<u4").tobytes(), -1
    while (at := large.find(small, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


class ItemBlock:
    """Q-grams of some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE):
        self.q = q
        self.ids, self.codes, keys, owners, places = [], [], [], [], []
        for item_id, text in items:
            codes, _ = normalized(text or "")
            if len(codes) < q:
                continue
            own = gram_keys(codes, q)
            keys.append(own)
            owners.append(np.full(len(own), len(self.ids)))
            places.append(np.arange(len(own)))
            self.ids.append(item_id)
            self.codes.append(codes)
        sizes = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([edit_budget(int(m), rate, q) for m in sizes], np.int64)
        self.least = np.maximum(1, sizes - q + 1 - q * self.edits)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.owner = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint64(42)] = True

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the best region for each leaked item."""
        codes, at = normalized(text)
        keys = gram_keys(codes, self.q)
        spots = np.flatnonzero(self.seen[keys >> np.uint64(42)]) if len(keys) else keys
        if not len(spots):
            return []
        slot = np.searchsorted(self.keys, keys[spots])
        slot[slot == len(self.keys)] = 0
        hit = self.keys[slot] == keys[spots]
        spots, slot = spots[hit], slot[hit]
        n = self.count[slot]
        entry = np.repeat(self.first[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.owner[entry]
        diagonal = np.repeat(spots, n) - self.place[entry]
        step = self.edits[item] + 1
        band = diagonal // step
        offset = 1 << 40
        both = np.concatenate([item * (4 * offset) + band + offset, item * (4 * offset) + band - 1 + offset])
        bands, counts = np.unique(both, return_counts=True)
        owner = bands // (4 * offset)
        enough = counts >= self.least[owner]
        found: dict[int, tuple[int, int, int]] = {}
        for i, b in zip(owner[enough].tolist(), (bands[enough] % (4 * offset) - offset).tolist(), strict=True):
            budget, m = int(self.edits[i]), len(self.codes[i])
            start = max(0, b * (budget + 1) - budget)
            region = codes[start:min(len(codes), (b + 2) * (budget + 1) + m + budget)]
            place = exact_place(self.codes[i], region)
            if place >= 0:
                best = (0, int(at[start + place]), int(at[start + place + m - 1]) + 1)
                found[i] = min(found.get(i, best), best)
                continue
            got = banded_distance(self.codes[i], region, budget)
            if got:
                edits, end = got
                # the alignment backwards from its end gives where it starts
                back = banded_distance(self.codes[i][::-1], region[:end][::-1], edits)
                begin = end - (back[1] if back and back[0] == edits else m)
                best = (edits, int(at[start + max(0, begin)]), int(at[start + end - 1]) + 1)
                found[i] = min(found.get(i, best), best)
        return [(self.ids[i], s, e, d) for i, (d, s, e) in sorted(found.items())]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``chars`` characters, one at a time on the driver."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(total / chars)
    for block in range(blocks):
        yield [(r["id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: the best region of every item that a document leaks.

    Positions are code points of the text as given.  Among equal regions the first counts.  Null
    and empty texts leak nothing; items without id or text, or of fewer than ``q`` characters,
    are not searched; repeated rows are reported each; an empty benchmark or table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, item_id long, start long, end long, edits long"

    def search(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = ItemBlock(items, q, rate)
            for batch in batches:
                rows = [(doc_id, *leak) for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) if text for leak in block.leaks(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"])

        return texts.mapInPandas(run, schema)

    found = [search(items) for items in item_blocks(benchmark, item_id_col, item_text_col, block_chars)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that leak no item; nothing but the verdict is added and dropped again."""
    bounded_batches(docs.sparkSession)

    def clean_of(items: list[tuple[int, str]]):
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            block = ItemBlock(items, q, rate)
            for texts in batches:
                yield pd.Series([not (t and block.leaks(t)) for t in texts], dtype=bool)

        return F.pandas_udf(clean, "boolean")

    for items in item_blocks(benchmark, item_id_col, item_text_col, block_chars):
        docs = docs.filter(clean_of(items)(F.col(text_col)))
    return docs


def op1_decontamination(spark, sf):
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
