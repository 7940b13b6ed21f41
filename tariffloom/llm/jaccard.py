"""Exact join of texts by the Jaccard similarity of their word n-gram sets.

A size-aware join in two halves:

* *light* sets (up to a size) enumerate their subsets of the size that any partner must share, and
  meet where they share one;
* *heavy* sets, and light ones that a heavy partner may have, are found through inverted lists.  A
  list is kept for a block of the set, not for a single n-gram: sets within the threshold differ in
  at most ``k`` elements, so of ``k + 1`` blocks (elements dealt by hash) one is equal.  Lists of
  single n-grams would be as long as a common phrase is frequent; block lists hold near copies only.

The size that parts light from heavy is the one with the least total cost under the sizes at hand.

Copies with equal sets are one node.  Linked sets are wanted as components, so pairs that are
already in one component need no test.  A set carries a parity sketch: each element flips one bit, so
two sketches differ in no more bits than the sets in elements, and pairs whose sketches differ in
more than a link allows are left out without a loss.  A round of star pairs (every member of a list
against one pivot) is tested first.  Then a list gives a *forest*: pairs that its sketches allow, but
only such as join what the list's earlier pairs did not, so a group of copies gives as many pairs as
sets and not their square.  When all pairs of a forest round are links, every pair that is left lies
in one component; otherwise forests are drawn in another order, and at last all remaining pairs of a
list that lie in different components are tested, so that no link is lost.  Elements and sets are
known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, cut_lineage, release, table
from tariffloom.llm.components import component_labels

WORDS, PERCENT = 3, 90
STAR_ROUNDS = 1
FOREST_ROUNDS = 2
#: list entries are dealt, sorted, and tested against others of their list; subsets mostly stand alone
SCAN_COST = 4
LARGEST_LIGHT = 48
#: sets in a tile of a family
TILE = 256
#: ids (eight bytes each) that may be broadcast; more are joined by shuffling
SHIPPED_IDS = 200_000
MEMO = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Texts to sorted arrays of the hashes of their distinct word n-grams."""

    def __init__(self, words: int):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know the ASCII letters and the six ASCII spaces only
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
        each = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = len(each) - self.words + 1
        h = each[:n].copy()
        for j in range(1, self.words):
            h = h * _A + each[j:j + n]
        return np.unique(_mixed(h))


def set_mark(elements: np.ndarray) -> int:
    """A 64-bit hash of a whole set, as a signed number."""
    total = _mixed(elements + _A).sum(keepdims=True, dtype=np.uint64) + np.array([len(elements)], np.uint64) * _B
    return int(_mixed(total).view(np.int64)[0])


def differences_allowed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Elements in which linked sets of these sizes may differ; below 0 if the sizes rule a link out."""
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return np.where(fits, (n + m) * (100 - percent) // (100 + percent), -1)


def parity_sketch(elements: np.ndarray, percent: int) -> bytes:
    """Bits flipped by the elements; 24 times as many bits as differences a link may have, or more."""
    need = max(64, 48 * len(elements) * (100 - percent) // (100 + percent))
    bits = 1 << (need - 1).bit_length()
    flips = np.bincount((_mixed(elements + _B) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, words: int) -> np.ndarray:
    """The sketch that a smaller number of 64-bit words would have given."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, "<u8").reshape(-1, words), axis=0)


class Scheme:
    """Sizes, blocks and subsets for a threshold in per cent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts, self.blocks = [1], []

    def largest_partner(self, n: int) -> int:
        return n * 100 // self.percent

    def smallest_partner(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def _grow(self, upto: int) -> None:
        while len(self.blocks) < upto + 1:
            low = self.starts[-1]
            high = self.largest_partner(low)  # sizes low..high; partners end in the next class
            differ = (high + self.largest_partner(high)) * (100 - self.percent) // (100 + self.percent)
            # some spare blocks, so that sets with the usual few empty blocks still share a full one
            empty = (differ + 1) * math.exp(-low / (differ + 1))
            self.blocks.append((differ + 1 + math.ceil(empty + 4 * math.sqrt(empty)), differ))
            self.starts.append(high + 1)

    def size_class(self, n: int) -> int:
        c = 0
        while True:
            self._grow(c)
            if n < self.starts[c + 1]:
                return c
            c += 1

    def list_classes(self, n: int, light: int) -> list[int]:
        """Classes whose lists a set of ``n`` elements enters."""
        c = self.size_class(n)
        if n > light:
            return [x for x in (c, c - 1) if x >= 0]
        return [c] if self.largest_partner(n) > light else []

    def shared(self, smaller: int) -> int:
        """Elements that a set and any larger partner share at least."""
        return -(-2 * smaller * self.percent // (100 + self.percent))

    def subset_sizes(self, n: int) -> list[int]:
        return sorted({self.shared(m) for m in range(self.smallest_partner(n), n + 1)} - {0})

    def light_limit(self, sizes: dict[int, int]) -> int:
        """The largest light size at the least cost over the given sizes (size -> sets)."""
        subsets = {n: sum(math.comb(n, s) for s in self.subset_sizes(n)) for n in sizes}
        lists = {n: SCAN_COST * sum(self.blocks[c][0] for c in self.list_classes(n, 0)) for n in sizes}
        cost = lambda b: sum(k * (subsets[n] if n <= b else lists[n]) for n, k in sizes.items())
        return min(range(LARGEST_LIGHT + 1), key=cost)

    def keys(self, elements: np.ndarray, light: int) -> np.ndarray:
        """The lists and subset meetings that the set enters, as 64-bit keys."""
        n, out = len(elements), []
        for c in self.list_classes(n, light):
            blocks, differ = self.blocks[c]
            if differ == 0:
                continue  # only equal sets, which are one node already
            block = elements % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            block = block[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            sums = np.add.reduceat(_mixed(elements[order] + _B), first)
            name = np.uint64((c + 1) << 32)
            out.append(_mixed(_mixed(sums) + _A * (block[first] + name)))
            if blocks - len(first) >= blocks - differ:  # so many empty blocks that only those may agree
                bare = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[first])
                out.append(_mixed(_A * (bare + name)))
        if n <= light:
            for size in self.subset_sizes(n):
                if size == n and self.smallest_partner(n) == n and self.largest_partner(n) == n:
                    continue
                chosen = np.array(list(combinations(range(n), size)))
                out.append(_mixed(_mixed(elements + _A)[chosen].sum(axis=1, dtype=np.uint64) + np.array([size], np.uint64) * _B))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, mark`` for every row of ``doc_id, text``; no mark without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": [len(s) for s in sets],
                                "mark": pd.array([set_mark(s) if len(s) else None for s in sets], "Int64")})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, mark long")


def list_entries(docs: DataFrame, words: int, percent: int, light: int) -> DataFrame:
    """``key, mark``: a set's lists, once for each different set of a task (or nearly so)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, scheme, seen = Shingler(words), Scheme(percent), set()
        for batch in batches:
            keys, marks = [], []
            for text in batch["text"]:
                elements = shingles(text)
                if not len(elements) or (mark := set_mark(elements)) in seen:
                    continue
                if len(seen) >= MEMO:
                    seen.clear()
                seen.add(mark)
                keys.append(scheme.keys(elements, light))
                marks.append(np.full(len(keys[-1]), mark))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "mark": np.concatenate(marks)})

    return docs.select("text").mapInPandas(run, "key long, mark long")


def shared_lists(entries: DataFrame) -> DataFrame:
    """The entries of lists that hold more than one set, each once; lists are streamed in key order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, joined = None, False  # the last entry, and whether its list has an earlier one
        for batch in batches:
            key, mark = batch["key"].to_numpy(), batch["mark"].to_numpy()
            if held is not None:
                key, mark = np.r_[held[0], key], np.r_[held[1], mark]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]
            key, mark = key[fresh], mark[fresh]
            like = key[1:] == key[:-1]
            shared = np.r_[joined if held is not None else False, like] | np.r_[like, False]
            out = slice(0, len(key) - 1)
            yield pd.DataFrame({"key": key[out][shared[out]], "mark": mark[out][shared[out]]})
            joined = bool(like[-1]) if len(like) else joined
            held = (key[-1:], mark[-1:])
        if held is not None and joined:
            yield pd.DataFrame({"key": held[0], "mark": held[1]})

    return entries.repartition("key").sortWithinPartitions("key", "mark").mapInPandas(run, "key long, mark long")


def star_pairs(lists: DataFrame, seed: int) -> DataFrame:
    """One pair ``a, b`` for each set ``b`` that shares a list with a pivot of another component.

    The pivot of a list is its first set in an order drawn by ``seed``.
    """
    order = F.xxhash64("mark", F.lit(seed))
    pivots = lists.groupBy("key").agg(F.min_by(F.struct("mark", "label"), order).alias("p"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = pivots.filter("low <> high").select("key", F.col("p.mark").alias("a"), F.col("p.label").alias("pivot_label"))
    met = lists.join(mixed, "key").filter("label <> pivot_label")
    return met.groupBy(F.col("mark").alias("b")).agg(F.min_by("a", F.xxhash64("a", F.lit(seed))).alias("a"))


def joined_by(pairs: list[tuple[int, int]], parts: np.ndarray) -> np.ndarray:
    """Which of the pairs of parts join two that earlier ones did not; ``parts`` (part -> its first one) follows."""

    def root(x: int) -> int:
        while parts[x] != x:
            parts[x] = x = parts[parts[x]]
        return x

    new = np.zeros(len(pairs), bool)
    for k, (x, y) in enumerate(pairs):
        x, y = root(x), root(y)
        if x != y:
            new[k], parts[max(x, y)] = True, min(x, y)
    while (parts[parts] != parts).any():
        parts[:] = parts[parts]
    return new


def likely_pairs(rows: pd.DataFrame, percent: int, forest: bool = False) -> Iterator[pd.DataFrame]:
    """Pairs of whole lists in different components whose sketches leave a link possible.

    ``forest``: of these only such as join parts of the list that no earlier pair of it joins.
    """
    key, sketch = rows["key"].to_numpy(), rows["sketch"].to_numpy()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    words = np.repeat(np.minimum.reduceat([len(x) // 8 for x in sketch], first), size)
    rank = np.arange(len(key)) - np.repeat(first, size)
    list_no = np.repeat(np.arange(len(first)), size)
    for width in np.unique(words).tolist():
        at = np.flatnonzero(words == width)  # whole lists, in order
        bits = np.stack([folded(sketch[i], width) for i in at])
        mark, label, n = (rows[c].to_numpy()[at] for c in ("mark", "label", "n"))
        own, lists = rank[at], list_no[at]
        # a part is a component's share of a list
        part = pd.DataFrame({"list": lists, "label": label}).groupby(["list", "label"], sort=False).ngroup().to_numpy()
        parts = np.arange(int(part.max()) + 1)
        several = np.ones(len(first), bool)
        for step in range(1, int(own.max()) + 1):
            later = np.flatnonzero((own >= step) & several[lists])
            if not len(later):
                break
            for cut in range(0, len(later), 50_000):
                i = later[cut:cut + 50_000]
                j = i - step
                apart = parts[part[i]] != parts[part[j]]
                i, j = i[apart], j[apart]
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                fit = differ <= differences_allowed(n[i], n[j], percent)
                i, j = i[fit], j[fit]
                if forest and len(i):
                    new = joined_by(list(zip(part[i].tolist(), part[j].tolist(), strict=True)), parts)
                    i, j = i[new], j[new]
                if len(i):
                    a, b = mark[i], mark[j]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            if forest and step & (step - 1) == 0:  # now and then leave out lists that are one part by now
                roots = parts[part]
                low, high = np.full(len(first), len(parts)), np.full(len(first), -1)
                np.minimum.at(low, lists, roots)
                np.maximum.at(high, lists, roots)
                several = low < high


def open_pairs(lists: DataFrame, sets: DataFrame, percent: int, forest: bool = False, seed: int = 0) -> DataFrame:
    """Pairs of sets that share a list, are in different components and may be linked: all of them, or a
    forest for each list, its sets taken in an order drawn by ``seed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = rows["key"].to_numpy()
            done = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and key[0] != key[-1] else 0
            if done:
                yield from likely_pairs(rows[:done], percent, forest)
            held = rows[done:]
        if held is not None and len(held):
            yield from likely_pairs(held.reset_index(drop=True), percent, forest)

    mixed = lists.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    told = lists.join(mixed, "key").join(sets.select("mark", "n", "sketch"), "mark")
    dealt = told.repartition("key").sortWithinPartitions("key", F.xxhash64("mark", F.lit(seed)))
    return dealt.mapInPandas(run, "a long, b long").distinct()


def by_ids(docs: DataFrame, ids: DataFrame, column: str, how: str, shipped: int = SHIPPED_IDS) -> DataFrame:
    """Semi or anti join by an id table, which is broadcast only when it is counted small enough."""
    return docs.join(F.broadcast(ids) if ids.count() <= shipped else ids, column, how)


def possible_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave a link possible."""

    def possible(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for left, right, n, m in batches:
            allowed = differences_allowed(n.to_numpy(), m.to_numpy(), percent)
            out = np.zeros(len(left), bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                words = min(len(x), len(y)) // 8
                out[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum() <= allowed[i]
            yield pd.Series(out)

    side = lambda end: sets.select(F.col("mark").alias(end), *[F.col(c).alias(c + end) for c in ("n", "sketch")])
    told = pairs.join(side("a"), "a").join(side("b"), "b")
    return told.filter(F.pandas_udf(possible, "boolean")("sketcha", "sketchb", "na", "nb")).select("a", "b")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold, by counting shared elements.

    A set in many pairs is not sent once for each: sets are put into families by the smallest name
    within two steps, families into tiles of bounded size, and a task gets two tiles and the pairs
    between them.  Families only say what travels together; any would give the same pairs.
    """
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("near"))
    far = both.join(near.select(F.col("a").alias("b"), "near"), "b").groupBy("a").agg(F.min("near").alias("family"))
    sizes = far.groupBy("family").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    tiles = cut_lineage(far.join(sizes, "family").select(F.col("a").alias("mark"), F.xxhash64("family", F.pmod(F.xxhash64("a"), "tiles")).alias("tile")))
    cells = max(1, tiles.count() // TILE)
    of = lambda end: tiles.select(F.col("mark").alias(end), F.col("tile").alias("tile" + end))
    cell = F.pmod(F.xxhash64(F.least("tilea", "tileb"), F.greatest("tilea", "tileb")), F.lit(cells)).alias("cell")
    placed = cut_lineage(pairs.join(of("a"), "a").join(of("b"), "b").select(cell, "a", "b"))
    members = placed.select(F.col("cell").alias("home"), F.explode(F.array("a", "b")).alias("mark")).distinct().join(sets.select("mark", "elements"), "mark")

    def reached(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        elements = {m: np.frombuffer(e, "<u8") for m, e in zip(own["mark"].tolist(), own["elements"], strict=True)}
        out = []
        for a, b in zip(asked["a"].tolist(), asked["b"].tolist(), strict=True):
            x, y = elements[a], elements[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return members.groupBy("home").cogroup(placed.groupBy("cell")).applyInPandas(reached, "a long, b long")


def set_components(docs: DataFrame, nodes: DataFrame, words: int, percent: int, rounds: int = STAR_ROUNDS,
                   forests: int = FOREST_ROUNDS) -> DataFrame | None:
    """``node, label`` of the sets that have links; None if there are no candidates."""
    scheme = Scheme(percent)
    sizes = {r["n"]: r["count"] for r in nodes.filter(f"n between 1 and {LARGEST_LIGHT}").groupBy("n").count().collect()}
    light = scheme.light_limit(sizes)
    lists = cut_lineage(shared_lists(list_entries(docs, words, percent, light)))
    candidates = lists.select("mark").distinct()
    wanted = cut_lineage(nodes.filter("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("doc_id")).join(candidates, "mark", "left_semi"))

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        for batch in batches:
            own = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({"mark": [set_mark(s) if len(s) else 0 for s in own], "n": [len(s) for s in own],
                                "elements": [s.astype("<u8").tobytes() for s in own], "sketch": [parity_sketch(s, percent) for s in own]})

    texts = by_ids(docs.select("doc_id", "text").filter("text is not null"), wanted.select("doc_id"), "doc_id", "left_semi")
    read = texts.mapInPandas(elements, "mark long, n long, elements binary, sketch binary").filter("n > 0")
    sets = cut_lineage(read.dropDuplicates(["mark"]).join(candidates, "mark", "left_semi"))

    links, tested, labels = None, None, None
    last = rounds + forests
    for seed in range(last + 1):
        here = lists.withColumn("label", F.col("mark")) if labels is None else (
            lists.join(labels.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark")))
        pairs = star_pairs(here, seed) if seed < rounds else open_pairs(here, sets, percent, seed < last, seed)
        pairs = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        asked = pairs.count()
        pairs = pairs if tested is None else cut_lineage(pairs.join(tested, ["a", "b"], "left_anti"))
        joined = 0
        if pairs.limit(1).count():
            tested = pairs if tested is None else tested.unionAll(pairs)
            likely = cut_lineage(possible_pairs(pairs, sets, percent)) if seed < rounds else pairs
            found = cut_lineage(linked_pairs(likely, sets, percent))
            joined = found.count()
            if joined:
                links = found if links is None else links.unionAll(found)
                labels = component_labels(links)
            release(docs.sparkSession)
        if seed >= rounds and joined == asked:
            break  # every pair that sketches allow is joined by links now
    return labels


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Null, empty and wordless texts have no set and no links; rows without an id are counted but
    not linked, and their component is null; equal rows are in one component; an empty table gives
    an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(document_sets(own, words))
    with_id = own.filter("doc_id is not null")
    nodes = rows.filter("doc_id is not null")
    labels = set_components(with_id, nodes, words, percent)
    first = nodes.filter("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("first"))
    if labels is not None:
        named = first.join(labels.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
        named = cut_lineage(named)
        low = named.groupBy("label").agg(F.min("first").alias("first"))
        first = named.select("mark", "label").join(low, "label").select("mark", "first")
    return rows.join(first, "mark", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``docs`` without those whose component holds a smaller id; rows without id stay."""
    others = cut_lineage(jaccard_components(docs, words, percent).filter("component_id < doc_id").select("doc_id").distinct())
    return by_ids(docs, others, "doc_id", "left_anti").select(*docs.columns)


def op3_jaccard_join(spark, sf):
    return jaccard_components(table(spark, sf, "documents"))
