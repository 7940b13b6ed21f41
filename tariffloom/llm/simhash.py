"""SimHash fingerprints and the groups of documents whose fingerprints differ in few bits.

Fingerprints are compared once each, however many documents share one.  Their 64 bits are dealt
into groups of bits that go together in these fingerprints (correlated bits in one group leave the
other groups more even).  Two fingerprints within ``distance`` bits of each other are, in at least
one group, within that group's threshold, as long as the thresholds add up to ``distance`` less
the number of groups plus one; minus one leaves a group out (the general pigeonhole principle).
Each fingerprint gets its own thresholds by dynamic programming over the number of candidates that
a group and threshold would bring, which histograms of all fingerprints tell.

A fingerprint lies in one cell for each group and visits the cells within its thresholds.  The
cells of a very common value are divided by pigeonhole once more over the other bits, and what is
still large is cut into tiles.  A task compares the visitors of a cell with those that lie there
and sends a spanning forest of the links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, table, written
from tariffloom.llm.components import component_labels

WORDS, DISTANCE, SEED = 4, 4, 42
GROUPS, WIDTH = 4, 16
#: a visit costs as much as so many comparisons
VISIT = 50
#: a cell with more fingerprints is divided by the other bits
HOT_CELL = 4096
#: a divided cell with more rows is cut into tiles
TILE = 200_000
#: comparisons that a task holds at a time
PAIRS = 2_000_000
BATCH = 200_000
#: fingerprints that more than this part of all rows share are joined by broadcast
OFTEN = 1000

U64 = np.uint64


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: str | None, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, repeats included, some at a time."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(own) <= words:
        yield np.array([digest(b" ".join(own))], U64)
        return
    for at in range(0, len(own) - words + 1, 65_536):
        part = own[at:at + 65_536 + words - 1]
        rows = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        yield np.fromiter(map(digest, rows), U64, len(part) - words + 1)


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number; a bit is set if it is set in over half of the hashes."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words):
        total += len(hashes)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row its id and ``print`` (the fingerprint as a signed number); a text without words has zero."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint_of(t.as_py(), words) for t in batch.column(1)], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], ["doc_id", "print"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, print long")


# ---------------------------------------------------------------- groups of bits and thresholds

def picker(bits: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gathers ``bits`` of unsigned numbers into one small number, a byte at a time."""
    tables = []
    for byte in range(8):
        place = [(k, bit - 8 * byte) for k, bit in enumerate(bits) if bit // 8 == byte]
        if place:
            values = np.arange(256)
            tables.append((U64(8 * byte), sum(((values >> bit & 1) << k for k, bit in place), np.zeros(256, np.int64))))

    def pick(prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), np.int64)
        for shift, values in tables:
            out |= values[(prints >> shift & U64(255)).astype(np.int64)]
        return out

    return pick


def _summed(prints: DataFrame, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all fingerprints of what ``count`` says of a batch (an array of fixed length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = count(batch.column(0).to_numpy(zero_copy_only=False).view(U64))
            total = own if total is None else total + own
        if total is not None:
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "n"])

    sums = prints.select("print").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(count(np.zeros(0, U64))), np.int64)
    out[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return out


def together(prints: np.ndarray) -> np.ndarray:
    """How often each two bits are set in one fingerprint (64 x 64, flat), and the number of fingerprints."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return np.append(np.rint(bits.T @ bits).astype(np.int64), len(prints))


def bit_groups(both: np.ndarray, n: int) -> list[list[int]]:
    """Deal the bits into groups of equal size; each group takes the bits that correlate most with those it has."""
    both = both.reshape(64, 64) / max(n, 1)
    share = np.diag(both)
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    tie = np.abs(np.divide(both - np.outer(share, share), scale, out=np.zeros_like(both), where=scale > 0))
    np.fill_diagonal(tie, 0)
    left, groups = list(range(64)), []
    for _ in range(GROUPS):
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < WIDTH:
            nearest = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def masks(within: int) -> list[np.ndarray]:
    """For 0..within: the masks of a group with just so many bits."""
    return [np.array([sum(1 << b for b in own) for own in combinations(range(WIDTH), k)], np.int64) for k in range(within + 1)]


def candidates(histogram: np.ndarray, within: int) -> np.ndarray:
    """Fingerprints within 0..within bits of each value of a group."""
    places = np.arange(len(histogram))
    return np.cumsum([sum(histogram[places ^ m] for m in own) for own in masks(within)], axis=0)


def thresholds(costs: list[np.ndarray], distance: int) -> np.ndarray:
    """Cheapest thresholds of each fingerprint (rows) by group (columns).

    ``costs[g][e]`` are the costs of group g under threshold ``e - 1`` for all fingerprints.  The
    dynamic program goes from group to group over the sum of thresholds so far.
    """
    n, aim = costs[0].shape[1], distance - len(costs) + 1
    sums = {0: np.zeros(n)}
    steps = []
    for own in costs:
        after, chosen = {}, {}
        for total, cost in sums.items():
            for e in range(len(own)):
                to, sum_ = total + e - 1, cost + own[e]
                if to not in after:
                    after[to], chosen[to] = sum_, np.full(n, e - 1)
                else:
                    less = sum_ < after[to]
                    after[to] = np.where(less, sum_, after[to])
                    chosen[to] = np.where(less, e - 1, chosen[to])
        sums = after
        steps.append(chosen)
    if aim not in sums:
        raise ValueError("the distance is too large for these groups")
    out = np.empty((n, len(costs)), np.int64)
    total = np.full(n, aim)
    for g in reversed(range(len(costs))):
        for at in np.unique(total):
            here = total == at
            out[here, g] = steps[g][at][here]
        total = total - out[:, g]
    return out


# ---------------------------------------------------------------- cells and links

def sub_bits(group: list[int], parts: int) -> list[list[int]]:
    """The bits outside a group in ``parts`` parts."""
    rest = [b for b in range(64) if b not in set(group)]
    return [rest[len(rest) * k // parts:len(rest) * (k + 1) // parts] for k in range(parts)]


def _visits(groups: list[list[int]], histograms: np.ndarray, distance: int, hot: int):
    """Rows (key, print, lies, visits): a fingerprint and a cell that it lies in or visits."""
    widest = min(2, distance)
    near = [candidates(h, widest) for h in histograms]
    steps = masks(widest)
    sizes = np.cumsum([len(m) for m in steps])
    pick = [picker(g) for g in groups]
    parts = [[picker(b) for b in sub_bits(g, distance + 1)] for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            values = [p(prints) for p in pick]
            costs = [np.vstack([np.zeros(len(prints)), near[g][:, values[g]] + VISIT * sizes[:, None]]) for g in range(GROUPS)]
            chosen = thresholds(costs, distance)
            for g in range(GROUPS):
                visit = chosen[:, g] >= 0
                found = [(values[g], np.arange(len(prints)), np.ones(len(prints), bool), visit)]
                for e in range(1, widest + 1):
                    who = np.flatnonzero(chosen[:, g] >= e)
                    cells, row = (values[g][who][:, None] ^ steps[e]).ravel(), np.repeat(who, len(steps[e]))
                    there = histograms[g][cells] > 0
                    cells, row = cells[there], row[there]
                    found.append((cells, row, np.zeros(len(row), bool), np.ones(len(row), bool)))
                cells, row, lies, visits = (np.concatenate(x) for x in zip(*found, strict=True))
                key = (g << WIDTH) | cells
                large = histograms[g][cells] > hot
                out = [(key[~large], row[~large], lies[~large], visits[~large])]
                if large.any():
                    key, row, lies, visits = key[large], row[large], lies[large], visits[large]
                    out += [(1 << 62 | key << 24 | k << 20 | own(prints[row]), row, lies, visits) for k, own in enumerate(parts[g])]
                for key, row, lies, visits in out:
                    for at in range(0, len(key), BATCH):
                        cut = slice(at, at + BATCH)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[cut]), pa.array(prints[row[cut]].view(np.int64)), pa.array(lies[cut]), pa.array(visits[cut])],
                            ["key", "print", "lies", "visits"])

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the least node that it reaches by the links a-b."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (further := label[label]).tobytes() != label.tobytes():
            label = further


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what the links a-b connect: each node with its root."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = roots(len(nodes), place[:len(a)], place[len(a):])
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def spread_links(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of all links among ``prints`` by walking outward: only what is not yet reached is compared."""
    prints = np.unique(prints)
    leaves, heads = [], []
    while len(prints):
        root, front, prints = prints[0], prints[:1], prints[1:]
        while len(front) and len(prints):
            reached = np.zeros(len(prints), bool)
            for at in range(0, len(front), 64):
                open_ = np.flatnonzero(~reached)
                if not len(open_):
                    break
                reached[open_[(np.bitwise_count(front[at:at + 64, None] ^ prints[open_]) <= distance).any(axis=0)]] = True
            front, prints = prints[reached], prints[~reached]
            leaves.append(front)
            heads.append(np.full(len(front), root))
    return (np.concatenate(leaves), np.concatenate(heads)) if leaves else (prints, prints)


def cell_links(keys: np.ndarray, prints: np.ndarray, lies: np.ndarray, visits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links in whole cells, given in the order of their keys."""
    cell = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
    n_lie, n_visit = np.bincount(cell, lies), np.bincount(cell, visits)
    wide = n_lie * n_visit > PAIRS
    bounds = np.searchsorted(cell, np.arange(len(n_lie) + 1))
    found = [spread_links(prints[bounds[c]:bounds[c + 1]], distance) for c in np.flatnonzero(wide)]
    small = ~wide[cell]
    lie, visit = np.flatnonzero(lies & small), np.flatnonzero(visits & small)
    first = np.searchsorted(cell[lie], np.arange(len(n_lie)))
    times = n_lie[cell[visit]].astype(np.int64)
    ends = np.cumsum(times)
    at = 0
    while at < len(visit):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own, times_ = visit[at:to], times[at:to]
        left = np.repeat(own, times_)
        right = lie[np.repeat(first[cell[own]] - np.cumsum(times_) + times_, times_) + np.arange(times_.sum())]
        near = prints[left] > prints[right]  # either of two visits the other's cell
        left, right = prints[left[near]], prints[right[near]]
        near = np.bitwise_count(left ^ right) <= distance
        found.append(forest(left[near], right[near]))
        at = to
    if not found:
        return prints[:0], prints[:0]
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _links(distance: int):
    """Rows (a, b) of whole cells, read in the order of their keys."""
    names = ("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def linked(rows: pa.Table) -> pa.RecordBatch:
            keys = [rows[c].to_numpy() for c in names]
            cell = np.cumsum(np.r_[False, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if rows.num_rows else keys[0]
            a, b = cell_links(cell, rows["print"].to_numpy().view(U64), rows["lies"].to_numpy(), rows["visits"].to_numpy(), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            last, first = held[-1], held[0]
            if n >= BATCH and any(last[c][-1] != first[c][0] for c in names):
                # the last cell may go on
                rows = pa.Table.from_batches(held)
                same = np.all([rows[c].to_numpy() == rows[c][-1].as_py() for c in names], axis=0)
                cut = int(np.argmax(same))
                yield linked(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                n -= cut
        if n:
            yield linked(pa.Table.from_batches(held))

    return run


def near_links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT_CELL, tile: int = TILE) -> DataFrame:
    """``a, b`` (signed numbers): links that connect just what fingerprints within ``distance`` bits connect.

    ``prints`` holds every fingerprint once, in ``print``.
    """
    if not 2 <= distance < 3 * GROUPS:
        raise ValueError(f"the distance is from 2 to {3 * GROUPS - 1}")
    *both, n = _summed(prints, together)
    groups = bit_groups(np.array(both), n)
    pick = [picker(g) for g in groups]
    histograms = _summed(prints, lambda x: np.concatenate([np.bincount(p(x), minlength=1 << WIDTH) for p in pick])).reshape(GROUPS, -1)
    rows = prints.select("print").mapInArrow(_visits(groups, histograms, distance, hot), "key long, print long, lies boolean, visits boolean")
    whole = [F.lit(0).alias("i"), F.lit(0).alias("j")]
    if histograms.max(initial=0) > hot:
        rows = written(rows)
        # a cell of several tiles: each row meets every tile
        large = rows.filter(F.col("key") >= 1 << 62).groupBy("key").count().filter(F.col("count") > tile).select(
            "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
        own, other = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1))
        dealt = rows.join(large, "key", "left").select("key", "print", "lies", "visits", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
        rows = dealt.select("key", "print", "lies", "visits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        rows = rows.select("*", *whole)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "print", "lies", "visits").mapInArrow(
        _links(distance), "a long, b long")


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_copies(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
                hot: int = HOT_CELL, tile: int = TILE) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), and the smallest id reachable over links.

    Fingerprints link when they differ in at most ``distance`` bits (2 to 11).  Texts without words,
    null ones included, have fingerprint zero and link like any other.  Rows with equal ids stay
    apart and have fingerprints of their own; null ids are never the smallest, and a group of null
    ids only has none; an empty table gives an empty result; other columns are ignored.
    """
    printed = written(fingerprints(docs, id_col, text_col, words))
    prints = written(printed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    links = near_links(prints, distance, hot, tile)
    labels = component_labels(links)
    linked = prints.join(labels, prints["print"] == labels["node"]).select("print", "least", "label")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = written(prints.join(linked.join(least, "label").select("print", "component_id"), "print", "left").select(
        "print", "copies", F.coalesce("component_id", "least").alias("component_id")))
    # a fingerprint of many documents is no key to shuffle by: there are at most OFTEN of these
    bound = (groups.agg(F.sum("copies")).first()[0] or 0) / OFTEN
    often = groups.filter(F.col("copies") > bound).select("print", "component_id", F.lit(True).alias("often"))
    marked = printed.join(F.broadcast(often), "print", "left")
    rest = marked.filter(F.col("often").isNull()).select("doc_id", "print").join(groups.select("print", "component_id"), "print")
    both = marked.filter("often").select("doc_id", "print", "component_id").unionByName(rest.select("doc_id", "print", "component_id"))
    return both.select("doc_id", hex_of("print").alias("fingerprint"), "component_id")


def op13_simhash(spark, sf):
    return near_copies(table(spark, sf, "documents"))
