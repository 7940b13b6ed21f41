"""Ranking labels by lexical and vector similarity inside blocks.

The labels of a block are laid out so that similar ones are neighbours (by their numbers where
other numbers demote, then by the nearest of a few pivot vectors where there are vectors, then by
text) and cut into tiles of bounded size.  A label is in one tile.  Tiles that follow one another make
a part, chunks of queries a bundle; a task takes a bundle and a part, which hold many small blocks
or a piece of a large one.  Inside a part the tiles of a large block are indexed by token: for
each token of a tile the greatest weight that one of its labels has, the numbers of its labels, and
the range of their distances to the pivots.  From these follows the greatest score that a query can
have in a tile:

1. a query is scored in the tile that promises most, which gives its k-th best score so far;
2. it is then scored only in tiles whose promise reaches that score.

Promises hold for every label of a tile (shared tokens add at most their greatest weights, and by
the triangle inequality a vector is no nearer than its distances to a pivot differ), so the result
is exact: the best of a block are among the best of its parts.  Scoring inside a task goes along the
posting lists of shared tokens; neither pairs nor visits are rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.labels import negated, numeric_relation, opposite, opposite_mask, plain_numbers
from tariffloom.functions.text import bigrams, token_counts
from tariffloom.session import cut_lineage

TILE = 64  # labels that share an index entry
CHUNK = 1024  # queries that are laid out together
BUNDLE = 1024  # queries that a task holds at a time
PART = 8192  # labels that a task holds at a time
INDEXED = 16  # tiles from which on a block's part is indexed
CELLS = 1 << 19  # scores that a task works out at a time
PIVOTS = 8
PRODUCTS = 4_000_000  # products of weights that a task holds at a time
SCORE_DIGITS = 9  # scores equal to this many digits tie, so summation order cannot reorder them


@dataclass(frozen=True)
class HybridConfig:
    alpha: float = fixed.ALPHA
    cosine_floor: float = fixed.COSINE_FLOOR
    cutoff: float = fixed.CUTOFF
    k: int = 3
    vetoes: bool = True
    tile: int = TILE
    chunk: int = CHUNK


def dense_score(cosine: Column, floor: float = fixed.COSINE_FLOOR) -> Column:
    """Cosine stretched from [floor, 1] to [0, 1]."""
    return F.least(F.greatest((cosine - floor) / (1 - floor), F.lit(0.0)), F.lit(1.0))


def cosine_of(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def hashed_vector(text: Column, width: int = 64) -> Column:
    """A unit vector of hashed two-character windows, for use where no encoder's vectors are
    at hand."""
    slots = F.transform(bigrams(text), lambda t: F.pmod(F.xxhash64(t), F.lit(width)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                         lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: (x / F.nullif(length, F.lit(0.0))).cast("float"))


def idf(n_docs: Column, n_with: Column) -> Column:
    """Inverse document frequency with a floor; an unseen token gets the largest value."""
    seen = F.greatest(F.log((n_docs - n_with + 0.5) / (n_with + 0.5) + 1.0), F.lit(fixed.IDF_FLOOR))
    return F.when(n_with.isNull(), F.log((n_docs + 0.5) / 0.5 + 1.0)).otherwise(seen)


def saturation(tf: Column, length: Column, avg_len: Column) -> Column:
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def _featured(keep: Sequence[str]) -> list[Column]:
    """What scoring needs to know of a label, beside columns to keep."""
    norm = F.col("norm")
    tokens = bigrams(norm)
    return [*map(F.col, keep), token_counts(tokens).alias("tokens"), F.size(tokens).alias("n_tokens"),
            plain_numbers(norm).alias("nums"), opposite_mask(norm).alias("mask"), negated(norm).alias("neg")]


def _with_vectors(df: DataFrame, vectors: DataFrame | None) -> DataFrame:
    if vectors is None:
        return df.withColumn("vec", F.lit(None).cast("array<float>"))
    return df.join(vectors.select("norm", F.col("vec").cast("array<float>").alias("vec")), "norm", "left")


def _distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def _laid_out(df: DataFrame, block: Sequence[str], pivots: DataFrame | None, by_numbers: bool, size: int, held: int, out: str) -> DataFrame:
    """Rows with ``out``, the number of a run of at most ``size`` similar neighbours, and ``dist``, the distances to the pivots.

    No more partitions are made than hold ``held`` rows each, as bundles and parts end with a partition."""
    block = list(block)
    if pivots is None:
        measured, order = df.withColumn("dist", F.lit(None).cast("array<double>")), [F.col("norm")]
    else:
        measured = df.join(pivots, block, "left").withColumn(
            "dist", F.when(F.col("vec").isNotNull(), F.transform("pivots", lambda p: _distance(p, F.col("vec"))))).drop("pivots")
        near = F.array_min("dist")
        order = [F.array_position("dist", near), near, F.col("norm")]
    if by_numbers:
        order.insert(0, F.array_join(plain_numbers(F.col("norm")), " "))
    keyed = measured.select("*", *[o.alias(f"__o{n}") for n, o in enumerate(order)])
    order = [*block, *[f"__o{n}" for n in range(len(order))]]
    # a row's id goes up by one inside a partition
    parts = max(1, min(_parts(df), -(-df.count() // held)))
    laid = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(out, F.floor(F.monotonically_increasing_id() / size))
    # features come after the shuffle, since its bounds are sampled from the rows before
    return cut_lineage(laid.select(*_featured([*df.columns, "dist", out])))


def _parts(df: DataFrame) -> int:
    """As many partitions as a shuffle has; a fixed number is not merged for the small size of its rows,
    whose work lies in scoring."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pivots(t: DataFrame, block: Sequence[str]) -> DataFrame:
    """A few vectors of each block, the same in every run."""
    held = t.filter(F.col("vec").isNotNull())
    chosen = [F.min_by("vec", F.struct(F.xxhash64("norm", F.lit(n)), "norm")) for n in range(PIVOTS)]
    return held.groupBy(*block).agg(F.array(*chosen).alias("pivots"))


# --- inside tasks ---------------------------------------------------------------------------------

def _entries(lists: pd.Series, weights: pd.Series | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per-row lists as flat (row, entry, weight)."""
    sizes = lists.map(len).to_numpy(dtype=np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    parts = [np.asarray(x, dtype=object) for x in lists if len(x)]
    flat = np.concatenate(parts) if parts else np.zeros(0, object)
    values = np.ones(len(rows)) if weights is None else np.concatenate([np.zeros(0), *[np.asarray(x, dtype=float) for x in weights]])
    return rows, flat, values


def _shared(q: tuple, t: tuple, n_q: int, n_t: int) -> np.ndarray:
    """Sum over shared entries of the product of their weights, for all rows of q and t, along t's posting lists."""
    (q_row, q_entry, q_weight), (t_row, t_entry, t_weight) = q, t
    out = np.zeros(n_q * n_t)
    if len(q_row) and len(t_row):
        codes, vocab = pd.factorize(t_entry)
        order = np.argsort(codes, kind="stable")
        t_row, t_weight = t_row[order], t_weight[order]
        size = np.bincount(codes, minlength=len(vocab))
        first = np.cumsum(size) - size
        code = pd.Index(vocab).get_indexer(q_entry)
        known = code >= 0
        code, q_row, q_weight = code[known], q_row[known], q_weight[known]
        times = size[code]
        ends = np.cumsum(times)
        at = 0
        while at < len(code):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
            n = times[at:to]
            place = np.repeat(first[code[at:to]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out += np.bincount(np.repeat(q_row[at:to], n) * n_t + t_row[place], np.repeat(q_weight[at:to], n) * t_weight[place], n_q * n_t)
            at = to
    return out.reshape(n_q, n_t)


def _lexical(raw: np.ndarray, own: pd.Series) -> np.ndarray:
    own = own.to_numpy()[:, None]
    return np.where(own > 0, np.minimum(raw / np.where(own > 0, own, 1.0), 1.0), 0.0)


def _stretched(cosine: np.ndarray, floor: float) -> np.ndarray:
    return np.clip((cosine - floor) / (1 - floor), 0.0, 1.0)


def _stacked(q: pd.Series, t: pd.Series) -> tuple:
    """Vectors of both sides as matrices, zeros where there is none; None where no row has any."""
    width = max((len(v) for v in [*q, *t] if v is not None), default=0)
    stack = lambda s: np.vstack([np.zeros(width) if v is None else np.asarray(v, dtype=float) for v in s])
    return (stack(q), stack(t)) if width else (None, None)


def _opposite(q: pd.DataFrame, t: pd.DataFrame) -> np.ndarray:
    a, b = q["mask"].to_numpy()[:, None], t["mask"].to_numpy()[None, :]
    clash = q["neg"].to_numpy()[:, None] != t["neg"].to_numpy()[None, :]
    if not a.any() or not b.any():
        return clash
    for n in range(len(fixed.ANTONYMS)):
        x, y = (a >> 2 * n) & 3, (b >> 2 * n) & 3
        clash |= (x != 0) & (y != 0) & (x != y)
    return clash


def promises(q: pd.DataFrame, tiles: pd.DataFrame, config: HybridConfig) -> np.ndarray:
    """Greatest score that each query can have in each tile."""
    raw = _shared(_entries(q["toks"], q["weights"]), _entries(tiles["toks"], tiles["weights"]), len(q), len(tiles))
    lexical = _lexical(raw * (1 + 1e-9), q["self_score"])
    least = _stretched(np.zeros(1), config.cosine_floor)[0]
    dense = np.full(lexical.shape, least)
    far = [i for i, d in enumerate(q["dist"]) if d is not None]
    held = [i for i, d in enumerate(tiles["low"]) if d is not None]
    if far and held:
        own = np.vstack([np.asarray(q["dist"].iloc[i], float) for i in far])
        low, high = (np.vstack([np.asarray(tiles[c].iloc[i], float) for i in held]) for c in ("low", "high"))
        gap = np.zeros((len(far), len(held)))
        for p in range(own.shape[1]):
            d = own[:, p, None]
            gap = np.maximum(gap, np.maximum(low[None, :, p] - d, d - high[None, :, p]))
        gap = np.maximum(gap - 1e-6, 0.0)
        square = q["square"].to_numpy(dtype=float)[far][:, None] + tiles["square"].to_numpy(dtype=float)[held][None, :]
        dense[np.ix_(far, held)] = np.maximum(_stretched((square - gap * gap) / 2 + 1e-6, config.cosine_floor), least)
    score = config.alpha * lexical + (1 - config.alpha) * dense
    if config.vetoes:
        # numbers that no label of the tile has together demote whatever else fits
        whole = lambda lists: lists.map(lambda x: ["\0".join(x)])
        same = _shared(_entries(whole(q["nums"])), _entries(tiles["number_sets"]), len(q), len(tiles)) > 0
        bare = (q["nums"].map(len).to_numpy() == 0)[:, None] | tiles["number_sets"].map(lambda x: "" in x).to_numpy(dtype=bool)[None, :]
        extra = bare | (_shared(_entries(q["nums"]), _entries(tiles["numbers"]), len(q), len(tiles)) > 0)
        score = score * np.where(same, 1.0, np.where(extra, fixed.EXTRA_FACTOR, fixed.CONFLICT_FACTOR))
    return score


def _homes(score: np.ndarray, tiles: pd.DataFrame, config: HybridConfig) -> np.ndarray:
    """The tile that promises each query most."""
    full = tiles["n"].to_numpy() >= config.k  # a tile of fewer labels tells little
    return np.argmax(np.where(full[None, :], score, score - 2), axis=1)


def _open(score: np.ndarray, tiles: pd.DataFrame, least: np.ndarray, config: HybridConfig) -> np.ndarray:
    """Which tiles can still matter to which query, given its k-th best score so far."""
    # labels without any score rank by position, so the first ones can matter
    first = np.sort(np.concatenate([np.asarray(x) for x in tiles["first"]]))[: 2 * config.k]
    early = tiles["first"].map(lambda x: min(x)).to_numpy() <= first[-1]
    return (score >= np.maximum(least - 2e-9, 4e-10)[:, None]) | ((least < 2e-9)[:, None] & early[None, :])


def _visits(block: Sequence[str], config: HybridConfig, home: bool):
    """Tiles that queries visit, as rows: the most promising one, or all others that can still matter."""
    def run(q: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        score = promises(q, tiles, config)
        if home:
            row, col = np.arange(len(q)), _homes(score, tiles, config)
        else:
            other = tiles["tile"].to_numpy()[None, :] != q["home"].to_numpy()[:, None]
            row, col = np.nonzero(_open(score, tiles, q["least"].to_numpy(dtype=float), config) & other)
        pick = lambda s, i: s.to_numpy(dtype=object)[i]
        return pd.DataFrame({**{c: pick(q[c], row) for c in (*block, "q_norm")}, "tile": pick(tiles["tile"], col), "promise": score[row, col]})

    return run


def _index(t: pd.DataFrame, config: HybridConfig) -> pd.DataFrame:
    """One row a tile of the labels ``t``, which are sorted by ``tile``."""
    rows = []
    for tile, own in t.groupby("tile", sort=True):
        peaks: dict[str, float] = {}
        for tokens, weights in zip(own["toks"], own["weights"]):
            for token, weight in zip(tokens, weights):
                peaks[token] = max(peaks.get(token, 0.0), weight)
        held = [np.asarray(d, dtype=float) for d in own["dist"] if d is not None]
        rows.append({
            "tile": tile, "n": len(own), "first": sorted(own["pos"])[: 2 * config.k], "toks": list(peaks), "weights": list(peaks.values()),
            "low": np.min(held, axis=0) if held else None, "high": np.max(held, axis=0) if held else None,
            "square": own["square"].max() if held else None,
            "number_sets": list({"\0".join(x) for x in own["nums"]}), "numbers": list({n for x in own["nums"] for n in x})})
    return pd.DataFrame(rows)


class _Lists:
    """Per-row lists of both sides under common numbers, of which rows can be picked."""

    def __init__(self, q: pd.Series, t: pd.Series, q_weights: pd.Series | None = None, t_weights: pd.Series | None = None):
        sides = [_entries(q, q_weights), _entries(t, t_weights)]
        codes, _ = pd.factorize(np.concatenate([sides[0][1], sides[1][1]]))
        cut = len(sides[0][1])
        self.empty = not cut or cut == len(codes)
        self.sides = []
        for n, (rows, _, weights), own in zip((len(q), len(t)), sides, (codes[:cut], codes[cut:])):
            self.sides.append((np.searchsorted(rows, np.arange(n + 1)), own, weights))

    def sizes(self, side: int, rows: np.ndarray) -> np.ndarray:
        starts = self.sides[side][0]
        return starts[rows + 1] - starts[rows]

    def of(self, side: int, rows: np.ndarray) -> tuple:
        starts, codes, weights = self.sides[side]
        n = self.sizes(side, rows)
        place = np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), codes[place], weights[place]

    def shared(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.zeros((len(q), len(t))) if self.empty else _shared(self.of(0, q), self.of(1, t), len(q), len(t))


class _Scores:
    """Scores of any queries and labels of a task."""

    def __init__(self, q: pd.DataFrame, t: pd.DataFrame, config: HybridConfig):
        self.q, self.t, self.config = q, t, config
        self.tokens = _Lists(q["toks"], t["toks"], q["weights"], t["weights"])
        self.vectors = _stacked(q["vec"], t["vec"])
        if config.vetoes:
            self.nums = _Lists(q["nums"], t["nums"])
            self.signs = q[["mask", "neg"]].copy(), t[["mask", "neg"]].copy()

    def best(self, rows: np.ndarray, cols: np.ndarray, allowed: np.ndarray | None) -> dict[str, np.ndarray]:
        """The best ``k`` of the labels ``cols`` that each of the queries ``rows`` may have; the smaller position first where scores tie."""
        config = self.config
        bm25 = _lexical(self.tokens.shared(rows, cols), self.q["self_score"].iloc[rows])
        a, b = self.vectors
        dense = np.full(bm25.shape, _stretched(np.zeros(1), config.cosine_floor)[0]) if a is None else _stretched(a[rows] @ b[cols].T, config.cosine_floor)
        final = config.alpha * bm25 + (1 - config.alpha) * dense
        relation, antonym = np.zeros(final.shape, np.int8), np.zeros(final.shape, bool)
        if config.vetoes:
            relation = self._relation(rows, cols)
            antonym = _opposite(self.signs[0].iloc[rows], self.signs[1].iloc[cols])
            final *= np.array([1.0, fixed.EXTRA_FACTOR, fixed.CONFLICT_FACTOR])[relation]
            final = np.where(antonym, final * fixed.CONFLICT_FACTOR, final)
        rounded = np.round(final, SCORE_DIGITS)
        if allowed is not None:
            rounded[~allowed] = -1.0
        k = min(config.k, len(cols))
        last = np.partition(rounded, len(cols) - k, axis=1)[:, len(cols) - k]
        row, col = np.nonzero((rounded >= last[:, None]) & (rounded >= 0))
        order = np.lexsort((self.t["pos"].to_numpy()[cols[col]], -rounded[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        return {"q": rows[row], "t": cols[col], "final": final[row, col], "bm25": bm25[row, col], "embedding": dense[row, col],
                "relation": relation[row, col], "antonym": antonym[row, col]}

    def _relation(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """0 same, 1 extra, 2 conflict, from the sizes of the number sets and their overlap."""
        shared = self.nums.shared(rows, cols)
        nq, nt = self.nums.sizes(0, rows)[:, None], self.nums.sizes(1, cols)[None, :]
        one, other = shared == nq, shared == nt
        return np.where(one & other, 0, np.where(one | other, 1, 2))


def _small_blocks(scores: _Scores, q_of: list[np.ndarray], t_of: list[np.ndarray]):
    """Best labels of queries in blocks of few labels, many blocks at a time."""
    at = 0
    while at < len(q_of):
        n_q = n_t = 0
        to = at
        while to < len(q_of) and (to == at or (n_q + len(q_of[to])) * (n_t + len(t_of[to])) <= CELLS):
            n_q, n_t, to = n_q + len(q_of[to]), n_t + len(t_of[to]), to + 1
        number = np.arange(to - at)
        rows, cols = np.concatenate(q_of[at:to]), np.concatenate(t_of[at:to])
        q_block, t_block = np.repeat(number, [len(x) for x in q_of[at:to]]), np.repeat(number, [len(x) for x in t_of[at:to]])
        step = max(1, CELLS // len(cols))
        for n in range(0, len(rows), step):
            yield scores.best(rows[n:n + step], cols, q_block[n:n + step, None] == t_block[None, :] if to - at > 1 else None)
        at = to


def _large_block(scores: _Scores, rows: np.ndarray, cols: np.ndarray):
    """Best labels of a block's queries, without the tiles that hold nothing better."""
    config, q = scores.config, scores.q.iloc[rows]
    cols = cols[np.argsort(scores.t["tile"].to_numpy()[cols], kind="stable")]
    t = scores.t.iloc[cols]
    tiles = _index(t, config)
    tile_of = np.searchsorted(tiles["tile"].to_numpy(), t["tile"].to_numpy())
    promise = promises(q, tiles, config)
    homes = _homes(promise, tiles, config)
    # queries with one home are neighbours, so that a slice of them visits few tiles
    order = np.argsort(homes, kind="stable")
    rows, homes, promise = rows[order], homes[order], promise[order]

    def scored(open_: np.ndarray, step: int):
        for n in range(0, len(rows), step):
            own = open_[n:n + step]
            held = np.flatnonzero(own.any(axis=0)[tile_of])
            yield scores.best(rows[n:n + step], cols[held], own[:, tile_of[held]])

    at_home = homes[:, None] == np.arange(len(tiles))[None, :]
    n, least = np.zeros(len(scores.q), int), np.full(len(scores.q), np.inf)
    for found in scored(at_home, 64):
        np.add.at(n, found["q"], 1)
        np.minimum.at(least, found["q"], found["final"])
    least = np.where(n >= config.k, least, -1.0)[rows]
    yield from scored(at_home | _open(promise, tiles, least, config), max(1, CELLS // len(cols)))


def _scorer(block: Sequence[str], payload: Sequence[str], config: HybridConfig):
    """Best labels of a bundle of queries among a part of the labels."""
    def score(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        names = [*block, "q_norm", *payload, "final", "bm25", "embedding", "relation", "antonym"]
        if q.empty or t.empty:
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        q, t = q.reset_index(drop=True), t.reset_index(drop=True)
        scores = _Scores(q, t, config)
        number = pd.concat([q[list(block)], t[list(block)]], ignore_index=True).groupby(list(block)).ngroup().to_numpy()
        places = [pd.Series(np.arange(len(x))).groupby(x).apply(lambda s: s.to_numpy()) for x in (number[:len(q)], number[len(q):])]
        both = [(places[0][b], places[1][b]) for b in places[0].index if b in places[1].index]
        large = [p for p in both if len(p[1]) > INDEXED * config.tile]
        small = [p for p in both if len(p[1]) <= INDEXED * config.tile]
        found = list(_small_blocks(scores, [a for a, _ in small], [b for _, b in small]))
        for rows, cols in large:
            found += _large_block(scores, rows, cols)
        if not found:
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        found = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
        # object columns: string columns of pandas may hold several Arrow chunks
        pick = lambda s, at: pd.Series(s.to_numpy(dtype=object)[at], dtype=object)
        return pd.DataFrame({
            **{b: pick(q[b], found["q"]) for b in block}, "q_norm": pick(q["q_norm"], found["q"]), **{c: pick(t[c], found["t"]) for c in payload},
            **{c: found[c] for c in ("final", "bm25", "embedding", "relation", "antonym")}})

    return score


def _cogrouped(left: DataFrame, right: DataFrame, keys: Sequence[str], run, schema: str) -> DataFrame:
    # fresh key names: both sides may stem from one table
    right = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    left, right = left.repartition(_parts(left), *keys), right.repartition(_parts(left), *[f"__{c}" for c in keys])
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"__{c}" for c in keys])).applyInPandas(run, schema)


def _prepared(queries: DataFrame, targets: DataFrame, block: list[str], config: HybridConfig, vectors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Queries and labels with their weights, laid out in chunks and tiles."""
    carried = [c for c in targets.columns if c not in (*block, "pos")]
    active = queries.select(*block).distinct()
    # rows are counted, sampled for bounds and laid out
    t = cut_lineage(_with_vectors(targets.join(active, block, "left_semi"), vectors))
    q = _with_vectors(queries.select(*block, "norm"), vectors)
    pivots = None if vectors is None else cut_lineage(_pivots(t, block))
    t = _laid_out(t, block, pivots, config.vetoes, config.tile, PART, "tile")
    stats = t.groupBy(*block).agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avg_len"))
    spread = t.select(*block, F.explode("tokens.token").alias("token")).groupBy(*block, "token").agg(
        F.count("*").alias("n_with"))
    q = _laid_out(cut_lineage(q.join(stats, block)), block, pivots, config.vetoes, config.chunk, BUNDLE, "chunk")
    weighted = (
        q.select(*block, "norm", "n_docs", "avg_len", "n_tokens", F.inline("tokens"))
        .join(spread, [*block, "token"], "left")
        .withColumn("idf", idf(F.col("n_docs"), F.col("n_with")))
        .groupBy(*block, "norm").agg(
            F.collect_list("token").alias("toks"), F.collect_list(F.col("tf") * F.col("idf")).alias("weights"),
            F.sum(F.col("tf") * F.col("idf") * saturation(F.col("tf"), F.col("n_tokens"), F.col("avg_len"))
                  ).alias("self_score"))
    )
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    q_rows = cut_lineage(q.join(weighted, [*block, "norm"], "left").select(
        *block, F.col("norm").alias("q_norm"), "chunk", F.coalesce("toks", F.array().cast("array<string>")).alias("toks"),
        F.coalesce("weights", F.array().cast("array<double>")).alias("weights"), F.coalesce("self_score", F.lit(0.0)).alias("self_score"),
        "nums", "mask", "neg", "vec", "dist", square.alias("square")))
    t_rows = t.join(stats, block).select(
        *block, "tile", "pos", *[F.col(c).alias(f"t_{c}") for c in carried], F.col("tokens.token").alias("toks"),
        F.transform("tokens", lambda x: saturation(x["tf"], F.col("n_tokens"), F.col("avg_len"))).alias("weights"),
        "nums", "mask", "neg", "vec", "dist", square.alias("square"))
    return q_rows, t_rows


def rank_candidates(queries: DataFrame, targets: DataFrame, block: Sequence[str],
                    config: HybridConfig = HybridConfig(), vectors: DataFrame | None = None) -> DataFrame:
    """The best ``k`` target labels of every query within its block.

    ``queries``: block columns and ``norm`` (distinct per block).  ``targets``: block columns,
    ``norm``, ``pos`` (distinct per block; ties go to the smaller) and any columns to hand on,
    which come back as ``t_*``.  ``vectors``: ``norm, vec`` unit vectors; labels without one
    have no vector score.  Features and results are checkpointed, since each feeds several
    branches.
    """
    block = list(block)
    payload = ["pos", *[f"t_{c}" for c in targets.columns if c not in (*block, "pos")]]
    q_rows, t_rows = _prepared(queries, targets, block, config, vectors)
    types = {f.name: f.dataType.simpleString() for f in [*t_rows.schema, *q_rows.schema]}
    keys_ddl = ", ".join(f"`{b}` {types[b]}" for b in block)
    score_ddl = (keys_ddl + ", q_norm string, " + ", ".join(f"`{c}` {types[c]}" for c in payload)
                 + ", final double, bm25 double, embedding double, relation int, antonym boolean")

    q_rows = q_rows.withColumn("bundle", F.floor(F.col("chunk") / max(1, BUNDLE // config.chunk)))
    t_rows = t_rows.withColumn("part", F.floor(F.col("tile") / max(1, PART // config.tile)))
    asked = q_rows.join(t_rows.select(*block, "part").distinct(), block)
    held = t_rows.join(q_rows.select(*block, "bundle").distinct(), block)
    found = _cogrouped(asked, held, ["bundle", "part"], _scorer(block, payload, config), score_ddl)

    per_query = Window.partitionBy(*block, "q_norm").orderBy(F.round("final", SCORE_DIGITS).desc(), "pos")
    best = found.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= config.k)
    flags = F.array_compact(F.array(
        F.when(F.col("relation") == 2, "NUMERIC_VETO_APPLIED").when(F.col("relation") == 1, "NUMERIC_EXTRA"),
        F.when(F.col("antonym"), "ANTONYM_BLOCKED")))
    following = Window.partitionBy(*block, "q_norm").orderBy("rank")  # at most k rows
    margin = F.col("final") - F.lead("final").over(following)
    return cut_lineage(best.select(
        *block, "q_norm", "rank", *payload, "final", "bm25", "embedding",
        (flags if config.vetoes else F.array().cast("array<string>")).alias("flags"),
        F.when(F.col("rank") == 1, margin).alias("margin_to_next")))


def score_pairs(pairs: DataFrame, queries: DataFrame, targets: DataFrame, block: Sequence[str],
                config: HybridConfig = HybridConfig(), vectors: DataFrame | None = None) -> DataFrame:
    """Scores of given pairs of a query and a label, whatever their rank.

    ``pairs``: block columns, ``q_norm``, ``t_norm``; the other inputs are those of :func:`rank_candidates`.
    Pairs whose query or label is not there are left out.
    """
    block = list(block)
    q_rows, t_rows = _prepared(queries, targets, block, config, vectors)
    q = q_rows.select(*block, "q_norm", F.map_from_arrays("toks", "weights").alias("own"), "self_score", "nums", "mask", "neg", "vec")
    t = t_rows.select(*block, "t_norm", "pos", *[F.col(c).alias(f"t_{c}") for c in ("toks", "weights", "nums", "mask", "neg", "vec")])
    both = pairs.select(*block, "q_norm", "t_norm").distinct().join(q, [*block, "q_norm"]).join(t, [*block, "t_norm"])
    shared = F.zip_with("t_toks", "t_weights", lambda token, w: F.coalesce(F.try_element_at("own", token), F.lit(0.0)) * w)
    raw = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x)
    bm25 = F.when(F.col("self_score") > 0, F.least(raw / F.col("self_score"), F.lit(1.0))).otherwise(0.0)
    dense = dense_score(F.coalesce(cosine_of(F.col("vec"), F.col("t_vec")), F.lit(0.0)), config.cosine_floor)
    scored = both.select("*", bm25.alias("bm25"), dense.alias("embedding"))
    final = config.alpha * F.col("bm25") + (1 - config.alpha) * F.col("embedding")
    if config.vetoes:
        relation = numeric_relation(F.col("nums"), F.col("t_nums"))
        final = final * F.when(relation == "same", 1.0).when(relation == "extra", fixed.EXTRA_FACTOR).otherwise(fixed.CONFLICT_FACTOR)
        final = final * F.when(opposite(F.col("mask"), F.col("t_mask"), F.col("neg"), F.col("t_neg")), fixed.CONFLICT_FACTOR).otherwise(1.0)
    return scored.select(*block, "q_norm", "t_norm", "pos", final.alias("final"), "bm25", "embedding")
