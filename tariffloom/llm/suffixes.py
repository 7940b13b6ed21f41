"""Exact removal of long repeated byte strings with a run-length index.

A byte is removed when a string of ``length`` bytes that covers it also starts earlier.  Strings
are looked at where they can repeat at all:

1. Every string of ``length`` bytes holds one *anchor*: of its ``q``-grams the one with the least
   hash.  Equal strings have equal anchors at the same place, so strings are compared within groups
   of equal anchors.  With an anchor goes the hash of its *context*, the bytes that any string over
   it can cover.
2. An occurrence whose context stood earlier is removed whole.  Bytes are fetched only for first
   contexts whose anchor has other contexts too.
3. Those contexts, anchor group by group, are put into texts of bounded size.  For each text a
   run-length compressed Burrows-Wheeler transform is made; at the run ends the suffix positions are
   sampled and their common prefixes measured; the text is streamed once, where between samples
   the length of a match falls by one for each byte (the permuted longest-common-prefix array).
   Neighbours that match over ``length`` bytes are one string, and all but its earliest are marked.
4. Anchors with very many different contexts (a common line amid different text) would fill one
   task.  Their strings are put into a few classes by where the anchor stands; all strings of a class
   hold one core, so only classes whose core is found twice are looked at, and of these the strings
   are hashed one by one, sorted and streamed, and all but the earliest of each are marked.

Nothing is sampled or cut: both ways give the same marks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, cut_lineage, table, written
from tariffloom.llm.jaccard import SHIPPED_IDS

LENGTH = 100
GRAM = 20
HOT_CONTEXTS = 256
#: classes of the strings over a hot anchor
CLASSES = 4
#: open anchors (eight bytes each) that are shipped to all tasks; beyond it they are joined by document
SHIPPED_GRAMS = 2_000_000
INDEX_BYTES = 1_000_000
#: positions looked at together when anchors are chosen
STRIDE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all ``q``-grams, from halves of powers of two."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, width = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * width <= q:
        h = powers[width]
        powers[2 * width] = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    total, done = np.zeros(n, np.uint64), 0
    while done < q:
        width = max(w for w in powers if w <= q - done)
        total = total * np.uint64(pow(_BASE, width, 1 << 64)) + powers[width][done:done + n]
        done += width
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, q: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all strings of ``length`` bytes, and their gram hashes."""
    window, found, hashes = length - q + 1, [], []
    for at in range(0, max(0, len(data) - length + 1), STRIDE):
        h = gram_hashes(data[at:at + STRIDE + length - 1], q)
        low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:len(low) - (window - width)], low[window - width:])
        chosen = np.unique((low & np.uint64((1 << 20) - 1)).astype(np.int64))
        found.append(chosen + at)
        hashes.append(h[chosen])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def context_span(at: int, size: int, length: int, q: int) -> tuple[int, int]:
    return max(0, at - (length - q)), min(size, at + length)


class RunLengthIndex:
    """A run-length compressed transform of a few contexts with sampled run ends."""

    def __init__(self, contexts: list[bytes], origins: np.ndarray, length: int):
        sizes = np.array([len(c) for c in contexts])
        gaps = 1  # each gap is a number of its own that stands in no context, so no string runs over an end
        starts = np.cumsum(sizes + gaps) - sizes - gaps
        text = np.zeros(int((sizes + gaps).sum()), np.int64)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.own = np.repeat(starts, sizes) + within
        text[starts + sizes] = np.arange(len(sizes))
        text[self.own] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + len(sizes)
        #: where each position of the contexts comes from, as an order over all documents
        self.origin = np.repeat(origins, sizes) + within
        self.text, self.length = text, length
        self.names, self.rows = self._sorted(text, 2 * length)
        self.previous = np.r_[0, text[:-1]]
        transform = self.previous[self.rows]
        #: rows where a run of the transform begins
        self.heads = np.flatnonzero(np.r_[True, transform[1:] != transform[:-1]])

    @staticmethod
    def _sorted(text: np.ndarray, kept: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Names of all substrings of 1, 2, 4 .. below ``kept`` bytes, and the order of the suffixes.

        From four bytes on a name is the number of suffixes below, so one that is known to stand alone keeps
        its name, and a round sorts only those that do not stand alone yet.
        """
        n, names, width, name = len(text), {1: text}, 1, text
        base = int(text.max(initial=0)) + 1

        def beyond(own: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
            """One more than the name of what follows the first ``width``; 0 after the end."""
            return np.r_[own[width:] + 1, np.zeros(min(width, n), np.int64)][at]

        while width < 4 and (base + 1) ** 2 < 1 << 60:  # as numbers, without a sort
            name = name * (base + 1) + beyond(name, slice(None))
            base, width = (base + 1) ** 2, 2 * width
            if width < kept:
                names[width] = name
        open_, start = np.arange(n), np.zeros(n, np.int64)
        keys = name
        while True:
            order = np.argsort(keys, kind="stable")
            sorted_keys, open_, start = keys[order], open_[order], start[order]
            fresh = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]] if n else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            size = np.diff(np.r_[first, len(open_)])
            # places in the sorted keys where a suffix's new group and its former group begin
            former = np.flatnonzero(np.r_[True, start[1:] != start[:-1]]) if n else first
            begins = np.repeat(former, np.diff(np.r_[former, len(open_)]))
            ranks = start + np.repeat(first, size) - begins
            if len(open_) == n:
                name = np.empty(n, np.int64)
            name[open_] = ranks
            if width < kept:
                names[width] = name.copy()
            alone = np.repeat(size == 1, size)
            open_, start = open_[~alone], ranks[~alone]
            if not len(open_):
                break
            keys = start * (n + 1) + beyond(name, open_)
            width *= 2
        order = np.empty(n, np.int64)
        order[name] = np.arange(n)
        while 2 * width < kept:  # all stand alone by now
            width *= 2
            names[width] = name
        return names, order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share, up to below twice the widest name."""
        shared = np.zeros(len(a), np.int64)
        end = len(self.text)
        for width in sorted(self.names, reverse=True):
            x, y = a + shared, b + shared
            ok = (x + width <= end) & (y + width <= end)
            same = ok & (self.names[width][np.minimum(x, end - 1)] == self.names[width][np.minimum(y, end - 1)])
            shared += width * same
        return shared

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the contexts in order: is it a start of a long string that starts earlier?"""
        n, rows, heads = len(self.text), self.rows, self.heads
        sample = rows[heads]
        measured = np.r_[0, self.common(sample[1:], rows[heads[1:] - 1])]
        # stream: from a sampled position the match gets shorter by one a byte until the next sample
        value, last = np.zeros(n, np.int64), np.full(n, -1)
        value[sample], last[sample] = measured, sample
        last = np.maximum.accumulate(last)
        match = np.where(last >= 0, value[last] - (np.arange(n) - last), 0)
        # matches are measured up to a bounded length only, so short ones are measured again
        below = match[rows] < self.length
        check = np.flatnonzero(below)
        check = check[check > 0]
        exact = self.common(rows[check], rows[check - 1]) >= self.length
        below[check] = ~exact
        below[0] = True
        first = np.flatnonzero(below)
        origin = np.full(n, _LAST)
        origin[self.own] = self.origin
        earliest = np.minimum.reduceat(origin[rows], first)
        mark = np.empty(n, bool)
        mark[rows] = origin[rows] > np.repeat(earliest, np.diff(np.r_[first, n]))
        full = np.r_[self.own[1:] != self.own[:-1] + 1, True]  # last byte of each context
        ends = np.flatnonzero(full)
        end_of = np.repeat(self.own[ends], np.diff(np.r_[-1, ends]))
        return mark[self.own] & (self.own + self.length - 1 <= end_of), self.own


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered stretches of strings that begin at the (ordered) starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


def _body(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchor_rows(docs: DataFrame, length: int, q: int) -> DataFrame:
    """``gram, context, doc, part, at`` for every anchor of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frames = []
            for doc, part, text in zip(batch["doc"], batch["part"], batch["text"], strict=True):
                body = _body(text)
                at, gram = anchors(np.frombuffer(body, np.uint8), length, q)
                spans = [context_span(p, len(body), length, q) for p in at.tolist()]
                context = [xxhash.xxh64_intdigest(body[s:e], seed=p - s) for p, (s, e) in zip(at.tolist(), spans, strict=True)]
                if context:
                    frames.append(pd.DataFrame({"gram": gram.view(np.int64), "context": np.array(context, np.uint64).view(np.int64), "doc": doc, "part": part, "at": at}))
            if frames:
                yield pd.concat(frames)

    return docs.mapInPandas(run, "gram long, context long, doc long, part long, at long")


def sorted_out(rows: DataFrame) -> DataFrame:
    """``whole`` occurrences (their context stood earlier) and first contexts among others.

    Anchors are streamed in order; of the group at hand only the first row and its state are held.
    An anchor that several rows bring for one place (equal rows with one id) counts once.
    """
    names = ["gram", "doc", "part", "at"]
    place = ["gram", "context", "doc", "part", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pending = None, None  # gram and context of the last row; its group's only context so far
        before = None  # place of the last row
        for batch in batches:
            if not len(batch):
                continue
            places = batch[place].to_numpy()
            new = np.r_[before is None or (places[0] != before).any(), (places[1:] != places[:-1]).any(axis=1)]
            before = places[-1].copy()
            batch = batch[new].reset_index(drop=True)
            if not len(batch):
                continue
            gram, context = batch["gram"].to_numpy(), batch["context"].to_numpy()
            fresh = np.r_[last is None or gram[0] != last[0], gram[1:] != gram[:-1]]
            first = fresh | np.r_[last is None or context[0] != last[1], context[1:] != context[:-1]]
            goes_on = not fresh[0]
            group = np.cumsum(fresh)
            contexts = np.bincount(group, first)
            if goes_on:
                contexts[0] += 1  # there was a context in an earlier batch
            open_ = first & (contexts[group] > 1)
            frames = [batch[names][~first].assign(whole=True), batch[names][open_].assign(whole=False)]
            if pending is not None and goes_on and contexts[0] > 1:
                frames.append(pending.assign(whole=False))
                pending = None
            if not goes_on or group[-1] > 0:
                alone = contexts[group[-1]] == 1
                pending = batch[names][(group == group[-1]) & first] if alone else None
            last = (gram[-1], context[-1])
            yield pd.concat(frames)

    ordered = rows.repartition("gram").sortWithinPartitions("gram", "context", "doc", "part", "at")
    return ordered.mapInPandas(run, "gram long, doc long, part long, at long, whole boolean")


def classes(length: int, q: int) -> list[tuple[int, int]]:
    """Ranges of places (first, last) that the anchor has in the strings of a class."""
    places = length - q + 1
    cuts = [places * k // CLASSES for k in range(CLASSES + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _pieces(body: bytes, gram: int, at: int, hot: bool, length: int, q: int) -> list[tuple[int, int, int, bytes | None]]:
    """``key, start, class, bytes``: the context, or for a hot anchor the cores of its classes."""
    if not hot:
        start, end = context_span(at, len(body), length, q)
        return [(gram, start, start - at - 1, body[start:end])]
    return [(xxhash.xxh64_intdigest(core, seed=k) - (1 << 63), at, k, None) for k, core in cores(body, at, length, q)]


def cores(body: bytes, at: int, length: int, q: int) -> list[tuple[int, bytes]]:
    """For each class with a whole string over the anchor, the bytes that all its strings hold."""
    found = []
    for k, (low, high) in enumerate(classes(length, q)):
        # strings of the class begin at ``at - high .. at - low``, as far as the text goes
        if max(0, at - high) <= min(at - low, len(body) - length):
            found.append((k, body[at - low:max(0, at - high + length)]))
    return found


def context_bytes(texts: DataFrame, open_: DataFrame, grams: DataFrame, length: int, q: int, shipped: int) -> DataFrame:
    """Contexts of open anchors (``class`` is minus one minus the anchor's place in them), and the
    cores of hot ones (``class`` from 0 on).

    A small table of open grams is shipped and the anchors are chosen again beside the text; that
    also brings contexts that stood earlier, whose strings are marked twice then.  A large one is
    joined by document.
    """
    names, schema = ["key", "doc", "part", "start", "class", "body"], "key long, doc long, part long, start long, class int, body binary"
    if grams.count() <= shipped:
        table_ = grams.toPandas().sort_values("gram")
        known, hot = table_["gram"].to_numpy(), table_["hot"].to_numpy()

        def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for doc, part, text in zip(batch["doc"], batch["part"], batch["text"], strict=True):
                    body = _body(text)
                    at, gram = anchors(np.frombuffer(body, np.uint8), length, q)
                    gram = gram.view(np.int64)
                    slot = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
                    for i in np.flatnonzero(known[slot] == gram).tolist() if len(known) and len(gram) else ():
                        rows += [(k, doc, part, s, c, b) for k, s, c, b in _pieces(body, int(gram[i]), int(at[i]), bool(hot[slot[i]]), length, q)]
                yield pd.DataFrame(rows, columns=names)

        return texts.mapInPandas(beside, schema)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, part, text, own in zip(batch["doc"], batch["part"], batch["text"], batch["wanted"], strict=True):
                body = _body(text)
                for a in own:
                    rows += [(k, doc, part, s, c, b) for k, s, c, b in _pieces(body, a["gram"], a["at"], a["hot"], length, q)]
            yield pd.DataFrame(rows, columns=names)

    by_doc = open_.join(grams, "gram").groupBy("doc", "part").agg(F.collect_list(F.struct("gram", "at", "hot")).alias("wanted"))
    return texts.join(by_doc, ["doc", "part"]).mapInPandas(joined, schema)


def hashed_marks(texts: DataFrame, cores: DataFrame, length: int, q: int, shipped: int) -> DataFrame:
    """Stretches of strings over hot anchors that start earlier, among classes with a repeated core."""
    twice = cores.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    wanted = written(cores.join(twice, "key").select("doc", "part", "start", "class"))
    ranges = classes(length, q)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, part, text, own in zip(batch["doc"], batch["part"], batch["text"], batch["wanted"], strict=True):
                body = _body(text)
                starts = sorted({s for a in own for s in range(max(0, a["start"] - ranges[a["class"]][1]), min(a["start"] - ranges[a["class"]][0], len(body) - length) + 1)})
                rows += [(xxhash.xxh64_intdigest(body[s:s + length]) - (1 << 63), doc, part, s) for s in starts]
            yield pd.DataFrame(rows, columns=["key", "doc", "part", "start"])

    by_doc = wanted.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "class")).alias("wanted"))
    own = near_ids(texts, wanted.select("doc").distinct(), shipped).join(by_doc, ["doc", "part"])
    hashed = written(own.mapInPandas(strings, "key long, doc long, part long, start long"))
    return later_strings(hashed, length)


def later_strings(hashed: DataFrame, length: int) -> DataFrame:
    """``doc, part, low, high`` of the strings (``key, doc, part, start``) whose key an earlier place has too.

    Strings are streamed in order of key and place; only the key and place of the last one's group are held.
    """
    place = ["doc", "part", "start"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first = None, None  # the key at hand and its earliest place
        for batch in batches:
            if not len(batch):
                continue
            key, places = batch["key"].to_numpy(), batch[place].to_numpy()
            fresh = np.r_[key[0] != last, key[1:] != key[:-1]]
            group = np.cumsum(fresh)
            heads = places[np.flatnonzero(fresh)]
            if not fresh[0]:
                heads = np.r_[first[None, :], heads]
                group = group + 1
            last, first = key[-1], heads[-1].copy()
            later = batch[(places != heads[group - 1]).any(axis=1)]
            yield pd.DataFrame({"doc": later["doc"], "part": later["part"], "low": later["start"], "high": later["start"] + length})

    ordered = hashed.repartition("key").sortWithinPartitions("key", *place)
    return ordered.mapInPandas(run, "doc long, part long, low long, high long")


def with_shared_cores(rows: list[tuple], length: int, q: int) -> list[tuple]:
    """The contexts of one anchor that share a core with another; of equal ones the earliest.

    Later equal contexts are removed whole anyway.
    """
    earliest: dict[tuple[int, bytes], tuple] = {}
    for r in rows:
        known = earliest.get((r[4], r[5]))
        if known is None or r[1:4] < known[1:4]:
            earliest[r[4], r[5]] = r
    rows = list(earliest.values())
    own = [[(r[0], k, core) for k, core in cores(r[5], -1 - r[4], length, q)] for r in rows]
    seen = Counter(core for found in own for core in found)
    return [r for r, found in zip(rows, own, strict=True) if any(seen[core] > 1 for core in found)]


def index_marks(contexts: DataFrame, length: int, q: int, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc, part, low, high``: stretches to remove, from run-length indexes over whole anchor groups."""

    def marks(rows: list[tuple]) -> pd.DataFrame:
        # an order over documents and places that leaves room for every place of a text
        docs = sorted({(r[1], r[2]) for r in rows})
        room = max(r[3] + len(r[5]) for r in rows) + 1
        number = {d: i * room for i, d in enumerate(docs)}
        index = RunLengthIndex([r[5] for r in rows], np.array([number[r[1], r[2]] + r[3] for r in rows], np.int64), length)
        repeated, _ = index.repeated()
        out, at = [], 0
        for _, doc, part, start, _, body in rows:
            own = np.flatnonzero(repeated[at:at + len(body)])
            out += [(doc, part, start + low, start + high) for low, high in _runs(own, length)]
            at += len(body)
        return pd.DataFrame(out, columns=["doc", "part", "low", "high"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, group = [], 0, []
        for batch in batches:
            for row in zip(*(batch[c].tolist() for c in ("key", "doc", "part", "start", "class", "body")), strict=True):
                if group and row[0] != group[0][0]:
                    kept = with_shared_cores(group, length, q)
                    held.extend(kept)
                    size, group = size + sum(len(r[5]) for r in kept), []
                    if size >= index_bytes:
                        yield marks(held)
                        held, size = [], 0
                group.append(row)
        held.extend(with_shared_cores(group, length, q))
        if held:
            yield marks(held)

    return contexts.repartition("key").sortWithinPartitions("key").mapInPandas(run, "doc long, part long, low long, high long")


def repeated_stretches(docs: DataFrame, length: int = LENGTH, q: int = GRAM, hot: int = HOT_CONTEXTS, shipped: int = SHIPPED_IDS,
                       shipped_grams: int = SHIPPED_GRAMS) -> DataFrame:
    """``doc, part, low, high`` (bytes) covering all that is removed; stretches may overlap and repeat."""
    found = written(sorted_out(anchor_rows(docs, length, q)))
    whole = found.filter("whole").select("doc", "part", F.greatest(F.lit(0), F.col("at") - (length - q)).alias("low"), (F.col("at") + length).alias("high"))
    open_ = found.filter("not whole").drop("whole")
    grams = cut_lineage(open_.groupBy("gram").agg((F.count("*") > hot).alias("hot")))
    contexts = written(context_bytes(docs, open_, grams, length, q, shipped_grams))
    indexed = index_marks(contexts.filter("class < 0"), length, q)
    # of hot anchors only first contexts count, as later ones are removed whole
    first = open_.join(grams.filter("hot"), "gram").select("doc", "part", F.col("at").alias("start"))
    hashed = hashed_marks(docs, contexts.filter("class >= 0").join(first, ["doc", "part", "start"], "left_semi"), length, q, shipped)
    return whole.unionAll(indexed).unionAll(hashed)


def near_ids(docs: DataFrame, ids: DataFrame, shipped: int, how: str = "left_semi") -> DataFrame:
    """Documents among (or not among) the ids; ids are broadcast only when counted small enough."""
    ids = cut_lineage(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= shipped else ids, "doc", how)


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = GRAM, hot: int = HOT_CONTEXTS, id_col: str = "doc_id", text_col: str = "text",
                   shipped: int = SHIPPED_IDS, shipped_grams: int = SHIPPED_GRAMS) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` and the kept bytes (``kept``).

    Documents come in the order of their ids, null last; texts under one id in the order of a
    hash; equal rows with one id are one document and do not remove each other.  A null text is
    empty; texts below ``length`` bytes stay whole; an empty table gives an empty result; other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(text_col).alias("part"), F.col(text_col).alias("text"))
    texts = own.drop("doc_id")
    stretches = repeated_stretches(texts, length, q, hot, shipped, shipped_grams)
    by_doc = written(stretches.groupBy("doc", "part").agg(F.collect_list(F.struct("low", "high")).alias("cuts")))
    touched = by_doc.select("doc").distinct()

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for series, cuts in batches:
            rows = []
            for text, own_cuts in zip(series, cuts, strict=True):
                body = _body(text)
                kept, at, removed, spans, end = [], 0, 0, 0, -1
                for c in sorted((c["low"], c["high"]) for c in (own_cuts if own_cuts is not None else ())):
                    low, high = c[0], min(c[1], len(body))
                    if low > end:
                        kept.append(body[at:low])
                        spans += 1
                        removed += high - low
                        at = end = high
                    elif high > end:
                        removed += high - end
                        at = end = high
                kept.append(body[at:])
                rows.append((len(body), removed, spans, b"".join(kept)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    udf = F.pandas_udf(cut, "n_bytes long, n_removed long, n_spans long, kept binary")
    changed = near_ids(own, touched, shipped).join(by_doc, ["doc", "part"], "left")
    same = near_ids(own, touched, shipped, "left_anti").withColumn("cuts", F.lit(None).cast(by_doc.schema["cuts"].dataType))
    both = changed.select("doc_id", "text", "cuts").unionAll(same.select("doc_id", "text", "cuts"))
    return both.select("doc_id", udf("text", "cuts").alias("c")).select("doc_id", "c.*")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op5_suffix_dedup(spark, sf):
    done = remove_repeats(table(spark, sf, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
