"""Alignment of two tokenizers over whole texts, and how often their tokens meet in the corpus.

Both tokenizers cut a space and the text into tokens.  Where a token of each ends at one byte the
text is cut into groups; every token of the first inside a group is linked with every token of the
second there.  Token ends come from the libraries' own spans (character offsets of ``tokenizers``,
spans of the piece proto); a span says nothing inside a character, so tokens that hold part of a
character, and byte-fallback tokens, take their ends from their decoded bytes.

Both tokenizers always cut before a single space between two characters that are no white space,
so a word between such spaces has the same tokens wherever it stands.  A chunk of texts therefore
aligns each of its distinct words once, if the worker does not know it from an earlier chunk:

1. a chunk writes its documents' own figures, its distinct pairs of linked ids with the number of
   its documents that hold them, and how often each document holds each (one row a chunk);
2. the pairs' rows are added up by pair, which gives the corpus-wide counts and the best of each
   id; a pair is in a chunk at most once, so no key is hot;
3. each chunk gets the counts of its own pairs back and sums them by document.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, table, written
from tariffloom.llm.tokens import _pack, _unpack

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_CHARS = 6_000_000
CHUNK_ROWS = 60_000
#: aligned words that a worker keeps
MEMO = 400_000
#: words are handed to the tokenizers about so many characters at a time
JOINED_CHARS = 500_000
#: a space that both tokenizers cut at (U+180E is white space in some Unicode versions)
CUT = re.compile(r" (?<=[^\s᠎] )(?=[^\s᠎])")
EDGE = re.compile(r"^[\s᠎]|[\s᠎]$")
PIECE_SPACE = "▁"

DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """One tokenizer: ids and byte ends of a text's tokens."""

    def __init__(self, entries: list[bytes], fallback: list[bool]):
        self.entries = entries
        self.sizes = np.array([len(e) for e in entries], np.int64)

        def whole(entry: bytes) -> bool:
            try:
                entry.decode()
            except UnicodeDecodeError:
                return False
            return True

        #: tokens whose span is coarse: parts of characters, and single bytes
        self.coarse = np.array([f or not whole(e) for e, f in zip(entries, fallback, strict=True)])

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids.tolist()))

    def refined(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Byte ends of tokens: ``ends`` where a token is whole characters, decoded bytes elsewhere.

        A run of coarse tokens is measured from the last end before it.
        """
        coarse = self.coarse[ids]
        if not coarse.any():
            return ends
        sizes = np.where(coarse, self.sizes[ids], 0)
        run = np.cumsum(sizes)
        last = np.maximum.accumulate(np.where(coarse, -1, np.arange(len(ids))))
        base = np.where(last >= 0, ends[last] - run[last], 0)
        return np.where(coarse, base + run, ends)


class ByteLevel(Vocabulary):
    """A byte-level tokenizer of the ``tokenizers`` library; special strings in a text are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        entries = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for entry, i in self.tokenizer.get_vocab().items():
            entries[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        super().__init__(entries, [False] * len(entries))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends in ``' ' + text``."""
        full = " " + text
        got = self.tokenizer.encode(full, add_special_tokens=False)
        ids = np.array(got.ids, np.int64)
        ends = np.fromiter((end for _, end in got.offsets), np.int64, len(ids))
        return ids, self.refined(ids, ends if full.isascii() else byte_places(full)[ends])


class Pieces(Vocabulary):
    """A sentencepiece model that puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        fallback = [self.model.is_byte(i) for i in range(n)]
        entries = [bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if fallback[i]
                   else self.model.id_to_piece(i).replace(PIECE_SPACE, " ").encode() for i in range(n)]
        super().__init__(entries, fallback)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode(text, return_type="proto").pieces
        ids = np.fromiter((p.id for p in got), np.int64, len(got))
        ends = np.fromiter((p.end for p in got), np.int64, len(got))
        size = len(text.encode("utf-8", "surrogatepass"))
        if len(ends) and size != len(text) and ends[-1] == len(text):  # releases that count characters
            ends = byte_places(text)[ends]
        # spans leave out the space that was put before the text
        return ids, self.refined(ids, ends + 1)


def byte_places(text: str) -> np.ndarray:
    """Byte place of each character of ``text``, and of its end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate(([0], np.cumsum(sizes)))


@lru_cache(1)
def vocabularies(first: str, second: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(first), Pieces(second)


class Aligned:
    """Tokens and groups of one stretch of text: ids, and the bounds of its groups in either list."""

    __slots__ = ("a", "a_cuts", "b", "b_cuts", "ends", "fits")

    def __init__(self, first: ByteLevel, second: Pieces, text: str):
        full = b" " + text.encode("utf-8", "surrogatepass")
        (self.a, a_ends), (self.b, b_ends) = first.encode(text), second.encode(text)
        self.fits = first.bytes_of(self.a) == full == second.bytes_of(self.b)
        if self.fits:
            at = np.searchsorted(b_ends, a_ends)
            self.ends = a_ends[b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends]
            self.a_cuts = np.concatenate(([0], np.searchsorted(a_ends, self.ends, "right")))
            self.b_cuts = np.concatenate(([0], np.searchsorted(b_ends, self.ends, "right")))


def split_words(text: str) -> list[str]:
    """Words of a text that has any character: the stretches between spaces that both tokenizers cut at."""
    return CUT.split(text)


class Words:
    """Alignment of distinct words as flat lists: per word its tokens, groups, links and group text."""

    def __init__(self, words: list[str], first: ByteLevel, second: Pieces):
        n = len(words)
        self.fits = np.ones(n, bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.groups = [""] * n
        self._owners, self._pairs = [], []
        self.first, self.second = first, second
        at, size = [], 0
        for i, word in enumerate(words):
            if EDGE.search(word) or PIECE_SPACE in word:
                self._add(words, [i])
                continue
            at.append(i)
            size += len(word)
            if size >= JOINED_CHARS:
                self._add(words, at)
                at, size = [], 0
        if at:
            self._add(words, at)
        owner = np.concatenate(self._owners) if self._owners else np.zeros(0, np.int64)
        pairs = np.concatenate(self._pairs) if self._pairs else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        #: linked ids (first << 32 | second), word after word
        self.pairs = pairs[order]
        self.links_before = np.concatenate(([0], np.cumsum(self.n_links)))

    def _add(self, words: list[str], at: list[int]) -> None:
        """Align the words ``at`` as one stretch with single spaces in between."""
        got = Aligned(self.first, self.second, " ".join([words[i] for i in at]))
        sizes = np.fromiter((len(words[i].encode("utf-8", "surrogatepass")) + 1 for i in at), np.int64, len(at))
        word_ends = np.cumsum(sizes)
        if len(at) > 1 and not (got.fits and (got.ends[np.minimum(np.searchsorted(got.ends, word_ends), len(got.ends) - 1)] == word_ends).all()):
            for i in at:
                self._add(words, [i])
            return
        if not got.fits:
            self.fits[at] = False
            return
        places = np.array(at, np.int64)
        own = np.searchsorted(word_ends, got.ends)  # the word of each group
        a_sizes, b_sizes = np.diff(got.a_cuts), np.diff(got.b_cuts)
        for name, values in (("n_a", a_sizes), ("n_b", b_sizes), ("n_links", a_sizes * b_sizes), ("n_groups", np.ones_like(own))):
            getattr(self, name)[places] = np.bincount(own, values, len(at)).astype(np.int64)
        a_text, b_text = [list(map(str, x.tolist())) for x in (got.a, got.b)]
        a, b = got.a_cuts.tolist(), got.b_cuts.tolist()
        texts = [f"{a_text[a[g]]}|{b_text[b[g]]}" if a[g + 1] - a[g] == 1 == b[g + 1] - b[g]
                 else f"{','.join(a_text[a[g]:a[g + 1]])}|{','.join(b_text[b[g]:b[g + 1]])}" for g in range(len(own))]
        bounds = np.searchsorted(own, np.arange(len(at) + 1)).tolist()
        for k, i in enumerate(at):
            self.groups[i] = ";".join(texts[bounds[k]:bounds[k + 1]])
        # every token of a group with every token of the other side
        group = np.repeat(np.arange(len(own)), a_sizes)
        times = b_sizes[group]
        left = np.repeat(got.a, times)
        right = got.b[np.repeat(got.b_cuts[group] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        self._pairs.append(left << 32 | right)
        self._owners.append(places[np.repeat(own[group], times)])


    def picked(self, at: np.ndarray) -> Words:
        """The words at these places."""
        out = object.__new__(Words)
        for name in ("fits", "n_a", "n_b", "n_groups", "n_links"):
            setattr(out, name, getattr(self, name)[at])
        out.groups = list(map(self.groups.__getitem__, at.tolist()))
        out.links_before = np.concatenate(([0], np.cumsum(out.n_links)))
        out.pairs = self.pairs[np.repeat(self.links_before[at] - out.links_before[:-1], out.n_links) + np.arange(out.links_before[-1])]
        return out

    def extend(self, more: Words) -> None:
        for name in ("fits", "n_a", "n_b", "n_groups", "n_links", "pairs"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(more, name)]))
        self.groups += more.groups
        self.links_before = np.concatenate(([0], np.cumsum(self.n_links)))


class Known:
    """Words that a worker has aligned; when they are too many, those that came up in one chunk only are forgotten."""

    def __init__(self, first: ByteLevel, second: Pieces):
        self.first, self.second = first, second
        self.place: dict[str, int] = {}
        self.words, self.again = Words([], first, second), np.zeros(0, bool)

    def of(self, words: list[str]) -> Words:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > MEMO:
            keep = np.flatnonzero(self.again)
            names = list(self.place)
            self.place = {names[i]: n for n, i in enumerate(keep.tolist())} if len(keep) < MEMO // 2 else {}
            self.words = self.words.picked(keep[:len(self.place)])
            self.again = np.zeros(len(self.place), bool)
            new = [w for w in words if w not in self.place]
        old = len(self.place)
        self.place.update(zip(new, range(old, old + len(new)), strict=True))
        self.words.extend(Words(new, self.first, self.second))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        self.again[at[at < old]] = True
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return self.words.picked(at)


@lru_cache(1)
def known_words(first: str, second: str) -> Known:
    return Known(*vocabularies(first, second))


CHUNKS = pa.schema([("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("body", pa.binary()), ("groups", pa.list_(pa.string()))])


def _close(chunk: int, ids: list, words: dict, texts: list[np.ndarray], memo: Known, keep: bool) -> pa.RecordBatch:
    """The row of a chunk."""
    known = memo.of(list(words))
    fits = np.array([known.fits[t].all() for t in texts], bool)
    used = [t if fit else t[:0] for t, fit in zip(texts, fits, strict=True)]
    figures = np.array([[x[t].sum() for x in (known.n_a, known.n_b, known.n_groups, known.n_links)] for t in used], np.int64).reshape(-1, 4)
    groups = [";".join(map(known.groups.__getitem__, t.tolist())) for t in used]
    digests = "\n".join(hashlib.sha256(g.encode()).hexdigest() if len(t) else "" for g, t in zip(groups, used, strict=True))
    # how often each document holds each word, then each pair
    flat = np.concatenate(used) if used else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(used)), [len(t) for t in used])
    pair, times = np.unique(flat << 16 | owner, return_counts=True)
    word, doc = pair >> 16, pair & 0xFFFF
    sizes = known.n_links[word]
    entry = np.repeat(known.links_before[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    pairs, number = np.unique(known.pairs, return_inverse=True)
    del known
    key = number[entry] << 16 | np.repeat(doc, sizes)
    times = np.repeat(times, sizes)
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    held = np.add.reduceat(times, starts) if len(key) else times
    key = key[starts]
    n_docs = np.bincount(key >> 16, minlength=len(pairs))
    there = n_docs > 0  # words of texts that do not fit are in no document
    body = _pack(np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids), figures.astype("<i8").tobytes(), digests.encode(),
                 n_docs[there].astype("<i4").tobytes(), (key & 0xFFFF).astype("<u2").tobytes(), held.astype("<i8" if len(held) and held.max() > 2**31 else "<u4").tobytes())
    rows = [[chunk], [pairs[there]], [n_docs[there].astype(np.int32)], [body], [groups if keep else None]]
    return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, CHUNKS, strict=True)], schema=CHUNKS)


def _chunks(first: str, second: str, keep: bool, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = known_words(first, second)
        chunk = TaskContext.get().partitionId() << 32
        ids, chars, words, texts = [], 0, defaultdict(count().__next__), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                chars += len(text or "")
                texts.append(np.fromiter(map(words.__getitem__, split_words(text)), np.int64) if text else np.zeros(0, np.int64))
                if chars >= chunk_chars or len(ids) >= CHUNK_ROWS:
                    yield _close(chunk, ids, words, texts, memo, keep)
                    ids, chars, words, texts, chunk = [], 0, defaultdict(count().__next__), [], chunk + 1
        if ids:
            yield _close(chunk, ids, words, texts, memo, keep)

    return run


def _documents(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Rows of a chunk's documents, from its own row and the counts of its pairs."""
    ids, missing, figures, digests, n_docs, doc, held = _unpack(rows["body"].iloc[0], 7)
    ids, missing, figures = np.frombuffer(ids, "<i8"), np.frombuffer(missing, "?"), np.frombuffer(figures, "<i8").reshape(-1, 4)
    doc = np.frombuffer(doc, "<u2").astype(np.int64)
    held = np.frombuffer(held, "<u4" if len(held) == 4 * len(doc) else "<i8").astype(np.int64)
    counts = counts.sort_values("place")
    of = np.repeat(np.arange(len(counts)), np.frombuffer(n_docs, "<i4"))
    sums = np.zeros((2, len(ids)), np.int64)
    np.add.at(sums[0], doc, held * counts["best"].to_numpy(bool)[of])
    np.add.at(sums[1], doc, held * counts["total"].to_numpy(np.int64)[of])
    out = pd.DataFrame({"doc_id": pd.array(ids.copy(), "Int64")})
    out["doc_id"] = out["doc_id"].mask(missing)
    for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
        out[name] = figures[:, i]
    out["n_best"], out["count_sum"] = sums
    out["groups_sha256"] = digests.decode().split("\n")
    if "groups" in rows:
        out["groups"] = list(rows["groups"].iloc[0])
    return out


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False,
          chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row: tokens of either tokenizer, groups, links, corpus-wide counts of the links, and the groups' SHA-256.

    ``first`` is a byte-level file of ``tokenizers``, ``second`` a sentencepiece model that puts a
    space before the text.  ``n_best`` counts links whose pair is in as many documents as any pair
    of its first id (ties all count); ``count_sum`` adds up the documents of each link's pair.  With
    ``groups`` the groups themselves follow as text (``a1,a2|b1;a3|b2``).

    A text that is null or empty, or that either tokenizer does not give back byte by byte, has no
    tokens: zeros and an empty hash, and it counts in no pair.  Rows with equal or null ids stay
    apart and count as documents of their own, an empty table gives an empty result, and other
    columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = written(texts.mapInArrow(_chunks(first, second, groups, chunk_chars), "chunk long, pairs array<long>, held array<int>, body binary, groups array<string>"))
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "own")).select(
        "chunk", "place", F.col("own.pairs").alias("pair"), F.col("own.held").alias("held"))
    totals = rows.groupBy("pair").agg(F.sum("held").alias("total"))
    # at most one row for each id of the first vocabulary
    highest = totals.groupBy(F.shiftright("pair", 32).alias("id")).agg(F.max("total").alias("highest"))
    best = totals.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("id")).select(
        "pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    counts = rows.join(best, "pair").select(F.col("chunk").alias("of"), "place", "total", "best")
    own = chunks.select("chunk", "body", *(["groups"] if groups else []))
    return own.groupBy("chunk").cogroup(counts.groupBy("of")).applyInPandas(_documents, DIGEST + (", groups string" if groups else ""))


def op12_token_alignment(spark, sf):
    import public_tokenizers

    return align(table(spark, sf, "documents"), public_tokenizers.path(FIRST), public_tokenizers.path(SECOND))
