"""Token counts of whole texts without making token ids.

The tokenizer cuts a text into pre-tokens and each pre-token into pieces, so a text has as many
tokens as its pre-tokens have pieces.  The count runs as three steps of one job:

1. texts are gathered into chunks of bounded size; a chunk lists its distinct pre-tokens and, for
   each, the documents it is in and how often (the per-document frequencies).  The lists are dealt
   to shards by pre-token.
2. a shard counts the pieces of each distinct pre-token once and turns the lists into one sum per
   document of a chunk (the join).
3. the sums of a chunk's shards are added up.

A pre-token that fills much of a chunk's lists (``the``) is dealt by pre-token and chunk, so that
it is counted once in several shards instead of filling one.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CHUNK_CHARS = 2_000_000
CHUNK_ROWS = 60_000
#: a pre-token with a larger share of a chunk's list entries is dealt by chunk as well
HOT_SHARE = 1 / 512
MEMO = 400_000
#: ASCII white space; every tokenizer here cuts at it, so words can be looked at one by one
WORDS = re.compile(r"[^ \t-\r]+")
OTHER_SPACE = re.compile(r"\s")


class Pretokens(dict):
    """Word -> its pre-tokens as the tokenizer's own first steps give them.

    Words are handed to the tokenizer many at a time with one space between them, where it cuts in
    any case.  A word that holds a special token is one entry marked by a leading NUL (which
    byte-level pre-tokens never contain) and is encoded as it stands; a word that holds other
    white space goes alone.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.normalize = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def learn(self, words: list[str]) -> None:
        """Cut the words that are not known yet; the memory is bounded by starting anew."""
        if len(self) >= MEMO:
            self.clear()
        new, own = [], self.special.search
        for word in words:
            if word in self:
                continue
            if own(word):
                self[word] = ("\0" + word,)
            elif word.isascii() or not OTHER_SPACE.search(word):
                new.append(word)
            else:
                self[word] = tuple(p for p, _ in self.split(self.normalize(word)))
        for at in range(0, len(new), 1000):
            self._cut(new[at:at + 1000])

    def _cut(self, words: list[str]) -> None:
        text = self.normalize(" ".join(words))
        parts = text.split(" ")
        if len(parts) != len(words):
            for word in words:
                self[word] = tuple(p for p, _ in self.split(self.normalize(word)))
            return
        cut: list[list[str]] = [[] for _ in words]
        i, end = 0, len(parts[0])
        for pretoken, (start, _) in self.split(text):
            while start > end:
                i += 1
                end += len(parts[i]) + 1
            cut[i].append(pretoken)
        self.update(zip(words, map(tuple, cut), strict=True))


def piece_count(tokenizer, pretoken: str) -> int:
    if pretoken[0] == "\0":
        return len(tokenizer.encode(pretoken[1:], add_special_tokens=False).ids)
    return len(tokenizer.model.tokenize(pretoken))


def _load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pack(*parts: bytes) -> bytes:
    sizes = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(parts))


def _unpack(body: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 8 * n
    for size in struct.unpack_from(f"<{n}Q", raw):
        out.append(raw[at:at + size])
        at += size
    return out


def _numbered() -> defaultdict:
    """A dict that gives each new key the next number."""
    return defaultdict(count().__next__)


def _expand(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ragged stretches one after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _chunks(path: str, shards: int):
    """Rows (shard, chunk, head, body): lists of a chunk's pre-tokens, and its documents."""

    def close(chunk: int, docs: list, words: dict, occurrences: list[np.ndarray], pretokens: Pretokens) -> pd.DataFrame:
        rows = [(chunk % shards, chunk, True, _pack(
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(), bytes(d is None for d, _ in docs), np.array([n for _, n in docs], "<i8").tobytes()))]
        if words:
            owner = np.repeat(np.arange(len(docs)), [len(o) for o in occurrences])
            pair, times = np.unique(np.concatenate(occurrences) << 16 | owner, return_counts=True)
            pretokens.learn(words)
            own = [pretokens[w] for w in words]
            number = _numbered()
            flat = np.fromiter((number[p] for ps in own for p in ps), np.int64)
            size = np.array([len(ps) for ps in own], np.int64)
            word, doc = pair >> 16, pair & 0xFFFF
            entry = flat[_expand((np.cumsum(size) - size)[word], size[word])]
            doc, times = np.repeat(doc, size[word]), np.repeat(times, size[word])
            names = list(number)
            entries = np.bincount(entry, minlength=len(names))
            seed = np.fromiter((crc32(n.encode()) for n in names), np.int64, len(names))
            for i in np.flatnonzero(entries > max(64, HOT_SHARE * len(entry))).tolist():
                seed[i] = crc32(struct.pack("<q", chunk), int(seed[i]))
            shard = seed % shards
            ordered = np.argsort(shard, kind="stable")
            place = np.empty(len(names), np.int64)
            place[ordered] = np.arange(len(names))
            order = np.argsort(place[entry], kind="stable")
            doc, times, entries, shard = doc[order].astype("<u2"), times[order].astype("<u4"), entries[ordered], shard[ordered]
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            ends = np.cumsum(entries)
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(names)], strict=True):
                cut = slice(int(ends[low - 1]) if low else 0, int(ends[high - 1]))
                rows.append((int(shard[low]), chunk, False, _pack(
                    "\n".join(names[i] for i in ordered[low:high].tolist()).encode(), entries[low:high].astype("<u4").tobytes(), doc[cut].tobytes(), times[cut].tobytes())))
        return pd.DataFrame(rows, columns=["shard", "chunk", "head", "body"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pretokens = Pretokens(_load(path))
        chunk = TaskContext.get().partitionId() << 32
        docs, chars, words, occurrences = [], 0, _numbered(), []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                docs.append((None if pd.isna(doc_id) else int(doc_id), len(text.encode("utf-8", "surrogatepass"))))
                chars += len(text)
                occurrences.append(np.fromiter(map(words.__getitem__, WORDS.findall(text)), np.int64))
                if chars >= CHUNK_CHARS or len(docs) >= CHUNK_ROWS:
                    yield close(chunk, docs, words, occurrences, pretokens)
                    docs, chars, words, occurrences, chunk = [], 0, _numbered(), [], chunk + 1
        if docs:
            yield close(chunk, docs, words, occurrences, pretokens)

    return run


def _shard_sums(path: str):
    """Lists -> (chunk, head, body): sums by document; each distinct pre-token is cut once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _load(path)
        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            for chunk, head, body in zip(batch["chunk"], batch["head"], batch["body"], strict=True):
                if head:
                    rows.append((chunk, True, body))
                    continue
                names, sizes, places, times = _unpack(body, 4)
                counts = []
                for pretoken in names.decode().split("\n"):
                    n = known.get(pretoken)
                    if n is None:
                        if len(known) >= 4 * MEMO:
                            known.clear()
                        n = known[pretoken] = piece_count(tokenizer, pretoken)
                    counts.append(n)
                each = np.repeat(np.array(counts, np.int64), np.frombuffer(sizes, "<u4"))
                # whole numbers far below 2^53, so exact as doubles
                sums = np.bincount(np.frombuffer(places, "<u2"), each * np.frombuffer(times, "<u4").astype(np.int64))
                rows.append((chunk, False, _pack(sums.astype("<i8").tobytes())))
            yield pd.DataFrame(rows, columns=["chunk", "head", "body"])

    return run


def _documents(limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, missing, sizes = _unpack(rows.loc[rows["head"], "body"].iloc[0], 3)
        ids, missing, sizes = np.frombuffer(ids, "<i8"), np.frombuffer(missing, "?"), np.frombuffer(sizes, "<i8")
        total = np.zeros(len(ids), np.int64)
        for body in rows.loc[~rows["head"], "body"]:
            sums = np.frombuffer(_unpack(body, 1)[0], "<i8")
            total[:len(sums)] += sums
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy(), "n_bytes": sizes, "n_tokens": total, "over_limit": total > limit}).assign(
            doc_id=lambda x: x["doc_id"].mask(missing))

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
                 shards: int | None = None) -> DataFrame:
    """Per row: id, bytes, tokens, and whether the tokens are over ``limit``.

    Counts are those of the tokenizer file at ``path`` without added begin or end tokens.  A null
    text is empty, an empty text has no tokens, rows with equal or null ids stay apart, an empty
    table gives an empty result, and other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    lists = texts.mapInPandas(_chunks(path, shards), "shard int, chunk long, head boolean, body binary")
    sums = lists.repartition(shards, "shard").mapInPandas(_shard_sums(path), "chunk long, head boolean, body binary")
    return sums.groupBy("chunk").applyInPandas(
        _documents(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf):
    import public_tokenizers

    return count_tokens(table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY))
