"""Letter n-grams of a batch of texts as arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

SPACE = 32
#: characters whose arrays (over a hundred bytes for each) are held at once
SLICE = 1 << 18


@functools.cache
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)


def slices(texts: list[str], limit: int = SLICE) -> Iterator[list[str]]:
    """The texts in order in lists of at most ``limit`` characters, or of one longer text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def letter_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with one space between words; and each one's text number.

    Every text begins and ends with a space.
    """
    parts = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) // 4 for p in parts])
    codes = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
    letter = _letter_table()[np.minimum(codes, 0x2FFFF)]
    codes = np.where(letter, codes, SPACE)
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= (codes[1:] == SPACE) & ((codes[:-1] != SPACE) | (owner[1:] != owner[:-1]))
    return codes[keep], owner[keep]


def gram_hash(*codes: np.ndarray, bits: int) -> np.ndarray:
    """A bucket of ``bits`` bits for the n-gram of aligned code arrays."""
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def trigrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams that hold a letter, and each one's text number."""
    codes, owner = letter_stream(texts)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = (owner[2:] == owner[:-2]) & ~((codes[:-2] == SPACE) & (codes[1:-1] == SPACE))
    return gram_hash(codes[:-2], codes[1:-1], codes[2:], bits=bits)[ok], owner[2:][ok]
