"""Secret scans: fixed patterns, and novelty against a primed compressor.

The fixed patterns give the base spans.  The method adds strings that stand after a sensitive
word and that neither the text around them nor the corpus's identifiers explain: a zstandard
compressor primed with the most frequent identifiers of all documents packs the surroundings with
and without the candidate, and the difference, the candidate's marginal bytes, is held against its
length.  Names and words made of known parts cost little; random strings cost almost their length.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import bounded_batches, table

KINDS = ("assign", "access", "hex", "novel")
#: fixed patterns: kind -> pattern, group that is measured, least characters
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: as the hex pattern with its least length, which on maximal runs selects the same matches
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|auth|credential|bearer|signature", re.I | re.A)
#: a number alone is no key
CANDIDATE = re.compile(r"(?=[0-9+/_=~-]*[A-Za-z])[A-Za-z0-9+/_=~-]{8,}")
#: candidates below this length must look random, as words of a text are novel too
LONG = 16
#: the next part of a secret in parts: after a point or a line feed, plain or spelled out
FOLLOWS = re.compile(r"(?:\.|[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)([A-Za-z0-9+/_=~-]+)")
#: names joined by _ . - and camel case; digits are left out, so that a secret copied a
#: thousand times does not become a known name
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]{2,20}(?:[_.-][A-Za-z]{2,20}){1,4}|[a-z]{2,20}(?:[A-Z][a-z]{1,20}){1,4})(?![A-Za-z0-9])")
REACH = 64
AROUND = 256
NAMES = 4096
NOVELTY = 0.62


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        pattern, group, least = PATTERNS["assign"]
        found += [(m.start(), m.end(), "assign") for m in pattern.finditer(text) if len(m[group]) >= least]
    if "AKIA" in text:
        pattern, group, least = PATTERNS["access"]
        found += [(m.start(), m.end(), "access") for m in pattern.finditer(text) if len(m[group]) >= least]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def marginal_bytes(pack, before: str, candidate: str, after: str) -> int:
    """Packed bytes that the candidate adds to its surroundings."""
    encode = lambda s: s.encode("utf-8", "surrogatepass")
    return len(pack(encode(before + candidate + after))) - len(pack(encode(before + after)))


def _candidate(string: str) -> bool:
    """Long, or with digits, or with many capitals after small letters."""
    return CANDIDATE.fullmatch(string) is not None and (
        len(string) >= LONG or re.search("[0-9]", string) is not None or 4 * len(re.findall("[a-z](?=[A-Z])", string)) >= len(string))


def novel_spans(text: str, taken: list[tuple[int, int, str]], pack, novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates after a sensitive word that overlap no base span and are nearly incompressible.

    The parts that follow a candidate directly (the next lines of a key, the next parts of a token)
    are candidates too, however far the word is; a short end with padding goes with a secret.
    """
    found: dict[tuple[int, int], bool] = {}

    def measure(start: int, end: int) -> bool:
        if (start, end) not in found:
            free = all(end <= s or e <= start for s, e, _ in taken)
            found[start, end] = free and marginal_bytes(
                pack, text[max(0, start - AROUND):start], text[start:end], text[end:end + AROUND]) >= novelty * (end - start)
        return found[start, end]

    for word in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, word.end()):
            start, end = m.span()
            if start > word.end() + REACH:
                break
            if (start, end) in found or not _candidate(m[0]):
                continue
            secret = measure(start, end)
            while (part := FOLLOWS.match(text, end)) and part.span(1) not in found:
                end = part.end(1)
                if _candidate(part[1]):
                    secret = measure(*part.span(1))
                else:
                    if secret and len(part[1]) < LONG and part[1].endswith("="):
                        found[part.span(1)] = all(end <= s or e <= part.start(1) for s, e, _ in taken)
                    break
    return [(s, e, "novel") for (s, e), secret in found.items() if secret]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def identifier_names(docs: DataFrame, text_col: str = "text", names: int = NAMES) -> list[str]:
    """The most frequent identifiers of all documents, at most ``names`` of bounded length."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(IDENTIFIER.findall(text or ""))
            if len(seen) > 200_000:
                yield pd.DataFrame(seen.items(), columns=["name", "n"])
                seen.clear()
        yield pd.DataFrame({"name": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "name string, n long")
    top = counts.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(names)
    return [r["name"] for r in top.collect()]


def primed_packer(names: list[str]):
    """A compress function primed with the names, the most frequent last, where they cost least."""
    content = "\n".join(reversed(names)).encode()[-112_000:]
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=3).compress
    primer = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primer).compress


def _redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_col: str = "text", novelty: float = NOVELTY, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with ``secrets``: counts, span texts, and the text with spans replaced.

    A null text is empty and stays null when redacted; overlapping spans are replaced once; every
    row is scanned whole and by itself, so repeated rows get the same result; an empty table gives
    an empty result.  All columns of ``docs`` are kept; the added struct replaces a column of the
    name ``secrets``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = identifier_names(docs, text_col)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pack = primed_packer(names)
        for texts in batches:
            rows = []
            for text in texts:
                body = text or ""
                base = base_spans(body)
                spans = base + novel_spans(body, base, pack, novelty)
                kinds = Counter(kind for _, _, kind in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], joined(base), joined(spans),
                             _redacted(body, spans, mark) if spans else None))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans", "redacted"])

    udf = F.pandas_udf(scan, "n_assign long, n_access long, n_hex long, base string, spans string, redacted string")
    return docs.withColumn("secrets", udf(F.col(text_col)))


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced; all rows stay."""
    kept = [F.coalesce("secrets.redacted", F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return scan_secrets(docs, text_col).select(*kept)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op4_secret_scans(spark, sf):
    found = scan_secrets(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
