"""Repair of conversation structure with the cheapest list of edits.

A conversation is well formed when its roles read an optional system row, then user and assistant
in turn, or nothing at all.  Rows are kept, given another role, deleted or put in; a dynamic
program over the four states of that pattern finds the cheapest edits, and of equally cheap ones
the least audit (the edits' initials in order).

Audits are persistent: a state holds a node, which is its last edit and a link to the audit before
it, so prefixes are shared.  A node knows its ancestors at all powers of two and a rolling hash of
its audit; audits of equal cost are compared by a search for their longest common prefix along
those ancestors.  That the prefixes are equal and not merely hashed alike is looked up in full.

Rows are laid out in ranges of conversation and turn, so one conversation of any length spreads
over tasks.  A conversation that lies inside one range is finished there.  Others become pieces of
bounded length; a piece is solved from each state to each state, and pieces are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffloom.llm.common import ASCII_SPACE, bounded_batches, group_key, table, written

PIECE_ROWS, PIECE_CHARS = 4096, 4_000_000
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED_COST = 3
ENDINGS = ".!?"
LEGAL = {"su", "ua", "au"}
#: states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)  # where another role or an inserted row leads
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: order in which inserted rows can help: from nothing or system to user, to assistant, to user
CHAIN = ((START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Audits:
    """Audits as linked nodes; node 0 is the empty audit."""

    MODULUS, BASE = (1 << 61) - 1, 911_382_323

    def __init__(self):
        self.up: list[tuple[int, ...]] = [()]  # ancestors 1, 2, 4 ... edits back
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.same: dict[int, int] = {}  # node -> an older node with the same audit

    def push(self, node: int, edit: str) -> int:
        up, way, k = [node], node, 0
        while k < len(self.up[way]):
            way = self.up[way][k]
            up.append(way)
            k += 1
        self.up.append(tuple(up))
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(edit)) % self.MODULUS)
        return len(self.up) - 1

    def back(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def text(self, node: int, until: int = 0) -> str:
        out = []
        while node != until:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _oldest(self, node: int) -> int:
        while node in self.same:
            node = self.same[node]
        return node

    def _identical(self, x: int, y: int) -> bool:
        """Whether two audits of one length are equal, edit by edit down to what they share."""
        x, y = a, b = self._oldest(x), self._oldest(y)
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self._oldest(self.up[a][0]), self._oldest(self.up[b][0])
        if x != y:
            self.same[max(x, y)] = min(x, y)
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the audit of x comes before that of y."""
        short = min(self.depth[x], self.depth[y])
        a, b = self.back(x, self.depth[x] - short), self.back(y, self.depth[y] - short)
        if self.hash[a] == self.hash[b]:
            if self._identical(a, b):
                return self.depth[x] < self.depth[y]
            return self.text(x) < self.text(y)
        k = len(self.up[a]) - 1
        while k >= 0:
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
            k -= 1
        if self._identical(self.up[a][0], self.up[b][0]):
            return self.edit[a] < self.edit[b]
        return self.text(x) < self.text(y)


def cheapest(rows: Sequence[tuple[int, str]], start: int = START) -> tuple[Audits, dict[int, tuple[int, int]]]:
    """Cheapest cost and least audit (a node) from ``start`` to each state over rows (fault, initial of the role)."""
    audits = Audits()
    states = {start: (0, 0)}

    def offer(to: dict, state: int, cost: int, node: int, edit: str) -> bool:
        """Take an audit if it is better; it is ``node`` and one more edit."""
        held = to.get(state)
        if held is not None and held[0] < cost:
            return False
        new = audits.push(node, edit)
        if held is not None and held[0] == cost and not audits.less(new, held[1]):
            return False
        to[state] = (cost, new)
        return True

    def insert(to: dict) -> dict:
        moved = True
        while moved:  # costs only grow, so at most once round
            moved = False
            for state, after in CHAIN:
                if state in to:
                    moved |= offer(to, after, to[state][0] + INSERT, to[state][1], "I")
        return to

    states = insert(states)
    for fault, initial in rows:
        to: dict[int, tuple[int, int]] = {}
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, (cost, node) in states.items():
            offer(to, state, cost + DELETE, node, "D")
            if fault not in (BLANK, DUPLICATE):
                if (state, initial) in KEPT:
                    offer(to, KEPT[state, initial], cost + KEEP + extra, node, "K")
                offer(to, NEXT[state], cost + REROLE + extra, node, "R")
        states = insert(to)
    return audits, states


def repaired(roles: Sequence[str], texts: Sequence[str], audit: str, state: int = START) -> Iterator[str]:
    """Rows ``role:text`` that an audit leaves or puts in, from ``state`` on."""
    rows = iter(zip(roles, texts, strict=True))
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield f"{NAMES[state]}:"
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEPT[state, role[:1]]
            yield f"{role}:{text}"
        elif edit == "R":
            state = NEXT[state]
            yield f"{NAMES[state]}:{text}"


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def row_faults(roles: Sequence[str], texts: Sequence[str], seen: set[bytes]) -> list[int]:
    """The first fault of each row; ``seen`` are digests of earlier rows and takes these rows' in."""
    out = []
    for role, text in zip(roles, texts, strict=True):
        own = digest(role, text)
        last = text.rstrip(ASCII_SPACE)[-1:]
        out.append(BLANK if not last else DUPLICATE if own in seen else SOUND if last in ENDINGS else TRUNCATED)
        seen.add(own)
    return out


def turn_counts(turns: Sequence[int | None]) -> tuple[int | None, int | None, int]:
    """Least and greatest turn and the number of distinct ones, of turns in order, nulls left out."""
    own = [t for t in turns if t is not None]
    if not own:
        return None, None, 0
    return own[0], own[-1], 1 + sum(a != b for a, b in zip(own, own[1:], strict=False))


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def solve(turns: Sequence[int | None], roles: Sequence[str], texts: Sequence[str]) -> tuple:
    """The result of one whole conversation, in the order of ``RESULT``."""
    faults = row_faults(roles, texts, set())
    initials = [r[:1] for r in roles]
    low, high, distinct = turn_counts(turns)
    audits, states = cheapest(list(zip(faults, initials, strict=True)))
    (cost, node), (other, way) = (states[s] for s in ENDS)
    if other < cost or other == cost and audits.less(way, node):
        cost, node = other, way
    audit = audits.text(node)
    text = "\n".join(repaired(roles, texts, audit))
    return (0 if low is None else high - low + 1 - distinct, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)),
            illegal_pairs(initials), cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())


# ---------------------------------------------------------------- rows, ranges, pieces

def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults by the CRC-32 of ``conversation:turn``; ``copies`` is 0 for a row that is dropped."""
    conv, turn, role, text = F.col(conv_col), F.col(turn_col).cast("bigint"), F.col(role_col), F.col(text_col)
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))) % 20
    cut = rows.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"), kind.alias("kind"))
    return cut.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def whole(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as they are, in the form that ``repair`` takes."""
    space = F.lit(" ")
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"),
                       F.coalesce(F.col(text_col), space).alias("text"), F.lit(1).alias("copies"))


def _fields(ddl: str, conv: T.DataType) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(ddl).fields])
    return schema, to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _laid_out(schema: pa.Schema, piece_rows: int, piece_chars: int):
    """Results of conversations that lie inside a range, and pieces of the others, from rows in order."""
    nothing = (None,) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        current, started, first, split = None, False, True, False
        turns, roles, texts, chars = [], [], [], 0

        def close(ends: bool, last: bool) -> None:
            nonlocal place, turns, roles, texts, chars, first, split
            if ends and not (first or last or split):
                out.append((current, *solve(turns, roles, texts), None, None, None, None))
            else:
                out.append((current, *nothing, place, turns, roles, texts))
                place += 1
            turns, roles, texts, chars = [], [], [], 0
            if ends:
                first, split = False, False
            else:
                split = True

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if started and conv != current:
                    close(True, False)
                current, started = conv, True
                for _ in range(copies):
                    if len(turns) >= piece_rows or chars >= piece_chars:
                        close(False, False)
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    chars += len(role) + len(text)
            if out:
                yield _batch(out, schema)
                out = []
        if started:
            close(True, True)
            yield _batch(out, schema)

    return run


def _solved(schema: pa.Schema):
    """Pieces solved from each state to each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, key, place, turns, roles, texts, seen in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                faults = row_faults(roles, texts, {bytes.fromhex(s) for s in seen or ()})
                initials = [r[:1] for r in roles]
                ways = []
                for start in range(4):
                    audits, states = cheapest(list(zip(faults, initials, strict=True)), start)
                    ways += [(start, to, cost, audits.text(node)) for to, (cost, node) in states.items()]
                rows.append((conv, key, place, len(roles), *turn_counts(turns), *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal_pairs(initials),
                             initials[0] if roles else None, initials[-1] if roles else None, *map(list, zip(*ways, strict=True))))
            yield _batch(rows, schema)

    return run


def _later(x: tuple, y: tuple) -> bool:
    """Whether the audit of path x comes after that of y; a path is (path before, from, to, audit of the piece)."""
    a, b = [], []
    while x is not y:
        a.append(x[3])
        b.append(y[3])
        x, y = x[0], y[0]
    return "".join(reversed(a)) > "".join(reversed(b))


def _joined(schema: pa.Schema):
    """Conversations from their pieces in order: the result without its hash, and each piece's state and audit."""
    root = (None, START, START, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def finish(h: dict) -> pa.RecordBatch:
            paths = h["paths"]
            ends = [paths[s] for s in ENDS if s in paths] if h["n"] else [(0, root)]
            cost, path = ends[0]
            for other, way in ends[1:]:
                if other < cost or other == cost and _later(path, way):
                    cost, path = other, way
            rows, places = [], h["places"]
            while path is not root:
                rows.append((None, h["key"], places[len(places) - 1 - len(rows)], path[1], path[3], *[None] * 6))
                path = path[0]
            rows.reverse()
            gaps = 0 if h["low"] is None else h["high"] - h["low"] + 1 - h["distinct"]
            rows.append((h["conv"], h["key"], None, None, "".join(r[4] for r in rows), gaps, *h["counts"], h["illegal"], cost))
            return _batch(rows, schema)

        for batch in batches:
            for conv, key, place, n, low, high, distinct, blank, duplicate, truncated, illegal, head, tail, starts, tos, costs, audits in zip(
                    *(batch.column(c).to_pylist() for c in range(17)), strict=True):
                if held is not None and held["key"] != key:
                    yield finish(held)
                    held = None
                if held is None:
                    held = {"conv": conv, "key": key, "paths": {START: (0, root)}, "places": [], "n": 0, "low": None, "high": None, "distinct": 0,
                            "counts": [0, 0, 0], "illegal": 0, "tail": None}
                if not n:
                    continue
                to: dict[int, tuple[int, tuple]] = {}
                for start, end, cost, audit in zip(starts, tos, costs, audits, strict=True):
                    if start in held["paths"]:
                        cost += held["paths"][start][0]
                        way = (held["paths"][start][1], start, end, audit)
                        if end not in to or cost < to[end][0] or cost == to[end][0] and _later(to[end][1], way):
                            to[end] = (cost, way)
                held["paths"] = to
                held["places"].append(place)
                held["n"] += n
                if distinct:
                    held["distinct"] += distinct - (held["high"] == low)
                    held["low"], held["high"] = low if held["low"] is None else held["low"], high
                held["counts"] = [a + b for a, b in zip(held["counts"], (blank, duplicate, truncated), strict=True)]
                held["illegal"] += illegal + (held["tail"] is not None and held["tail"] + head not in LEGAL)
                held["tail"] = tail
        if held is not None:
            yield finish(held)

    return run


def _hashed(schema: pa.Schema):
    """SHA-256 of each conversation's repaired rows, from its pieces in order, one piece in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, first = None, None, True
        for batch in batches:
            for key, roles, texts, state, audit in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if sha is not None and key != current:
                    yield _batch([(current, sha.hexdigest())], schema)
                    sha = None
                if sha is None:
                    current, sha, first = key, hashlib.sha256(), True
                for row in repaired(roles, texts, audit, state):
                    sha.update(("" if first else "\n").encode() + row.encode("utf-8", "surrogatepass"))
                    first = False
        if sha is not None:
            yield _batch([(current, sha.hexdigest())], schema)

    return run


def _digest_column(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id, turn, role, text, copies``, from ``damaged`` or ``whole``): faults, edits, result.

    Rows go by turn, nulls first; rows of one turn go by role, by their first 32 characters and by a
    hash of the text, and equal rows are repeats of each other.  Null roles and texts are one space.
    A null ``conv_id`` is a conversation of its own.  A conversation whose rows are all dropped has
    zeros, an empty audit and the hash of nothing; an empty table gives an empty result.  The audit
    of a conversation is one string and its hash goes over all its rows in order, so these two pass
    one task for each conversation, a piece at a time.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    conv = rows.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "__text", "__hash"]
    keyed = rows.select("conv_id", "turn", "role", "text", "copies", F.left("text", F.lit(32)).alias("__text"), F.xxhash64("text").alias("__hash"))
    # equal rows may fill several ranges
    laid = keyed.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    spark_schema, schema = _fields(RESULT + ", place long, turns array<long>, roles array<string>, texts array<string>", conv)
    out = written(laid.mapInArrow(_laid_out(schema, piece_rows, piece_chars), spark_schema))
    done = out.filter(F.col("place").isNull()).select("conv_id", *[f.strip().split()[0] for f in RESULT.split(",")])
    pieces = out.filter(F.col("place").isNotNull()).select("conv_id", group_key("conv_id").alias("ckey"), "place", "turns", "roles", "texts")

    # rows that an earlier piece of their conversation has
    own = pieces.select("ckey", "place", F.explode(F.array_distinct(F.zip_with("roles", "texts", _digest_column))).alias("digest"))
    firsts = own.groupBy("ckey", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("ckey", "digest", "first")
    seen = own.join(firsts, ["ckey", "digest"]).filter("place > first").groupBy("ckey", "place").agg(F.collect_list("digest").alias("seen"))
    spark_schema, schema = _fields("ckey string, place long, n long, low long, high long, distinct_turns long, blank long, duplicate long, truncated long, "
                                   "illegal long, head string, tail string, starts array<long>, tos array<long>, costs array<long>, audits array<string>", conv)
    solved = pieces.join(seen, ["ckey", "place"], "left").select("conv_id", "ckey", "place", "turns", "roles", "texts", "seen").mapInArrow(_solved(schema), spark_schema)
    spark_schema, schema = _fields("ckey string, place long, state long, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long", conv)
    joined = written(solved.repartition("ckey").sortWithinPartitions("ckey", "place").mapInArrow(_joined(schema), spark_schema))
    chosen = joined.filter(F.col("place").isNotNull()).select("ckey", "place", "state", "audit")
    hashed_schema = pa.schema([("ckey", pa.string()), ("repaired_sha256", pa.string())])
    hashed = pieces.join(chosen, ["ckey", "place"]).select("ckey", "place", "roles", "texts", "state", "audit").repartition("ckey").sortWithinPartitions(
        "ckey", "place").select("ckey", "roles", "texts", "state", "audit").mapInArrow(_hashed(hashed_schema), "ckey string, repaired_sha256 string")
    rest = joined.filter(F.col("place").isNull()).join(hashed, "ckey", "left").select(
        "conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return done.unionByName(rest)


def op11_conversation_repair(spark, sf):
    return repair(damaged(table(spark, sf, "conversations")))
