"""Cheapest edits against all lists of edits, and pieces against whole conversations."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest

from tariffloom.llm import conversations as cv

SHAPE = re.compile(r"(s?(ua)+)?")


def all_edits(rows):
    """Least (cost, audit) over every list of edits, inserts at most two in a row."""
    best = None

    def go(at, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0] or roles and roles[0] not in "su" or len(roles) > 1 and roles[-2:] not in cv.LEGAL:
            return
        if at == len(rows):
            if SHAPE.fullmatch(roles):
                best = min(best or (cost, audit), (cost, audit))
        else:
            fault, initial = rows[at]
            extra = 3 if fault == cv.TRUNCATED else 0
            go(at + 1, roles, cost + 4, audit + "D", 0)
            if fault not in (cv.BLANK, cv.DUPLICATE):
                go(at + 1, roles + initial, cost + extra, audit + "K", 0)
                for role in "ua":
                    go(at + 1, roles + role, cost + 3 + extra, audit + "R", 0)
        if inserted < 2:
            for role in "ua":
                go(at, roles + role, cost + 3, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best


def plain(rows):
    """Result of one conversation, rows as (turn, role, text) in order, by strings."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\r\v\f")
        faults.append(cv.BLANK if not body else cv.DUPLICATE if (role, text) in seen else cv.SOUND if body[-1] in ".!?" else cv.TRUNCATED)
        seen.add((role, text))
    states = {"": (0, "", ())}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    def put(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way
            return True
        return False

    def insert(to):
        while any([put(to, step[s], (c + 3, a + "I", (*r, name[step[s]] + ":"))) for s, (c, a, r) in list(to.items())]):
            pass
        return to

    states = insert(states)
    for fault, (_, role, text) in zip(faults, rows, strict=True):
        to = {}
        extra = 3 if fault == cv.TRUNCATED else 0
        for s, (c, a, r) in states.items():
            put(to, s, (c + 4, a + "D", r))
            if fault not in (cv.BLANK, cv.DUPLICATE):
                if (s, role[:1]) in kept:
                    put(to, kept[s, role[:1]], (c + extra, a + "K", (*r, f"{role}:{text}")))
                put(to, step[s], (c + 3 + extra, a + "R", (*r, f"{name[step[s]]}:{text}")))
        states = insert(to)
    cost, audit, left = min(states[s] for s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (cv.BLANK, cv.DUPLICATE, cv.TRUNCATED)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(left).encode()).hexdigest())


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        by[conv] += []
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: plain(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))) for c, r in by.items()}


def found(df):
    got = df.collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


def random_rows(rng, convs):
    texts = ["One.", "Two?", "cut off", "", " \t", "no", "Yes!", "ü漢.", "A longer text that ends well. "]
    rows = []
    for conv, n in convs:
        turns = [rng.choice([None, t, t]) if rng.random() < 0.2 else t + (t > 5) * 3 for t in range(n)]
        seen = set()
        for t in turns:
            if t is not None and t in seen:
                continue  # texts of one turn would need the same order in both
            seen.add(t)
            rows.append((conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "U", None]), rng.choice([*texts, None, *(f"Text {rng.random()}." for _ in range(9))])))
            if t is None:
                seen.add(None)
        rows = [r for i, r in enumerate(rows) if r[1] is not None or (r[0], None) not in {(x[0], x[1]) for x in rows[:i]}]
    return rows


def test_no_list_of_edits_is_cheaper():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.randrange(4), rng.choice("suatx")) for _ in range(rng.randrange(5))]
        audits, states = cv.cheapest(rows)
        got = min((states[s][0], audits.text(states[s][1])) for s in cv.ENDS)
        assert got == all_edits(rows)


def test_audits_compare_as_their_texts():
    rng = random.Random(1)
    audits = cv.Audits()
    nodes = [0]
    for _ in range(600):
        nodes.append(audits.push(rng.choice(nodes[-40:]), rng.choice("DK")))
    for _ in range(4000):
        x, y = rng.choice(nodes), rng.choice(nodes)
        assert audits.less(x, y) == (audits.text(x) < audits.text(y))


def test_hashes_that_collide_are_looked_up(monkeypatch):
    monkeypatch.setattr(cv.Audits, "MODULUS", 3)
    test_audits_compare_as_their_texts()


@pytest.mark.parametrize("piece", [4096, 3, 1])
def test_conversations_equal_plain_strings(spark, piece):
    rng = random.Random(7)
    rows = random_rows(rng, [*((c, rng.randrange(1, 12)) for c in range(60)), (1000, 300), (None, 5), (-3, 1)])
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(5)
    assert found(cv.repair(cv.damaged(df), piece_rows=piece)) == expected(rows)


def test_odd_conversations(spark):
    schema = "conv_id string, turn int, role string, text string, audit string, place long"
    dropped = next(f"c{i}" for i in range(1000) if crc32(f"c{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hello."), *[("same", 1, "user", "Again and again.")] * 40, ("", None, None, None), ("long", 1, "user", "word " * 400_000 + "."), ("long", 2, "assistant", "é" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = found(cv.repair(cv.damaged(df)))
    assert got == expected(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(cv.repair(cv.damaged(df.limit(0)))) == {}
    assert found(cv.repair(cv.damaged(df), piece_rows=7)) == got


def test_rows_as_they_are(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello.")]
    got = found(cv.repair(cv.whole(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert got[1] == plain([r[1:] for r in rows]) and got[1][5:7] == (0, "KKK")
