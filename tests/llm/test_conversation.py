"""Repair of conversations against exhaustive search and a plain recursion."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from gazewatch.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    found = []
    for conv, turn, role, text in rows:
        told = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        role = "user" if kind == 4 else told[2]
        text = "" if kind == 1 else re.sub("[.!?]", "", told[3]) if kind == 2 else told[3]
        found += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return found


def faults_of(rows):
    found, seen = [], set()
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        if not solid:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def searched(rows, faults):
    """(cost, audit) by trying every string of edits."""
    best = None
    for size in range(len(rows), len(rows) + 4):
        for audit in itertools.product("DIKR", repeat=size):
            if sum(e != "I" for e in audit) != len(rows):
                continue
            for new in itertools.product("ua", repeat=sum(e in "IR" for e in audit)):
                cost, at, fresh, out = 0, 0, iter(new), ""
                for e in audit:
                    if e != "I":
                        (role, _), fault = rows[at], faults[at]
                        at += 1
                        if e != "D" and fault in ("blank", "duplicate"):
                            cost = 99
                        cost += 3 if e != "D" and fault == "truncated" else 0
                    cost += {"D": 4, "I": 3, "K": 0, "R": 3}[e]
                    out += "" if e == "D" else role[:1] or "-" if e == "K" else next(fresh)
                if legal(out) and (best is None or (cost, "".join(audit)) < best):
                    best = cost, "".join(audit)
    return best


def recursed(rows, faults):
    """(cost, audit) and the repaired rows by a recursion over rows and what was said last."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(at, last, inserts):
        options = [(3 + c, "I" + a, ((follow[last], ""), *r)) for c, a, r in [best(at, follow[last], inserts + 1)]] if inserts < 3 else []
        if at == len(rows):
            return min([*options, *([(0, "", ())] if last in ("", "a") else [])], default=(10**6, "", ()))
        (role, text), extra = rows[at], 3 if faults[at] == "truncated" else 0
        options += [(4 + c, "D" + a, r) for c, a, r in [best(at + 1, last, 0)]]
        if faults[at] not in ("blank", "duplicate"):
            options += [(3 + extra + c, "R" + a, ((follow[last], text), *r)) for c, a, r in [best(at + 1, follow[last], 0)]]
            if role[:1] == follow[last] or (role[:1] == "s" and last == ""):
                options += [(extra + c, "K" + a, ((role, text), *r)) for c, a, r in [best(at + 1, role[:1], 0)]]
        return min(options, key=lambda o: o[:2])

    for at in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        best(at, "", 0)
    cost, audit, left = best(0, "", 0)
    return cost, audit, [(name.get(role, role), text) for role, text in left]


def brute(rows):
    """{conv_id: the report} of rows after damage."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn is not None, turn or 0, role, text))
    found = {}
    for conv, group in held.items():
        group.sort()
        said = [(role, text) for _, _, role, text in group]
        faults = faults_of(said)
        turns = {t for some, t, *_ in group if some}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        cost, audit, left = recursed(said, faults)
        whole = "\n".join(f"{role}:{text}" for role, text in left)
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())
    return found


NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def some(seed, n=60, longest=12):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", " ", "", "ok?", "a.\n", "é 😀.", "x"]
    rows = []
    for conv in range(n):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "sys", "agent", None])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), role, draw.choice([*texts, f"said {draw.random()}.", None])))
    return rows


def told(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_the_programme_finds_what_trying_everything_finds():
    draw = random.Random(1)
    for n in (0, 1, 2, 3, 3):
        for _ in range(6 if n < 3 else 3):
            rows = [(draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice(["a.", "b", "c.", ""])) for _ in range(n)]
            faults = faults_of(rows)
            assert recursed(rows, faults)[:2] == searched(rows, faults)
            runs = conversation.written(conversation.runs_of(conversation.symbol(r[:1], f) for (r, _), f in zip(rows, faults, strict=True)))
            ((state, letters),) = conversation.unrolled(runs, conversation.END, (conversation.START,))
            missing = "I" * (conversation.END[state] // 3)
            cost = conversation.applied(conversation.matrix(runs), conversation.END)[conversation.START]
            assert (cost, letters + missing) == searched(rows, faults)


@pytest.mark.parametrize("tile", [1, 3, 256])
def test_reports(spark, monkeypatch, tile):
    monkeypatch.setattr(conversation, "TILE_TURNS", tile)
    rows = some(tile)
    rows += [(None, 1, "user", "hi."), (None, 2, "user", "hi."), (None, None, None, None)]
    rows += rows[:5]  # repeated rows
    raw = spark.createDataFrame(rows, SCHEMA).repartition(4)
    hurt = conversation.damaged(raw)
    want = {c: NONE for c, *_ in rows} | brute(brute_damage(rows))
    got = told(conversation.report(hurt, raw).collect())
    assert got == want
    assert sorted(map(repr, map(tuple, hurt.collect()))) == sorted(map(repr, brute_damage(rows)))


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation, "TILE_TURNS", 50)
    draw = random.Random(9)
    rows = [(7, t, draw.choice(["user", "assistant"]), draw.choice(["same.", f"{t}.", f"{t}"])) for t in range(400)]
    rows += [(8, t, "user", "u.") for t in range(300)] + [(8, 300, "assistant", "long " * 300_000)]
    rows += [(9, 2**62, "user", "far."), (9, -(2**62), "assistant", "away.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = told(conversation.report(frame, frame).collect())
    want = brute([r for r in rows if r[0] != 9])
    assert {c: got[c] for c in want} == want
    kept = conversation.repaired(frame.where("conv_id = 7")).collect()
    said = [f"{r.role}:{r.text}" for r in sorted(kept, key=lambda r: (r.tile, r.nth))]
    assert hashlib.sha256("\n".join(said).encode()).hexdigest() == got[7][-1]


def test_powers_are_repeated_steps():
    for row in "suaoSUAOx":
        step, whole = conversation.power_of_two(row, 0), conversation.IDENTITY
        for n in range(1, 20):
            whole = conversation.times(whole, step)
            assert conversation.matrix(f"{row}{n}") == whole


def test_no_rows_and_other_columns(spark):
    raw = spark.createDataFrame([(1, 0, "user", "a.", "x", 3)], SCHEMA + ", tile string, digest int")
    assert conversation.report(conversation.damaged(raw.limit(0)), raw.limit(0)).collect() == []
    assert told(conversation.report(raw.limit(0), raw).collect()) == {1: NONE}
    assert told(conversation.report(raw, raw).collect()) == brute([(1, 0, "user", "a.")])
