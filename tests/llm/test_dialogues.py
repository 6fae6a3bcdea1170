"""Conversation repair against a search over all edits, and its results on odd input."""

import collections
import hashlib
import heapq
import random
import zlib

import pytest

from emberscope.llm import common, dialogues

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        inked = text.strip(BLANK)
        out.append("blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def may_follow(state, initial):
    """State after a role, None if the grammar ``(s?(ua)+)?`` does not allow it; the state is the last initial."""
    return initial if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None


def cheapest(turns, found):
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in ("", "a"):
            return cost, audit, kept
        for role in ("user", "assistant"):
            if may_follow(state, role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], [*kept, f"{role}:"]))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, kept))
            if found[at] not in ("blank", "duplicate"):
                more = 5 * (found[at] == "truncated")
                if may_follow(state, role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], [*kept, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    if may_follow(state, other[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, other[0], [*kept, f"{other}:{text}"]))


def brute(rows):
    by = collections.defaultdict(list)
    for row in rows:
        by[row[0]].append(row)
    out = {}
    for conv, mine in by.items():
        turns = damage(mine)
        found = faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, kept = cheapest(turns, found)
        counts = collections.Counter(found)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def repaired(spark, rows):
    return {r.conv_id: tuple(r)[1:] for r in dialogues.repaired(spark.createDataFrame(rows, SCHEMA)).collect()}


def talks(seed, n, longest):
    pick, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(pick.randrange(1, longest)):
            role = pick.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if pick.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = pick.choice(["Yes.", "No", "Why?", "", " \n", None, f"Turn {turn}.", f"Turn {turn} of {conv}", "Ähm… gut!"])
            rows.append((conv, None if pick.random() < 0.05 else turn + pick.randrange(2), role, text))
    return rows


def test_repairs_against_search(spark):
    rows = talks(1, 250, 12) + [(1000 + c, *x) for c in range(3) for _, *x in talks(2 + c, 1, 2) + [(0, t, "user" if t % 2 else "assistant", f"t{t % 60}" + "." * (t % 3)) for t in range(150 + 64 * c)]]
    got = repaired(spark, rows)
    want = brute(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_long_conversations_run_over_blocks(spark):
    pick = random.Random(9)
    rows = [(c, t, pick.choice(["user", "assistant", "system"]), pick.choice([f"{t}.", f"{t}", "again."])) for c in range(6) for t in range(dialogues.BLOCK * (1 + c) + c - 2)]
    assert repaired(spark, rows) == brute(rows)


def test_odd_conversations(spark):
    dropped = next(c for c in range(1, 500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (dropped, 0, "user", "gone."), (9000, None, None, None), (9001, 3, "assistant", "x" * 100_000)]
    rows += [(9002, 5, "user", "Same."), (9002, 5, "user", "Same."), (9002, 5, "assistant", "Same.")] * 40 + [(9003, None, "user", "a."), (9003, None, "assistant", "b.")]
    got = repaired(spark, rows)
    assert got == brute(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dialogues.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "'x' as word", "2 as tail", "'k' as kind", "map('a', 1) as number")
    assert {r.conv_id: tuple(r)[1:] for r in dialogues.repaired(clash).collect()} == got
    texts = spark.createDataFrame(rows, SCHEMA).selectExpr("'c' || conv_id as conv_id", "turn", "role", "text")
    assert dialogues.repaired(texts).schema["conv_id"].dataType.simpleString() == "string" and dialogues.repaired(texts).count() == len(got)


def test_classes_are_few_and_closed():
    known, steps = dialogues.classes()
    assert len(known) == len(set(known)) == len(steps) < 100
    assert all(0 <= to < len(known) for step in steps for to in step.values())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [("hot", i) for i in range(60)] + [(f"k{i % 7}", 100 + i) for i in range(20)] + [("lost", 200), ("alone", 201)] + [("hotlost", 300 + i) for i in range(40)]
    left = spark.createDataFrame(rows, "k string, v long")
    one = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(7)), ("unused", 5), ("alone", 9)], "k string, w long")
    counts = left.groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    got = sorted(map(tuple, common.hot_join(left, one, counts, ["k"], how).collect()), key=str)
    assert got == sorted(map(tuple, left.join(one, "k", how).collect()), key=str)
    assert len(got) == (122 if how == "left" else 81)
