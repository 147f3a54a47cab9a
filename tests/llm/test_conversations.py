"""Conversation repair against a search over all cheapest edits."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from docpipe.llm.conversations import BLOCK, CODES, ENDING, block_costs, damage, least_audits, repair_conversations, repair_report

SCHEMA = "conv_id long, turn long, role string, text string, part string, k string, codes string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def ordered(rows):
    """conv_id -> its rows in order."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in convs.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest edits by Dijkstra over (cost, audit)."""
    bad = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, made
        if (i, last) in done:
            continue
        done.add((i, last))
        due = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, due[0], (*made, (due, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, made))
        if bad[i] in ("blank", "duplicate"):
            continue
        more = 3 if bad[i] == "truncated" else 0
        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, due[0], (*made, (due, text))))
        if role[:1] == due[0] or role[:1] == "s" and last == "":
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*made, (role, text))))


def wanted(rows, convs):
    by_conv, out = ordered(rows), []
    for conv in convs:
        mine = by_conv.get(conv, [])
        cost, audit, made = brute(mine)
        bad, turns = faults(mine), [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def check(spark, rows, convs=None):
    convs = {r[0] for r in rows} if convs is None else convs
    got = repair_report(frame(spark, rows), spark.createDataFrame([(c,) for c in convs], "conv_id long"))
    assert sorted(map(tuple, got.collect()), key=str) == wanted(rows, convs)


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Hello.", "hello", "", " \t", None, "Why?", "é 🙂!", "x\n", "so. \r\n", "a:b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "sys"]
    return [(conv, rng.choice([t, t, t + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.")
            for conv in convs for t in range(rng.randrange(longest))]


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    check(spark, random_rows(seed, [None, *range(60)], 14), [None, *range(62)])


def test_conversations_longer_than_a_block(spark):
    rng = random.Random(3)
    assert BLOCK < 3000
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a", "b."]) + str(i % 50) + rng.choice([".", ""])) for i in range(3000)]
    check(spark, rows + [(2, 1, "user", "hi.")])


def test_blocks_join_to_the_same_edits():
    rng = random.Random(1)
    for _ in range(200):
        codes = "".join(rng.choices(CODES, k=rng.randrange(1, 40)))
        whole, end = least_audits([codes], ENDING[None])
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes)) for _ in range(3))})
        blocks = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        after, afters = ENDING, []
        for block in reversed(blocks):
            afters.append(after)
            after = (block_costs([block])[0] + after).min(1)
        state, audit = 0, ""
        for block, cost in zip(blocks, reversed(afters)):
            found, ends = least_audits([block], np.array([cost]))
            audit += found[0][state]
            state = ends[0][state]
        assert (audit, state) == (whole[0][0], end[0][0])


def test_planted_damage(spark):
    rng = random.Random(9)
    rows = [(None if c == 7 else c, None if rng.random() < 0.05 else t, ["user", "assistant"][t % 2], f"Text {c} {t}. More?")
            for c in range(80) for t in range(rng.randrange(9))]
    got = damage(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(damaged(rows), key=str)
    check(spark, damaged(rows), {r[0] for r in rows})


def test_repaired_rows(spark):
    rows = random_rows(4, range(20), 8)
    got = sorted(map(tuple, repair_conversations(frame(spark, rows)).collect()))
    want = []
    for conv, mine in ordered(rows).items():
        _, audit, made = brute(mine)
        want += [(conv, i, role, text) for i, (role, text) in enumerate(made)]
        assert "".join(r[2] for r in got if r[0] == conv) == audit.replace("D", "")
    assert [(r[0], r[1], r[4], r[5]) for r in got] == sorted(want)
    turns = {(r[0], r[3]) for r in got if r[2] != "I"}
    assert turns <= {(r[0], r[1]) for r in rows} and all(r[3] is None for r in got if r[2] == "I")


def test_odd_tables(spark):
    assert repair_report(frame(spark, [])).collect() == []
    assert repair_conversations(frame(spark, [])).collect() == []
    check(spark, [], [1, None])
    check(spark, [(1, None, None, None), (1, None, None, None), (2, 5, "user", "x" * 300_000), (2, 5, "user", "x" * 300_000), (3, -4, "assistant", "y.")])
    check(spark, [(1, 2, "user", "same.")] * 50)
