"""Conversation repair against a plain search from the end, and its algebra."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dossier.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]


def after_damage(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        held = conv[c]
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        way = zlib.crc32(key.encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if way == 1 else re.sub("[.!?]", "", x) if way == 2 else x
        r = "user" if way == 4 else r
        held += [(t, r, x)] * (0 if way == 0 else 2 if way == 3 else 1)
    for v in conv.values():
        v.sort(key=lambda a: (a[0] is not None, a[0] or 0, a[1], a[2]))
    return conv


def faults_of(v):
    seen, faults = set(), []
    for _, r, x in v:
        y = x.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "-")
        seen.add((r, x))
    return faults


def inserted(best):
    for _ in range(5):
        for s, steps in enumerate(STEP):
            for role, j in steps.items():
                if role != "s" and best[j] is not None:
                    x = (best[j][0] + 2, "I" + best[j][1])
                    best[s] = x if best[s] is None else min(x, best[s])
    return best


def cheapest(v, faults):
    """By the least (cost, audit) from each state to the end."""
    best = inserted([(0, ""), None, None, (0, "")])
    for (_, r, _), f in zip(reversed(v), reversed(faults), strict=True):
        now = []
        for s, steps in enumerate(STEP):
            ways = [(best[s][0] + 3, "D" + best[s][1])] if best[s] else []
            for role, j in steps.items():
                if f not in "bd" and best[j] is not None:
                    ways += [(best[j][0] + (f == "t"), "K" + best[j][1])] * (r[:1] == role)
                    ways += [(best[j][0] + 2 + (f == "t"), "R" + best[j][1])] * (role in "ua")
            now.append(min(ways, default=None))
        best = inserted(now)
    return best[0]


def applied(v, audit):
    state, at, out = 0, 0, []
    for e in audit:
        given = "assistant" if state == 2 else "user"
        if e != "D":
            role, text = (given, "") if e == "I" else (given if e == "R" else v[at][1], v[at][2])
            state = STEP[state][role[0]]
            out.append((e, role, text))
        at += e != "I"
    return out


def expected(rows):
    out = {}
    for c, v in after_damage(rows).items():
        known = {t for t, _, _ in v if t is not None}
        faults = faults_of(v)
        cost, audit = cheapest(v, faults)
        text = "\n".join(f"{r}:{x}" for _, r, x in applied(v, audit))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(v))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def awkward(n, seed, hot=0.4):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "", "other", "Über", None], ["a.", "b", "", "  ", None, "ç!", "\n\t", "x \n"]
    return [(7 if rng.random() < hot else rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(600)]), rng.choice(roles), rng.choice([*texts, "x" * rng.randrange(5) + "."])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize(("n", "chunk"), [(0, 8), (1, 8), (700, 3), (900, 1024)])
def test_equals_search_from_the_end(spark, n, chunk):
    """A hot conversation over all partitions; with chunks of 3 a tree of three levels."""
    rows = awkward(n, n)
    got = turns.repair(frame(spark, rows), chunk=chunk).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)


def test_repaired_turns(spark):
    rows = awkward(300, 5)
    got = defaultdict(list)
    for r in turns.repaired_turns(frame(spark, rows), chunk=16).orderBy("conv_id", "seq", "place").collect():
        got[r.conv_id].append((r.edit, r.role, r.text))
    conv = after_damage(rows)
    assert {c: x for c, v in conv.items() if (x := applied(v, cheapest(v, faults_of(v))[1]))} == got


def test_dropped_conversation_and_long_text(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    fine = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "a."), (fine, 0, "user", "é" * 3_000_000)]
    assert {r.conv_id: tuple(r)[1:] for r in turns.repair(frame(spark, rows)).collect()} == expected(rows)


def test_extreme_turns(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    got = turns.repair(frame(spark, [(i, t, "user", "a.") for i in range(9) for t in (low, high)])).collect()
    assert len(got) == 9 and all(r.gaps in (0, high) for r in got)


def test_products_are_associative():
    rng = random.Random(8)
    for _ in range(200):
        a, b, c = ([list(r) for r in turns.matrix("".join(rng.choices("xsuaoSUAO", k=rng.randrange(4))))] for _ in range(3))
        assert turns.product(turns.product(a, b), c) == turns.product(a, turns.product(b, c))
    for n in range(1, 4):  # every product is the least over all edits
        for symbols in itertools.product("xsuaU", repeat=n):
            m = [list(r) for r in turns.matrix("")]
            for s in symbols:
                m = turns.product(m, [list(r) for r in turns.matrix(s)])
            assert m == [list(r) for r in turns.matrix("".join(symbols))]


def test_damage_by_crc(spark):
    df = spark.range(200).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("system").alias("role"), F.lit("a.b!c?").alias("text"))
    got = defaultdict(list)
    for r in turns.damaged(df).collect():
        got[r.conv_id].append((r.kept, r.role, r.text))
    for i in range(200):
        way = zlib.crc32(f"{i}:0".encode()) % 20
        assert len(got[i]) == 1 + (way == 3) and got[i][0] == (way != 0, "user" if way == 4 else "system", "" if way == 1 else "abc" if way == 2 else "a.b!c?")
