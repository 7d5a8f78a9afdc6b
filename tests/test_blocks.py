"""The block index against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from dossier.operators import blocks

FIELDS = {"project": 10.0, "title": 5.0, "body": 1.0}


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda k: " ".join(rng.choices(words, weights, k=rng.randrange(k)))
    return [(3 * i, text(3), None if i % 17 == 0 else text(6), text(40) + (" rare" * rng.randrange(1, 9) if i in (5, n // 2) else "")) for i in range(n)]


def tokens(t):
    return [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]


def scored(rows, wanted):
    n = len(rows)
    lens = {r[0]: sum(len(tokens(t)) for t in r[1:]) for r in rows}
    mean = sum(lens.values()) / n
    out = {}
    for w in sorted(set(wanted)):
        f = {r[0]: sum(k * tokens(t).count(w) for k, t in zip(FIELDS.values(), r[1:], strict=True)) for r in rows}
        hit = [i for i, x in f.items() if x]
        idf = math.log(1 + (n - len(hit) + 0.5) / (len(hit) + 0.5))
        for i in hit:
            out[i] = out.get(i, 0.0) + idf * f[i] * 2.2 / (f[i] + 1.2 * (0.25 + 0.75 * lens[i] / mean))
    return sorted(((i, round(s, 6)) for i, s in out.items()), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def built(spark):
    rows = corpus(2600, 4)
    df = spark.createDataFrame(rows, "id long, project string, title string, body string").repartition(3)
    return rows, blocks.build(df, "id", FIELDS)


@pytest.mark.parametrize("wanted", [["w0", "w3"], ["rare"], ["rare", "w1", "w59"], ["none"], ["w2", "w2"]])
@pytest.mark.parametrize("k", [1, 10])
def test_top_equals_full_scoring(spark, built, wanted, k):
    rows, ix = built
    got, _ = blocks.top(ix, wanted, k, first=1)
    assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == scored(rows, wanted)[:k]


def test_blocks_that_promise_too_little_are_not_read(spark):
    """The term is strong in one range and weak in the others."""
    rows = [(i, "", "", "pad pad pad pad " + ("hit " * 8 if 2000 <= i < 2012 else "hit" if i % 3 == 0 else "")) for i in range(6000)]
    ix = blocks.build(spark.createDataFrame(rows, "id long, project string, title string, body string"), "id", FIELDS)
    got, ranges = blocks.top(ix, ["hit"], 10, first=1)
    assert [r.id for r in got.orderBy("rank").collect()] == [i for i, _ in scored(rows, ["hit"])[:10]]
    read = [r.blocks for r in ranges.where("read").collect()]
    assert sum(read) == 1 and ranges.count() == 6


def test_phrases(spark, built):
    rows, ix = built
    want = {r[0] for r in rows if any(re.search(r"(^| )w0 w1( |$)", t or "") for t in r[1:])}
    assert {r.id for r in blocks.phrase(ix, ["w0", "w1"]).collect()} == want and want


def test_packing():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 1 << int(b), 50) for b in range(1, 60)] + [[0, 127, 128, 1 << 62]])
    assert (blocks.unpack(blocks.pack(v)) == v).all() and blocks.pack(np.zeros(0)) == b"" and len(blocks.unpack(b"")) == 0


def test_empty_table(spark):
    ix = blocks.build(spark.createDataFrame([], "id long, project string, title string, body string"), "id", FIELDS)
    assert blocks.top(ix, ["a"])[0].count() == 0


def test_postings_reach_blocks_as_rows_in_any_batches(spark, monkeypatch):
    """No list of postings is made for each block, and blocks go on over batches."""
    import random

    import numpy as np

    from dossier.operators import blocks

    rng = random.Random(3)
    docs = [(i, " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(9))), f"w{i % 3}") for i in range(300)]
    plans, cut = [], blocks.cut

    def seen(frame):
        plans.append(frame._jdf.queryExecution().toString())
        return cut(frame)

    monkeypatch.setattr(blocks, "cut", seen)
    monkeypatch.setattr(blocks, "RANGE", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ix = blocks.build(spark.createDataFrame(docs, "id long, a string, b string"), "id", {"a": 1.0, "b": 2.0})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not any("collect_list" in p for p in plans)
    want = {}
    for i, *fields in docs:
        for f, t in enumerate(fields):
            for p, w in enumerate(t.split()):
                want.setdefault(w, {}).setdefault(i, []).append((f, p))
    got = {}
    for b in ix.blocks.collect():
        number = np.cumsum(blocks.unpack(b["docs"])) + b["range"] * blocks.RANGE
        count, step = blocks.unpack(b["counts"]).reshape(-1, 2), blocks.unpack(b["positions"]).tolist()
        assert b["n"] == len(number) == len(blocks.unpack(b["lengths"]))
        for d, each in zip(number.tolist(), count.tolist(), strict=True):
            assert d // blocks.RANGE == b["range"] and d not in got.get(b["term"], {})
            for f, n in enumerate(each):
                for p in np.cumsum([step.pop(0) for _ in range(n)]).tolist():
                    got.setdefault(b["term"], {}).setdefault(d, []).append((f, p))
        assert not step
    assert got == want
