"""Source divergence against dense arithmetic, and radix selection against sorting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from dossier.llm import divergence, shared

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "z", 1) for i, (t, g, s) in enumerate(rows)], SCHEMA)


def expected(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole += counts[lang, s]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        shares, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(shares[s][t], q[t])) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return Counter(out)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "été", "Été", "ÀB", "x1y", "a-b", "日本"] + [f"{chr(97 + i % 26)}{'bcdefgh'[i % 7]}{'xyz' * (i % 5)}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(" ".join(rng.choices(words, weights, k=rng.randrange(0, 40))), rng.choice(["en", "fr"]), f"s{rng.randrange(5)}" if rng.random() < 0.6 else "hot") for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "en", "empty"), ("1 2 3", "de", "a"), ("x", "de", "b"), ("the THE the", None, None), ("the", None, "s"), ("The", None, "s"), ("w " * 50_000, "en", "s0")] + [("rep eat", "en", "s2")] * 3


@pytest.mark.parametrize("top", [3, 200])
def test_equals_dense_arithmetic(spark, top):
    rows = corpus(150, top)
    got = divergence.audit(frame(spark, rows), top=top)
    assert Counter(tuple(r) for r in got.collect()) == expected(rows, 3, top)


def test_empty_table_and_single_source(spark):
    assert divergence.audit(frame(spark, []).where("false")).count() == 0
    rows = [("a b", "en", "s")] * 3
    assert Counter(tuple(r) for r in divergence.audit(frame(spark, rows)).collect()) == expected(rows, 3, 200) == Counter()


@pytest.mark.parametrize("seed", range(3))
def test_radix_top(spark, seed):
    """Ties that only the last bytes of long items decide, groups below and above k."""
    rng = random.Random(seed)
    rows = set()
    for _ in range(900):
        g = rng.choice("aab") if rng.random() < 0.98 else "c"
        value = rng.choice([0, 5, 5, (1 << 60) - 1, rng.getrandbits(60), (1 << 45) + rng.randrange(3)])
        rows.add((g, rng.choice(["", "é", "long common beginning " * 2]) + str(rng.randrange(2000)), value))
    rows = list({(g, i): (g, i, v) for g, i, v in rows}.values())
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k in (1, 40, 200):
        got = Counter(tuple(r) for r in divergence.radix_top(df, ["g"], k, shared.Scratch(spark, "t")).collect())
        want = [r for g in "abc" for r in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1].encode()))[:k]]
        assert got == Counter(want)
