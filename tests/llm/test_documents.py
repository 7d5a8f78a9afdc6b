"""Operators on documents against brute force, and their awkward cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import minhash, mixing, passages, pieces, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 140)), f"s{i % 3}") for i in range(60)]
    shared = prose(rng, 70)
    base = prose(rng, 120, 10_000)
    for i in range(60, 75):  # near copies of one text
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "zzz"
        rows.append((i, " ".join(w), "hot"))
    rows += [(i, prose(rng, 40) + " " + shared + " " + prose(rng, 30), "hot") for i in range(75, 82)]
    rows += [(82, rows[0][1], "s0"), (83, rows[0][1].upper(), "s0"), (84, "", None), (85, None, "s1"), (86, " \t\n", "s1"), (87, "a b c", "s2"), (88, "A b  c", "s2"), (89, "w " * 500, None)]
    return rows


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    return ({tuple(w)} if w else set()) if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def classes(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, corpus, monkeypatch):
    want = classes(corpus)
    for block in (minhash.BLOCK_SHINGLES, 300):  # one block, and many
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
        got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, corpus)).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_awkward_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", "x"), (2, "a b c", "x")]
    docs = frame(spark, rows).withColumn("component_id", F.lit("mine")).withColumn("class", F.lit(0))
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def spans(rows):
    where = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 49):
            where.setdefault(tuple(w[s : s + 50]), []).append((i, s))
    hit = {}
    for places in where.values():
        first = min(i for i, _ in places)
        if first < max(i for i, _ in places):
            for i, s in places:
                hit.setdefault((i, i > first), {})[s] = first
    out = set()
    for (i, later), starts in hit.items():
        run = []
        for s in [*sorted(starts), None]:
            if run and (s is None or s > run[-1] + 50):
                out.add((i, run[0], run[-1] + 50 - run[0], min(starts[x] for x in run), later))
                run = []
            if s is not None:
                run.append(s)
    return out


def test_repeated_spans_equal_brute_force(spark, corpus):
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.repeat) for r in passages.repeated_spans(frame(spark, corpus)).collect()}
    assert got == spans(corpus) and got


def test_shared_prefixes_meet_across_batches(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted((rng.randrange(30), rng.randrange(8), rng.randrange(6)) for _ in range(200))
    texts = {}
    for s, k, _ in rows:
        texts.setdefault(s, set()).add(k)

    def parts(size):
        for i in range(0, len(rows), size):
            s, k, p = zip(*rows[i : i + size])
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(k, pa.int64()), pa.array(p, pa.int32())], names=["prefix", "key", "place"])

    need = {(k, p) for s, k, p in rows if len(texts[s]) > 1}
    for size, buffer in ((1, 1000), (3, 1000), (200, 1000), (7, 4)):
        monkeypatch.setattr(passages, "BUFFER", buffer)
        got = {x for b in passages._shared(parts(size)) for x in zip(b.column("key").to_pylist(), b.column("place").to_pylist())}
        assert need <= got <= {(k, p) for _, k, p in rows}


def test_spans_do_not_depend_on_ranges(spark, corpus, monkeypatch):
    """Runs dealt in parts meet again, whatever the partitions."""
    want = spans(corpus)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(passages, "RUN", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.repeat) for r in passages.repeated_spans(frame(spark, corpus)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_runs_in_parts_make_a_row_a_text(spark, monkeypatch):
    """A passage that texts hold many times: its windows aren't laid out as rows."""
    rng = random.Random(5)
    passage = prose(rng, 56)
    rows = [(i, " ".join([passage, prose(rng, 1)] * 25), "a") for i in range(1, 13)]
    monkeypatch.setattr(passages, "RUN", 40)
    made, cut = {}, passages.shared.Scratch.cut

    def counted(self, df, name, *more):
        out = cut(self, df, name, *more)
        made[name] = out.count()
        return out

    monkeypatch.setattr(passages.shared.Scratch, "cut", counted)
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.repeat) for r in passages.repeated_spans(frame(spark, rows)).collect()}
    assert got == spans(rows) and got
    assert made["many"] and made["matches"] + made.get("owned", 0) < made["suffixes"]


def test_texts_under_one_id(spark):
    """Two texts of one document: no crash, no spans of the other's, no foreign cut."""
    rng = random.Random(11)
    shared_, own, other = prose(rng, 80), prose(rng, 200), prose(rng, 60, 9000)
    rows = [(5, shared_ + " " + prose(rng, 20), "a"), (5, own, "a"), (5, "short text", "a"), (7, other + " " + shared_, "a"), (7, own, "a"), (9, own, "b"), (9, own, "b")]
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.repeat) for r in passages.repeated_spans(frame(spark, rows)).collect()}
    assert got == {(5, 0, 80, 5, False), (7, 60, 80, 5, True), (5, 0, 200, 5, False), (7, 0, 200, 5, True), (9, 0, 200, 5, True)}
    out = sorted((r.doc_id, len(WORD.findall(r.text))) for r in passages.cut_repeats(frame(spark, rows)).collect())
    assert out == [(5, 2), (5, 100), (5, 200), (7, 0), (7, 60), (9, 0), (9, 0)]
    alone = [(1, own, "a"), (1, own + " more words", "a")]
    assert passages.repeated_spans(frame(spark, alone)).count() == 0


def test_near_texts_under_one_id(spark):
    rng = random.Random(12)
    a, b = prose(rng, 60, 5000), prose(rng, 60, 5000)
    docs = frame(spark, [(5, a, "s"), (5, b, "s"), (3, a, "s"), (7, b, "s"), (8, "", "s"), (8, a, "s"), (9, None, "s")])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == [(3, 56, 3), (5, 56, 3), (5, 56, 3), (7, 56, 3), (8, 0, 8), (8, 56, 3), (9, 0, 9)]


def test_collisions_equal_brute_force():
    rng = np.random.default_rng(4)
    sig = rng.integers(1, 4, (60, minhash.COORDINATES)).astype(np.uint64) + np.arange(minhash.COORDINATES, dtype=np.uint64) * np.uint64(1000)
    sig[40:] = rng.integers(1, 1 << 40, (20, minhash.COORDINATES)).astype(np.uint64)
    got = {(i, int(j)): int(h) for i, js, hits in minhash.collisions(sig) for j, h in zip(js, hits)}
    want = {(i, j): n for i in range(60) for j in range(i + 1, 60) if (n := int((sig[i] == sig[j]).sum())) >= minhash.MATCHES}
    assert got == want and want


def test_near_duplicates_without_a_common_original(spark):
    """Copies of copies: no document is near all others, so stars don't settle it."""
    rng = random.Random(8)
    w, rows = prose(rng, 100, 50_000).split(), []
    for i in range(60):
        rows.append((i, " ".join(w), "s"))
        for _ in range(2):
            w[rng.randrange(len(w))] = f"n{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_cut_repeats_keeps_the_rest(spark, corpus):
    docs = frame(spark, corpus).withColumn("places", F.lit(1)).withColumn("window", F.lit("x"))
    out = passages.cut_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i, _, _ in corpus}
    later = {}
    for i, s, n, _, repeat in spans(corpus):
        if repeat:
            later.setdefault(i, set()).update(range(s, s + n))
    for i, t, _ in corpus:
        if i in later:
            assert WORD.findall(got[i].text) == [w for k, w in enumerate(WORD.findall(t)) if k not in later[i]]
            assert got[i].n_chars == len(got[i].text)
        else:
            assert got[i].text == t
    assert passages.cut_repeats(frame(spark, [])).count() == 0
    assert passages.repeated_spans(frame(spark, [(None, prose(random.Random(1), 90), "x")] * 2)).count() == 0


def water_filling(sizes, repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            return full | share
        full |= {s: repeats * sizes[s] for s in over}


def test_mix_meets_targets_and_bounds(spark, corpus):
    docs = frame(spark, corpus)
    size = {i: len(WORD.findall(t or "")) for i, t, _ in corpus}
    total = Counter()
    for i, _, s in corpus:
        total[s] += size[i]
    want = water_filling(total)
    got = mixing.taken(docs, shards=4, blocks=8).collect()
    assert {r.doc_id: r.size for r in got} == size
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
    sums = Counter()
    for r in got:
        sums[r.source] += r.taken
    assert all(abs(sums[s] - want[s]) <= 1 for s in want)
    again = mixing.taken(docs.repartition(5), shards=4, blocks=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_deals_disjoint_blocks(spark, corpus):
    rows = mixing.mix(frame(spark, corpus), shards=5, blocks=6).collect()
    shard = {}
    for r in rows:
        assert shard.setdefault((r.source, r.start), r.shard) == r.shard
        assert 0 <= r.shard < 5
    spans_ = sorted((r.source or "", r.ahead, r.words) for r in rows)
    for (s, a, n), (t, b, _) in zip(spans_, spans_[1:]):
        assert s != t or a + n <= b
    places = [r.place for r in rows]
    assert len(set(places)) == len(places)


def test_mix_tree_splits_exact_quotas(spark):
    goal = spark.createDataFrame([("a", 700, 699.6), ("b", 300, 300.2), (None, 5, 0.2), ("d", 9, 1.0)], "source string, source_size long, target double")
    quota = mixing.quotas(goal, 8, 100)
    assert {r.source: r.quota for r in quota.collect()} == {"a": 558, "b": 240, "d": 2}
    dealt = mixing.deal_units(quota, 8, 1)
    assert {r["count"] for r in dealt.groupBy("shard").count().collect()} == {100}
    # the tree's counts vary as draws without replacement do
    by = [r["count"] for r in dealt.where("source = 'b'").groupBy("shard").count().collect()]
    assert sum(by) == 240 and 1 < np.std(by) < 10
    drawn = mixing.draw_blocks(dealt, 1).collect()
    for s, words in (("a", 700), ("b", 300), ("d", 1)):
        own = sorted((r.start, r.length) for r in drawn if r.source == s)
        assert sum(n for _, n in own) == words
        assert all(x + n <= y for (x, n), (y, _) in zip(own, own[1:]))


def test_mix_follows_the_tree(spark, corpus):
    """The same units in another tree draw other words of the same sum."""
    docs = frame(spark, corpus)
    one, two = ({(r.doc_id, r.size): r.taken for r in mixing.taken(docs, shards=n, blocks=b).collect()} for n, b in ((4, 8), (8, 4)))
    assert one != two and sum(one.values()) == sum(two.values())


def test_mix_of_equal_rows(spark):
    rows = [(1, "one two three four five six seven eight nine ten", "a")] * 6 + [(2, "x " * 50, "b"), (3, "y " * 20, "b")]
    got = mixing.taken(frame(spark, rows)).collect()
    goal = next(r.target for r in got if r.source == "a")
    assert goal == pytest.approx(130 / 3) and len(got) == 8
    assert sum(r.taken for r in got if r.source == "a") == round(goal)
    assert all(r.taken <= 3 * r.size for r in got)
    other = [(1, "a b c", "s"), (1, "a b c d e f", "s"), (1, None, "s"), (1, "a b c", "t"), (1, "a b c", None)]
    first, second = (sorted(map(str, mixing.taken(frame(spark, x)).collect())) for x in (other, other[::-1]))
    assert first == second and len(first) == 5


def test_mixed_documents_come_whole(spark, corpus):
    docs = frame(spark, corpus).withColumn("shard", F.lit(1)).withColumn("index", F.lit("x"))
    out = mixing.mixed_documents(docs, shards=4, blocks=8)
    assert out.columns == docs.columns
    size = {i: len(WORD.findall(t or "")) for i, t, _ in corpus}
    text = {i: t for i, t, _ in corpus}
    got = Counter()
    for r in out.collect():
        assert r.text == text[r.doc_id]
        got[r.doc_id] += 1
    assert max(got.values()) <= 3
    sums, total = Counter(), Counter()
    for i, _, s in corpus:
        sums[s] += got[i] * size[i]
        total[s] += size[i]
    want = water_filling(total)
    assert all(abs(sums[s] - want[s]) <= 4 * max(size.values()) for s in want)
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    twice = mixing.mixed_documents(frame(spark, [(1, "a b", "s"), (1, "a b", "s"), (1, "a", "s"), (2, None, "s"), (None, "c d", None)]))
    assert {(r.doc_id, r.text) for r in twice.collect()} <= {(1, "a b"), (1, "a"), (None, "c d")}


def test_mix_awkward_rows(spark):
    assert mixing.taken(frame(spark, [])).count() == 0
    empty = mixing.taken(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0), (0, 0.0)]
    docs = frame(spark, [(1, "a b", None), (1, "a b", None), (None, "c d e", "s")]).withColumn("taken", F.lit(1))
    got = mixing.taken(docs).collect()
    assert abs(sum(r.taken for r in got if r.source is None) - next(r.target for r in got if r.source is None)) <= 1
    assert mixing.mixed_documents(docs).columns == docs.columns


def noisy(rng, kind):
    w = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(rng.randrange(40, 200))]
    if kind == 0:
        w = [x + rng.choice(("***", "%%%", "###")) for x in w]
    elif kind == 1:
        w = [x.upper() + "!!" for x in w]
    elif kind == 2:
        w = [x for x in w for _ in range(9)]
    return " ".join(w).capitalize() + "."


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_quality_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(i, noisy(rng, i % 12), "s") for i in range(240)] + [(None, None, None), (500, "", "s"), (501, " \n", "s"), (502, noisy(rng, 5), None), (502, noisy(rng, 5), None)]
    docs = frame(spark, rows).withColumn("kept", F.lit("x")).withColumn("score", F.lit(1))
    got = [r for r in quality.classify(docs).collect()]
    assert len(got) == len(rows)
    assert all(not r.kept and r.score == 0 for r in got if r.n_words == 0)
    bad = {i for i in range(240) if i % 12 < 3}
    judged = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 240}
    assert np.mean([judged[i] == (i not in bad) for i in judged]) > 0.97
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and 200 > out.count() > 150
    assert quality.classify(frame(spark, [])).count() == 0


def test_weak_labels_find_each_kind():
    rng = np.random.default_rng(0)
    votes = np.ones((3000, len(quality.LABELLERS)), int)
    kind = rng.integers(0, 10, 3000)
    for j in range(3):
        votes[kind == j, j] = -1
    votes[rng.random(votes.shape) < 0.01] = 0
    codes, counts = np.unique(quality._codes(votes), return_counts=True)
    good, chance, prior = quality.accuracies(codes, counts.astype(float))
    post = dict(zip(codes.tolist(), good))
    assert np.mean([(post[c] > 0.5) == (k > 2) for c, k in zip(quality._codes(votes).tolist(), kind)]) > 0.99
    assert prior == pytest.approx(0.7, abs=0.05)


def plain_em(votes, counts, rounds):
    """The same model, one pattern and one labeller at a time."""
    m = len(votes[0])
    share = []
    for v in votes:
        bad = [j for j in range(m) if v[j] < 0]
        start = [0.0 if bad else 1.0] + [1 / len(bad) if j in bad else 0.0 for j in range(m)]
        share.append([0.98 * x + 0.02 / (m + 1) for x in start])
    for _ in range(rounds):
        weight = [[n * s for s in row] for n, row in zip(counts, share)]
        prior = [(sum(w[c] for w in weight) + 0.1) / (sum(counts) + 0.1 * (m + 1)) for c in range(m + 1)]
        chance = [[{x: sum(w[c] for w, v in zip(weight, votes) if v[j] == x) + 0.1 for x in (-1, 0, 1)} for j in range(m)] for c in range(m + 1)]
        for row in chance:
            for d in row:
                total = sum(d.values())
                for x in d:
                    d[x] /= total
        for i, v in enumerate(votes):
            p = [prior[c] * float(np.prod([chance[c][j][v[j]] for j in range(m)])) for c in range(m + 1)]
            share[i] = [x / sum(p) for x in p]
    return [row[0] for row in share], prior[0], chance


def test_accuracies_equal_plain_estimation():
    rng = np.random.default_rng(6)
    votes = rng.integers(-1, 2, (40, len(quality.LABELLERS)))
    codes, at = np.unique(quality._codes(votes), return_index=True)
    counts = rng.integers(1, 90, len(codes)).astype(float)
    good, chance, prior = quality.accuracies(codes, counts, rounds=7)
    want, want_prior, want_chance = plain_em(votes[at].tolist(), counts.tolist(), 7)
    assert good == pytest.approx(want, abs=1e-9) and prior == pytest.approx(want_prior)
    for c, row in enumerate(want_chance):
        for j, d in enumerate(row):
            assert chance[c, j] == pytest.approx([d[-1], d[0], d[1]])


def test_scorer_equals_plain_training(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 25)
    rng = random.Random(9)
    texts = [noisy(rng, i % 6).encode() for i in range(30)] + [b"", None, b"one"]
    f = quality.Features(texts)
    rows = [f.sparse(i) for i in range(30)]
    good = np.array([rng.random() for _ in range(30)])
    got = quality.train([r[0] for r in rows], [r[1] for r in rows], good)
    w, seen = np.zeros(quality.BUCKETS + 1), np.full(quality.BUCKETS + 1, 1e-6)
    x = np.zeros((30, quality.BUCKETS + 1))
    x[:, -1] = 1
    for i, (index, value) in enumerate(rows):
        x[i, index] = value
    for _ in range(25):
        error = (1 / (1 + np.exp(-(x @ w))) - good) / 30
        slope = x.T @ error
        slope[:-1] += quality.PENALTY * w[:-1]
        seen += slope**2
        w -= quality.RATE * slope / np.sqrt(seen)
    assert got == pytest.approx(w, abs=1e-9)
    scores = f.scores(got)
    assert scores[:30] == pytest.approx(x @ w, abs=1e-9)
    # too short for a labeller: no vote of its
    assert all(v == 0 for v, least in zip(f.votes[32], quality._LEAST) if least > 1)


def test_token_files_equal_the_library(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = ["a<|endoftext|>b  x", "İSTANBUL Σας b\u0085c", "é ́x", "힣 ｶﾞ don't I'LL\tx\x1cy", "ß ÿ Ÿ × ÷ ªº µ", "''s !'s 's' ²½ x²", "naïve—test “q” ..."]
    rows = corpus + [(100 + i, x, "u") for i, x in enumerate(extra)] + [(200, "Long " * 30_000, "u"), (None, "no id", "u")]
    got = {r.doc_id: r for r in tokens.round_trip(frame(spark, rows)).collect()}
    start = 0
    for i, text, _ in sorted((r for r in rows if r[0] is not None)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows) - 1
    assert tokens.round_trip(frame(spark, [])).count() == 0


def test_piece_encoding_and_decoding_equal_the_library(spark, corpus):
    import public_tokenizers

    sp = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).sp
    extra = ["x ", "a  ", " ", " a  b\n c  ", "日本語 Ÿ\x00ab", "é", "q" * 3000]
    rows = corpus + [(100 + i, x, "u") for i, x in enumerate(extra)]
    got = {r.doc_id: r for r in pieces.segmentations(frame(spark, rows), with_ids=True).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert r.ids == sp.encode(text or "") and r.n_pieces == len(r.ids)
        assert r.decoded and all(s.decoded for s in r.samples)
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) >= 1
        for s in r.samples:
            assert sp.decode(s.ids) == (text or "")
            assert s.log_prob <= 1e-9 and s.log_inclusion <= 0
        values = [s.value for s in r.samples]
        assert values == sorted(values, reverse=True)
    again = {r.doc_id: r for r in pieces.segmentations(frame(spark, rows).repartition(7)).collect()}
    assert all([s.ids_crc32 for s in again[i].samples] == [s.ids_crc32 for s in got[i].samples] for i in got)


def lattice_paths(v, text):
    """All segmentations of one chunk, with their weights."""
    if not text:
        return [((), 0.0)]
    out = []
    for i in v.plain:
        if text.startswith(v.text[i]):
            out += [((i, *p), v.score[i] + w) for p, w in lattice_paths(v, text[len(v.text[i]) :])]
    return out


def test_samples_follow_the_lattice_without_replacement():
    import public_tokenizers

    from dossier.llm import words

    coder = pieces.Coder(public_tokenizers.path("piece_bpe_32k.model"))
    n = 6000
    sampler = pieces.Sampler(coder, coder.prepare(["then"] * n), words.mix(np.arange(1, n + 1, dtype=np.uint64)))
    rows = [[tuple(sampler.ids(x["edges"]).tolist()) for x in r] for r in sampler.top(3)]
    paths = lattice_paths(coder.v, "▁then")
    z = np.logaddexp.reduce([w for _, w in paths])
    p = {k: np.exp(w - z) for k, w in paths}
    first, second = Counter(r[0] for r in rows), Counter((r[0], r[1]) for r in rows)
    for k, chance in p.items():
        assert first[k] / n == pytest.approx(chance, abs=4 * np.sqrt(chance / n) + 1e-3)
    for (a, b), times in second.most_common(6):
        chance = p[a] * p[b] / (1 - p[a])
        assert times / n == pytest.approx(chance, abs=4 * np.sqrt(chance / n) + 1e-3)
    assert all(len(set(r)) == 3 for r in rows)


def test_token_files_of_repeated_ids(spark):
    rows = [(2, "b b", "s"), (1, "second text", "s"), (1, "a", "s"), (1, "a", "s"), (3, None, "s"), (4, "long " * 60_000, "s")]
    one, two = (sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.round_trip(frame(spark, x).withColumn("start", F.lit("x")).withColumn("part", F.lit(1))).collect()) for x in (rows, rows[::-1]))
    assert one == two and len(one) == 6
    at = 0
    for _, start, n, _ in sorted(one, key=lambda r: r[1]):
        assert start == at
        at += n


def test_segmentations_of_awkward_rows(spark):
    rows = [(None, "no id here", "s"), (1, "same text", "s"), (1, "same text", "s"), (2, None, None), (3, "", "s"), (4, "Wort " * 50_000 + "x" * 200_000, "s")]
    docs = frame(spark, rows).withColumn("samples", F.lit("x")).withColumn("key", F.lit(1)).withColumn("ids", F.lit(2))
    got = pieces.segmentations(docs).collect()
    assert len(got) == len(rows) and all(r.decoded and all(s.decoded for s in r.samples) for r in got)
    same = [r for r in got if r.doc_id == 1]
    assert [s.ids for s in same[0].samples] == [s.ids for s in same[1].samples]
    assert all(r.n_pieces == 0 and len(r.samples) == 1 and not r.samples[0].ids for r in got if r.doc_id in (2, 3))
    assert pieces.segmentations(frame(spark, [])).count() == 0


def test_segmentation_does_not_depend_on_the_batch(monkeypatch, spark, corpus):
    """The same samples, whatever was remembered and however batches are cut."""
    want = {r.doc_id: r for r in pieces.segmentations(frame(spark, corpus)).collect()}
    import public_tokenizers

    coder = pieces.Coder(public_tokenizers.path("piece_bpe_32k.model"))
    for a in range(0, len(corpus), 7):
        part = [(t or "").replace("▁", " ") for _, t, _ in corpus[a : a + 7]]
        coder.prepare(["other words than these, and again other words"] * 2 + part[::-1])
    texts = [(t or "") for _, t, _ in corpus]
    sp = coder.v.sp
    _, _, ids = coder.prepare(texts)
    assert [x.tolist() for x in ids] == [sp.encode(t) for t in texts]
    assert all(want[i].ids == x.tolist() for (i, _, _), x in zip(corpus, ids))


def test_mix_settings_and_folders(spark):
    from dossier.llm import shared

    before = dict(spark.sparkContext.getConf().getAll())
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    minhash.near_duplicates(frame(spark, [(1, "a b", "s")])).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    assert dict(spark.sparkContext.getConf().getAll()) == before

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.work_dir(Far)


def test_columns_of_any_name_pass_through(spark):
    """Names that an operator might use for itself."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, 1, 2, 3, 4, 5), (2, text, 6, 7, 8, 9, 10), (3, "other " + text, 11, 12, 13, 14, 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone int, __id int, __key int, __cut int, ____ int")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [rows[0]]
    cut = {r.doc_id: tuple(r) for r in passages.cut_repeats(df).collect()}
    assert cut[1] == rows[0] and cut[2][2:] == rows[1][2:] and len(cut[3][1]) < len(rows[2][1])
