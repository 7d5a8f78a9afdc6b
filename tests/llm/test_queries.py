"""Registered queries against their SQL, the pipeline, and shared helpers."""

import importlib.util
import random

import pytest
from pyspark.sql import functions as F

from compare import connect, same
from dossier.llm import queries, shared

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, connect(FOLDER), queries.queries()[name], queries.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in shared.components(df, shared.Scratch(spark, "t"), "c").collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert shared.components(df.limit(0), shared.Scratch(spark, "t"), "c").count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
    assert cp.run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["op8_piece_segmentations", "pipeline"])
def test_segmentations_come_whole(spark, name):
    """Ids of the encoding and of every sample, which decode to the text."""
    import zlib

    import public_tokenizers

    import corpus_pipeline as cp
    from dossier.llm import pieces

    sp = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).sp
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if name == "pipeline":
        docs = docs.limit(20)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    found = queries.op8_piece_segmentations(spark, FOLDER) if name != "pipeline" else cp.STAGES[-1][1](spark, docs, FOLDER)
    got = found.collect()
    crc = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert {r.doc_id for r in got} == set(text)
    for r in got:
        assert list(r.ids) == sp.encode(text[r.doc_id]) and r.samples
        assert len({tuple(x.ids) for x in r.samples}) == len(r.samples)
        for x in [r, *r.samples]:
            assert x.n_pieces == len(x.ids) and x.ids_crc32 == crc(x.ids) and x.decoded
            assert sp.decode(list(x.ids)) == text[r.doc_id].replace("▁", " ")


AWKWARD = [
    (None, "a row without an id " * 20, "en", "s0", 1),
    (900, None, "en", "s0", None),
    (901, "", None, None, 0),
    (902, " \n\t", "en", "s1", 3),
    (903, "Twice the same row, with a few words of its own in it.", "en", "s1", 9),
    (903, "Twice the same row, with a few words of its own in it.", "en", "s1", 9),
    (904, "Long text. " * 30_000, "en", "s2", 9),
]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_stages_take_awkward_rows(spark):
    """Nulls, empty, repeated and long texts, clashing names, empty tables."""
    import corpus_pipeline as cp

    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(docs)
    more = [F.lit(1).alias(c) for c in ("component", "key", "shard", "score", "kept", "node", "index", "places", "size")]
    clashing = whole.select("*", *more)
    for name, stage in cp.STAGES:
        out = stage(spark, clashing, FOLDER)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "segment":
            assert len(ids) == whole.count()
            continue
        assert out.columns == clashing.columns, name
        if name in ("near_dedup", "passage_dedup"):
            assert {None, 900, 901, 902, 903, 904} <= set(ids) and ids.count(903) == 2
        else:  # texts without words go
            assert not {900, 901, 902} & set(ids)
        assert stage(spark, clashing.limit(0), FOLDER).count() == 0
    assert cp.STAGES[-1][1](spark, clashing.limit(0), FOLDER).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage against what it must keep of its own input."""
    import public_tokenizers

    import corpus_pipeline as cp
    from dossier.llm import mixing, pieces, quality
    from test_documents import WORD, classes, spans, water_filling

    source = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    docs, rows = source, source.collect()
    sp = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).sp
    for name, stage in cp.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "segment":
            out.write.parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
        got = out.collect()
        plain = [(r.doc_id, r.text, r.source) for r in rows]
        if name == "quality_classifier":
            model = quality.fit(docs)
            f = [(r, quality.Features([(r.text or "").encode()])) for r in rows]
            want = {r.doc_id for r, x in f if x.n[0] and 1 / (1 + 2.718281828459045 ** -float(x.scores(model.weights)[0])) >= 0.5}
            assert {r.doc_id for r in got} == want
        elif name == "near_dedup":
            assert {r.doc_id for r in got} == {i for i, (_, c) in classes(plain).items() if i == c}
        elif name == "passage_dedup":
            gone = {}
            for i, s, n, _, repeat in spans(plain):
                if repeat:
                    gone.setdefault(i, set()).update(range(s, s + n))
            for i, text, _ in plain:
                after = next(r.text for r in got if r.doc_id == i)
                assert WORD.findall(after) == [w for k, w in enumerate(WORD.findall(text)) if k not in gone.get(i, ())]
        elif name == "source_mix":
            size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
            total, taken, times = {}, {}, {}
            for r in rows:
                total[r.source] = total.get(r.source, 0) + size[r.doc_id]
            for r in got:
                taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
                times[r.doc_id] = times.get(r.doc_id, 0) + 1
            assert max(times.values()) <= mixing.REPEATS
            for s, want in water_filling(total).items():
                assert abs(taken.get(s, 0) - want) <= 4 * max(size.values())
        else:
            assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((r.doc_id, tuple(sp.encode(r.text))) for r in rows)
        docs, rows = out, got
