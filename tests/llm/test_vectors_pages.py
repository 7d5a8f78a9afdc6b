"""Vector searches, URL filters and archives."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import ann, mips, urls, warc

V = "vec_id long, embedding array<float>, label int"


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in r], 0) for i, r in enumerate(x)] + list(extra), V)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[300:420] = x[7]  # a vector that many rows share
    return x


def odd(dim):
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (950, [0.0] * dim, 1), (1000, [nan] * dim, 1), (1050, [inf] * dim, 1), (1100, [None] * dim, 1), (1150, [], 1), (None, [1.0] * dim, 1), (1200, [1.0], 1)]


def test_products_equal_brute_force(spark, points, monkeypatch):
    z = np.floor(256 * points.astype(float))
    ids = np.arange(len(z))
    for shard in (mips.SHARD, 150):  # one shard, and several
        monkeypatch.setattr(mips, "SHARD", shard)
        docs = vectors(spark, points, [r for r in odd(16) if r[0] != 950]).withColumn("score", F.lit("x"))
        got = {}
        for r in mips.top_products(docs).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(range(0, 700, 50))
        for q, rows in got.items():
            s = z @ z[q]
            s[q] = -np.inf
            order = np.lexsort((ids, -s))[:5]
            assert rows == [(k + 1, i, int(s[i])) for k, i in enumerate(order)]


def test_zero_vectors_have_products(spark):
    got = mips.top_products(vectors(spark, [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]])).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_nearest_reaches_its_recall_and_exact_scores(spark, points):
    x = points.astype(float)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    ids = np.arange(len(x))
    got = {}
    for r in ann.nearest(vectors(spark, points, odd(16))).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.score == pytest.approx(float(u[r.query_id] @ u[r.vec_id]), abs=1e-12)
    assert set(got) == set(range(0, 700, 50))
    hits = total = 0
    for q, rows in got.items():
        s = u @ u[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -np.round(s, 12)))[:5]
        hits += len({i for i, _ in rows} & set(want.tolist()))
        total += 5
        assert len(rows) == 5
    assert hits / total >= 0.9
    copies = [i for i, _ in got[350]]
    assert copies == [7, 300, 301, 302, 303]


def test_few_and_no_vectors(spark):
    got = ann.nearest(vectors(spark, [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.1]])).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2)]
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert mips.top_products(vectors(spark, [])).count() == 0


def test_probes_come_in_order_and_once():
    sets = ann.probe_sets(6, 60)
    assert sets[0] == [] and sets[1] == [0]
    assert len({tuple(s) for s in sets}) == 60
    assert all(11 - x not in s for s in sets for x in s)


CASES = [
    (None, "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://casino-win.example.com/fr/1", "casino-win.example.com", "/fr/1", "com/fr/", "allow"),
    ("http://casino-win.example.net/en", "casino-win.example.net", "/en", None, "block"),
    ("http://casinos.example.net/en", "casinos.example.net", "/en", None, "allow"),
    ("http://free.example.net/Bets", "free.example.net", "/Bets", None, "block"),
    ("http://free.example.net/free", "free.example.net", "/free", None, "allow"),
    ("http://x.net?casino", "x.net", "", None, "allow"),
    ("x://y://z/w", "y:", "//z/w", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)] + [(None, None, "y")], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert {i: c[1:] for i, c in enumerate(CASES)} == {i: v for i, v in got.items() if i is not None}
    assert len(got) == len(CASES) + 1
    assert urls.judge(df.limit(0)).count() == 0


def test_rules_against_a_list():
    import random

    rng = random.Random(4)
    label = lambda: rng.choice(("a", "b", "org", "x"))
    rules = [(rng.choice(("allow", "block")), ".".join(label() for _ in range(rng.randrange(1, 4))), "/" + "/".join(label() for _ in range(rng.randrange(3)))) for _ in range(60)]
    rules = list({h + p: (v, h, p) for v, h, p in rules}.values())
    known = urls.Rules(rules)
    for _ in range(2000):
        host, path = ".".join(label() for _ in range(rng.randrange(1, 5))), "/" + "/".join(label() for _ in range(rng.randrange(4)))
        fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        got = known.find(host, path)
        assert (got is None) == (not fits)
        assert got is None or (got in fits and len(got[0]) == max(len(f[0]) for f in fits))
    assert known.find("", "") is None


def test_long_and_repeated_urls(spark):
    rows = [(1, "http://a.net/" + "x/" * 50_000 + "porn", 1), (1, "http://a.net/free/bonus", 2), (1, "http://a.net/free/bonus", 2)]
    got = sorted(r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host int")).collect())
    assert got == ["block"] * 3


def recall(df):
    """Of ``nearest`` at 5 against a scan of all rows; ties count as hits."""
    v = df.select("vec_id", "embedding").toPandas()
    x = np.stack(v["embedding"].to_numpy()).astype(np.float64)
    ids = v["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append(r.score)
    q = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[q].tolist())
    hits = 0
    for i in q:
        s = x @ x[i]
        s[i] = -2
        hits += sum(y >= np.sort(s)[-5] - 1e-9 for y in got[int(ids[i])])
    return hits / (5 * len(q))


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    assert recall(spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")) >= 0.9


def test_recall_over_ten_thousand_vectors(spark):
    """64 dimensions, nearly orthogonal directions and a cluster of close ones."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((10_000, 64))
    x[:500] = x[0] + 0.1 * x[:500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(df) >= 0.9


def test_chances_are_those_of_gaussian_neighbours():
    """Of vectors at one distance from a query, as many fall into each bucket as said."""
    rng = np.random.default_rng(3)
    q, far = rng.standard_normal(64), 0.6
    q /= np.linalg.norm(q)
    step = rng.standard_normal((40_000, 64))
    p = ann._project(q[None], 1)[0]
    a, _ = ann._family(64)
    cell = np.floor(p)
    near = np.floor(p + (step / np.linalg.norm(step, axis=1, keepdims=True) * far) @ a[1] / ann.WIDTH) - cell
    moves = ann._moves(p - cell, ann.probe_sets(ann.FUNCTIONS, 50))
    want = np.array([(near == m).all(1).mean() for m in moves])
    assert np.abs(ann.chances(p - cell, moves, far) - want).max() < 0.01


def test_several_vectors_under_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.5])]
    for f in (ann.nearest, mips.top_products):
        one, two = ([tuple(r) for r in f(spark.createDataFrame(x, "vec_id long, embedding array<float>")).collect()] for x in (rows, rows[::-1]))
        assert sorted(one) == sorted(two) and len(one) == 2


def test_hits_against_patterns():
    terms = tuple(sorted(urls.WEIGHTS.items()))
    for text in ("cheap-pills.net/x", "cheap-pillsx", "xxx", "axxx", "free free bets", "pornhub.porn", "spam-farm", ""):
        want = {t: w for t, w in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text)}
        assert urls.hits(text, terms) == want


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives(spark, tmp_path):
    long = "ü" * 60 + "tail"
    rows = [(5, "http://a/\r\nX: y", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", "x"), (7, "u", "z" * 200_000)]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows).withColumn("refers_to", F.lit("x"))).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9}
    for i, _, html in rows:
        if i is not None:
            raw = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3}
    assert warc.round_trip(pages(spark, [])).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages(spark, rows), path)
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path).where("record_type = 'response'").collect()}[3] == long
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0


def test_filters_are_pushed_and_payloads_passed_over(spark, tmp_path, monkeypatch):
    import gzip

    records = [warc.record(i, f"u{i}", "d", 4000, None if i % 2 else 1, b"p" * 4000) for i in range(6)]
    data = b"".join(map(warc._member, records))
    assert gzip.decompress(data) == b"".join(records)
    foreign = b"".join(gzip.compress(r) for r in records)  # members that don't tell their length
    for d in (data, foreign):
        rows = list(warc.read_records(d, lambda r: r["record_type"] == "response", True))
        assert [r["page_id"] for r in rows] == [1, 3, 5] and all(r["payload"] == b"p" * 4000 for r in rows)
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", ("response",))]
    path = f"file://{tmp_path}/v"
    warc.write_pages(pages(spark, [(i, "u", "x" * 150) for i in range(4)]), path)
    df = warc.read(spark, path).where("record_type = 'revisit'")
    assert sorted(r.page_id for r in df.collect()) == [1, 2, 3]


def test_archives_of_repeated_page_ids(spark):
    long = "p" * 300
    rows = [(1, "u", long), (1, "u", long), (1, "v", "other " * 40), (2, "u", long), (3, "u", "other " * 40)]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows)).collect())
    assert got == [(1, "response", None)] * 3 + [(2, "revisit", 1), (3, "revisit", 1)]


def test_searches_with_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], "x", "y", 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, ids string, rep int")
    for f in (ann.nearest, mips.top_products):
        got = f(df).collect()
        assert len(got) == 15 and {r.query_id for r in got} == {0, 50, 100}


def foreign(n, size=3000):
    """Records as others write them: urn ids, Latin-1 in a header, no length of members."""
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + bytes(rng.integers(97, 123, size, np.uint8))
        kind = ("response", "request", "metadata")[i % 3]
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i:08x}-0>\r\nWARC-Refers-To: <urn:uuid:ab-cd>\r\nWARC-Target-URI: <http://x.net/{i}>\r\nX-Note: caf".encode() + b"\xe9" + f"\r\nContent-Length: {len(body)}".encode()
        out.append((kind, body.partition(b"\r\n\r\n")[2], head + b"\r\n\r\n" + body + b"\r\n\r\n"))
    return out


@pytest.mark.parametrize("kind", ["members", "named", "whole"])
def test_archives_of_others(spark, tmp_path, kind):
    import gzip
    import io

    rows = foreign(60)

    def named(data):
        buffer = io.BytesIO()
        with gzip.GzipFile("record with a name.warc", "wb", fileobj=buffer) as f:
            f.write(data)
        return buffer.getvalue()

    pack = named if kind == "named" else gzip.compress
    data = pack(b"".join(r[2] for r in rows)) if kind == "whole" else b"".join(pack(r[2]) for r in rows)
    # after records of our own in the same file, too
    own = warc._member(warc.record(7, "http://y/", "0" * 64, 3, None, b"abc"))
    got = list(warc.read_records(own + data, lambda r: r["record_type"] == "response", True))
    assert [r["payload"] for r in got] == [b"abc"] + [r[1] for r in rows if r[0] == "response"]
    assert got[1]["target_uri"] == "http://x.net/0" and got[1]["refers_to"] is None and got[1]["page_id"] is None
    (tmp_path / "a.warc.gz").write_bytes(data)
    df = warc.read(spark, f"file://{tmp_path}")
    assert df.where("record_type = 'request'").count() == 20 and df.where("payload IS NOT NULL").count() == 20


def test_archives_of_others_in_one_pass():
    """Time grows with the file: once as many members were 60 times as slow."""
    import gzip
    import time

    rows = foreign(6000, 1500)
    data = b"".join(gzip.compress(r[2], 1) for r in rows)
    start = time.perf_counter()
    assert sum(1 for _ in warc.read_records(data, lambda r: True, True)) == 6000
    assert time.perf_counter() - start < 20


def test_members_are_sought_not_read():
    """Of records that aren't wanted only the first bytes are read."""
    import io

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            data = super().read(n)
            Counted.seen += len(data)
            return data

    rng = np.random.default_rng(1)
    data = b"".join(warc._member(warc.record(i, f"http://y/{i}", "0" * 64, 3, None, rng.bytes(50_000))) for i in range(50))
    assert [r["page_id"] for r in warc.read_records(Counted(data), lambda r: r["page_id"] == 20, True)] == [20]
    assert Counted.seen < len(data) / 5
