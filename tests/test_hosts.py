"""The host machine: its rules, and streams in several triggers against a replay."""

import datetime
import random

import pytest

from dossier.streaming import hosts

SCHEMA = "host string, at timestamp, seq long, url string, verdict string, canary boolean"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def actions(spark, probes, **rules):
    rows = [("h", at(s), i, u, v, c) for i, (s, u, v, c) in enumerate(probes)]
    return [(r.action, r.fails, r.withdrawn) for r in hosts.replay(spark.createDataFrame(rows, SCHEMA), **rules).orderBy("seq").collect()]


def test_refusals_are_not_charged(spark):
    got = actions(spark, [(0, "a", "error", True), (1, "b", "http_error", True), (2, "a", "http_error", False), (3, "b", "ok", True), (90, "a", "error", True), (91, "b", "ok", None)], rest=60)
    # a and b failed before the canary did: both charges are withdrawn
    assert got == [("failed", 1, 0), ("failed", 1, 0), ("refused", 0, 2), ("skipped", 0, 0), ("failed", 1, 0), ("ok", 0, 0)]


def test_every_nth_probe_looks_at_the_canary(spark):
    got = actions(spark, [(i, f"u{i}", "ok", i < 2) for i in range(5)], every=2, rest=60)
    assert [g[0] for g in got] == ["ok", "ok", "ok", "dropped", "skipped"]


def test_giving_up_and_hosts_without_canary(spark):
    got = actions(spark, [(i, "a", "http_error", None) for i in range(4)] + [(9, "b", "error", None), (10, "b", "ok", None), (11, "b", "error", None)], give_up=3)
    assert got == [("failed", 1, 0), ("failed", 2, 0), ("failed", 3, 0), ("given up", 3, 0), ("failed", 1, 0), ("ok", 0, 0), ("failed", 1, 0)]


def made(n, seed):
    rng = random.Random(seed)
    rows, second = [], 0
    for i in range(n):
        second += rng.randrange(4)
        host = "hot" if rng.random() < 0.5 else f"h{rng.randrange(5)}"
        rows.append((host, at(second), i, f"u{rng.randrange(12)}", rng.choice(["ok", "error", "http_error", "soft404"]), None if host == "h0" else rng.random() < 0.8))
    return rows


@pytest.mark.parametrize("cuts", [[400], [1, 130, 270, 400]])
def test_stream_in_triggers_equals_replay(spark, tmp_path, cuts):
    rows = made(400, 3)
    rules = {"every": 4, "give_up": 3, "rest": 40.0}
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        first = 0
        for number, last in enumerate(cuts):  # each part lands, and a lane that resumes takes it
            part = rows[first:last]
            random.Random(number).shuffle(part)
            spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
            first = last
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            q = hosts.watch(stream, **rules).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None and not q.isActive
    finally:
        spark.conf.unset(key)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("host", "seq", "url", "action", "fails", "withdrawn").collect())
    want = sorted(tuple(r) for r in hosts.replay(spark.createDataFrame(rows, SCHEMA), **rules).collect())
    assert got == want and {r[3] for r in want} == {"ok", "failed", "refused", "dropped", "skipped", "given up"}
