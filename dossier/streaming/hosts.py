"""Hosts that refuse: canaries, dead hosts and retries that refusals don't charge.

A machine for each host takes its probes in their order.  A probe (host, at, seq, url,
verdict, canary) says how the url answered and how the host's canary, a page known to
be there, answered then; null where the host has none.  Every ``every``-th probe looks
at the canary first, and so does every http error.  A canary that fails kills the host
for ``rest`` seconds: the probe isn't the url's fault, what had failed before since the
host last woke is withdrawn and its charges are given back, and later urls are skipped.
A url that has failed ``give_up`` times is left alone; a success clears its failures.

``replay`` runs the machine over a table, ``watch`` over a stream, where its state
lives in the state store: a head, and a row for each url with failures.  Timers clear
the state of a host whose rest is over, whether or not more probes come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Probes between two looks at a canary, failures after which a url is left alone.
EVERY, GIVE_UP, REST = 25, 3, 3600

OUT = "host string, seq long, url string, action string, fails int, withdrawn int"
#: A url's failures, and how many of them could be withdrawn.
URLS = "fails int, open int"
HEAD = "hits long, until double"


@dataclass
class Memory:
    """The state of a host, in memory."""

    head: tuple[int, float | None] = (0, None)
    urls: dict[str, tuple[int, int]] = field(default_factory=dict)

    def get(self, url: str) -> tuple[int, int]:
        return self.urls.get(url, (0, 0))

    def put(self, url: str, fails: int, held: int) -> None:
        if fails or held:
            self.urls[url] = (fails, held)
        else:
            self.urls.pop(url, None)

    def items(self) -> list[tuple[str, tuple[int, int]]]:
        return list(self.urls.items())


def wake(state) -> None:
    """The host's rest is over: counting starts anew, charges stay."""
    state.head = (0, None)


def step(state, at: float, url: str, verdict: str, canary: bool | None, every: int, give_up: int, rest: float) -> tuple[str, int, int]:
    """Action, failures of the url and how many urls were withdrawn, for one probe."""
    hits, until = state.head
    if until is not None and at >= until:
        wake(state)
        hits, until = state.head
    fails, held = state.get(url)
    if until is not None:
        return "skipped", fails, 0
    if fails >= give_up:
        return "given up", fails, 0
    hits += 1
    looked = hits % every == 0 and canary is False
    if looked or (verdict == "http_error" and canary is False):
        state.head = (hits, at + rest)
        gone = [(u, f, h) for u, (f, h) in state.items() if h]
        for u, f, h in gone:
            state.put(u, f - h, 0)
        return "dropped" if looked else "refused", state.get(url)[0], len(gone)
    state.head = (hits, None)
    if verdict == "ok":
        state.put(url, 0, 0)
        return "ok", 0, 0
    state.put(url, fails + 1, held + 1)
    return "failed", fails + 1, 0


def replay(probes: DataFrame, every: int = EVERY, give_up: int = GIVE_UP, rest: float = REST) -> DataFrame:
    """The machine over a table: host, seq, url, action, fails and withdrawn of each
    probe.  Hosts are dealt over tasks and each task reads its probes in order; it holds
    the state of one host, that is its urls with failures."""
    rows = probes.select("host", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "seq", "url", "verdict", "canary").repartition("host").sortWithinPartitions("host", "at", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, Memory()
        for frame in frames:
            out = []
            for host, at, seq, url, verdict, canary in frame.itertuples(index=False, name=None):
                if host != now:
                    now, state = host, Memory()
                known = None if canary is None or pd.isna(canary) else bool(canary)
                out.append((host, seq, url, *step(state, at / 1e6, url, verdict, known, every, give_up, rest)))
            yield pd.DataFrame(out, columns=["host", "seq", "url", "action", "fails", "withdrawn"])

    return rows.mapInPandas(run, OUT)


class _Kept:
    """The state of a host, in the state store."""

    def __init__(self, head, urls):
        self._head, self._urls = head, urls

    @property
    def head(self) -> tuple[int, float | None]:
        return tuple(self._head.get()) if self._head.exists() else (0, None)

    @head.setter
    def head(self, value: tuple[int, float | None]) -> None:
        self._head.update(value)

    def get(self, url: str) -> tuple[int, int]:
        return tuple(self._urls.getValue((url,))) if self._urls.containsKey((url,)) else (0, 0)

    def put(self, url: str, fails: int, held: int) -> None:
        if fails or held:
            self._urls.updateValue((url,), (fails, held))
        elif self._urls.containsKey((url,)):
            self._urls.removeKey((url,))

    def items(self) -> list[tuple[str, tuple[int, int]]]:
        return [(k[0], tuple(v)) for k, v in self._urls.iterator()]


class HostMachine(StatefulProcessor):
    def __init__(self, every: int, give_up: int, rest: float):
        self.rules = (every, give_up, rest)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = _Kept(handle.getValueState("head", HEAD), handle.getMapState("urls", "url string", URLS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self.state.head[1]
        # a trigger's probes of one host, which its size bounds
        for r in sorted(rows, key=lambda r: (r.micros, r.seq)):
            found = step(self.state, r.micros / 1e6, r.url, r.verdict, r.canary, *self.rules)
            yield Row(host=key[0], seq=r.seq, url=r.url, action=found[0], fails=found[1], withdrawn=found[2])
        after = self.state.head[1]
        if after is not None and after != before:
            self.handle.registerTimer(int(after * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        until = self.state.head[1]
        if until is not None and int(until * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            wake(self.state)
        return iter(())

    def close(self) -> None:
        pass


def watch(probes: DataFrame, late: str = "1 second", every: int = EVERY, give_up: int = GIVE_UP, rest: float = REST) -> DataFrame:
    """The machine over a stream of probes.  Within a trigger they may come in any
    order, from one trigger to the next in that of ``at``; equal times may be in two
    triggers.  The session needs the RocksDB state store.  Results are those of
    ``replay`` over all triggers."""
    rows = probes.withColumn("at", F.col("at").cast("timestamp")).withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    return rows.groupBy("host").transformWithState(HostMachine(every, give_up, rest), OUT, "Append", "EventTime")
