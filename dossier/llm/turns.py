"""Conversation structure repair as a min-plus matrix scan.

Roles of a repaired conversation read ``(s?(ua)+)?``: an automaton of four states
(nothing yet, after s, after u, after a).  Each turn is a 4x4 matrix of its edits,
with the closure of inserted turns ahead of it.  Elements are (cost, audit), added by
min and multiplied by adding costs and joining audits.  Two audits of equal cost over
the same turns never begin one another, as the longer one's inserts would cost more,
so the least audit survives on either side of a product: it is associative.

Turns are sorted over ranges, so a long conversation lies in several partitions.  A
conversation that lies within one partition is solved on the way.  Others leave
chunks: matrix, summary and turns.  Matrices are multiplied in a tree, FAN at a time;
on the way back each chunk learns in which state it begins and ends, and its repaired
turns are hashed in their order, streaming.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import Scratch, small_batches

# White space, ends of a finished text, costs of the edits.
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

FAN = 16
CHUNK = 1024
CHUNK_BYTES = 1 << 20

Element = tuple[int, str]
Matrix = list[list[Element | None]]

#: state -> {initial: next state}
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)


def product(a: Matrix, b: Matrix) -> Matrix:
    rows: Matrix = []
    for row in a:
        out: list[Element | None] = [None] * 4
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None and (out[j] is None or (x[0] + y[0], x[1] + y[1]) < out[j]):
                        out[j] = (x[0] + y[0], x[1] + y[1])
        rows.append(out)
    return rows


def _closure() -> Matrix:
    """Any number of inserted turns, from each state to each."""
    one: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i, to in enumerate(STEPS):
        for role, j in to.items():
            if role in "ua":
                one[i][j] = (INSERT, "I")
    return product(product(one, one), product(one, one))


CLOSURE = _closure()


def _turn(symbol: str) -> Matrix:
    """The closure, then one turn: x may only go; capitals are truncated turns."""
    edits: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    for i, to in enumerate(STEPS if symbol != "x" else ()):
        more = TRUNCATED * symbol.isupper()
        for role, j in to.items():
            ways = [(more, "K")] * (role == symbol.lower()) + [(REROLE + more, "R")] * (role in "ua")
            if ways:
                edits[i][j] = min(ways + [edits[i][j]] * (edits[i][j] is not None))
    return product(CLOSURE, edits)


TURNS = {s: _turn(s) for s in "xsuaoSUAO"}
_SPARSE = {s: [(i, j, *x) for i, row in enumerate(m) for j, x in enumerate(row) if x is not None] for s, m in TURNS.items()}


def _from(start: int, symbols: str) -> list[Element | None]:
    """A row of the matrix of many turns, closed at both ends."""
    now: list[Element | None] = [None] * 4
    now[start] = (0, "")
    for s in symbols:
        then: list[Element | None] = [None] * 4
        for i, j, cost, edit in _SPARSE[s]:
            x = now[i]
            if x is not None and (then[j] is None or (x[0] + cost, x[1] + edit) < then[j]):
                then[j] = (x[0] + cost, x[1] + edit)
        now = then
    return product([now], CLOSURE)[0]


@lru_cache(4096)
def matrix(symbols: str) -> tuple[tuple[Element | None, ...], ...]:
    return tuple(tuple(_from(i, symbols)) for i in range(4))


@lru_cache(4096)
def solve(symbols: str) -> Element:
    row = _from(0, symbols)
    return min(row[j] for j in ENDS if row[j] is not None)


def repaired(state: int, audit: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves, from a state on.  Where a
    role is to be given, only one continues."""
    at = 0
    for edit in audit:
        given = "assistant" if state == 2 else "user"
        role, text = (given, "") if edit == "I" else (given if edit == "R" else roles[at], texts[at])
        at += edit != "I"
        if edit != "D":
            state = STEPS[state][role[0]]
            yield edit, role, text


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32(``conv_id:turn``) % 20
    says, null values read as one space; dropped turns stay with ``kept`` false."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), clean("role"), clean("text"), (F.crc32(key.cast("binary")) % 20).alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("role", F.when(F.col("way") == 4, "user").otherwise(F.col("role")))
    return out.select("conv_id", "turn", "role", "text", (F.col("way") != 0).alias("kept"), F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _marked(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``fault`` (b, d, t or -) and ``kind`` (s, u, a or o, by the role's initial)."""
    rest = F.rtrim("text", F.lit(SPACE))
    fault = F.when(rest == "", "b").when(~F.right(rest, F.lit(1)).isin(*STOPS), "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    rows = turns.withColumn("uid", F.monotonically_increasing_id()).withColumns({"fault": fault, "kind": F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), "h1": F.xxhash64(F.lit(1), "role", "text"), "h2": F.xxhash64(F.lit(2), "text", "role")})
    rows = scratch.cut(rows, "turns")
    same = ["conv_id", "h1", "h2"]
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "uid")
    firsts = rows.where("fault <> 'b'").groupBy(*same).agg(F.count("*").alias("n"), F.min(order).getField("uid").alias("first")).where("n > 1")
    firsts = firsts.select(*(F.col(c).alias(c + "_") for c in same), "first")
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")), "left")
    again = (F.col("fault") != "b") & F.col("first").isNotNull() & (F.col("first") != F.col("uid"))
    return met.select("conv_id", "turn", "role", "text", "kind", F.when(again, "d").otherwise(F.col("fault")).alias("fault"), "h1", "uid")


SUMMARY = "blank long, duplicate long, truncated long, illegal long, first_kind string, last_kind string, first_turn long, last_turn long, low long, distinct_turns long"
SEGMENT = f"whole boolean, part int, seq long, {SUMMARY}, cost long, audit string, repaired_sha256 string, costs array<long>, audits array<string>, roles array<string>, texts array<string>, turns array<struct<edit:string,role:string,text:string>>"


def _summary(turns: list, kinds: list[str], faults: list[str]) -> dict:
    known = [t for t in turns if t is not None]
    return {
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False)),
        "first_kind": kinds[0], "last_kind": kinds[-1], "first_turn": turns[0], "last_turn": turns[-1],
        "low": known[0] if known else None, "distinct_turns": len(set(known)),
    }


def _symbols(kinds: list[str], faults: list[str]) -> str:
    return "".join("x" if f in "bd" else k.upper() if f == "t" else k for k, f in zip(kinds, faults, strict=True))


def _digest(turns: list[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None or high is None else min(high - low + 1 - distinct, (1 << 63) - 1)


def _segments(schema: pa.Schema, with_turns: bool, chunk: int):
    """Sorted turns to whole conversations, solved, and chunks of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[tuple] = []
        size, out_size, seq, first, now = 0, 0, 0, True, None

        def close(whole: bool) -> None:
            nonlocal size, out_size, seq
            if held:
                turns, roles, texts, kinds, faults = (list(x) for x in zip(*held, strict=True))
                row = {"conv_id": now, "whole": whole, "part": part, "seq": seq, **_summary(turns, kinds, faults)}
                symbols = _symbols(kinds, faults)
                if whole:
                    cost, audit = solve(symbols)
                    left = list(repaired(0, audit, roles, texts))
                    row |= {"cost": cost, "audit": audit, "repaired_sha256": _digest(left)}
                    if with_turns:
                        row["turns"] = [dict(zip(("edit", "role", "text"), x, strict=True)) for x in left]
                else:
                    flat = [x for r in matrix(symbols) for x in r]
                    row |= {"costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat], "roles": roles, "texts": texts}
                out.append(row)
                out_size += size * (with_turns or not whole) + 200
                held.clear()
            size, seq = 0, seq + 1

        started = False
        for batch in batches:
            for conv, turn, role, text, kind, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind", "fault")), strict=True):
                if not started or conv != now:
                    if started:
                        close(whole=not first and seq == 0)
                        first = False
                    started, now, seq = True, conv, 0
                held.append((turn, role, text, kind, fault))
                size += len(role) + len(text) + 16
                if len(held) >= chunk or size >= CHUNK_BYTES:
                    close(whole=False)
                if len(out) >= 1000 or out_size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, out_size = [], 0
        if started:
            close(whole=False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _matrix_of(costs: list, audits: list) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return [flat[i : i + 4] for i in (0, 4, 8, 12)]


def _multiply(schema: pa.Schema):
    """Matrices of up to FAN neighbours to their product."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        m = _matrix_of(rows[0]["costs"], rows[0]["audits"])
        for r in rows[1:]:
            m = product(m, _matrix_of(r["costs"], r["audits"]))
        flat = [x for r in m for x in r]
        one = {"conv_id": rows[0]["conv_id"], "at": rows[0]["at"] // FAN, "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat]}
        return pa.Table.from_pylist([one], schema)

    return run


def _between(schema: pa.Schema):
    """Of up to FAN neighbours, with the states in which all of them begin and end,
    the states in which each does."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        ways: list[list] = [[None] * 4]
        ways[0][rows[0]["enters"]] = (0, "", -1)
        for r in rows:
            m, then = _matrix_of(r["costs"], r["audits"]), [None] * 4
            for k, x in enumerate(ways[-1]):
                for j, y in enumerate(m[k]):
                    if x is not None and y is not None and (then[j] is None or (x[0] + y[0], x[1] + y[1]) < then[j][:2]):
                        then[j] = (x[0] + y[0], x[1] + y[1], k)
            ways.append(then)
        state, out = rows[0]["leaves"], []
        for r, way in zip(reversed(rows), reversed(ways), strict=False):
            out.append({"conv_id": r["conv_id"], "at": r["at"], "enters": way[state][2], "leaves": state})
            state = way[state][2]
        return pa.Table.from_pylist(out, schema)

    return run


def _joined(schema: pa.Schema, with_turns: bool):
    """Chunks in their order, with their states, to conversations; one chunk of turns
    is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, sha, audit = None, None, None, []

        def done() -> pa.RecordBatch:
            now["audit"] = "".join(audit)
            now["repaired_sha256"] = sha.hexdigest()
            return pa.RecordBatch.from_pylist([now], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["at"] == 0:
                    if now is not None:
                        yield done()
                    now, last, sha, audit = {"conv_id": r["conv_id"], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "seq": 0}, None, hashlib.sha256(), []
                    low, high, distinct, some = None, None, 0, False
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += r[c]
                distinct += r["distinct_turns"]
                if last is not None:
                    now["illegal"] += last["last_kind"] + r["first_kind"] not in ("su", "ua", "au")
                    distinct -= r["first_turn"] is not None and last["last_turn"] == r["first_turn"]
                low = r["low"] if low is None else low
                high = r["last_turn"] if r["last_turn"] is not None else high
                now["gaps"] = _gaps(low, high, distinct)
                at = 4 * r["enters"] + r["leaves"]
                now["cost"] += r["costs"][at]
                audit.append(r["audits"][at])
                left = list(repaired(r["enters"], audit[-1], r["roles"], r["texts"]))
                for _, role, text in left:
                    sha.update(("\n" * some + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    some = True
                if with_turns and left:
                    yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "seq": r["at"], "turns": [dict(zip(("edit", "role", "text"), x, strict=True)) for x in left]}], schema)
                last = {k: r[k] for k in ("last_kind", "last_turn")}
        if now is not None:
            yield done()

    return run


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arrow(spark_schema: StructType) -> pa.Schema:
    return to_arrow_schema(spark_schema)


def _long_ones(parts: DataFrame, scratch: Scratch, with_turns: bool) -> DataFrame:
    """Chunks to conversations: the tree of products, and back."""
    conv = parts.select("conv_id").schema
    of = lambda ddl: StructType(conv.fields + StructType.fromDDL(ddl).fields)
    order = Window.partitionBy("conv_id").orderBy("part", "seq")
    numbered = parts.select("conv_id", "part", "seq", "costs", "audits", (F.row_number().over(order) - 1).cast("long").alias("at"))
    numbered = scratch.cut(numbered, "numbered")
    level, levels = numbered.drop("part", "seq"), []
    node = of("at long, costs array<long>, audits array<string>")
    while level.where("at > 0").first() is not None or not levels:
        levels.append(level)
        up = level.withColumn("up", F.expr(f"at div {FAN}")).groupBy("conv_id", "up").applyInArrow(_multiply(_arrow(node)), node)
        level = scratch.cut(up, f"level-{len(levels)}")
    # entries 0 and 3 of the root are from the start to a state that ends
    worth = lambda j: F.struct(F.col("costs")[j].alias("cost"), F.col("audits")[j].alias("audit"), F.lit(j).alias("leaves"))
    best = F.when(F.col("costs")[0].isNull(), F.lit(3)).when(F.col("costs")[3].isNull(), F.lit(0)).otherwise(F.least(worth(0), worth(3)).getField("leaves"))
    states = level.select("conv_id", "at", F.lit(0).alias("enters"), best.alias("leaves"))
    known = of("at long, enters int, leaves int")
    for k in reversed(range(len(levels))):
        above = states.select(F.col("conv_id").alias("conv_id_"), F.col("at").alias("up"), "enters", "leaves")
        below = levels[k].withColumn("up_", F.expr(f"at div {FAN}"))
        met = below.join(above, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("up_") == F.col("up"))).drop("conv_id_", "up_")
        states = scratch.cut(met.groupBy("conv_id", "up").applyInArrow(_between(_arrow(known)), known), f"states-{k}")
    placed = numbered.select("conv_id", "part", "seq", "at").join(states.select(F.col("conv_id").alias("conv_id_"), F.col("at").alias("at_"), "enters", "leaves"), F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("at") == F.col("at_")))
    placed = placed.select(F.col("part").alias("part_"), F.col("seq").alias("seq_"), "conv_id_", "at", "enters", "leaves")
    chunks = parts.join(placed, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("part") == F.col("part_")) & (F.col("seq") == F.col("seq_")))
    chunks = chunks.drop("conv_id_", "part_", "seq_", "turns", "part", "seq").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    out = of(f"seq long, {RESULT}, turns array<struct<edit:string,role:string,text:string>>")
    return chunks.mapInArrow(_joined(_arrow(out), with_turns), out)


def _solved(rows: DataFrame, with_turns: bool, chunk: int) -> DataFrame:
    spark = rows.sparkSession
    scratch = Scratch(spark, "conversations")
    hurt = damaged(rows)
    marked = _marked(hurt.where("kept").drop("kept"), scratch)
    head = lambda c: F.substring(c, 1, 64)
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), head("role"), head("text"), F.col("h1"), F.col("uid")]
    ordered = marked.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys)
    schema = StructType(ordered.select("conv_id").schema.fields + StructType.fromDDL(SEGMENT).fields)
    with small_batches(spark):
        segments = scratch.cut(ordered.select("conv_id", "turn", "role", "text", "kind", "fault").mapInArrow(_segments(_arrow(schema), with_turns, chunk), schema), "segments")
    whole = segments.where("whole").withColumn("gaps", F.when(F.col("low").isNull(), 0).otherwise(F.expr("try_add(try_subtract(last_turn, low), 1 - distinct_turns)")).cast("long"))
    whole = whole.withColumn("gaps", F.coalesce("gaps", F.lit((1 << 63) - 1)))
    columns = ["conv_id", "seq", *(c.split()[0] for c in RESULT.split(", ")), "turns"]
    none = hurt.groupBy("conv_id").agg(F.max("kept").alias("kept")).where("NOT kept")
    zero = F.lit(0).cast("long")
    none = none.select("conv_id", zero.alias("seq"), *(zero.alias(c) for c in columns[2:8]), F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"), F.lit(None).cast(segments.schema["turns"].dataType).alias("turns"))
    with small_batches(spark):
        long = scratch.cut(_long_ones(segments.where("NOT whole"), scratch, with_turns), "long")
    return whole.select(*columns).unionByName(long.select(*columns)).unionByName(none)


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each conv_id of ``conversations``: gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256, after the damage of ``damaged``.

    Turns of a conversation are taken by turn, nulls first; those of equal turn by the
    first 64 characters of role and text, then by a hash of both.  Null roles and texts
    are one space, so such texts are blank and such roles end in another's place or
    go.  A null conv_id is a conversation like any other.  A role counts by its first
    character; an empty role has none.  A conversation whose turns were all dropped has
    zeros, an empty audit and the hash of nothing.  Gaps beyond the range of a long are
    its largest.  An empty table gives an empty result.  Other columns are not read.
    """
    return _solved(conversations, False, chunk).where("cost IS NOT NULL").drop("seq", "turns")


def repaired_turns(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations themselves: conv_id, seq and place (together the
    order of turns), edit (K, R or I), role and text.  A conversation of which nothing
    is left has no row.  Awkward rows as in ``repair``."""
    rows = _solved(conversations, True, chunk).where("turns IS NOT NULL")
    return rows.select("conv_id", "seq", F.posexplode("turns").alias("place", "x")).select("conv_id", "seq", "place", "x.edit", "x.role", "x.text")
