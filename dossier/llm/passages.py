"""Repeated passages by a sparse suffix array.

1. Suffixes are retained only at content-selected positions: the leftmost
   minimum of the hashes of ``GRAM`` words among the first ``SPAN`` positions of
   any window of ``LENGTH`` words.  Equal windows select the same position, so
   every passage of ``LENGTH`` words that repeats has a retained suffix in each
   of its copies, with at least ``PREFIX`` common words from there on.  Texts
   that occur more than once take part once.
2. A first sort, of the hashes of the suffixes' first PREFIX words alone, drops
   those that no other text shares: each is compared with its neighbours.
3. The suffixes that are left are sorted by their words (the
   first PREFIX as one symbol, the rest one by one) and compared with their
   neighbours: the common prefix of neighbours tells how far to the right each
   match extends, and the words to the left, compared backwards, how far to the
   left.  Together they tell which windows around a suffix other documents hold
   too; the smallest document that holds a window owns it.
4. Equal prefixes meet in one task, unless more than ``RUN`` suffixes have one: then
   they are dealt over many, text by text.  Each part names its windows once, with the
   first and last document that it has of them; these are aggregated over the cluster,
   and the owners go back to the parts, where the suffixes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

LENGTH, GRAM, SPAN = 50, 5, 21
PREFIX = LENGTH - SPAN + 1
SIDE = SPAN - 1
BUFFER = RUN = 1 << 16
_STEP = 1 << 15
_PIECE = 1 << 13  # suffixes of a part whose windows are laid out at once


def selected(h: np.ndarray) -> np.ndarray:
    """For each window of LENGTH words, the position of its retained suffix."""
    n = len(h) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(n + SPAN - 1)
    grams = words.spans(h, at, at + GRAM)
    out = np.empty(n, np.int64)
    for a in range(0, n, _STEP):
        b = min(n, a + _STEP)
        out[a:b] = sliding_window_view(grams[a : b + SPAN - 1], SPAN).argmin(axis=1) + np.arange(a, b)
    return out


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.trim()
    for batch in batches:
        keys, texts = batch.column("key").to_numpy(), shared.texts_of(batch)
        for a, b in words.batches(texts):
            h, first, *_ = words.hash_words(texts[a:b])
            key, place, prefix = [], [], []
            for i in range(b - a):
                own = h[first[i] : first[i + 1]]
                p = np.unique(selected(own))
                if len(p):
                    key.append(np.full(len(p), keys[a + i]))
                    place.append(p)
                    prefix.append(words.spans(own, p, p + PREFIX))
            if key:
                yield _batch({"prefix": np.concatenate(prefix).view(np.int64), "key": np.concatenate(key), "place": np.concatenate(place).astype(np.int32)})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by prefix and text, those whose prefix two texts share,
    each once.  What lies at the ends of the range is kept unseen."""
    shared.trim()
    held: list[np.ndarray] = []  # the last run, which may go on
    start = True

    def rows(parts: list[np.ndarray], whole: bool) -> Iterator[pa.RecordBatch]:
        """whole: the last run is complete; the first run of a range never is."""
        nonlocal start
        s, k, p = parts
        if not len(s):
            return
        head = np.r_[True, s[1:] != s[:-1]]
        run = np.cumsum(head) - 1
        several = np.zeros(run[-1] + 1, bool)
        several[run[1:][~head[1:] & (k[1:] != k[:-1])]] = True
        several[0] |= start
        several[-1] |= not whole
        start = False
        once = np.r_[True, head[1:] | (k[1:] != k[:-1]) | (p[1:] != p[:-1])]
        keep = several[run] & once
        if keep.any():
            yield _batch({"key": k[keep], "place": p[keep]})

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(c).to_numpy() for c in ("prefix", "key", "place")]
        if held:
            parts = [np.concatenate(x) for x in zip(held, parts)]
        last = int(np.searchsorted(parts[0], parts[0][-1]))
        if len(parts[0]) - last > BUFFER:  # a very long run is kept part by part
            yield from rows(parts, False)
            start, held = True, []
            continue
        yield from rows([x[:last] for x in parts], True)
        held = [x[last:].copy() for x in parts]
    if held:
        yield from rows(held, False)


def _bytes(codes: np.ndarray, real: np.ndarray) -> pa.Array:
    """The real codes of each row as one binary value."""
    ends = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(4 * real.sum(axis=1), out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes[real].astype(">u4").tobytes())])


def _codes(column: pa.Array) -> np.ndarray:
    """The codes of each row, SIDE columns, 0 where a row has fewer."""
    column = pa.concat_arrays([column])  # offsets from 0
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[: len(column) + 1].astype(np.int64) // 4
    flat = np.frombuffer(data, ">u4") if data is not None else np.zeros(0, ">u4")
    out = np.zeros((len(column), SIDE), np.uint32)
    n = np.diff(ends)
    out[np.arange(SIDE) < n[:, None]] = flat[: ends[-1]]
    return out


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Retained suffixes with the words around them that their windows hold, and
    a row without words for each text that has copies (near, far: its windows)."""
    shared.trim()
    for batch in batches:
        doc, last, key = (batch.column(c).to_numpy() for c in ("doc", "last", "key"))
        texts, places = shared.texts_of(batch), batch.column("places")
        for a, b in words.batches(texts):
            h, first, *_ = words.hash_words(texts[a:b])
            out: dict[str, list] = {c: [] for c in ("prefix", "row", "place", "near", "far")}
            right, left, right_real, left_real = [], [], [], []
            for i in range(b - a):
                own = h[first[i] : first[i + 1]]
                pick = selected(own)
                if not len(pick):
                    continue
                code = (own >> np.uint64(32)).astype(np.uint32)
                values = places[a + i].values
                p = np.zeros(0, np.int64) if values is None else np.sort(values.to_numpy()).astype(np.int64)
                # windows that select a suffix are neighbours: first and last start
                lo, hi = np.searchsorted(pick, p), np.searchsorted(pick, p, "right") - 1
                near, far, side = p - hi, p - lo, np.arange(SIDE)
                to_right, to_left = side < (SIDE - near)[:, None], side < far[:, None]
                right.append(code[np.minimum(p[:, None] + PREFIX + side, len(own) - 1)])
                left.append(code[np.maximum(p[:, None] - 1 - side, 0)])
                right_real.append(to_right)
                left_real.append(to_left)
                for name, x in (("prefix", words.spans(own, p, p + PREFIX).view(np.int64)), ("row", np.full(len(p), a + i)), ("place", p), ("near", near), ("far", far)):
                    out[name].append(x)
                if last[a + i] > doc[a + i]:
                    right.append(np.zeros((1, SIDE), np.uint32))
                    left.append(right[-1])
                    right_real.append(np.zeros((1, SIDE), bool))
                    left_real.append(right_real[-1])
                    for name, x in (("prefix", 0), ("row", a + i), ("place", -1), ("near", 0), ("far", len(pick) - 1)):
                        out[name].append(np.array([x]))
            if out["row"]:
                x = {name: np.concatenate(v) for name, v in out.items()}
                row = x["row"]
                r, l = (_bytes(np.concatenate(c), np.concatenate(m)) for c, m in ((right, right_real), (left, left_real)))
                yield _batch({"prefix": x["prefix"], "right": r, "left": l, "doc": doc[row], "last": last[row], "key": key[row], "place": x["place"].astype(np.int32), "near": x["near"].astype(np.int32), "far": x["far"].astype(np.int32)})


_RANGES = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("first", pa.int64())]))
SUFFIX = "prefix long, right binary, left binary, doc long, last long, key long, place int, near int, far int"
RANGES = "array<struct<low:int,high:int,first:long>>"
MATCH = f"doc long, key long, rows {RANGES}"
WINDOW = "window long, first long, final long, part long"


def _arrays(batch: pa.RecordBatch) -> tuple:
    x = {c: batch.column(c).to_numpy() for c in ("prefix", "doc", "last", "key", "place", "near", "far")}
    return (x["prefix"], _codes(batch.column("right")), _codes(batch.column("left")), x["doc"], x["last"], x["key"], x["place"].astype(np.int64), x["near"].astype(np.int64), x["far"].astype(np.int64))


def _listed(first: np.ndarray, found: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """The windows found around suffixes (a column for each word further back) as ranges
    of starts with one owner, a row for each text."""
    head = found.copy()
    head[:, 1:] &= ~(found[:, :-1] & (first[:, 1:] == first[:, :-1]))
    tail = found.copy()
    tail[:, :-1] &= ~(found[:, 1:] & (first[:, 1:] == first[:, :-1]))
    row, a = np.nonzero(head)
    _, b = np.nonzero(tail)
    order = np.lexsort((doc[row], key[row]))
    row, a, b = row[order], a[order], b[order]
    d, k = doc[row], key[row]
    heads = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])][: len(row)])
    parts = pa.StructArray.from_arrays([pa.array((place[row] - b).astype(np.int32)), pa.array((place[row] - a).astype(np.int32)), pa.array(first[row, a])], ["low", "high", "first"])
    rows = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(row)].astype(np.int32)), parts)
    return _batch({"doc": d[heads], "key": k[heads], "rows": rows})


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to ranges of starts (low to high) of windows that several
    documents hold, with their owner, a row for each text that a piece of the array
    has."""
    shared.trim()
    held: tuple | None = None

    def ranges(prefix, right, left, doc, last, key, place, near, far) -> Iterator[pa.RecordBatch]:
        n = len(prefix)
        same = np.zeros(n, np.int64)  # words beyond PREFIX in common with the suffix before; -1: not even those
        equal = right[1:] == right[:-1]
        same[1:] = np.where(equal.all(axis=1), SIDE, equal.argmin(axis=1))
        same[1:][prefix[1:] != prefix[:-1]] = -1
        same[0] = -1
        sums = _sums(left)
        first = np.zeros((n, SPAN), np.int64)
        found = np.zeros((n, SPAN), bool)
        for back in range(SPAN):
            run = np.cumsum(same < SIDE - back)
            live = (near <= back) & (far >= back)
            live &= np.bincount(run[live], minlength=int(run[-1]) + 1)[run] > 1
            at = np.flatnonzero(live)
            if not len(at):
                continue
            group = words.mix(run[at].astype(np.uint64) * np.uint64(words._BASE) ^ sums[at, back])
            order = np.argsort(group, kind="stable")
            at, group = at[order], group[order]
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            owner, final = np.minimum.reduceat(doc[at], heads), np.maximum.reduceat(last[at], heads)
            size = np.diff(np.r_[heads, len(at)])
            several = np.repeat(owner < final, size)
            first[at, back] = np.repeat(owner, size)
            found[at[several], back] = True
        if found.any():
            yield _listed(first, found, doc, key, place)

    for batch in batches:
        if not batch.num_rows:
            continue
        held = tuple(np.concatenate(v) for v in zip(held, _arrays(batch))) if held is not None else _arrays(batch)
        if len(held[0]) < BUFFER:
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield from ranges(*(x[:last] for x in held))
        held = tuple(x[last:] for x in held)
    if held is not None and len(held[0]):
        yield from ranges(*held)


def _around(prefix: np.ndarray, right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window around suffixes: its suffix, how far back it starts, its hash."""
    n = far - near + 1
    row = np.repeat(np.arange(len(n)), n)
    back = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + near[row]
    r, l = _sums(right), _sums(left)
    h = words.mix(words.mix(prefix.view(np.uint64)[row] ^ r[row, SIDE - back]) + l[row, back] + back.astype(np.uint64))
    return row, back, h.view(np.int64)


def _windows(part: pa.Table) -> pa.Table:
    """The windows of a part of a run, each once, with the least and the last document
    that the part has of it."""
    shared.trim()
    window, first, final = (np.zeros(0, np.int64) for _ in range(3))
    for batch in part.select([c for c in part.schema.names if c != "part"]).to_batches(_PIECE):
        prefix, right, left, doc, last, _, _, near, far = _arrays(batch)
        row, _, h = _around(prefix, right, left, near, far)
        window, first, final = np.r_[window, h], np.r_[first, doc[row]], np.r_[final, last[row]]
        order = np.argsort(window, kind="stable")
        window = window[order]
        heads = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        window, first, final = window[heads], np.minimum.reduceat(first[order], heads), np.maximum.reduceat(final[order], heads)
    return pa.Table.from_batches([_batch({"window": window, "first": first, "final": final, "part": np.full(len(window), part.column("part")[0].as_py())})])


def _owned(part: pa.Table, owners: pa.Table) -> pa.Table:
    """What ``_matches`` finds, for a part of a run and the owners of its windows."""
    shared.trim()
    order = np.argsort(owners.column("window").to_numpy())
    known, first_of = owners.column("window").to_numpy()[order], owners.column("first").to_numpy()[order]
    out = []
    # a text's suffixes side by side, so that it has a row or two
    for batch in part.sort_by("key").to_batches(_PIECE) if len(known) else ():
        prefix, right, left, doc, _, key, place, near, far = _arrays(batch)
        row, back, h = _around(prefix, right, left, near, far)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        first = np.zeros((len(prefix), SPAN), np.int64)
        found = np.zeros((len(prefix), SPAN), bool)
        first[row[hit], back[hit]] = first_of[at[hit]]
        found[row[hit], back[hit]] = True
        out.append(_listed(first, found, doc, key, place))
    kinds = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("rows", _RANGES)])
    return pa.Table.from_batches([b.cast(kinds) for b in out], kinds)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... codes of each row."""
    out = np.zeros((len(codes), SIDE + 1), np.uint64)
    np.cumsum(words.mix(codes.astype(np.uint64) + np.uint64(1)) * words.powers(words._BASE, SIDE), axis=1, out=out[:, 1:])
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of one text to maximal spans."""
    shared.trim()
    for batch in batches:
        out = ([], [], [], [], [], [])
        for doc, key, rows in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), batch.column("rows")):
            x = rows.values
            low, high, f = (x.field(c).to_numpy() for c in ("low", "high", "first"))
            n = (high - low + 1).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            s, f = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row], f[row]
            order = np.lexsort((f, s))
            s, f = s[order], f[order]
            once = np.r_[True, s[1:] != s[:-1]]
            s, f = s[once], f[once]  # of each window its smallest owner
            own = f == doc
            for mine in (True, False):
                t, g = s[own == mine], f[own == mine]
                if len(t):
                    heads = np.flatnonzero(np.r_[True, t[1:] > t[:-1] + LENGTH])
                    lasts = np.r_[heads[1:] - 1, len(t) - 1]
                    k = len(heads)
                    for column, values in zip(out, ([doc] * k, [key] * k, t[heads].tolist(), (t[lasts] + LENGTH - t[heads]).tolist(), np.minimum.reduceat(g, heads).tolist(), [not mine] * k)):
                        column.extend(values)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "text_key", "start_word", "n_words", "first_doc_id", "repeat"])


def text_key(column) -> F.Column:
    return F.xxhash64(F.col(column).cast("string"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of 50 or more words that occur, word for word, in several documents.

    Rows: doc_id, text_key (xxhash64 of the text), start_word (from 0), n_words,
    first_doc_id (the smallest document with a window of the span) and repeat:
    false for the copy in that document, which stays, true for all later copies.
    Spans of one text and one kind don't overlap or touch.

    Null, empty and short texts give no rows; nor do rows with a null id.  Texts
    under one id are one document: a passage that only they share gives none, and
    each has spans of its own, by text_key.  Equal rows count once.  An empty
    table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    with shared.small_batches(spark):
        scratch = shared.Scratch(spark, "passages")
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
        docs = docs.withColumn("key", text_key("text"))
        ids = scratch.cut(docs.select("doc_id", "key", F.xxhash64(F.lit(1), "text").alias("key2")).distinct(), "ids", "zstd")
        texts = scratch.cut(ids.groupBy("key", "key2").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last")), "texts", "zstd")

        anchors = scratch.cut(docs.select("key", "text").mapInArrow(_anchors, "prefix long, key long, place int"), "anchors", "zstd")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["prefix", "key", "place"]
        kept = scratch.cut(anchors.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_shared, "key long, place int"), "kept", "zstd")
        scratch.drop("anchors")
        places = kept.groupBy("key").agg(F.collect_set("place").alias("places"))
        chosen = texts.join(places, "key", "left").where("places is not null or doc < last").select("doc", "last", F.col("key").alias("k"), "places")
        found = chosen.hint("shuffle_hash").join(docs, (F.col("doc_id") == F.col("doc")) & (F.col("key") == F.col("k")))
        found = found.select("doc", "last", "key", "places", "text").mapInArrow(_suffixes, SUFFIX)
        suffixes = scratch.cut(found, "suffixes", "zstd")
        scratch.drop("kept")

        array = suffixes.where("place >= 0")
        many = array.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > RUN)
        many = scratch.cut(many.select(F.col("prefix").alias("hot"), F.ceil(F.col("n") / RUN).alias("shares")), "many")
        alone = array.join(many, F.col("prefix") == F.col("hot"), "left_anti").repartition(parts, "prefix").sortWithinPartitions("prefix", "right", "doc", "place")
        matches = scratch.cut(alone.mapInArrow(_matches, MATCH), "matches", "zstd")
        part = F.xxhash64("prefix", F.pmod(F.xxhash64("key"), "shares"))
        dealt = array.join(many, F.col("prefix") == F.col("hot")).withColumn("part", part).drop("hot", "shares").repartition(parts, "part")
        owners = dealt.groupBy("part").applyInArrow(_windows, WINDOW).groupBy("window").agg(F.min("first").alias("first"), F.max("final").alias("final"), F.collect_set("part").alias("parts"))
        owners = scratch.cut(owners.where("first < final").select("window", "first", F.explode("parts").alias("part")), "owners", "zstd")
        owned = scratch.cut(dealt.groupBy("part").cogroup(owners.repartition(parts, "part").groupBy("part")).applyInArrow(_owned, MATCH), "owned", "zstd")
        one = lambda low, high, first: F.array(F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.col(first).alias("first"))).alias("rows")
        ranges = matches.unionAll(owned)
        ranges = ranges.unionAll(suffixes.where("place < 0").select("doc", "key", one("near", "far", "doc")))
        rows = ranges.groupBy("doc", "key").agg(F.flatten(F.collect_list("rows")).alias("rows"))
        spans = scratch.cut(rows.mapInArrow(_merge, "doc_id long, text_key long, start_word long, n_words long, first_doc_id long, repeat boolean"), "spans")
        scratch.drop("suffixes", "matches", "owners", "owned")

        # copies of a text are later copies as a whole
        several = texts.where("doc < last").select("doc", F.col("key").alias("k1"), F.col("key2").alias("k2"))
        whole = spans.groupBy("doc_id", "text_key").agg(F.max(F.col("start_word") + F.col("n_words")).alias("n_words"), F.min("first_doc_id").alias("first_doc_id"))
        whole = scratch.cut(several.join(whole, (F.col("doc") == F.col("doc_id")) & (F.col("k1") == F.col("text_key"))).drop("doc_id", "text_key"), "whole", "zstd")
        later = ids.join(whole, (F.col("key") == F.col("k1")) & (F.col("key2") == F.col("k2")) & (F.col("doc_id") > F.col("doc")))
        later = later.select("doc_id", F.col("key").alias("text_key"), F.lit(0).cast("long").alias("start_word"), "n_words", "first_doc_id", F.lit(True).alias("repeat"))
        return spans.unionAll(later)


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the spans that the last column holds; rows without any pass as they are."""
    shared.trim()
    for batch in shared.small(batches):
        *names, cuts = batch.schema.names  # the cuts stand last
        columns, cuts = dict(zip(names, batch.columns)), batch.column(cuts).to_pylist()
        if any(cuts):
            texts, changed = shared.texts_of(batch), {}
            for i, rows in enumerate(cuts):
                if not rows:
                    continue
                _, _, starts, ends, _ = words.hash_words([texts[i]])
                pieces, at = [], 0
                for r in sorted(rows, key=lambda r: r["start_word"]):
                    a = int(starts[r["start_word"]])
                    last = r["start_word"] + r["n_words"]
                    pieces.append(texts[i][at:a])
                    at = max(at, int(starts[last]) if last < len(starts) else int(ends[-1]))
                changed[i] = b"".join(pieces) + texts[i][at:]
            kind = columns["text"].type
            columns["text"] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.large_binary()).cast(pa.large_string()).cast(kind)
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(changed[i].decode()) if i in changed else n for i, n in enumerate(old)]).cast(columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``documents`` without the later copies of repeated passages: the words of
    a span go, with the white space up to the next word.  All other text, rows
    and columns stay; n_chars follows the new text.  A document whose whole text
    is a later copy stays with what white space led it.

    Null, empty and short texts and rows with a null id pass as they are; texts
    repeated under one id are cut each by its own spans; an empty table stays
    empty; other columns, whatever their names, pass through.
    """
    free = "_" * (1 + max(map(len, docs.columns)))  # names that no column has
    cuts = repeated_spans(docs).where("repeat").groupBy(F.col("doc_id").alias(f"{free}i"), F.col("text_key").alias(f"{free}k")).agg(F.collect_list(F.struct("start_word", "n_words")).alias(f"{free}c")).hint("shuffle_hash")
    both = docs.join(cuts, (F.col("doc_id").cast("long") == F.col(f"{free}i")) & (text_key("text") == F.col(f"{free}k")), "left").select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{free}c"))
    return both.mapInArrow(_cut_text, docs.schema)
