"""Token ids in binary files: canonical, length-limited Huffman codes from the
global counts of ids, in independent blocks with bit-offset checkpoints.

A file holds whole documents of one run in ascending doc_id order:

    magic DTOKHUF1 | documents, ids, block, lengths (uint64 each)
    doc_id int64[documents] | tokens uint32[documents]
    first bit of each block uint64[ids / block, rounded up]
    code lengths, zlib-compressed uint8[vocabulary] | 64-bit words of bits

all little-endian, the words' bits from the highest down.  Any block can be
decoded alone from its checkpoint, with one table lookup an id.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import huffman, shared, words

MAGIC = b"DTOKHUF1"
END_ID = 1
BLOCK = 1024
STEP = 256
FILE_IDS = 4 << 20
CACHED_WORDS = 300_000


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words that take the quick way: visible ASCII and Latin-1 letters, which neither
#: compose nor change with their neighbours in lower case.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The vocabulary's own split of such words, in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class WordEncoder:
    """Encodes whole texts with a tokenizer that drops white space and joins
    nothing across it: the ids of a text are those of its words in turn, and of
    a plain word those of its parts.  The first ``CACHED_WORDS`` distinct words
    and parts are remembered; parts that are new are encoded as one text, cut
    again after the pieces that end a word."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.words, self.parts = _Words(), _Known()
        self.ends = np.zeros(1 << 16, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def _part_ids(self, parts: set[str]) -> dict[str, bytes]:
        new = list(parts.difference(self.parts))
        if not new:
            return self.parts
        ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u2")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(new):
            raw, at = ids.tobytes(), [0, *(2 * cuts).tolist()]
            fresh = {p: raw[a:b] for p, a, b in zip(new, at, at[1:])}
        else:  # a vocabulary without word ends
            codes = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            fresh = {p: np.array(c.ids, "<u2").tobytes() for p, c in zip(new, codes)}
        self.parts.add(fresh)
        return self.parts

    def _word_ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        split, slow = {}, []
        for w in words:
            text = w.decode("utf-8")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                split[w] = _PARTS.findall(text.lower())
            else:
                slow.append(w)
        known = self._part_ids(set(chain.from_iterable(split.values())))
        get = known.__getitem__
        out = {w: get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps)) for w, ps in split.items()}
        codes = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in slow], add_special_tokens=False)
        out.update((w, np.array(c.ids, "<u2").tobytes()) for w, c in zip(slow, codes))
        return out

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian uint16."""
        self.words.rest = fresh = {}
        get = self.words.__getitem__
        rows = [list(map(get, t.split())) if t else [] for t in texts]
        if fresh:
            ids = self._word_ids(list(fresh))
            for word, place in fresh.items():
                place += ids[word]
            if len(self.words) < CACHED_WORDS:
                self.words.update(ids)
        end = np.array([END_ID], "<u2").tobytes()
        return [b"".join(row) + end for row in rows]


class _Words(dict):
    """Known words; one that isn't gets an empty place, to be filled later."""

    rest: dict = {}

    def __missing__(self, key):
        found = self.rest.get(key)
        if found is None:
            found = self.rest[key] = bytearray()
        return found


class _Known(dict):
    """Remembers up to CACHED_WORDS entries, and beyond that those added last."""

    rest: dict = {}

    def add(self, fresh: dict) -> None:
        if len(self) < CACHED_WORDS:
            self.update(fresh)
        else:
            self.rest = fresh

    def __missing__(self, key):
        return self.rest[key]


@cache
def _encoder(path: str) -> WordEncoder:
    """One a worker process: later tasks find the words of earlier ones."""
    return WordEncoder(path)


def _encode_texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), shared.texts_of(batch)
            for a, b in words.batches(texts, 1 << 21):
                out = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.full(b - a, part)), pa.array(np.arange(seq, seq + b - a)), pa.array(out, pa.binary())], names=["doc_id", "part", "seq", "ids"])
                seq += b - a

    return run


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and how many each row has."""
    n = np.fromiter((len(x) // 2 for x in column.to_pylist()), np.int64, len(column))
    return np.frombuffer(b"".join(column.to_pylist()), "<u2"), n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        total += np.bincount(_ids(batch.column("ids"))[0], minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """A file's bytes.  Ids are coded ``STEP`` blocks at a time, each such run from
    a new 64-bit word on."""
    known = zlib.compress(lengths.tobytes())
    starts, bits, base = [], [], 0
    for a in range(0, len(ids), STEP * BLOCK):
        part, at = huffman.encode(ids[a : a + STEP * BLOCK], lengths, codes)
        starts.append((at[:-1:BLOCK] + 64 * base).astype("<u8").tobytes())
        bits.append(part.astype("<u8").tobytes())
        base += len(part)
    head = MAGIC + struct.pack("<4Q", len(doc_ids), len(ids), BLOCK, len(known))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), *starts, known, *bits])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, tokens of each and all ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, n, block, known = struct.unpack_from("<4Q", data, 8)
    at = 40
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u4", docs, at := at + 8 * docs)
    blocks = -(-n // block)
    starts = np.frombuffer(data, "<u8", blocks, at := at + 4 * docs)
    lengths = np.frombuffer(zlib.decompress(data[(at := at + 8 * blocks) : at + known]), np.uint8)
    bits = np.frombuffer(data[at + known :], "<u8")
    sizes = np.full(blocks, block)
    if blocks:
        sizes[-1] = n - block * (blocks - 1)
    return doc_ids, counts, huffman.decode(bits, starts, sizes, lengths)


def _write_files(root: str, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = huffman.canonical(lengths)
        where, base = pafs.FileSystem.from_uri(root)
        where.create_dir(base, recursive=True)
        held, size, key = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            doc = np.concatenate([b.column("doc_id").to_numpy() for b in held])
            parts = [_ids(b.column("ids")) for b in held]
            ids, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            name = f"{uuid.uuid4().hex}.tok"
            with where.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(pack(doc, counts, ids, lengths, codes))
            yield pa.RecordBatch.from_arrays([held[0].column("part").slice(0, 1), held[0].column("seq").slice(0, 1), pa.array([name]), pa.array([len(ids)], pa.int64())], names=["part", "seq", "name", "n_ids"])

        for batch in batches:
            part, seq = batch.column("part").to_numpy(), batch.column("seq").to_numpy()
            # a new run where a file of another part, or another piece of one, begins
            edges = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (seq[1:] != seq[:-1] + 1), True]) if len(part) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and ((part[a], seq[a]) != key or size >= FILE_IDS):
                    yield from flush()
                    held, size = [], 0
                piece = batch.slice(a, b - a)
                held.append(piece)
                size += sum(len(x) for x in piece.column("ids").to_pylist()) // 2
                key = (part[b - 1], seq[b - 1] + 1)
        if held:
            yield from flush()

    return run


def _read_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with where.open_input_file(f"{base}/{name}") as f:
                    doc, counts, ids = unpack(f.read())
                last = np.cumsum(counts.astype(np.int64))
                first = last - counts
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first + start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, scratch: shared.Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encode and write all texts; the folder and its manifest: name, n_ids and
    start (the ids of all files before), a row for each file in doc_id order.

    Null texts are empty: a document then has the end id alone.  Rows with a null
    id are left out.  Rows repeated under one id are written one after another,
    in an order that their texts fix.  Ids must fit 16 bits.
    """
    spark = docs.sparkSession
    with shared.small_batches(spark):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("order", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "order").sortWithinPartitions("doc_id", "order", "text").drop("order")
        ids = scratch.cut(rows.mapInArrow(_encode_texts(tokenizer), "doc_id long, part long, seq long, ids binary"), "ids", "zstd")
        counts = np.zeros(1 << 16, np.int64)
        # one row for each id of the vocabulary
        for row in ids.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[row["id"]] = row["n"]
        root = scratch.path("files")
        files = scratch.cut(ids.mapInArrow(_write_files(root, huffman.code_lengths(counts)), "part long, seq long, name string, n_ids long"), "manifest")
        scratch.drop("ids")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return root, files.select("name", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and read those back: doc_id, start (ids of
    all documents before it), n_tokens (with the end id) and ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    root, manifest = write_token_files(docs, tokenizer, shared.Scratch(spark, "tokens"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "start").repartition(parts, "name").mapInArrow(_read_files(root), "doc_id long, start long, n_tokens long, ids_crc32 long")
