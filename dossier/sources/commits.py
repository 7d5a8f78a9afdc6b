"""Writers that act once all tasks are done: one file joined from ordered parts, and
objects that are claimed only after they have been put in place.

Tasks write to files of their own attempt and say so; what failed or repeated attempts
wrote isn't named in the commit and goes with the staging folder.  Folders are opened by
pyarrow, so local and shared paths, HDFS and object stores serve alike.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.numbering import numbered

_BUFFER = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


@dataclass
class Claims(WriterCommitMessage):
    rows: list[dict]


class _JoinedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.head, self.tail = options["path"], bytes.fromhex(options.get("head", "")), bytes.fromhex(options.get("tail", ""))
        self.staging = f"{self.path}.parts-{uuid.uuid4().hex[:12]}"

    def write(self, rows: Iterator[Row]) -> Part:
        task = TaskContext.get()
        store, folder = _opened(self.staging)
        store.create_dir(folder)
        part = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}"
        with store.open_output_stream(part) as out:
            for row in rows:
                out.write(bytes(row.value))
        return Part(task.partitionId(), part)

    def commit(self, messages: list[Part | None]) -> None:
        """The parts in order, a buffer at a time, beside the target, then moved there."""
        store, target = _opened(self.path)
        whole = f"{target}.{uuid.uuid4().hex[:12]}"
        with store.open_output_stream(whole) as out:
            out.write(self.head)
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with store.open_input_stream(part.path) as piece:
                    while data := piece.read(_BUFFER):
                        out.write(data)
            out.write(self.tail)
        if store.get_file_info(target).type == fs.FileType.Directory:
            store.delete_dir(target)
        store.move(whole, target)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = _opened(self.staging)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class Joined(DataSource):
    """One file: ``head``, the column ``value`` of all rows as partitions have them, ``tail``."""

    @classmethod
    def name(cls) -> str:
        return "joined"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _JoinedWriter(self.options)


class _ClaimWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.manifest = options["path"], options["manifest"]
        self.run = uuid.uuid4().hex[:12]

    def write(self, rows: Iterator[Row]) -> Claims:
        store, folder = _opened(self.path)
        staging = f"{folder}/.staged-{self.run}/{TaskContext.get().taskAttemptId()}"
        claimed = []
        for row in rows:
            data, place = bytes(row.data), f"{staging}/{row.key}"
            store.create_dir(place.rpartition("/")[0])
            with store.open_output_stream(place) as out:
                out.write(data)
            claimed.append({"url": row.url, "key": row.key, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "staged": place})
        return Claims(claimed)

    def commit(self, messages: list[Claims | None]) -> None:
        """Objects move to their keys; the manifest's rows come last, in one file that
        is moved in as a whole, so no row ever claims what isn't there."""
        store, folder = _opened(self.path)
        rows = [r for m in messages if m is not None for r in m.rows]
        for r in rows:
            place = f"{folder}/{r['key']}"
            store.create_dir(place.rpartition("/")[0])
            store.move(r.pop("staged"), place)
        keeper, at = _opened(self.manifest)
        keeper.create_dir(at)
        with keeper.open_output_stream(f"{at}/.{self.run}") as out:
            for r in rows:
                out.write((json.dumps(r) + "\n").encode())
        keeper.move(f"{at}/.{self.run}", f"{at}/{self.run}.json")
        self.abort(messages)

    def abort(self, messages: list[Claims | None]) -> None:
        store, folder = _opened(self.path)
        staged = f"{folder}/.staged-{self.run}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class Claimed(DataSource):
    """Objects (url, key, data) under ``path``, and their rows under ``manifest``."""

    @classmethod
    def name(cls) -> str:
        return "claimed"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ClaimWriter(self.options)


def write_joined(values: DataFrame, path: str, head: bytes = b"", tail: bytes = b"") -> None:
    """One file of the rows' ``value`` (binary), in the order of their partitions."""
    values.sparkSession.dataSource.register(Joined)
    values.select("value").write.format("joined").mode("append").option("path", path).option("head", head.hex()).option("tail", tail.hex()).save()


def archive(objects: DataFrame, path: str, manifest: str) -> None:
    """Put objects (url, key, data) under their keys and claim them (url, key, bytes,
    sha256) in a manifest of JSON lines.  If any task fails for good, nothing is
    claimed and what was staged goes."""
    objects.sparkSession.dataSource.register(Claimed)
    objects.select("url", "key", "data").write.format("claimed").mode("append").option("path", path).option("manifest", manifest).save()


def feature_collection(features: DataFrame, path: str) -> None:
    """One GeoJSON FeatureCollection, nulls pruned, from rows with lon, lat and
    properties, in the order of ``ord``: parts are made side by side and joined."""
    properties = F.struct(*[c for c in features.columns if c not in ("lon", "lat", "ord")])
    geometry = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    lines = numbered(features.select("ord", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("f")), ["ord", "f"], "n")
    parts = lines.select("n", F.concat(F.when(F.col("n") == 1, "").otherwise(",\n"), "f").cast("binary").alias("value"))
    write_joined(parts.repartitionByRange("n").sortWithinPartitions("n"), path, b'{"type":"FeatureCollection","features":[', b"]}")


def raster(cells: DataFrame, path: str, height: int, width: int) -> None:
    """Cells (row, col, cost) as a float32 array of that height and width in one .npy
    file; cells that aren't there, or lie outside, are NaN or left out.  A row of the
    raster is a row of bytes, so tasks never hold more than one."""
    import numpy as np
    import pandas as pd

    text = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({height}, {width}), }}"
    head = b"\x93NUMPY\x01\x00"
    pad = -(len(head) + 2 + len(text) + 1) % 64
    head += (len(text) + pad + 1).to_bytes(2, "little") + text.encode() + b" " * pad + b"\n"
    inside = cells.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    every = cells.sparkSession.range(height).select(F.col("id").alias("row"))
    lists = inside.groupBy(F.col("row").cast("long").alias("r")).agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("cost").cast("float").alias("cost"))).alias("cells"))

    def laid(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for held in frame["cells"]:
                line = np.full(width, np.nan, "<f4")
                for c in held if held is not None else ():
                    line[c["col"]] = c["cost"]
                out.append(line.tobytes())
            yield frame[["row"]].assign(value=out)

    lines = every.join(lists, F.col("row") == F.col("r"), "left").select("row", "cells").mapInPandas(laid, "row long, value binary")
    write_joined(lines.repartitionByRange("row").sortWithinPartitions("row"), path, head)
