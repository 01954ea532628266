"""Raw pixel rasters as a Spark data source that reads one file in many ranges.

A file is a header (version 1, width, height as 32-bit numbers, whose byte order is the file's) and records: a 64-bit
block id, pixels of two 16-bit numbers each, and a word of ones.  Everything lies on four-byte words, so a task that
starts anywhere looks for the first word of ones that ends a record.  Of a block id's halves only the lower one can be
all ones, which tells the two apart.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER, WORD, ONES = 12, 4, 0xFFFFFFFF
#: Words read at a time.
CHUNK = 1 << 20
#: Ranges are dealt over so many tasks, over more only where a task would read more than TASK_BYTES.
TASKS, TASK_BYTES = 128, 32 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _files(path: str) -> list[tuple[str, int]]:
    where, at = _open(path)
    info = where.get_file_info(at)
    found = where.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def byte_order(header: bytes) -> str:
    for order in "<>":
        if int(np.frombuffer(header[:4], order + "u4")[0]) == 1:
            return order
    raise ValueError("not a raw raster of version 1")


def size(path: str) -> tuple[int, int]:
    """(width, height), from the header of the first file."""
    where, _ = _open(path)
    with where.open_input_file(_files(path)[0][0]) as f:
        header = f.read(HEADER)
    width, height = np.frombuffer(header[4:], byte_order(header) + "i4").tolist()
    return width, height


def record_start(f, order: str, start: int, end: int) -> int | None:
    """The first place from ``start`` on where a record begins, or None if there is none before ``end``."""
    if start <= HEADER:
        return HEADER
    back = 1 if order == "<" else 2  # words between the end of a record and the lower half of the next one's id

    def ones(at: int) -> bool:
        if at < HEADER:
            return at == HEADER - WORD  # the header ends like a record
        f.seek(at)
        return f.read(WORD) == b"\xff" * WORD

    def ends_record(at: int) -> bool:
        chain = 0  # ones that could each be the lower half of the id behind the one before
        while ones(at - chain * back * WORD):
            chain += 1
        return chain % 2 == 1

    at = start - WORD
    while at + WORD < end:
        f.seek(at)
        words = np.frombuffer(f.read(min(CHUNK, (end - at) // WORD) * WORD), "<u4")
        for k in np.flatnonzero(words == ONES).tolist():
            if ends_record(at + k * WORD):
                return at + (k + 1) * WORD
        at += len(words) * WORD
    return None


def pixels_of(f, order: str, start: int, end: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, pixels n x 2) of the records that begin in [start, end), a chunk at a time, however long a record is."""
    at = record_start(f, order, start, end)
    block: int | None = None
    while at is not None and at < size and (block is not None or at < end):
        f.seek(at)
        words = np.frombuffer(f.read(min(CHUNK * WORD, (size - at) // WORD * WORD)), order + "u4")
        stops, k, ids, parts = np.flatnonzero(words == ONES), 0, [], []
        while k < len(words):
            if block is None:
                if at + k * WORD >= end or k + 2 > len(words):
                    break
                low, high = (words[k], words[k + 1]) if order == "<" else (words[k + 1], words[k])
                block, k = int(low) | int(high) << 32, k + 2
            s = int(np.searchsorted(stops, k))
            stop = int(stops[s]) if s < len(stops) else len(words)
            ids.append(np.full(stop - k, block, np.uint64))
            parts.append(words[k:stop])
            if s < len(stops):
                block = None
                stop += 1
            k = stop
        if parts:
            yield np.concatenate(ids).astype(np.int64), np.concatenate(parts).astype(order + "u4").view(order + "u2").reshape(-1, 2)
        if k == 0:  # less than a block id is left
            return
        at += k * WORD


@dataclass
class Ranges(InputPartition):
    """(file, start, end, size) of each range that a task reads."""

    parts: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", 32 << 20)) // WORD * WORD

    def partitions(self) -> list[InputPartition]:
        out = []
        for file, size in _files(self.path):
            size -= size % WORD
            out += [(file, start, min(start + self.split, size), size) for start in range(HEADER, size, self.split)]
        tasks = max(TASKS, -(-sum(end - start for _, start, end, _ in out) // TASK_BYTES))
        each = max(1, -(-len(out) // tasks))
        return [Ranges(out[k : k + each]) for k in range(0, len(out), each)] or [Ranges([])]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        where, _ = _open(self.path)
        for file, ranges in groupby(part.parts, lambda r: r[0]):
            with where.open_input_file(file) as f:
                order = byte_order(f.read(HEADER))
                yield from self.batches(f, order, ranges)

    def batches(self, f, order: str, ranges: Iterator[tuple[str, int, int, int]]) -> Iterator[pa.RecordBatch]:
        for _, start, end, size in ranges:
            for ids, xy in pixels_of(f, order, start, end, size):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(xy[:, 0].astype(np.int32)), pa.array(xy[:, 1].astype(np.int32))], ["ubid", "x", "y"])


@dataclass
class Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """A file for each task; a task's file gets its last name when all have been written."""

    def __init__(self, options: dict) -> None:
        self.path, self.header = options["path"], np.array([1, int(options["width"]), int(options["height"])], "<u4").tobytes()

    def write(self, rows) -> Written:
        where, at = _open(self.path)
        where.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.upix"
        with where.open_output_stream(posixpath.join(at, "_" + name)) as f:
            f.write(self.header)
            for r in rows:
                f.write(np.array([r.ubid], "<u8").tobytes() + np.array([(p.x, p.y) for p in r.pixels], "<u2").tobytes() + b"\xff" * WORD)
        return Written(name)

    def commit(self, messages: list) -> None:
        where, at = _open(self.path)
        for m in messages:
            if m:
                where.move(posixpath.join(at, "_" + m.name), posixpath.join(at, m.name))

    def abort(self, messages: list) -> None:
        where, at = _open(self.path)
        for m in messages:
            if m:
                where.delete_file(posixpath.join(at, "_" + m.name))


class UpixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "upix"

    def schema(self) -> str:
        return "ubid long, x int, y int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def read(spark: SparkSession, path: str, split: int = 32 << 20) -> DataFrame:
    """(ubid, x, y) of a raw raster, a file or a folder of them, in ranges of ``split`` bytes."""
    spark.dataSource.register(UpixSource)
    return spark.read.format("upix").option("split", str(split)).load(path)


def write(lists: DataFrame, path: str, width: int, height: int) -> None:
    """Write (ubid, pixels array<struct<x, y>>) as raw rasters, one file a task."""
    lists.sparkSession.dataSource.register(UpixSource)
    lists.select("ubid", "pixels").write.format("upix").option("width", str(width)).option("height", str(height)).mode("append").save(path)
