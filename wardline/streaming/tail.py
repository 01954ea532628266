"""Live tail: a streaming source over files that grow.

The offset is how many bytes of each file have been read.  It always stands behind a line's end, so a last line that is
still being written waits; the checkpoint keeps the offset, so a restarted stream goes on where it was.  A batch's
new bytes are read in ranges by many tasks.  A file that has become shorter is read from its beginning again.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bytes looked through at a time.
CHUNK = 1 << 20
#: Bytes that opening a file counts as, tasks of a batch at most, and files that the driver looks into at a time.
OPENING, TASKS, AT_ONCE = 1 << 12, 512, 16


@dataclass
class Range(InputPartition):
    file: str
    begin: int  # of the batch in this file: a line's start
    start: int
    end: int
    stop: int  # of the batch: a line's end


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def bundled(ranges: list[Range], split: int) -> list[InputPartition]:
    """``ranges`` of many small files in at most about ``TASKS`` tasks."""
    size = max(split, sum(r.end - r.start + OPENING for r in ranges) // TASKS)
    out, left = [], 0
    for r in ranges:
        if left <= 0:
            out.append(Ranges([]))
            left = size
        out[-1].ranges.append(r)
        left -= r.end - r.start + OPENING
    return out


def whole_lines(f, begin: int, size: int) -> int:
    """The last line's end in [begin, size], or ``begin``."""
    end = size
    while end > begin:
        start = max(begin, end - CHUNK)
        f.seek(start)
        at = f.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return begin


def lines_from(f, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, end)."""
    at = part.start
    f.seek(max(part.begin, at - 1))
    rest, place = b"", max(part.begin, at - 1)
    skip = at > part.begin  # the line that runs into the range is another task's
    while place - len(rest) < part.stop:
        chunk = f.read(min(CHUNK, part.stop - place))
        if not chunk:
            return
        place += len(chunk)
        rest += chunk
        begin = place - len(rest)
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if begin >= part.end:
                return
            if skip:
                skip = False
            else:
                yield begin, line
            begin += len(line) + 1


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glob, self.split = options["path"], options.get("glob", "*"), int(options.get("split", 32 << 20))
        self.last: dict[str, int] = {}

    def _where(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        where, at = self._where()
        found = (f for f in where.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob))

        def end(f: fs.FileInfo) -> int:
            seen = self.last.get(f.path, 0)
            with where.open_input_file(f.path) as opened:
                return whole_lines(opened, seen if f.size > seen else 0, f.size)

        changed = [f for f in found if f.size != self.last.get(f.path, 0)]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            self.last |= {f.path: at for f, at in zip(changed, pool.map(end, changed), strict=True) if at}
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = {**end, **self.last}
        out = []
        for file, stop in sorted(end.items()):
            begin = start.get(file, 0)
            begin = begin if begin <= stop else 0
            out += [Range(file, begin, at, min(at + self.split, stop), stop) for at in range(begin, stop, self.split)]
        return bundled(out, self.split) or [Ranges([])]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        where, _ = self._where()
        rows = []
        for r in part.ranges:
            with where.open_input_file(r.file) as f:
                for place, line in lines_from(f, r):
                    rows.append((r.file, place, line.decode(errors="replace").removesuffix("\r")))
                    if len(rows) == 10_000:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "at", "line"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def live_tail(spark: SparkSession, path: str, glob: str = "*", split: int = 32 << 20) -> DataFrame:
    """A stream of (file, at, line): every line of the files below ``path``, once, as soon as it ends."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("live_tail").option("glob", glob).option("split", str(split)).load(path)


def last_lines(stream: DataFrame, n: int = 10) -> DataFrame:
    """(file, marked, seen, lines): after each batch, a changed file's last ``n`` lines that are no comments, and how many of both kinds it has had."""

    def keep(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marked, seen, held = state.get if state.exists else (0, 0, [])
        new = pd.concat(list(frames)).sort_values("at")["line"]
        notes = new.str.startswith("#")
        marked, seen = marked + int(notes.sum()), seen + int((~notes).sum())
        held = [*held, *new[~notes]][-n:]
        state.update((marked, seen, held))
        yield pd.DataFrame({"file": [key[0]], "marked": [marked], "seen": [seen], "lines": [held]})

    return stream.groupBy("file").applyInPandasWithState(keep, "file string, marked long, seen long, lines array<string>", "marked long, seen long, held array<string>", "append", GroupStateTimeout.NoTimeout)
