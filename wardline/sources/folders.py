"""Folders of any number of files: listed, read and written in tasks, so that no list of files passes through the driver."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.shared import save as saved

#: Bytes and files that a task hands on at once.
BYTES, FILES = 8 << 20, 1000
#: Sub-folders that ``put`` spreads many files over.
SPREAD = 1024


def _where(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _prefix(folder: str) -> str:
    """What stands before a file system's own paths."""
    return folder.removesuffix(_where(folder)[1]) if "://" in folder else "file:"


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the files below ``folder``, or of that file; names that begin with ``_`` or a dot are left out.

    Each level of folders is a job, whose tasks list some of them.
    """
    root, prefix = _where(folder)[1], _prefix(folder)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = _where(folder)
        for batch in batches:
            for at in batch["path"]:
                info = where.get_file_info(at.removeprefix(prefix))
                inside = where.get_file_info(fs.FileSelector(info.path)) if info.type == fs.FileType.Directory else [info]
                kept = [f for f in inside if f.base_name[:1] not in ("_", ".") and f.type in (fs.FileType.File, fs.FileType.Directory)]
                for k in range(0, len(kept), 10_000):
                    some = kept[k : k + 10_000]
                    yield pd.DataFrame({"path": [prefix + f.path for f in some], "length": [f.size or 0 for f in some], "micros": [(f.mtime_ns or 0) // 1000 for f in some], "folder": [f.type == fs.FileType.Directory for f in some]})

    level, found = spark.createDataFrame([(prefix + root.rstrip("/"),)], "path string"), None
    while True:
        seen = saved(level.repartition(_tasks(spark), "path").mapInPandas(look, "path string, length long, micros long, folder boolean"))
        here = seen.where("NOT folder").select("path", "length", F.timestamp_micros("micros").alias("modified"))
        found = here if found is None else found.unionByName(here)
        level = seen.where("folder").select("path")
        if level.isEmpty():
            return found


def contents(files: DataFrame, folder: str) -> DataFrame:
    """``files`` (path, ... of a ``listing`` of ``folder``) with a column content; a task hands on few files at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = _where(folder)
        for batch in batches:
            start, got, size = 0, [], 0
            for k, path in enumerate(batch["path"]):
                with where.open_input_stream(path.removeprefix(prefix)) as f:
                    got.append(f.read())
                size += len(got[-1])
                if size >= BYTES or len(got) >= FILES or k + 1 == len(batch):
                    yield batch.iloc[start : k + 1].assign(content=got)
                    start, got, size = k + 1, [], 0

    prefix = _prefix(folder)
    kinds = ", ".join(f"`{n}` {k}" for n, k in files.dtypes)
    return files.repartition(_tasks(files.sparkSession), "path").mapInPandas(read, f"{kinds}, content binary")


def put(files: DataFrame, folder: str, spread: bool = False) -> DataFrame:
    """Names of the files (name, content binary) that are written below ``folder`` when this is run.  With ``spread`` they stand
    in ``SPREAD`` sub-folders by their names.  A file gets its name when it is whole, and a task that runs again writes the same file anew."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = _where(folder)
        where.create_dir(root, recursive=True)
        made = {root}
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                above, _, base = name.rpartition("/")
                at = "/".join(p for p in (root, f"{zlib.crc32(name.encode()) % SPREAD:04d}" if spread else "", above) if p)
                if at not in made:
                    where.create_dir(at, recursive=True)
                    made.add(at)
                part = f"{at}/_{base}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    f.write(content)
                where.move(part, f"{at}/{base}")
            yield batch[["name"]]

    return files.select("name", "content").mapInPandas(write, "name string")


def put_many(files: DataFrame, folder: str) -> int:
    """Writes ``files`` spread over sub-folders; returns their number."""
    return put(files, folder, spread=True).count()


def empty(folder: str) -> None:
    """Deletes what is in ``folder``, if there is one."""
    where, root = _where(folder)
    where.delete_dir_contents(root, missing_dir_ok=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes ``folder``, whose sub-folders at most are listed by the driver: tasks delete them with all that is below."""
    where, root = _where(folder)
    if where.get_file_info(root).type == fs.FileType.NotFound:
        return
    below = [(f.path,) for f in where.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory]

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = _where(folder)
        for batch in batches:
            for at in batch["path"]:
                if where.get_file_info(at).type != fs.FileType.NotFound:  # a task that runs again
                    where.delete_dir(at)
            yield batch

    if below:
        spark.createDataFrame(below, "path string").repartition(_tasks(spark), "path").mapInPandas(delete, "path string").count()
    where.delete_dir(root)


def is_pattern(path: str) -> bool:
    return any(c in path for c in "*?[{")
