"""Tables that are kept by key: upserts that rewrite only what they touch, and look-ups that read only what holds a key.

A table is a folder of numbered versions.  A version is a small file that names the folder of each bucket of keys; it is put in
place by renaming, which fails if another writer was first.  What a failed write leaves is named by no version, and a batch
that has been applied is not applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyedTable:
    """Rows with one row a key.  ``buckets`` is fixed when the table is made; a bucket is what an upsert rewrites."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        """The last version's number, 0 before the first."""
        folder = self._place(f"{self.path}/versions")
        if not self._files.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._files.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"buckets": self.buckets, "folders": {}, "batches": []}
        text = self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, version: int, manifest: dict) -> None:
        parent = self._place(f"{self.path}/versions")
        self._files.mkdirs(parent)
        draft, name = self._place(f"{self.path}/versions/_{uuid.uuid4().hex}"), self._place(f"{self.path}/versions/{version}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(name) or not self._files.rename(draft, name):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {version} was written by another")

    # ------------------------------------------------------------ rows

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        folders = self._manifest(self.version() if version is None else version)["folders"]
        return self._read(sorted(folders.values()))

    def upsert(self, changes: DataFrame, batch: str, order: str, gone: str | None = None) -> int:
        """Apply ``changes``: the last row by ``order`` of each key replaces the table's, or deletes it where ``gone`` holds.  Only buckets with
        changes are rewritten.  ``batch`` names the changes; a batch that is in already changes nothing.  Returns the version."""
        now = self.version()
        manifest = self._manifest(now)
        if batch in manifest["batches"]:
            return now
        if manifest["buckets"] != self.buckets:
            raise ValueError(f"the table has {manifest['buckets']} buckets")
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        deleted = F.coalesce(F.expr(gone), F.lit(False)) if gone else F.lit(False)
        ranked = changes.withColumns({"__k": F.row_number().over(Window.partitionBy(self.key).orderBy(F.col(order).desc())), "__gone": deleted, "__bucket": self.bucket()})
        new = ranked.where("__k = 1").select(*columns, "__gone", "__bucket")
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # at most the number of buckets
        old = self._read([manifest["folders"][str(b)] for b in touched if str(b) in manifest["folders"]])
        kept = old.join(new.select(self.key), self.key, "left_anti").withColumn("__bucket", self.bucket())
        merged = kept.select(*columns, "__bucket").unionByName(new.where("NOT __gone").drop("__gone"))
        data = f"{self.path}/data/{now + 1}-{uuid.uuid4().hex}"
        merged.repartition("__bucket").write.partitionBy("__bucket").parquet(data)
        folders = {k: v for k, v in manifest["folders"].items() if int(k) not in touched}
        folders |= {str(b): f"{data}/__bucket={b}" for b in touched if self._files.exists(self._place(f"{data}/__bucket={b}"))}
        self._publish(now + 1, manifest | {"folders": folders, "batches": [*manifest["batches"], batch]})
        return now + 1


# ---------------------------------------------------------------- sorted id index


def write_index(rows: DataFrame, path: str, key: str, ranges: int = 200) -> None:
    """``rows`` in ``ranges`` folders by ranges of ``key``, sorted within, and a table of each range's least and largest key."""
    dealt = rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("range", F.spark_partition_id())
    dealt.write.partitionBy("range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    found = spark.read.parquet(f"{path}/rows").groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    found.coalesce(1).write.parquet(f"{path}/ranges")  # a row a range


def look_up(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The indexed rows whose key is in ``keys``, and with ``found`` null keys that are in no row.  Only ranges that can hold one are read."""
    ranges = spark.read.parquet(f"{path}/ranges")
    wanted = keys.select(key).distinct()
    hit = wanted.join(F.broadcast(ranges), F.col(key).between(F.col("low"), F.col("high"))).select("range").distinct()
    some = sorted(r[0] for r in hit.collect())  # at most the number of ranges
    rows = spark.read.parquet(f"{path}/rows").where(F.col("range").isin(some)).drop("range")
    return wanted.join(rows.withColumn("found", F.lit(True)), key, "left")
