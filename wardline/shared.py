"""Tables written in the folder that all executors share: they cut the lineage of loops."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.  Only a local session, where driver and executors are
    one process, gets a temporary folder where the setting is missing."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wardline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/wardline-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation of what stands before."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def save_by(df: DataFrame, column: str, n: int) -> list[DataFrame]:
    """Write ``df`` once and read it back as ``n`` tables, of the rows with 0, 1, ... in ``column``; each can be
    released by itself."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.partitionBy(column).parquet(path)
    rest = df.drop(column)
    out = []
    for k in range(n):
        part = f"{path}/{column}={k}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        have = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        t = spark.read.schema(rest.schema).parquet(part) if have else spark.createDataFrame([], rest.schema)
        t.saved_path = part
        _kept[part] = spark
        out.append(t)
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``save`` wrote and nothing reads any more."""
    for t in tables:
        path = getattr(t, "saved_path", None)
        if path in _kept:
            _delete(_kept.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for path, spark in _kept.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and its folder with it
            return
