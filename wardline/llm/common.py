"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.shared import release, save, shared_folder

__all__ = ["WORD", "crc_mod", "likely", "release", "save", "shared_folder", "split_by_id", "table"]

#: A word: a run of anything but ASCII white space.  ``bytes.split()`` splits UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"

SLOTS = 1 << 26  # bits of a bitmap of doc_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % modulus


def split_by_id(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may have a doc_id of ``wanted``, and those that surely have none: a bitmap of hashed ids,
    of 8 MB whatever the tables' sizes, goes to every task, so that few other rows need a shuffle."""

    def place(doc_id: str):
        slot = F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(SLOTS))
        return F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)

    part, at = place("doc_id")
    bits = wanted.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(at).alias("bits"))
    part, at = place("row.doc_id")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column name can clash
    rows = rows.withColumn("part", part).join(F.broadcast(bits), "part", "left")
    return rows.where(hit).select("row.*"), rows.where(~hit).select("row.*")


def likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may have a doc_id of ``wanted``."""
    return split_by_id(docs, wanted)[0]
