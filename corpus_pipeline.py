"""Corpus pipeline: rejects poor documents, drops near copies and repeated passages, mixes the
sources to their targets and packs the mix into sequences.

Each stage works on all that its predecessor kept, written as Parquet and read again.

Defined cases: an empty table passes every stage empty; further columns pass through, whatever their
names; null texts count as empty and null ids and sources are kept, as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import mixing, near_dup, packing, quality, substring
from wardline.llm.common import save, split_by_id, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF does not reject.  Null and empty texts are scored too, and so are rows without
    an id, from which nothing is learned; without labels nothing is rejected."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there is
    return quality.score(docs, model, free).where(F.col(free) >= quality.THRESHOLD).drop(free)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.  Rows that share an id
    are one document; rows without an id or without words stay."""
    gone = save(near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    some, rest = split_by_id(docs, gone)
    return some.join(gone, "doc_id", "left_anti").select(*docs.columns).union(rest)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has, and n_chars after that.  Rows
    without an id or a text stay as they are."""
    return substring.dedup_text(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.  A null source is a source; empty texts have no
    weight in the targets and are taken as often as their source's epochs."""
    mixed = mixing.mixed_rows(docs)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens packed into sequences; every row is packed, an empty text as its end token."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicate removal", near_dedup),
    ("substring removal", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier's fit is not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
