"""One query for each training-data operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import conversations, html_text, imatch, lm, merkle, mixing, near_dup, packing, quality, substring, vectors, warc
from wardline.llm.common import save, table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), n=4)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op8_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("words"), mixing.symbol_weight().alias("weight"), mixing.fingerprint().alias("print"))
    mix = mixing.weighted_mix(save(docs), size=F.col("words"), weight=F.col("weight"), print_=F.col("print"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(vectors.valid("embedding") & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").alias("id"), vectors.whole_numbers("embedding").alias("vec"))
    return vectors.exact_top_k(rows, rows.where("id % 20 = 0"), 20)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pack": op1_pack, "op2_html": op2_html, "op3_quality": op3_quality, "op4_substring": op4_substring, "op5_near_dup": op5_near_dup, "op6_lm": op6_lm, "op7_warc": op7_warc, "op8_vector_near_dup": op8_vector_near_dup, "op9_mix": op9_mix, "op10_top_k": op10_top_k, "op11_fingerprints": op11_fingerprints, "op12_conversations": op12_conversations, "op13_merkle": op13_merkle}
#: WARC round trip: base32 takes five bits at a time of the SHA-1 in hexadecimal digits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

ORACLE_SQL = {"op7_warc": WARC_SQL, "op9_mix": mixing.SQL, "op10_top_k": vectors.TOP_K_SQL, "op11_fingerprints": imatch.SQL, "op12_conversations": conversations.SQL, "op13_merkle": merkle.SQL}
