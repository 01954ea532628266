"""Districting views over the sample tables, in DataFrames and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of 40 columns in vertical strips of districts, with a flipped block every 211."""
    div = lambda a, n: F.floor(a / n).cast("long")
    g = table(spark, sf, "customer").select(F.col("c_custkey").alias("ubid"), (F.col("c_custkey") % 40).alias("cx"), div(F.col("c_custkey"), 40).alias("cy"), "c_acctbal")
    strip = div(F.col("cx"), 6)
    return g.select(
        "ubid", (F.col("cx") * 1000).alias("lon"), (F.col("cy") * 1000).alias("lat"), F.floor(F.abs("c_acctbal")).cast("long").alias("pop"), (F.col("ubid") % 97 + 1).alias("area"),
        F.when(F.col("ubid") % 211 == 0, (strip + 3) % 7).otherwise(strip).cast("int").alias("district"),
        (1 + div(F.col("cx"), 4) + 10 * div(F.col("cy"), 5)).cast("int").alias("place"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours on the grid: two equi-joins, right and below."""
    b = blocks(spark, sf).select("ubid")
    right = b.where("ubid % 40 <> 39").select(F.col("ubid").alias("a"), (F.col("ubid") + 1).alias("b"))
    below = b.select(F.col("ubid").alias("a"), (F.col("ubid") + 40).alias("b"))
    return right.unionByName(below).join(b.withColumnRenamed("ubid", "b").hint("merge"), "b", "left_semi").select("a", "b")


def demographics(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0)).cast("long")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("recno")).agg(F.sum("l_quantity").cast("long").alias("total"), f("A").alias("a"), f("N").alias("n"), f("R").alias("r"))


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("config"), F.concat(F.lit("u"), F.col("user_id")).alias("path"), F.col("value").alias("kmpp"), (F.col("value") * 10).alias("spread"), "ts", "props")


def statlog(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("run"), F.row_number().over(w).alias("generation"), F.col("value").alias("kmpp"), (F.col("value") * 10).alias("spread"), (F.col("event_type") == "error").cast("int").alias("open"), "event_id", "event_type")


def races(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    v = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0)).cast("long")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return l.groupBy(F.col("s_nationkey").alias("state"), F.col("l_suppkey").alias("district")).agg(
        v(flag == "A").alias("d"), v(flag == "R").alias("r"), v((flag == "N") & (status == "O")).alias("g"), v((flag == "N") & (status == "F")).alias("l"), F.lit(0).cast("long").alias("other")
    )


#: The same views as named subqueries.
SQL = {
    "blocks": """g AS (SELECT c_custkey::BIGINT AS ubid, c_custkey % 40 AS cx, c_custkey // 40 AS cy, c_acctbal FROM customer),
blocks AS (SELECT ubid, cx * 1000 AS lon, cy * 1000 AS lat, floor(abs(c_acctbal))::BIGINT AS pop, 1 + ubid % 97 AS area,
  (CASE WHEN ubid % 211 = 0 THEN (cx // 6 + 3) % 7 ELSE cx // 6 END)::INT AS district, (1 + cx // 4 + 10 * (cy // 5))::INT AS place FROM g)""",
    "edges": """edges AS (SELECT a.ubid AS a, b.ubid AS b FROM blocks a JOIN blocks b ON b.ubid = a.ubid + 1 WHERE a.ubid % 40 <> 39
  UNION ALL SELECT a.ubid, b.ubid FROM blocks a JOIN blocks b ON b.ubid = a.ubid + 40)""",
    "both": "both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)",
    "sums": """sums AS (SELECT district, count(*) AS blocks, sum(pop)::BIGINT AS pop, sum(area)::BIGINT AS area, sum(area * lon)::BIGINT AS area_x, sum(area * lat)::BIGINT AS area_y,
  sum(pop * lon)::BIGINT AS pop_x, sum(pop * lat)::BIGINT AS pop_y FROM blocks WHERE district IS NOT NULL GROUP BY district)""",
    "demographics": """demographics AS (SELECT l_suppkey AS recno, sum(l_quantity)::BIGINT AS total, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)::BIGINT AS a,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END)::BIGINT AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS r FROM lineitem GROUP BY 1)""",
    "submissions": "submissions AS (SELECT event_id AS id, event_type AS config, 'u' || user_id AS path, value AS kmpp, value * 10 AS spread, ts, props FROM events)",
    "statlog": """statlog AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS generation, value AS kmpp, value * 10 AS spread,
  (event_type = 'error')::INT AS open, event_id, event_type FROM events)""",
    "races": """races AS (SELECT s_nationkey AS state, l_suppkey AS district, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)::BIGINT AS d,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS r, sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END)::BIGINT AS g,
  sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END)::BIGINT AS l, 0::BIGINT AS other
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""",
}


def sql(views: str, body: str, more: str = "") -> str:
    """``body`` with the named views (space-separated) before it, and further subqueries in ``more``."""
    parts = [SQL[v] for v in views.split()] + ([more] if more else [])
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}"
