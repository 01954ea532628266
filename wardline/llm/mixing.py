"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws u from a hash of its id and text and gets the exponential key -ln(u) / weight, so that
an ascending sort by key is a weighted sample without replacement.  A source with target t and
size s first takes floor(t / s) complete epochs; the rest of its budget goes to the documents with
the smallest keys, up to the one whose middle still lies within the budget.

The sort is never global: keys fall into ``buckets`` ordered ranges for each source, sums for each
range locate the one in which the budget ends, and only that range is sorted.  A source that holds
a third of the rows thus sorts 1/buckets of them in one task.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a null id
draws as the text 'null'; rows of equal id and text share a key, yet each takes its own part of the
budget, and where the budget ends among them as many are taken as fit; an empty table gives an empty
result; ``mixed_rows`` keeps each row in a struct, so that any column name may occur, and
``weighted_mix`` replaces columns named like its own (size, source_size, target, copies, taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import WORD, save

SYMBOLS = "#$%&*!|<>{}"
OWN = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def symbol_weight(text: str = "text") -> Column:
    """Quality weight in [0.1, 1]: falls with the share of symbol characters."""
    n = F.length(text)
    share = (n - F.length(F.translate(F.col(text), SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 4.0 * share), F.lit(0.1))


def fingerprint(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def uniform(id_text: Column, print_: Column, seed: int = 7) -> Column:
    """Uniform in (0, 1) from the first 52 bits of md5(seed:id:fingerprint)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_text, F.lit(":"), print_).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """Targets for (source, source_size) rows: weights 1, 2, 3 repeating by code point share the
    total; what exceeds ``cap`` sizes of a source is shared again by weight (water filling)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    s = sizes.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", cap * F.col("source_size"))
    ratio = F.col("cap") / F.col("w")
    up = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("wsum", F.sum("w").over(onward))
    )
    open_ = F.col("cap") * F.col("wsum") > F.col("left") * F.col("w")
    level = F.min(F.when(open_, F.struct(ratio.alias("r"), "left", "wsum"))).over(everything)
    s = s.withColumn("level", level)
    share = F.col("w") * F.col("level.left") / F.col("level.wsum")
    return s.select("source", "source_size", F.when(open_ & (F.col("source_size") > 0), share).otherwise(F.col("cap")).cast("double").alias("target"))


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weight: Column | None = None,
    print_: Column | None = None, cap: int = 3, buckets: int = 1024, seed: int = 7,
) -> DataFrame:
    """(row, size, source_size, target, copies, taken): each row of ``docs`` as a struct, how often the
    mix takes it and taken = copies * size.  ``weight`` lies in [0.1, 1] and is clamped to that;
    ``print_`` tells rows of one id apart."""
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(source_col).alias("src"), ids.alias("id"), (fingerprint() if print_ is None else print_).alias("print"),
        (word_count() if size is None else size).alias("size"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), symbol_weight() if weight is None else weight)).alias("weight"),
    )
    keyed = keyed.withColumn("key", -F.log(uniform(F.col("id"), F.col("print"), seed)) / F.col("weight"))
    keyed = keyed.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * buckets))
    slim = save(keyed.select("src", "id", "print", "size", "key", "bucket"))

    sums = save(slim.groupBy("src", "bucket").agg(F.sum("size").alias("part")))
    sizes = sums.groupBy(F.col("src").alias("source")).agg(F.sum("part").alias("source_size"))
    plan = (
        source_targets(sizes, cap)
        .withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    run = Window.partitionBy("src").orderBy("bucket")  # at most `buckets` rows a source
    ends = (
        sums.withColumn("upto", F.sum("part").over(run))
        .join(plan, F.col("src").eqNullSafe(F.col("source")))
        .where(F.col("upto") > F.col("rest"))
        .groupBy(F.col("source").alias("s2"))
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("part")).alias("base"))).alias("end"))
    )
    plan = save(plan.join(ends, F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", F.col("end.bucket").alias("at"), "end.base"))
    # in the range where the budget ends: equal rows are one class, which takes as many as fit
    order = Window.partitionBy("src").orderBy("key", "id", "print")
    classes = slim.join(plan, F.col("src").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("at"))).groupBy("src", "key", "id", "print", "size", "base", "rest").agg(F.count(F.lit(1)).alias("many"))
    classes = classes.withColumn("before", F.col("base") + F.sum(F.col("many") * F.col("size")).over(order) - F.col("many") * F.col("size"))
    fit = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)).when(F.col("before") <= F.col("rest"), F.col("many")).otherwise(0)
    classes = classes.withColumn("fit", F.least(F.col("many"), fit)).where("fit > 0")
    last = classes.groupBy(F.col("src").alias("s2")).agg(F.max(F.struct("key", "id", "print", "fit", "many")).alias("last"))
    # saved, so that Spark knows its size and broadcasts it only where that is small
    plan = save(plan.join(last, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2", "base", "rest"))

    placed = keyed.join(plan, F.col("src").eqNullSafe(F.col("s")))
    here, end = F.struct("key", "id", "print"), F.struct("last.key", "last.id", "last.print")
    at_end = F.coalesce((F.col("bucket") == F.col("at")) & (here == end), F.lit(False))
    inside = (F.col("bucket") < F.col("at")) | F.col("at").isNull() | at_end | ((F.col("bucket") == F.col("at")) & F.coalesce(here < end, F.lit(False)))
    split = at_end & (F.col("last.fit") < F.col("last.many"))
    placed = placed.withColumns({"more": F.coalesce(inside, F.lit(False)), "split": split})
    if not plan.where("last.fit < last.many").isEmpty():  # only there do equal rows part ways
        placed = placed.where("NOT split").unionByName(_first_ones(placed.where("split")))
    copies = F.col("epochs") + F.when(F.col("more") & (F.col("epochs") < cap), 1).otherwise(0)
    return placed.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _first_ones(rows: DataFrame) -> DataFrame:
    """Equal rows of each source, numbered within and then over their partitions: the first ``fit`` go in."""
    rows = save(rows.withColumns({"deal": F.spark_partition_id(), "uid": F.monotonically_increasing_id()}))
    before = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("src").alias("c"), F.col("deal").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("c", "d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))  # a row a partition
    rows = rows.join(counts, F.col("src").eqNullSafe(F.col("c")) & (F.col("deal") == F.col("d")))
    number = F.col("skip") + F.row_number().over(Window.partitionBy("src", "deal").orderBy("uid"))
    return rows.withColumn("more", number <= F.col("last.fit")).drop("deal", "uid", "c", "d", "skip")


def weighted_mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken, as ``mixed_rows`` has them."""
    own = [F.col(c) for c in OWN]
    return mixed_rows(docs, **how).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in OWN), *own)


#: DuckDB SQL of the mix of ``documents`` with the defaults above.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(greatest(0.1::DOUBLE, 1.0 - 4.0 * ((length(text) - length(translate(text, '#$%&*!|<>{}', '')))::DOUBLE / greatest(length(text), 1))), 0.1::DOUBLE) AS weight,
         md5(coalesce(text, '')) AS print,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
             sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM w),
l AS (SELECT rem, wsum FROM f WHERE cap * wsum > rem * w ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (SELECT f.source, f.source_size,
             CASE WHEN f.cap * f.wsum > f.rem * f.w AND f.source_size > 0 THEN (f.w * l.rem)::DOUBLE / l.wsum::DOUBLE ELSE f.cap::DOUBLE END AS target
      FROM f LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
             e.target - e.epochs * e.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / greatest(0.1, least(1.0, d.weight)), coalesce(d.doc_id::VARCHAR, 'null'), print ROWS UNBOUNDED PRECEDING) AS prefix
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 3 AND prefix - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""
