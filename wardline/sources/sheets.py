"""Spreadsheets in zipped XML, and the election workbooks kept in them.

The XML is read as a stream that gives runs: a value and how many columns and rows it is repeated over.  Spark expands the
runs; empty cells have none, so the million empty columns that end a row cost nothing.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
NUMBERS = ("float", "percentage", "currency")

#: First row of an election sheet (fixed value).
HEADER = ["State", "Dist", "D", "R", "G", "L", "other", "notes"]
PARTIES = ["d", "r", "g", "l", "other"]

RUN = "file string, sheet string, row int, rows int, col int, cols int, value string"
#: Runs of a batch.
BATCH = 10_000


def _value(cell: ElementTree.Element) -> str:
    if cell.get(OFFICE + "value-type") in NUMBERS and cell.get(OFFICE + "value") is not None:
        return cell.get(OFFICE + "value")
    return "\n".join("".join(p.itertext()) for p in cell.iter(TEXT + "p"))


def runs(content: bytes) -> Iterator[tuple[str, int, int, int, int, str]]:
    """(sheet, row, rows, col, cols, value) of each run of cells that hold something."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("content.xml") as f:
        sheet, row = "", 0
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if e.tag == TABLE + "table" and event == "start":
                sheet, row = e.get(TABLE + "name", ""), 0
            elif e.tag == TABLE + "table-row" and event == "end":
                many, col = int(e.get(TABLE + "number-rows-repeated", 1)), 0
                for cell in e:
                    if cell.tag in (TABLE + "table-cell", TABLE + "covered-table-cell"):
                        wide = int(cell.get(TABLE + "number-columns-repeated", 1))
                        if value := _value(cell):
                            yield sheet, row, many, col, wide, value
                        col += wide
                row += many
                e.clear()  # a row's cells are not kept
            elif e.tag == TABLE + "table" and event == "end":
                e.clear()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of all sheets of the spreadsheets at ``path``; files are read side by side, each as a stream."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RUN.split(", ")]
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                out = []
                for run in runs(content):
                    out.append((file, *run))
                    if len(out) == BATCH:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ods").load(path).select("path", "content").mapInPandas(parse, RUN)


def expand(found: DataFrame) -> DataFrame:
    """(file, sheet, row, col, value): each run's cells."""
    last = lambda first, n: F.col(first) + F.col(n) - 1
    down = found.withColumn("row", F.explode(F.sequence("row", last("row", "rows"))))
    return down.withColumn("col", F.explode(F.sequence("col", last("col", "cols")))).select("file", "sheet", "row", "col", "value")


def number(text: Column) -> Column:
    """A count as whole number; commas and blanks go, nothing is 0."""
    return F.coalesce(F.trim(F.translate(text, ",", "")).try_cast("double").cast("long"), F.lit(0).cast("long"))


def election(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sheets with the right header: votes (sheet, row, state, dist, d, r, g, l, other, notes) from the fourth row on, and seats
    (sheet, state, d, r, g, l, other) of the third."""
    wide = cells.where(F.col("col") < len(HEADER)).groupBy("file", "sheet", "row").agg(*(F.max(F.when(F.col("col") == k, F.col("value"))).alias(f"c{k}") for k in range(len(HEADER))))
    head = F.array(*(F.col(f"c{k}") for k in range(len(HEADER)))) == F.array(*(F.lit(h) for h in HEADER))
    good = wide.where((F.col("row") == 0) & head).select("file", "sheet")
    wide = wide.join(good, ["file", "sheet"], "left_semi")
    votes = [number(F.col(f"c{k + 2}")).alias(p) for k, p in enumerate(PARTIES)]
    rows = wide.where("row >= 3").select("sheet", "row", F.col("c0").alias("state"), number(F.col("c1")).cast("int").alias("dist"), *votes, F.coalesce("c7", F.lit("")).alias("notes"))
    return rows, wide.where("row = 2").select("sheet", F.col("c0").alias("state"), *votes)


def _line(*fields: Column) -> Column:
    quoted = lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(quoted(F.coalesce(c.cast("string"), F.lit(""))) for c in fields))


def _all(*words: str) -> list[Column]:
    return [F.lit(w) for w in words]


def seats_lines(votes: DataFrame, seats: DataFrame) -> DataFrame:
    """(part, sheet, value): the seats file, to be ordered by part and sheet: header, a line a state, sums, total."""
    spark, names = votes.sparkSession, ["D", "R", "G", "L", "other"]
    by_state = votes.groupBy("sheet").agg(*(F.sum(p).alias(f"v_{p}") for p in PARTIES))
    s = seats.join(by_state, "sheet", "left").fillna(0, [f"v_{p}" for p in PARTIES])
    v, k = [F.col(f"v_{p}") for p in PARTIES], [F.col(p) for p in PARTIES]
    total = s.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*(f"v_{p}" for p in PARTIES), *PARTIES]))
    plus = lambda cs: sum(cs[1:], cs[0])
    out = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("sheet"), _line(*_all("State", *names, *names)).alias("value"))
    out = out.unionByName(s.select(F.lit(1).alias("part"), "sheet", _line(F.col("state"), *v, *k).alias("value")))
    out = out.unionByName(total.select(F.lit(2).alias("part"), F.lit("").alias("sheet"), _line(F.lit("sums"), *v, *k).alias("value")))
    return out.unionByName(total.select(F.lit(3).alias("part"), F.lit("").alias("sheet"), _line(F.lit("total"), plus(v), *_all("", "", "", ""), plus(k)).alias("value")))


def all_lines(votes: DataFrame) -> DataFrame:
    """(part, sheet, row, value): the file of all districts, to be ordered by part, sheet and row: header, districts, sums and the extremes."""
    spark, p = votes.sparkSession, [F.col(c) for c in PARTIES]
    none = [F.lit("").alias("sheet"), F.lit(0).alias("row")]
    out = spark.range(1).select(F.lit(0).alias("part"), *none, _line(*_all(*HEADER)).alias("value"))
    out = out.unionByName(votes.select(F.lit(1).alias("part"), "sheet", "row", _line(F.col("state"), F.col("dist"), *p, F.col("notes")).alias("value")))
    most, cast = F.greatest(*p), sum(p[1:], p[0])
    at = lambda amount: F.struct(amount.alias("n"), "sheet", "row", "state", "dist")
    e = votes.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in PARTIES), F.coalesce(F.sum(most), F.lit(0)).alias("won"), F.min(F.when(most > 1, at(most))).alias("w0"), F.min(at(-most)).alias("w1"),
        F.min(F.when(cast > 1, at(cast))).alias("e0"), F.min(at(-cast)).alias("e1"),
    )
    rest = [
        _line(*_all("", "sums"), *p), _line(*_all("", "total"), cast), *(_line(F.lit(name), F.col(f"{c}.state"), F.col(f"{c}.dist"), F.abs(f"{c}.n")) for name, c in (("smallest winner", "w0"), ("biggest winner", "w1"), ("smallest election", "e0"), ("biggest election", "e1"))),
        _line(F.lit("votes for winners"), F.col("won")), _line(F.lit("votes for others"), cast - F.col("won")),
    ]
    parts = e.select(F.posexplode(F.array(*rest)).alias("part", "value"))
    return out.unionByName(parts.select((F.col("part") + 2).alias("part"), *none, "value"))
