"""Column metadata kept as indented lists: label statements of a statistics package and lists of table keys.

An item lies below the nearest earlier item of each lesser indent that no still lesser one has closed since.  Windows find the
last item of each indent; no task walks through a list with a stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.text import clean_label, indent_width

#: Distinct indents of a list.
MOST_LEVELS = 200
#: Number of a table's first column, behind those that every file begins with (fixed value).
FIRST_COLUMN = 5


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files; a list is short."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def ancestors(items: DataFrame, by: list[str], at: str = "pos", level: str = "level", name: str = "name") -> DataFrame:
    """``items`` with above: (level, name) of the items that each lies below, outermost first."""
    levels = sorted(r[0] for r in items.select(level).distinct().limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} indents")
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {v: F.last(F.when(F.col(level) == v, F.struct(F.col(at).alias("at"), F.col(level).alias("level"), F.col(name).alias("name"))), ignorenulls=True).over(before) for v in levels}
    out = items.withColumns({f"__{v}": c for v, c in last.items()})
    open_, closed = [], F.lit(None).cast("long")
    for v in levels:
        here = F.col(f"__{v}")
        open_.append(F.when((F.col(level) > v) & here.isNotNull() & (closed.isNull() | (here["at"] > closed)), F.struct(here["level"].alias("level"), here["name"].alias("name"))))
        closed = F.greatest(closed, here["at"].cast("long"))
    above = F.filter(F.array(*open_), lambda x: x.isNotNull()) if levels else F.array().cast("array<struct<level:int,name:string>>")
    return out.withColumn("above", above).drop(*(f"__{v}" for v in levels))


def label_records(files: DataFrame) -> DataFrame:
    """(file, pos, codename, comment, path) of the label statement in each of ``files`` (file, text).  ``comment`` joins the
    comments right before a run of labels; a path begins with the last label without indent, or an empty name."""
    body = F.regexp_extract("text", r"(?s)\bLABEL\s(.*)", 1)
    tokens = F.regexp_extract_all(body, F.lit(r"(?s)([^\s=]+='[^']+'|/\*.*?\*/|;|\bINPUT\b)"), F.lit(1))
    t = files.select("file", F.posexplode(tokens).alias("pos", "token"))
    order = Window.partitionBy("file").orderBy("pos")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(F.col("token").isin(";", "INPUT").cast("int")).over(up_to)
    t = t.withColumn("ended", ended).where("ended = 0").drop("ended").withColumn("remark", F.col("token").startswith("/*"))
    starts = F.col("remark") & ~F.coalesce(F.lag("remark").over(order), F.lit(False))
    t = t.withColumn("run", F.sum(starts.cast("int")).over(up_to))
    remark = F.trim(F.regexp_extract("token", r"(?s)^/\*(.*)\*/$", 1), F.lit(" \t\r\n"))
    comments = t.where("remark").groupBy("file", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", remark.alias("said")))), lambda x: x.said), "\n").alias("comment"))
    said = F.regexp_extract("token", r"(?s)='([^']+)'$", 1)
    items = t.where("NOT remark").select("file", "pos", "run", F.regexp_extract("token", "^[^=]+", 0).alias("codename"), indent_width(said).alias("level"), clean_label(said).alias("name"))
    items = ancestors(items, ["file"]).join(comments, ["file", "run"], "left")
    root = F.when((F.col("level") > 0) & (F.coalesce(F.get("above", F.lit(0))["level"], F.lit(1)) > 0), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    path = F.concat(root, F.transform("above", lambda a: a["name"]), F.array("name"))
    return items.select("file", "pos", "codename", F.coalesce("comment", F.lit("")).alias("comment"), path.alias("path"))


def table_keys(files: DataFrame) -> DataFrame:
    """(file, table, description, expected, found, column, path, jump) of table lists in ``files`` (file, text): ``# file`` lines name a data file,
    ``# P1. ... [n]`` its tables with n columns; other ``#`` lines describe, and lines with tabs before them are
    the columns.  ``jump`` marks a line whose indent is more than one deeper than the line before."""
    t = files.select(F.col("file").alias("list"), F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).where("line <> ''")
    up_to = Window.partitionBy("list").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_file, head = F.col("line").startswith("# file"), r"^# (P[^.]{1,9})\..*\[(\d+)\].*"
    is_table = ~is_file & F.col("line").rlike(head)
    t = t.withColumns({"is_table": is_table, "file": F.last(F.when(is_file, F.trim(F.substring("line", F.lit(7), F.length("line")))), ignorenulls=True).over(up_to)})
    t = t.withColumn("at", F.last(F.when(F.col("is_table"), F.col("pos")), ignorenulls=True).over(up_to)).where("at IS NOT NULL").where(~is_file)
    heads = t.where("is_table").select("list", "at", F.regexp_extract("line", head, 1).alias("table"), F.regexp_extract("line", head, 2).cast("int").alias("expected"))
    about = t.where(~F.col("is_table") & F.col("line").startswith("#")).groupBy("list", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.trim(F.substring("line", F.lit(2), F.length("line"))).alias("said")))), lambda x: x.said), "\n").alias("description"))
    tabs = F.length(F.regexp_extract("line", "^\t*", 0))
    items = t.where(~F.col("line").startswith("#")).select("list", "file", "at", "pos", tabs.alias("level"), F.rtrim(F.substring("line", tabs + 1, F.length("line"))).alias("name"))
    order = Window.partitionBy("list", "at").orderBy("pos")
    items = items.withColumns({"jump": F.col("level") > F.coalesce(F.lag("level").over(order) + 1, F.lit(0)), "found": F.count(F.lit(1)).over(Window.partitionBy("list", "at")).cast("int")})
    items = items.withColumn("column", F.row_number().over(Window.partitionBy("list", "file").orderBy("pos")) + FIRST_COLUMN - 1)
    items = ancestors(items, ["list", "at"]).join(heads, ["list", "at"]).join(about, ["list", "at"], "left")
    path = F.concat(F.transform("above", lambda a: a["name"]), F.array("name"))
    return items.select("file", "table", F.coalesce("description", F.lit("")).alias("description"), "expected", "found", "column", path.alias("path"), "jump")
