"""Run configurations: overrides, overlays, filters by name, argument lists.  All are columns or joins;
a configuration is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import merge_args

ALL = "all"


def overridden(configs: DataFrame, overrides: DataFrame) -> DataFrame:
    """configs (name, kwargs map) after the overrides (seq, target, kwargs map) in their order; the
    target 'all' means every config."""
    in_order = lambda a, b: a.seq - b.seq
    lines = F.collect_list(F.struct("seq", "kwargs"))
    own = overrides.where(F.col("target") != ALL).groupBy(F.col("target").alias("name")).agg(lines.alias("own"))
    every = overrides.where(F.col("target") == ALL).agg(lines.alias("every"))  # one row
    found = configs.join(own, "name", "left").join(every)
    steps = F.array_sort(F.concat(F.coalesce("own", F.array().cast("array<struct<seq:int,kwargs:map<string,string>>>")), "every"), in_order)
    return found.withColumn("kwargs", F.aggregate(steps, F.col("kwargs"), lambda m, s: merge_args(m, s.kwargs))).select(*configs.columns)


def prefixes(path: Column) -> Column:
    """'a.b.c' -> ['a', 'a.b', 'a.b.c']."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, 1, n)))


def overlaid(settings: DataFrame, overlays: DataFrame) -> DataFrame:
    """settings (name, path, value) with overlays (path, value) set in every config: what stands at an
    overlay's path, below it or at a leaf above it goes."""
    below = overlays.select(F.col("path").alias("set"))
    above = overlays.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    kept = settings.withColumn("set", F.explode(prefixes(F.col("path")))).join(below, "set", "left_semi").select("name", "path").distinct()
    rest = settings.join(kept, ["name", "path"], "left_anti").join(above, "path", "left_anti").select("name", "path", "value")
    return rest.unionByName(settings.select("name").distinct().join(overlays.select("path", "value")))


def unglob(pattern: str) -> str:
    """The regular expression of a file-name pattern with * and ?."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in pattern) + "$"


def column_list(text: Column) -> Column:
    """'file:1,2,3' -> (file, columns)."""
    numbers = F.regexp_extract_all(F.substring_index(text, ":", -1), F.lit(r"(\d+)"), F.lit(1))
    columns = F.when(F.instr(text, ":") > 0, numbers).otherwise(F.array().cast("array<string>")).cast("array<int>")
    return F.struct(F.substring_index(text, ":", 1).alias("file"), columns.alias("columns"))


def arg_tokens(text: Column) -> Column:
    """Arguments between white space; a backslash takes the next character as it is."""
    found = F.regexp_extract_all(text, F.lit(r"((?:[^\s\\]|\\.)+)"), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(t, r"\\(.)", "$1"))


def arg_map(tokens: Column) -> Column:
    """'-n=v', '-n v' and bare '-n' -> map; -- counts as -, the last of equal names wins."""
    name = lambda t: F.regexp_replace(t, "^--", "-")
    flag = lambda t: t.startswith("-")

    def entry(t: Column, i: Column) -> Column:
        follows = F.get(tokens, i + 1)
        value = F.when(F.instr(t, "=") > 0, F.regexp_extract(t, "=(.*)$", 1)).when(follows.isNotNull() & ~flag(follows), follows)
        return F.struct(name(F.substring_index(t, "=", 1)).alias("k"), value.alias("v"), flag(t).alias("flag"))

    entries = F.filter(F.transform(tokens, entry), lambda e: e.flag)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x.k == e.k))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e.k, e.v)))


def arg_list(kwargs: Column) -> Column:
    """map -> ['-n', 'v', ...]; a name without a value stands alone."""
    return F.flatten(F.transform(F.map_entries(kwargs), lambda e: F.when(e.value.isNull(), F.array(e.key)).otherwise(F.array(e.key, e.value))))


def stale(modified: Column, now: Column, seconds: float) -> Column:
    """Whether something last changed longer ago than that, or never."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(modified)) > int(seconds * 1_000_000), F.lit(True))
