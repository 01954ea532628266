"""Readers of census geography, demographics, links, solutions, names, logs and submissions.

Text formats are declared as columns over ``spark.read``; nothing is inferred."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import schema
from wardline.functions import text
from wardline.functions.geo import degrees_to_micro
from wardline.schema import ubid
from wardline.sources import binary, folders


def cut(start: int, stop: int, line: str = "value") -> Column:
    """Bytes start..stop (0-based, end-exclusive) of a fixed-width line, trimmed."""
    return F.trim(F.substring(F.col(line), start + 1, stop - start))


def _number(start: int, stop: int, kind: str = "long") -> Column:
    return cut(start, stop).try_cast(kind)


#: Class codes of incorporated places.
PLACE_CLASSES = ("C1", "C2", "C5", "C6", "C7", "C8")


def incorporated(code: Column, kind: Column) -> Column:
    """The place's number if its class is that of an incorporated place, else 0."""
    return F.coalesce(F.when(kind.isin(*PLACE_CLASSES), code.try_cast("int")), F.lit(0))


def geography_2010(spark: SparkSession, path: str, level: str | None = "750") -> DataFrame:
    lines = spark.read.text(path)
    if level:
        lines = lines.where(cut(8, 11) == level)
    return lines.select(
        ubid(cut(27, 29), cut(29, 32), cut(54, 60), cut(61, 65)).alias("ubid"), _number(18, 25, "int").alias("recno"),
        degrees_to_micro(cut(347, 359)).alias("lon"), degrees_to_micro(cut(336, 347)).alias("lat"), _number(318, 327, "int").alias("pop"),
        _number(198, 212).alias("area"), incorporated(cut(45, 50), cut(50, 52)).alias("place"),
    )


def geography_2000(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates are microdegrees already; old_district is 0-based, null where blank."""
    return spark.read.text(path).select(
        ubid(cut(29, 31), cut(31, 34), cut(55, 61), cut(62, 66)).alias("ubid"), _number(18, 25, "int").alias("recno"), _number(319, 331, "int").alias("lon"),
        _number(310, 319, "int").alias("lat"), _number(292, 301, "int").alias("pop"), _number(172, 186).alias("area"), (_number(138, 140, "int") - 1).cast("short").alias("old_district"),
    )


#: Column numbers (0-based) of the pipe-delimited header.
COLUMNS_2020 = {"level": 2, "recno": 7, "state": 12, "county": 14, "place": 29, "place_class": 30, "tract": 32, "block": 34, "land": 84, "water": 85, "pop": 90, "lat": 92, "lon": 93}


def geography_2020(spark: SparkSession, path: str, level: str | None = "750") -> DataFrame:
    wide = spark.read.option("encoding", "ISO-8859-1").text(path)
    c = {k: F.trim(text.pipe_field(F.col("value"), n)) for k, n in COLUMNS_2020.items()}
    if level:
        wide = wide.where(c["level"] == level)
    return wide.select(
        ubid(c["state"], c["county"], c["tract"], c["block"]).alias("ubid"), c["recno"].cast("int").alias("recno"), degrees_to_micro(c["lon"]).alias("lon"),
        degrees_to_micro(c["lat"]).alias("lat"), c["pop"].cast("int").alias("pop"), c["land"].cast("long").alias("area"), incorporated(c["place"], c["place_class"]).alias("place"),
    )


def geography(spark: SparkSession, path: str, level: str | None = "750") -> DataFrame:
    """2010 or 2020 geography by the file's first bytes."""
    first = spark.read.text(path).first()
    return (geography_2020 if first and first.value.startswith("PLST|") else geography_2010)(spark, path, level)


def demographics(spark: SparkSession, path: str, recno_column: int, columns: dict[str, int]) -> DataFrame:
    """(recno, named columns) by position from a CSV; header lines, whose recno is no number, go."""
    fields = F.split("value", ",")
    get = lambda n: text.leading_int(F.get(fields, F.lit(n)))
    rows = spark.read.text(path).select(get(recno_column).cast("int").alias("recno"), *(get(n).alias(k) for k, n in columns.items()))
    return rows.where("recno IS NOT NULL")


def join_demographics(blocks: DataFrame, demo: DataFrame) -> DataFrame:
    """``blocks`` with the columns of ``demo`` by recno, 0 where there is no record."""
    return blocks.join(demo, "recno", "left").fillna(0, [c for c in demo.columns if c != "recno"])


def race_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema="LOGRECNO int, total long, white long, black long, native long, asian long, pacific long, other long")
    return rows.withColumn("valid", (F.col("total") >= 0) & (F.col("white") <= F.col("total")) & (F.col("black") <= F.col("total")) & (F.col("white") + F.col("black") <= F.col("total")))


def links(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """Edges of 15+15 digits with a comma, or of 13+13 digits; edges of unknown blocks go."""
    line = F.trim("value")
    comma = F.instr(line, ",") > 0
    half = (F.length(line) / 2).cast("int")
    a = F.when(comma, F.substring_index(line, ",", 1)).otherwise(F.substring(line, F.lit(1), half))
    b = F.when(comma, F.substring_index(line, ",", -1)).otherwise(F.substring(line, half + 1, half))
    out = spark.read.text(path).select(a.try_cast("long").alias("a"), b.try_cast("long").alias("b")).dropna()
    if blocks is not None:
        for end in ("a", "b"):
            out = out.join(blocks.select(F.col("ubid").alias(end)), end, "left_semi")
    return out.select("a", "b")


def solution_csv(spark: SparkSession, path: str, base: int = 1, districts: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(ubid, district): any separator that is no digit; ids out of range are unassigned."""
    pair = lambda n: F.regexp_extract("value", r"^\D*(\d+)\D+(\d+)", n).try_cast("long")
    rows = spark.read.text(path).select(pair(1).alias("ubid"), (pair(2) - base).alias("district")).where("ubid IS NOT NULL")
    if blocks is not None:
        rows = rows.join(blocks.select("ubid"), "ubid", "left_semi")
    top = 252 if districts is None else districts - 1
    return rows.select("ubid", F.when(F.col("district").between(0, top), F.col("district")).cast("short").alias("district"))


def solution_kind(path: str) -> str:
    """'dsz', 'csv' or 'text' by file name."""
    name = path.rsplit("/", 1)[-1].lower().removesuffix(".gz")
    for kind in ("dsz", "csv", "text"):
        if name.endswith("." + kind):
            return kind
    raise ValueError(f"no known solution format: {path}")


def place_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", schema=schema.PLACE_NAMES, encoding="ISO-8859-1").where("place IS NOT NULL")


def zip_points(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width zip-area points, degrees."""
    return spark.read.text(path).select(cut(2, 66).alias("name"), _number(66, 75, "int").alias("pop"), _number(136, 146, "double").alias("lat"), _number(146, 157, "double").alias("lon"))


def legislatures(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, schema="state string, body string, seats int")
    return rows.withColumn("short", F.split("body", " ")[0])


def statlog_text(spark: SparkSession, path: str) -> DataFrame:
    """(run, generation, kmpp, std, max_pop, min_pop, nod_pop): one row a generation; run is the file."""
    if folders.is_pattern(path):
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), "value")
    else:
        whole = folders.contents(folders.listing(spark, path).select("path"), path).select(F.col("path").alias("run"), F.decode("content", "UTF-8").alias("value"))
    lines = whole.select("run", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    from wardline.operators.windows import carry_generation

    found = text.log_line(F.col("line"))
    rows = carry_generation(lines.select("run", "line_no", *(c.alias(k) for k, c in found.items())))
    keep = [k for k in found if k != "generation"]
    return rows.where("generation IS NOT NULL").groupBy("run", "generation").agg(*(F.first(k, ignorenulls=True).alias(k) for k in keep))


def summary_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").startswith("#"))
    return lines.select("value", *(c.alias(k) for k, c in text.summary_line(F.col("value")).items()))


def best_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.BEST_RUN).json(path)


def best_log(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Tab-separated rows keyed by their first column; later lines win."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("line <> ''")
    names = [c.split()[0] for c in re.split(r",\s*", columns)]
    row = F.from_csv("line", columns, {"sep": "\t"}).alias("r")
    return lines.select("line_no", row).select("line_no", "r.*").groupBy(names[0]).agg(F.max_by(F.struct(*names[1:]), "line_no").alias("r")).select(names[0], "r.*")


def _submitted(spark: SparkSession, folder: str, suffix: str, most: int, found: DataFrame | None) -> DataFrame:
    """(path, modificationTime, content) of the files below ``folder``, or of those ``found`` there, that may be submissions."""
    found = folders.listing(spark, folder) if found is None else found
    found = found.where((F.col("length") <= most) & F.col("path").endswith(suffix) & ~F.col("path").contains("/Attic/"))
    return folders.contents(found.select("path", F.col("modified").alias("modificationTime")), folder)


def json_submissions(spark: SparkSession, folder: str, most: int = 1_000_000, found: DataFrame | None = None) -> DataFrame:
    """Submission files: JSON objects of at most ``most`` bytes with n, ok and a solution or a summary."""
    files = _submitted(spark, folder, ".json", most, found).select("path", "modificationTime", F.decode("content", "UTF-8").alias("body"))
    parsed = files.where(F.ltrim("body").startswith("{")).select("path", "modificationTime", F.sha2("body", 256).alias("sha"), F.from_json("body", schema.RESULT).alias("r"))
    return parsed.where("r.n IS NOT NULL AND r.ok AND (r.`bestKmpp.dsz` IS NOT NULL OR r.statsum IS NOT NULL)").select("path", "modificationTime", "sha", "r.*")


def archived_submissions(spark: SparkSession, folder: str, most: int = 1_000_000, found: DataFrame | None = None) -> DataFrame:
    """Submissions in tar.gz archives of at most ``most`` bytes: (path, modificationTime, sha, n, vars, solution, statsum).  Their members are ``vars``, a
    URL query that has a config or a path, and perhaps ``solution`` and ``statsum``."""
    kept = {"vars": "vars string", "solution": "solution binary", "statsum": "statsum string"}

    def unpack(batches):
        for batch in batches:
            rows = [binary.tar_contents(c) for c in batch["content"]]
            text = lambda r, k: r[k].decode(errors="replace") if k in r else None
            yield batch[["path", "modificationTime"]].assign(sha=[hashlib.sha256(c).hexdigest() for c in batch["content"]], vars=[text(r, "vars") for r in rows], solution=[r.get("solution") for r in rows], statsum=[text(r, "statsum") for r in rows])

    rows = _submitted(spark, folder, ".tar.gz", most, found).mapInPandas(unpack, f"path string, modificationTime timestamp, sha string, {', '.join(kept.values())}")
    value = lambda k: F.url_decode(F.regexp_extract("vars", rf"(?:^|&){k}=([^&]*)", 1))
    config = F.coalesce(F.nullif(value("config"), F.lit("")), F.nullif(F.regexp_extract(value("path"), r"([A-Z]{2}_[A-Z][A-Za-z]+)", 1), F.lit("")))
    return rows.withColumn("n", config).where("vars IS NOT NULL AND n IS NOT NULL").select("path", "modificationTime", "sha", "n", "vars", "solution", "statsum")


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, sha, n, solution, statsum) of JSON files and tar.gz archives below ``folder``: one scan over both kinds."""
    columns = ["path", "modificationTime", "sha", "n", "solution", "statsum"]
    found = folders.listing(spark, folder)
    plain = json_submissions(spark, folder, found=found).withColumn("solution", F.unbase64("`bestKmpp.dsz`")).select(*columns)
    return plain.unionByName(archived_submissions(spark, folder, found=found).select(*columns))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of text files, plain or, by their names, gzipped."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def large_enough(spark: SparkSession, path: str, least: int) -> DataFrame:
    """(file, length) of files of at least ``least`` bytes; contents are not read."""
    found = folders.listing(spark, path)
    return found.where(F.col("length") >= least).select(F.substring_index("path", "/", -1).alias("file"), "length")


def folder_listing(spark: SparkSession, page: str) -> DataFrame:
    """Distinct (path, fips, county) links of a saved directory index page."""
    link = F.explode(F.regexp_extract_all("value", F.lit(r'href="(tl_\d+_(?:\d{5}|\d{2})_[^"]*\.zip)"'), F.lit(1)))
    code = F.regexp_extract("path", r"tl_\d+_(\d{2})(\d{3})?_", 1)
    return spark.read.text(page, wholetext=True).select(link.alias("path")).distinct().select("path", code.alias("fips"), F.regexp_extract("path", r"tl_\d+_\d{2}(\d{3})_", 1).alias("county"))


def colors(spark: SparkSession, path: str) -> DataFrame:
    """(number, r, g, b) from lines of a number and three hexadecimal bytes."""
    parts = F.split("value", " ")
    byte = lambda n: F.conv(F.get(parts, F.lit(n)), 16, 10).cast("int")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).cast("int").alias("number"), byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"))
