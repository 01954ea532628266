"""Registered queries: configurations, text formats read back from files, small measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import schema
from wardline.functions import geo, text
from wardline.operators import graph, metrics, settings, windows
from wardline.plans import bindings as B
from wardline.plans.measures import ORACLE_SQL as _KNOWN_SQL
from wardline.plans.measures import QUERIES as _KNOWN
from wardline.plans.solvers import default_generations
from wardline.shared import shared_folder as folder
from wardline.sources import files, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str):
    assert name not in _KNOWN and name not in _KNOWN_SQL

    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return add


def fixed(fields: dict[tuple[int, int], Column]) -> Column:
    """A fixed-width line with the fields at (start, stop)."""
    parts, at = [], 0
    for (start, stop), value in sorted(fields.items()):
        if start > at:
            parts.append(F.lit(" " * (start - at)))
        parts.append(F.rpad(value.cast("string"), stop - start, " "))
        at = stop
    return F.concat(*parts)


def text_file(lines: DataFrame, value: Column, gzip: bool = False) -> str:
    path = folder(lines.sparkSession)
    lines.select(value.alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)
    return path


def zeros(c: str | Column, n: int) -> Column:
    """With zeros before it to ``n`` digits; a longer number stays whole."""
    digits = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(F.length(digits) < n, F.lpad(digits, n, "0")).otherwise(digits)


# ---------------------------------------------------------------- configurations


CONFIG_SQL = "SELECT n_name AS name, n_nationkey AS k, n_regionkey AS r FROM nation"


@query("j23_config_overrides", f"SELECT name, CASE WHEN k = 3 THEN 'own' WHEN k = 5 THEN 'late' ELSE 'all' END AS d, CASE WHEN k = 3 THEN 'x' END AS extra, k::VARCHAR AS kept FROM ({CONFIG_SQL})")
def _(spark, sf):
    n = B.table(spark, sf, "nation")
    pair = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    configs = n.select(F.col("n_name").alias("name"), pair("-d", "1", "-k", F.col("n_nationkey").cast("string")).alias("kwargs"))
    own = n.where("n_nationkey = 3").select(F.lit(3).alias("seq"), F.col("n_name").alias("target"), pair("-d", "own", "-x", "x").alias("kwargs"))
    late = n.where("n_nationkey = 5").select(F.lit(1).alias("seq"), F.col("n_name").alias("target"), pair("-d", "early").alias("kwargs"))
    late = late.unionByName(late.select(F.lit(4).alias("seq"), "target", pair("-d", "late").alias("kwargs")))
    every = spark.range(1).select(F.lit(2).alias("seq"), F.lit("all").alias("target"), pair("-d", "all").alias("kwargs"))
    out = settings.overridden(configs, own.unionByName(late).unionByName(every))
    return out.select("name", *(F.col("kwargs")[k].alias(c) for k, c in (("-d", "d"), ("-x", "extra"), ("-k", "kept"))))


OVERLAY_SQL = """WITH s AS (SELECT n_name AS name, unnest(['common.kwargs.d', 'common.kwargs.k', 'solver', 'weight']) AS path, n_nationkey::VARCHAR AS value FROM nation),
o AS (SELECT 'common.kwargs' AS path, 'flat' AS value UNION ALL SELECT 'solver.args', 'q' UNION ALL SELECT 'weight', '9')
SELECT * FROM s WHERE path NOT IN ('common.kwargs.d', 'common.kwargs.k', 'solver', 'weight') UNION ALL SELECT n_name, path, value FROM nation, o"""


@query("j24_server_overlay", OVERLAY_SQL)
def _(spark, sf):
    path = F.explode(F.array(*(F.lit(p) for p in ("common.kwargs.d", "common.kwargs.k", "solver", "weight"))))
    rows = B.table(spark, sf, "nation").select(F.col("n_name").alias("name"), path.alias("path"), F.col("n_nationkey").cast("string").alias("value"))
    over = spark.createDataFrame([("common.kwargs", "flat"), ("solver.args", "q"), ("weight", "9")], "path string, value string")
    return settings.overlaid(rows, over)


@query("p11_name_filter", "SELECT c_name AS name FROM customer WHERE (regexp_matches(c_name, '1') OR regexp_matches(c_name, 'r#0*2')) AND NOT regexp_matches(c_name, '7$')")
def _(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit(False).alias("disabled"))
    return windows.name_filter(c, ["1", "r#0*2"], ["7$"]).select("name")


@query("p12_glob", "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND regexp_matches(c_name, '^Customer#.*1.$')")
def _(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("disabled"))
    return windows.name_filter(c, [settings.unglob("Customer#*1?")], []).select("c_custkey")


@query("f08_column_list", "SELECT o_orderkey, 'f' || o_custkey AS file, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS first, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 ELSE 0 END AS n FROM orders")
def _(spark, sf):
    o = B.table(spark, sf, "orders")
    numbers = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(":"), F.array_join(F.array_repeat(F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 3).cast("int")), ","))).otherwise("")
    got = settings.column_list(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), numbers))
    rows = o.select("o_orderkey", got.alias("c"))
    return rows.select("o_orderkey", "c.file", F.get("c.columns", F.lit(0)).cast("long").alias("first"), F.size("c.columns").cast("long").alias("n"))


@query("f16_arguments", "SELECT c_custkey, 'a b' AS b, c_custkey::VARCHAR AS n, c_custkey % 2 = 0 AS verbose, 5::INT AS tokens FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'a b', c_custkey::VARCHAR, false, 4 FROM customer WHERE c_custkey % 2 = 1")
def _(spark, sf):
    k = F.col("c_custkey")
    line = F.concat(F.lit("--n="), k.cast("string"), F.lit(" \t-b a\\ b  word"), F.when(k % 2 == 0, " -verbose").otherwise(""))
    rows = B.table(spark, sf, "customer").select("c_custkey", settings.arg_tokens(line).alias("t"))
    rows = rows.select("c_custkey", settings.arg_map(F.col("t")).alias("m"), F.size("t").alias("tokens"))
    return rows.select("c_custkey", F.col("m")["-b"].alias("b"), F.col("m")["-n"].alias("n"), F.map_contains_key("m", "-verbose").alias("verbose"), "tokens")


@query("f36_argument_lists", "SELECT c_custkey, '-n' || ' ' || c_custkey || ' -q' AS line FROM customer")
def _(spark, sf):
    kwargs = F.create_map(F.lit("-n"), F.col("c_custkey").cast("string"), F.lit("-q"), F.lit(None).cast("string"))
    return B.table(spark, sf, "customer").select("c_custkey", F.array_join(settings.arg_list(kwargs), " ").alias("line"))


@query("f35_merged_arguments", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b, CASE WHEN c_custkey % 2 = 1 THEN 'added' END AS c FROM customer")
def _(spark, sf):
    even = F.col("c_custkey") % 2 == 0
    over = F.when(even, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.create_map(F.lit("c"), F.lit("added")))
    m = text.merge_args(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")), over)
    return B.table(spark, sf, "customer").select("c_custkey", m.alias("m")).select("c_custkey", *(F.col("m")[k].alias(k) for k in "abc"))


@query("f41_query_args", "SELECT o_orderkey, o_custkey::VARCHAR AS cust, o_orderstatus AS s FROM orders")
def _(spark, sf):
    m = text.query_args(F.concat(F.lit("cust="), F.col("o_custkey").cast("string"), F.lit("&s="), F.col("o_orderstatus")))
    return B.table(spark, sf, "orders").select("o_orderkey", m["cust"].alias("cust"), m["s"].alias("s"))


@query("f14_config_parts", "SELECT 'S' || n_nationkey || '_Senate_2' AS name, 'S' || n_nationkey AS state, 'Senate_2' AS body FROM nation")
def _(spark, sf):
    n = B.table(spark, sf, "nation").select(F.concat(F.lit("S"), "n_nationkey", F.lit("_Senate_2")).alias("name"))
    return n.select("name", *(c.alias(k) for k, c in text.config_parts(F.col("name")).items()))


STATES_SQL = "(VALUES " + ", ".join(f"('{n}', '{p}', {f})" for n, p, f in text.state_rows()) + ") s(name, postal, fips)"


@query("f13_states", f"SELECT s_suppkey, name, postal FROM supplier LEFT JOIN {STATES_SQL} ON fips = s_nationkey + 1")
def _(spark, sf):
    states = spark.createDataFrame(text.state_rows(), "name string, postal string, fips long")
    return B.table(spark, sf, "supplier").join(states, F.col("fips") == F.col("s_nationkey") + 1, "left").select("s_suppkey", "name", "postal")


@query("p14_states_wanted", f"SELECT c_custkey, postal FROM customer JOIN {STATES_SQL} ON fips = c_custkey % 80 WHERE fips NOT IN (72, 11)")
def _(spark, sf):
    states = spark.createDataFrame(text.state_rows(), "name string, postal string, fips long").where("fips NOT IN (72, 11)")
    return B.table(spark, sf, "customer").join(states, F.col("fips") == F.col("c_custkey") % 80).select("c_custkey", "postal")


@query("v15_weighted_pick", "SELECT name, weight FROM (SELECT n_name AS name, n_nationkey::DOUBLE + 1 AS weight, sum(n_nationkey + 1) OVER (ORDER BY n_name) AS upto, sum(n_nationkey + 1) OVER () AS whole FROM nation WHERE n_regionkey <> 2) WHERE upto > 0.37 * whole ORDER BY name LIMIT 1")
def _(spark, sf):
    n = B.table(spark, sf, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 1.0).alias("weight"), (F.col("n_regionkey") == 2).alias("disabled"))
    return windows.weighted_pick(n, 0.37)


@query("v10_default_generations", "SELECT c_nationkey AS state, count(*) AS blocks, 10 * count(*) // (1 + c_nationkey % 9) AS grab, 15000::BIGINT AS nearest FROM customer GROUP BY 1")
def _(spark, sf):
    """By state, whose blocks are counted and whose districts are known."""
    n = B.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("state")).agg(F.count(F.lit(1)).alias("blocks"))
    grab = default_generations(F.col("blocks"), 1 + F.col("state") % 9)
    return n.select("state", "blocks", grab.alias("grab"), F.lit(default_generations(0, 1, "nearest")).cast("long").alias("nearest"))


@query("v11_stopped", B.sql("statlog", """SELECT run, min(generation) AS stop FROM (SELECT run, generation, count(kmpp) OVER w AS n, (max(kmpp) OVER w - min(kmpp) OVER w) / nullif(kmpp, 0) AS a, (max(spread) OVER w - min(spread) OVER w) / 1000.0::DOUBLE AS b
  FROM statlog WINDOW w AS (PARTITION BY run ORDER BY generation ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n >= 4 AND a < 2.5 AND b < 2.5 GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    return windows.stopped(B.statlog(spark, sf), 1000.0, 4, 2.5)


@query("a33_house_seats", "SELECT sum(n_regionkey + 1)::BIGINT AS seats, sum(n_regionkey + 1) = 435 AS right FROM nation WHERE n_nationkey % 3 <> 0")
def _(spark, sf):
    n = B.table(spark, sf, "nation").select((F.col("n_regionkey") + 1).alias("seats"), F.when(F.col("n_nationkey") % 3 != 0, "Congress").otherwise("Senate").alias("short"))
    return metrics.house_seats(n)


# ---------------------------------------------------------------- scanners and writers


@query("s02_geography_2010", B.sql("blocks", "SELECT 120010000000000 + ubid * 10000 + 1 AS ubid, ubid::INT AS recno, trunc(lon / 1000000.0::DOUBLE * 1000000)::INT AS lon, trunc(lat / 1000000.0::DOUBLE * 1000000)::INT AS lat, pop::INT AS pop, area, CASE WHEN ubid % 2 = 0 THEN place ELSE 0 END AS place FROM blocks WHERE ubid % 3 > 0"))
def _(spark, sf):
    b, micro = B.blocks(spark, sf), lambda c: F.format_string("%.6f", F.col(c) / 1_000_000)
    line = fixed({
        (8, 11): F.when(F.col("ubid") % 3 > 0, "750").otherwise("140"), (18, 25): zeros("ubid", 7), (27, 29): F.lit("12"), (29, 32): F.lit("001"), (45, 50): zeros("place", 5),
        (50, 52): F.when(F.col("ubid") % 2 == 0, "C1").otherwise("U1"), (54, 60): zeros("ubid", 6), (61, 65): F.lit("0001"), (198, 212): F.col("area"), (318, 327): F.col("pop"),
        (336, 347): micro("lat"), (347, 359): micro("lon"),
    })
    return files.geography(spark, text_file(b, line))


@query("s01_s16_geography_2000", B.sql("blocks", "SELECT 120010000000000 + ubid * 10000 + 1 AS ubid, ubid::INT AS recno, lon::INT AS lon, -lat::INT AS lat, pop::INT AS pop, area, CASE WHEN ubid % 2 = 0 THEN district END AS old_district FROM blocks"))
def _(spark, sf):
    district = F.when(F.col("ubid") % 2 == 0, zeros(F.col("district") + 1, 2)).otherwise("  ")
    line = fixed({
        (18, 25): zeros("ubid", 7), (29, 31): F.lit("12"), (31, 34): F.lit("001"), (55, 61): zeros("ubid", 6), (62, 66): F.lit("0001"), (138, 140): district,
        (172, 186): F.col("area"), (292, 301): F.col("pop"), (310, 319): -F.col("lat"), (319, 331): F.col("lon"),
    })
    return files.geography_2000(spark, text_file(B.blocks(spark, sf), line)).withColumn("old_district", F.col("old_district").cast("int"))


@query("s03_s04_geography_2020", B.sql("blocks", "SELECT 120010000000000 + ubid * 10000 + 1 AS ubid, ubid::INT AS recno, trunc(lon / 1000000.0::DOUBLE * 1000000)::INT AS lon, trunc(lat / 1000000.0::DOUBLE * 1000000)::INT AS lat, pop::INT AS pop, area, CASE WHEN ubid % 2 = 0 THEN place ELSE 0 END AS place FROM blocks WHERE ubid % 3 > 0"))
def _(spark, sf):
    micro = lambda c: F.format_string("%.6f", F.col(c) / 1_000_000)
    has = {
        "level": F.when(F.col("ubid") % 3 > 0, "750").otherwise("140"), "recno": F.col("ubid"), "state": F.lit("12"), "county": F.lit("001"), "place": F.col("place"), "tract": F.col("ubid"),
        "place_class": F.when(F.col("ubid") % 2 == 0, "C5").otherwise("U1"), "block": F.lit("0001"), "land": F.col("area"), "pop": F.col("pop"), "lat": micro("lat"), "lon": micro("lon"),
    }
    at = {files.COLUMNS_2020[k]: v for k, v in has.items()} | {0: F.lit("PLST")}
    line = F.concat_ws("|", *(at.get(n, F.lit("")).cast("string") for n in range(97)))
    return files.geography(spark, text_file(B.blocks(spark, sf), line))


@query("s06_s07_demographic_columns", B.sql("demographics", "SELECT recno::INT AS recno, total, r FROM demographics"))
def _(spark, sf):
    d = B.demographics(spark, sf)
    head = spark.range(1).select(F.lit("FILEID,LOGRECNO,P1,P2").alias("value"))
    rows = d.select(F.concat_ws(",", F.lit("x"), "recno", "total", F.concat("r", F.lit(" ok"))).alias("value"))
    return files.demographics(spark, text_file(head.unionByName(rows), F.col("value")), 1, {"total": 2, "r": 3})


@query("s27_p08_race_counts", """SELECT LOGRECNO, total, white, total >= one + more AND one + more >= numbered AND total >= numbered AND one >= single AS valid FROM (
  SELECT l_suppkey AS LOGRECNO, count(*) AS total, count(*) FILTER (l_linenumber = 1) AS white, count(*) FILTER (l_linenumber <= 3) AS one, count(*) FILTER (l_linenumber = 4) AS more,
    count(*) FILTER (l_linenumber <= 2) + count(*) FILTER (l_quantity > 40) AS numbered, count(*) FILTER (l_linenumber = 1) + count(*) FILTER (l_linenumber = 2) + l_suppkey % 9 AS single FROM lineitem GROUP BY 1)""")  # fmt: skip
def _(spark, sf):
    n = lambda cond: F.count_if(cond)
    line, k = F.col("l_linenumber"), F.col("l_suppkey")
    rows = B.table(spark, sf, "lineitem").groupBy(k.alias("LOGRECNO")).agg(F.count(F.lit(1)).alias("total"), n(line == 1).alias("white"), n(line == 2).alias("black"), n(line <= 3).alias("one"), n(line == 4).alias("more"), n(line <= 2).alias("r1"), n(F.col("l_quantity") > 40).alias("r2"))
    c = {x: F.col(x) for x in rows.columns}
    valid = text.races_add_up(c["total"], c["one"], c["more"], [c["r1"], c["r2"]], [c["white"], c["black"], c["LOGRECNO"] % 9])
    return rows.select("LOGRECNO", "total", "white", valid.alias("valid"))


@query("s18_place_names", "SELECT p_partkey::INT AS place, p_name AS name FROM part")
def _(spark, sf):
    line = F.concat_ws("|", F.lit("IA"), F.lit("19"), zeros("p_partkey", 5), "p_name", F.lit("Incorporated Place"), F.lit("C1"), F.lit("Story County"))
    return files.place_names(spark, text_file(B.table(spark, sf, "part"), line)).select("place", "name")


@query("s28_k09_statlog_round_trip", B.sql("statlog", "SELECT run::VARCHAR AS run, generation, kmpp FROM statlog WHERE generation % 2 = 0"))
def _(spark, sf):
    out = folder(spark)
    sinks.write_statlogs(B.statlog(spark, sf), out, 2)
    rows = files.statlog_text(spark, out)
    return rows.select(F.regexp_extract("run", r"run=(\d+)/", 1).alias("run"), "generation", "kmpp")


@query("s30_k14_best_runs", B.sql("submissions", "SELECT config AS n, kmpp, spread FROM submissions WHERE kmpp >= 1e-6"))
def _(spark, sf):
    out = folder(spark)
    rows = B.submissions(spark, sf).select(F.col("config").alias("n"), F.struct(F.col("kmpp").alias("Kmpp"), F.col("spread").alias("Spread")).alias("b"), F.lit(True).alias("ok"), F.lit(100).alias("generation"))
    sinks.append_log(rows, out)
    return files.best_runs(spark, out).where("ok AND b.Kmpp >= 1e-6").select("n", F.col("b.Kmpp").alias("kmpp"), F.col("b.Spread").alias("spread"))


@query("s34_best_log", "SELECT 's' || k AS name, arg_max(o_totalprice, o_orderkey) AS kmpp FROM (SELECT *, o_custkey % 40 AS k FROM orders) GROUP BY 1")
def _(spark, sf):
    line = F.concat_ws("\t", F.concat(F.lit("s"), F.col("o_custkey") % 40), F.col("o_totalprice"))
    ordered = B.table(spark, sf, "orders").select(line.alias("value"), (F.col("o_custkey") % 40).alias("deal"), "o_orderkey")
    out = folder(spark)
    ordered.repartition("deal").sortWithinPartitions("o_orderkey").select("value").write.text(out)  # a log a file, in its order
    return files.best_log(spark, out, "name string, kmpp double")


@query("s35_legislatures", "SELECT n_name AS state, 'House of ' || n_nationkey AS body, n_regionkey::INT + 1 AS seats, 'House' AS short FROM nation")
def _(spark, sf):
    line = F.concat_ws(",", "n_name", F.concat(F.lit("House of "), F.col("n_nationkey")), F.col("n_regionkey") + 1)
    return files.legislatures(spark, text_file(B.table(spark, sf, "nation"), line))


@query("s38_folder_listing", "SELECT DISTINCT 'tl_2009_' || lpad((s_nationkey + 10)::VARCHAR, 2, '0') || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') || '_faces.zip' AS path, lpad((s_nationkey + 10)::VARCHAR, 2, '0') AS fips, lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS county FROM supplier")
def _(spark, sf):
    s = B.table(spark, sf, "supplier")
    link = F.concat(F.lit('<a href="tl_2009_'), zeros(F.col("s_nationkey") + 10, 2), zeros(F.col("s_suppkey") % 1000, 3), F.lit('_faces.zip">x</a> <a href="other.txt">'))
    return files.folder_listing(spark, text_file(s, link))


@query("s39_zip_points", B.sql("blocks", "SELECT 'z' || ubid AS name, pop::INT AS pop, lat / 1000.0::DOUBLE AS lat, -lon / 1000.0::DOUBLE AS lon FROM blocks"))
def _(spark, sf):
    degrees = lambda c: F.format_string("%.3f", c / 1000)
    line = fixed({(2, 66): F.concat(F.lit("z"), F.col("ubid")), (66, 75): F.col("pop"), (136, 146): degrees(F.col("lat")), (146, 157): degrees(-F.col("lon"))})
    return files.zip_points(spark, text_file(B.blocks(spark, sf), line))


@query("k07_place_populations", B.sql("blocks", "SELECT place, sum(pop)::BIGINT AS pop, coalesce(any_value(p_name), '') AS name FROM blocks LEFT JOIN part ON place = p_partkey WHERE place NOT IN (0, 99999) GROUP BY 1"))
def _(spark, sf):
    return sinks.place_populations(B.blocks(spark, sf), B.table(spark, sf, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name")))


@query("k17_split_columns", "SELECT 'n_name' AS col, count(*) AS lines, sum(length(n_name))::BIGINT AS characters FROM nation UNION ALL SELECT 'n_regionkey', count(*), sum(length(n_regionkey::VARCHAR))::BIGINT FROM nation")
def _(spark, sf):
    out = folder(spark)
    sinks.split_columns(B.table(spark, sf, "nation").select("n_name", "n_regionkey"), out)
    read = lambda c: spark.read.text(f"{out}/{c}").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("characters")).select(F.lit(c).alias("col"), "lines", "characters")
    return read("n_name").unionByName(read("n_regionkey"))


@query("r09_color_file", "SELECT c_custkey::INT AS number, (c_custkey % 256)::INT AS r, (c_custkey * 7 % 256)::INT AS g, (c_custkey * 31 % 256)::INT AS b FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    lines = sinks.color_lines(B.table(spark, sf, "customer").select(k.alias("number"), (k % 256).alias("r"), (k * 7 % 256).alias("g"), (k * 31 % 256).alias("b")))
    out = folder(spark)
    lines.write.text(out)
    return files.colors(spark, out)


# ---------------------------------------------------------------- joins and measures


@query("j16_nearest_point", """SELECT id, other, miles FROM (SELECT a.id, b.id AS other, m.miles, row_number() OVER (PARTITION BY a.id ORDER BY m.miles, b.id) AS k FROM p a JOIN p b ON a.id <> b.id,
  LATERAL (SELECT round(2 * 3956 * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))), 6) AS miles) m) WHERE k = 1""".join(
    ["WITH p AS (SELECT s_suppkey AS id, 24 + (s_suppkey * 7919 % 2400) / 100.0::DOUBLE + s_suppkey / 1e5::DOUBLE AS lat, -120 + (s_suppkey * 104729 % 5000) / 100.0::DOUBLE + s_suppkey / 3e5::DOUBLE AS lon FROM supplier)\n", ""]))
def _(spark, sf):
    k = F.col("s_suppkey")
    points = B.table(spark, sf, "supplier").select(k.alias("id"), (24 + (k * 7919 % 2400) / 100 + k / 1e5).alias("lat"), (-120 + (k * 104729 % 5000) / 100 + k / 3e5).alias("lon"))
    return graph.nearest_other(points)


@query("j19_party_grid", B.sql("blocks", "SELECT lat // 1000 AS grid, district, count(*) FILTER (pop % 2 = 0) AS x, count(*) FILTER (pop % 2 = 1) AS o FROM blocks GROUP BY 1, 2"))
def _(spark, sf):
    row = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("lon", c.alias("v")))), lambda s: s.v)
    b = B.blocks(spark, sf)
    party, layout = F.when(F.col("pop") % 2 == 0, "x").otherwise("o"), F.col("district")
    grids = b.groupBy(F.floor(F.col("lat") / 1000).alias("grid")).agg(row(party).alias("party"), row(layout).alias("layout"))
    return metrics.party_counts(grids)


@query("j20_polygon_districts", B.sql("blocks", "SELECT count(*) AS polygons, count(m.district) AS placed, count(*) - count(m.district) AS misses FROM blocks LEFT JOIN (SELECT ubid + 1000000 AS ubid, district FROM blocks WHERE ubid % 5 <> 0) m ON blocks.ubid + 1000000 = m.ubid"))
def _(spark, sf):
    b = B.blocks(spark, sf).withColumn("ubid", F.col("ubid") + 1_000_000)
    out = folder(spark)
    sinks.write_solution(b.where("ubid % 5 <> 0"), out)
    placed = b.select("ubid").join(files.solution_csv(spark, out), "ubid", "left")
    return placed.agg(F.count(F.lit(1)).alias("polygons"), F.count("district").alias("placed"), F.count_if(F.col("district").isNull()).alias("misses"))


@query("j21_membership", B.sql("blocks", "SELECT place, (lon // 4000)::BIGINT AS county, count(*) AS blocks FROM blocks GROUP BY 1, 2"))
def _(spark, sf):
    return metrics.membership(B.blocks(spark, sf).withColumn("county", F.floor(F.col("lon") / 4000)))


@query("a07_moving_center_stats", B.sql("blocks sums", """SELECT round(sum(b.pop * sqrt((lon - (area_x / s.area + 500)) ** 2 + (lat - (area_y / s.area - 250)) ** 2)) / sum(b.pop) / 360e6 * 40075.013481, 6) AS kmpp,
  (SELECT max(pop) - min(pop) FROM sums) AS spread, (SELECT round(stddev_samp(pop), 6) FROM sums) AS std, 0::BIGINT AS median FROM blocks b JOIN sums s USING (district)"""))  # fmt: skip
def _(spark, sf):
    b = B.blocks(spark, sf)
    centers = metrics.district_centers(b).select("district", (F.col("land_x") + 500).alias("cx"), (F.col("land_y") - 250).alias("cy"))
    s = metrics.moving_center_stats(b, centers)
    return s.select(F.round("kmpp", 6).alias("kmpp"), "spread", F.round("std", 6).alias("std"), "median")


@query("a24_f07_run_totals", "SELECT round(sum(o_totalprice) FILTER (o_orderkey % 7 <> 0), 2) AS seconds, count(*) AS runs, count(*) FILTER (o_orderkey % 7 = 0) AS bad FROM orders")
def _(spark, sf):
    said = F.when(F.col("o_orderkey") % 7 == 0, "no such line").otherwise(F.concat(F.lit("x\n#District calculation: "), F.col("o_totalprice").cast("string"), F.lit(" sec user time\n")))
    return metrics.run_totals(B.table(spark, sf, "orders").select(said.alias("text"))).withColumn("seconds", F.round("seconds", 2))


@query("a25_race_winner_range", B.sql("races", "SELECT min(w) AS smallest, max(w) AS biggest, arg_min(district, (w, district)) AS smallest_race, arg_max(district, (w, district)) AS biggest_race FROM (SELECT district, greatest(d, r, g, l, other) AS w FROM races)"))
def _(spark, sf):
    return metrics.winner_range(windows.winners(B.races(spark, sf)))


@query("t11_better_bundle", "SELECT fips, arg_max(path, (year, vintage)) AS path FROM (SELECT lpad((c_custkey % 50 + 1)::VARCHAR, 2, '0') AS fips, 2000 + c_custkey // 50 % 25 AS year, [0, 1, 2][c_custkey // 1250 % 3 + 1] AS vintage, 'tl_' || (2000 + c_custkey // 50 % 25) || '_' || lpad((c_custkey % 50 + 1)::VARCHAR, 2, '0') || '_tabblock' || ['', '00', '10'][c_custkey // 1250 % 3 + 1] || '.zip' AS path FROM customer) GROUP BY 1")
def _(spark, sf):
    k = F.col("c_custkey")
    part = lambda n, m: F.floor(k / n).cast("long") % m
    kinds = F.element_at(F.array(F.lit(""), F.lit("00"), F.lit("10")), (part(1250, 3) + 1).cast("int"))
    fips = zeros(k % 50 + 1, 2)
    path = F.concat(F.lit("tl_"), part(50, 25) + 2000, F.lit("_"), fips, F.lit("_tabblock"), kinds, F.lit(".zip"))
    rows = B.table(spark, sf, "customer").select(fips.alias("fips"), path.alias("path"))
    return rows.groupBy("fips").agg(F.max_by("path", text.bundle_rank(F.col("path"))).alias("path"))


# ---------------------------------------------------------------- text and numbers


@query("f02_analyzer_text", B.sql("submissions", "SELECT id, kmpp, spread, 1.5::DOUBLE AS std FROM submissions"))
def _(spark, sf):
    s = B.submissions(spark, sf)
    said = F.concat(F.col("kmpp").cast("string"), F.lit(" Km/person\nmax="), F.col("spread").cast("string"), F.lit(" (dist# 1) min=0 (dist# 2)\nstd=1.5\n"))
    got = text.analyzer_text(said)
    return s.select("id", *(got[k].alias(k) for k in ("kmpp", "spread", "std")))


@query("f03_start_stats", "SELECT o_orderkey, o_totalprice AS kmpp, o_custkey::DOUBLE AS average, o_orderkey::DOUBLE - 1 AS spread FROM orders")
def _(spark, sf):
    said = F.concat(F.col("o_totalprice").cast("string"), F.lit("\tKm/p\navg="), F.col("o_custkey").cast("string"), F.lit(" max="), F.col("o_orderkey").cast("string"), F.lit(" min=1"))
    got = text.start_stats(said)
    return B.table(spark, sf, "orders").select("o_orderkey", *(got[k].alias(k) for k in ("kmpp", "average", "spread")))


@query("f05_variability_line", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS kmpp_var FROM orders")
def _(spark, sf):
    per = F.when(F.col("o_orderkey") % 2 == 0, "5000").otherwise("1000")
    got = text.variability_line(F.concat(F.lit("kmpp var per "), per, F.lit("="), F.col("o_totalprice").cast("string")))
    return B.table(spark, sf, "orders").select("o_orderkey", got["kmpp_var"].alias("kmpp_var"))


@query("f06_binlog_dump", "SELECT o_orderkey, o_totalprice AS kmpp, o_custkey::DOUBLE AS min_pop, o_orderkey::DOUBLE AS max_pop FROM orders")
def _(spark, sf):
    line = F.concat(F.lit("gen=1 kmpp="), F.col("o_totalprice").cast("string"), F.lit(" minPop="), F.col("o_custkey").cast("string"), F.lit(" maxPop="), F.col("o_orderkey").cast("string"))
    return B.table(spark, sf, "orders").select("o_orderkey", *(c.alias(k) for k, c in text.binlog_dump(line).items()))


@query("f09_f10_fields", "SELECT o_orderkey, o_custkey AS second, o_orderstatus AS third FROM orders")
def _(spark, sf):
    raw = lambda sep: F.concat_ws(sep, F.lit("x"), F.concat(F.col("o_custkey").cast("string"), F.lit("q")), "o_orderstatus")
    return B.table(spark, sf, "orders").select("o_orderkey", text.leading_int(text.pipe_field(raw(","), 1, ",")).alias("second"), text.pipe_field(raw("|"), 2).alias("third"))


@query("f12_escaped_html", "SELECT o_orderkey, '&lt;b&gt; &amp; &quot;' || o_orderstatus || '&quot;&#x27;' AS html, 'http://h/' || o_orderkey || '/x' AS url, 'a' || o_orderkey AS template FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey").cast("string")
    url = text.url_join(F.lit("http://h/"), F.concat(F.lit("/"), k), F.lit(""), F.lit("x"))
    return B.table(spark, sf, "orders").select(
        "o_orderkey", text.html_escape(F.concat(F.lit('<b> & "'), "o_orderstatus", F.lit("\"'"))).alias("html"), url.alias("url"), text.strip_comments(F.concat(F.lit("{# n\no #}a"), k, F.lit("{##}"))).alias("template")
    )


@query("f15_truthiness", "SELECT o_orderkey, o_orderkey % 4 < 2 AS yes FROM orders")
def _(spark, sf):
    word = F.element_at(F.array(F.lit(" Yes"), F.lit("TRUE"), F.lit("no"), F.lit(None).cast("string")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return B.table(spark, sf, "orders").select("o_orderkey", text.truthy(word).alias("yes"))


@query("f18_labels", "SELECT o_orderkey, 'Total pop ' || o_custkey AS label, 9::INT AS indent FROM orders")
def _(spark, sf):
    raw = F.concat(F.lit(" \tTotal&nbsp;pop<br /> "), F.col("o_custkey").cast("string"), F.lit("  "))
    return B.table(spark, sf, "orders").select("o_orderkey", text.clean_label(raw).alias("label"), text.indent_width(raw).alias("indent"))


@query("f21_f22_ages", "SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-06-01 00:00:00') / 1e6::DOUBLE AS seconds, date_diff('microsecond', ts, TIMESTAMP '2024-06-01 00:00:00') > 259200000000 AS stale FROM events")
def _(spark, sf):
    now, ts = F.lit("2024-06-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")
    return B.table(spark, sf, "events").select("event_id", ((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000).alias("seconds"), settings.stale(ts, now, 3 * 86400).alias("stale"))


@query("f25_f28_pixels", B.sql("blocks", "SELECT ubid, floor(((30 + pop % 10) - 30 + 1) / ((20 + ubid % 7 - 10) * cos(radians(((30 + pop % 10) + 29) / 2.0::DOUBLE))) * 1000 + 0.5)::INT AS height, floor((90000 - lat) / 300.0::DOUBLE)::INT AS row, ceil((lon - 500) / 250.0::DOUBLE - 0.5)::INT AS col FROM blocks"))
def _(spark, sf):
    return B.blocks(spark, sf).select(
        "ubid", geo.box_pixels(F.lit(10), F.lit(29), 20 + F.col("ubid") % 7, 30 + F.col("pop") % 10, 1000).alias("height"), geo.pixel_row(F.col("lat"), 90000.0, 300.0).alias("row"), geo.column_right(F.col("lon"), 500.0, 250.0).alias("col")
    )


@query("f27_blend", "SELECT c_custkey, least(255, (c_custkey % 300 / 200.0::DOUBLE * 255)::DECIMAL(20, 0))::INT AS unused, trunc(c_custkey % 256 * 0.5::DOUBLE + 100 * 0.5::DOUBLE)::INT AS mixed FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    return B.table(spark, sf, "customer").select("c_custkey", F.least(F.lit(255), F.round(k % 300 / 200 * 255)).cast("int").alias("unused"), geo.blend(k % 256, F.lit(100), 0.5).alias("mixed"))


@query("f30_r02_lines", B.sql("blocks", "SELECT ubid, greatest(abs(pop % 40 - 3), abs(area - 5))::INT + 1 AS pixels, (pop % 40)::INT AS last_x, area::INT AS last_y FROM blocks"))
def _(spark, sf):
    px = geo.line_pixels(F.lit(3), F.lit(5), F.col("pop") % 40, F.col("area"))
    rows = B.blocks(spark, sf).select("ubid", px.alias("p"))
    return rows.select("ubid", F.size("p").alias("pixels"), F.element_at("p", -1)["x"].alias("last_x"), F.element_at("p", -1)["y"].alias("last_y"))


@query("f31_jitter", "SELECT c_custkey, round(c_custkey % 100 / 100.0::DOUBLE * 0.5 * (cos(2 * pi() * c_custkey / 5000) + 1), 6) AS moved, round(0.3 * (cos(c_custkey / 1000.0::DOUBLE) + 1), 6) AS annealed FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    return B.table(spark, sf, "customer").select("c_custkey", F.round(geo.jitter(k % 100 / 100, 5000, k), 6).alias("moved"), F.round(geo.annealed(0.3, k), 6).alias("annealed"))


@query("f40_bitmap", "SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS bit FROM customer")
def _(spark, sf):
    return metrics.marked(B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), B.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


@query("p02_p03_ubid_synthesis", "SELECT o_orderkey, 12 * 10000000000000 + o_custkey % 1000 * 10000000000 + o_orderkey % 1000000 * 10000 + 7 AS ubid, '12' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || '0007' AS digits FROM orders")
def _(spark, sf):
    u = schema.ubid(F.lit("12"), F.col("o_custkey") % 1000, F.col("o_orderkey") % 1_000_000, F.lit("0007"))
    return B.table(spark, sf, "orders").select("o_orderkey", u.alias("ubid"), schema.ubid_text(u).alias("digits"))


@query("p04_block_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS id FROM orders")
def _(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    return B.table(spark, sf, "orders").select("o_orderkey", schema.block_id(raw).alias("id"))


@query("p05_incorporated_places", "SELECT c_custkey, CASE WHEN c_custkey % 10 IN (1, 2, 5, 6, 7, 8) THEN c_custkey::INT ELSE 0 END AS place FROM customer")
def _(spark, sf):
    code, kind = F.col("c_custkey").cast("string"), F.concat(F.lit("C"), (F.col("c_custkey") % 10).cast("string"))
    return B.table(spark, sf, "customer").select("c_custkey", files.incorporated(code, kind).alias("place"))


@query("p17_projection", B.sql("blocks", """SELECT ubid, round(k * cos(la) * sin(lo), 6) AS x, round(k * (cos(0.7) * sin(la) - sin(0.7) * cos(la) * cos(lo)), 6) AS y FROM (
  SELECT *, CASE WHEN sin(c) = 0 THEN 1.0 ELSE c / sin(c) END AS k FROM (SELECT *, acos(sin(0.7) * sin(la) + cos(0.7) * cos(la) * cos(lo)) AS c FROM (SELECT ubid, radians(lat / 1000.0::DOUBLE) AS la, radians(lon / 1000.0::DOUBLE) + 0.5 AS lo FROM blocks)))"""))  # fmt: skip
def _(spark, sf):
    x, y = geo.azimuthal(F.radians(F.col("lat") / 1000), F.radians(F.col("lon") / 1000), F.lit(0.7), F.lit(-0.5))
    return B.blocks(spark, sf).select("ubid", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("t01_sorted_blocks", B.sql("blocks", "SELECT ubid, row_number() OVER (ORDER BY ubid) - 1 AS idx FROM blocks"))
def _(spark, sf):
    return metrics.indexed(B.blocks(spark, sf).select("ubid"), "ubid")


@query("st06_time_limit", """SELECT run, seconds, ended IS NULL AND seconds > 21600 AS stop FROM (SELECT *, date_diff('microsecond', started, coalesce(ended, TIMESTAMP '2024-06-01 00:00:00')) / 1e6::DOUBLE AS seconds
  FROM (SELECT user_id AS run, min(ts) AS started, max(ts) FILTER (event_type = 'signup') AS ended FROM events GROUP BY 1))""")  # fmt: skip
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    runs = B.table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(F.min(ts).alias("started"), F.max(F.when(F.col("event_type") == "signup", ts)).alias("ended"))
    return windows.overdue(runs, F.lit("2024-06-01 00:00:00").cast("timestamp")).select("run", "seconds", "stop")
