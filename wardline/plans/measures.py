"""Registered queries: measures, reports, joins and rankings, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import schema
from wardline.functions import geo, text
from wardline.operators import graph, metrics, windows
from wardline.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """As SQL's round of a double: x * 10 ** digits goes to the nearest whole number, a half away from zero.  ``F.round`` goes by the decimal
    digits that x is shown with, and differs where the product is a half and x is not, or the other way about."""
    kinds, scale = dict(df.dtypes), 10.0**digits

    def nearest(c: str) -> Column:
        if kinds[c] != "double":
            return F.round(F.col(c), digits)
        x = F.signum(c) * F.round(F.abs(F.col(c) * scale)) / scale
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.col(c)).otherwise(x)  # not finite, or too large to be scaled

    return df.withColumns({c: nearest(c) for c in columns})


# ---------------------------------------------------------------- aggregates


@query("a01_district_sums", B.sql("blocks sums", "SELECT * FROM sums"))
def _(spark, sf):
    return metrics.district_sums(B.blocks(spark, sf))


@query("a02_centers", B.sql("blocks sums", "SELECT district, pop, round(area_x / area, 6) AS land_x, round(area_y / area, 6) AS land_y, round(pop_x / pop, 6) AS pop_cx, round(pop_y / pop, 6) AS pop_cy FROM sums"))
def _(spark, sf):
    return rounded(metrics.district_centers(B.blocks(spark, sf)), "land_x", "land_y", "pop_cx", "pop_cy")


STATS_SQL = """SELECT sum(pop)::BIGINT AS total, round(avg(pop), 6) AS mean, round(stddev_samp(pop), 6) AS std, min(pop) AS min_pop, max(pop) AS max_pop,
  (SELECT pop FROM (SELECT pop, row_number() OVER (ORDER BY pop, district) AS k, count(*) OVER () AS n FROM sums) WHERE k = n // 2 + 1) AS median,
  (SELECT district FROM sums ORDER BY pop, district LIMIT 1) AS min_district, (SELECT district FROM sums ORDER BY pop DESC, district LIMIT 1) AS max_district FROM sums"""


@query("a03_population_stats", B.sql("blocks sums", STATS_SQL))
def _(spark, sf):
    return rounded(metrics.population_stats(metrics.district_sums(B.blocks(spark, sf))), "mean", "std")


KM_SQL = """SELECT round(sum(b.pop * sqrt((lon - area_x / s.area) ** 2 + (lat - area_y / s.area) ** 2)) / sum(b.pop) / 360e6 * 40075.013481, 6) AS kmpp,
  round(sum(b.pop * sqrt((lon - pop_x / s.pop) ** 2 + (lat - pop_y / s.pop) ** 2)) / sum(b.pop) / 360e6 * 40075.013481, 6) AS kmppp FROM blocks b JOIN sums s USING (district)"""


@query("a05_km_per_person", B.sql("blocks sums", KM_SQL))
def _(spark, sf):
    return rounded(metrics.km_per_person(B.blocks(spark, sf)), "kmpp", "kmppp")


@query("a06_unassigned", B.sql("blocks", "SELECT count(*) AS nod_blocks, coalesce(sum(pop), 0)::BIGINT AS nod_pop FROM blocks WHERE ubid % 50 = 0 AND NOT (pop = 0 AND area = 0)"))
def _(spark, sf):
    return metrics.unassigned(B.blocks(spark, sf).withColumn("district", F.when(F.col("ubid") % 50 != 0, F.col("district"))))


@query("a08_pair_distance", B.sql("blocks", """SELECT a.district, round(sum(((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) * (a.pop + b.pop)) / 1e12, 3) AS pair_sum
  FROM blocks a JOIN blocks b ON a.district = b.district AND a.ubid < b.ubid GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    return metrics.pair_distance(B.blocks(spark, sf)).select("district", F.round(F.col("pair_sum") / 1e12, 3).alias("pair_sum"))


DEMO = "joined AS (SELECT b.district, coalesce(d.total, 0) AS total, coalesce(d.a, 0) AS a, coalesce(d.n, 0) AS n, coalesce(d.r, 0) AS r FROM blocks b LEFT JOIN demographics d ON b.ubid = d.recno)"


def _demographic_blocks(spark, sf):
    joined = B.blocks(spark, sf).join(B.demographics(spark, sf), F.col("ubid") == F.col("recno"), "left")
    return joined.fillna(0, ["total", "a", "n", "r"])


@query("a09_demographic_sums", B.sql("blocks demographics", "SELECT x.district, coalesce(sum(total), 0)::BIGINT AS total, coalesce(sum(a), 0)::BIGINT AS a, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(r), 0)::BIGINT AS r FROM (SELECT range::INT AS district FROM range(9)) x LEFT JOIN joined USING (district) GROUP BY 1", DEMO))
def _(spark, sf):
    nine = spark.range(9).select(F.col("id").cast("int").alias("district"))
    return metrics.column_sums(_demographic_blocks(spark, sf), ["total", "a", "n", "r"], nine)


@query("k05_demographic_report_by_column", B.sql("blocks demographics", """SELECT * FROM (UNPIVOT (SELECT district, sum(total)::BIGINT AS total, sum(a)::BIGINT AS a, sum(n)::BIGINT AS n, sum(r)::BIGINT AS r FROM joined GROUP BY 1) ON total, a, n, r INTO NAME "column" VALUE v)
  PIVOT (first(v) FOR district IN (0, 1, 2, 3, 4, 5, 6) GROUP BY "column")""", DEMO))  # fmt: skip
def _(spark, sf):
    columns = ["total", "a", "n", "r"]
    return metrics.transposed(metrics.column_sums(_demographic_blocks(spark, sf), columns), columns, list(range(7)))


PLACES = "places AS (SELECT place, count(DISTINCT district) AS districts, sum(pop)::BIGINT AS pop FROM blocks WHERE place NOT IN (0, 99999) GROUP BY 1)"


@query("a10_place_splits", B.sql("blocks", "SELECT count(*) FILTER (districts = 1) AS whole, count(*) FILTER (districts > 1) AS split, coalesce(sum(pop) FILTER (districts = 1), 0)::BIGINT AS whole_pop, coalesce(sum(pop) FILTER (districts > 1), 0)::BIGINT AS split_pop, round(100.0 * count(*) FILTER (districts > 1) / count(*), 6) AS split_percent FROM places", PLACES))
def _(spark, sf):
    return rounded(metrics.place_split_report(B.blocks(spark, sf)), "split_percent")


@query("w09_split_places_in_order", B.sql("blocks", "SELECT place, districts, pop FROM places WHERE districts > 1 ORDER BY place", PLACES))
def _(spark, sf):
    return metrics.place_splits(B.blocks(spark, sf)).where("districts > 1").orderBy("place")


@query("a11_place_population", B.sql("blocks", "SELECT place, pop FROM places", PLACES))
def _(spark, sf):
    return metrics.place_splits(B.blocks(spark, sf)).select("place", "pop")


@query("a12_county_counts", "SELECT c_nationkey AS county, count(*) AS blocks, sum(floor(abs(c_acctbal)))::BIGINT AS pop FROM customer GROUP BY 1")
def _(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("county")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.floor(F.abs("c_acctbal"))).cast("long").alias("pop"))


@query("a13_extents", B.sql("blocks", "SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat, sum(pop)::BIGINT AS total_pop, max(pop) AS max_pop, count(DISTINCT district) AS districts FROM blocks"))
def _(spark, sf):
    return metrics.extents(B.blocks(spark, sf))


@query("a16_count_per_config", B.sql("submissions", "SELECT config, count(*) AS n FROM submissions GROUP BY 1"))
def _(spark, sf):
    return B.submissions(spark, sf).groupBy("config").agg(F.count(F.lit(1)).alias("n"))


@query("a17_value_frequency", "SELECT 'o_orderstatus' AS \"column\", coalesce(o_orderstatus, 'None') AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, 'None'), count(*) FROM orders GROUP BY 2")
def _(spark, sf):
    return metrics.value_frequency(B.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("a18_a19_column_range", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c})::DOUBLE AS low, round(avg({c}), 6) AS mean, max({c})::DOUBLE AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, sf):
    return rounded(metrics.column_range(B.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "mean")


@query("a21_exponential_histogram", B.sql("statlog", """SELECT len(list_filter(range(20), lambda k: low + low * pow(pow(high / low, 1.0 / 20), k) <= kmpp))::INT AS bucket, count(*) AS n
  FROM statlog, (SELECT min(kmpp) AS low, max(kmpp) AS high FROM statlog) GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    return metrics.exponential_histogram(B.statlog(spark, sf), "kmpp")


DENSITY = """d AS (SELECT CASE WHEN area = 0 THEN 0.0 ELSE ln(pop::DOUBLE / area + 1) END AS density FROM blocks),
h AS (SELECT least(255, (trunc(density / (SELECT max(density) FROM d) * 255))::INT) AS level, count(*) AS n FROM d GROUP BY 1)"""


@query("a22_density_histogram", B.sql("blocks", "SELECT level, n, sum(n) OVER (ORDER BY level DESC)::BIGINT AS above, sum(n) OVER (ORDER BY level DESC) <= (sum(n) OVER ()) / 40.0 AS clamped FROM h", DENSITY))
def _(spark, sf):
    return metrics.density_histogram(B.blocks(spark, sf))


@query("a25_winners", B.sql("races", "SELECT state, district, greatest(d, r, g, l, other) AS winner_votes, d + r + g + l + other - greatest(d, r, g, l, other) AS other_votes FROM races"))
def _(spark, sf):
    return windows.winners(B.races(spark, sf))


@query("a26_votes_by_state", B.sql("races", "SELECT state, sum(d)::BIGINT AS d, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(l)::BIGINT AS l, sum(other)::BIGINT AS other FROM races GROUP BY ROLLUP (state)"))
def _(spark, sf):
    return windows.election_totals(B.races(spark, sf))


@query("a27_seats_per_vote", B.sql("races", """SELECT round(count(*) FILTER (d > r) * 1.0 / sum(d), 9) AS d_ratio, round(count(*) FILTER (r > d) * 1.0 / sum(r), 9) AS r_ratio, round(count(*) * 1.0 / sum(d + r + g + l + other), 9) AS all_ratio FROM races"""))
def _(spark, sf):
    r = B.races(spark, sf)
    ratio = lambda won, votes: F.round(F.try_divide(won.cast("double"), F.sum(votes)), 9)
    every = F.col("d") + F.col("r") + F.col("g") + F.col("l") + F.col("other")
    return r.agg(ratio(F.count_if(F.col("d") > F.col("r")), F.col("d")).alias("d_ratio"), ratio(F.count_if(F.col("r") > F.col("d")), F.col("r")).alias("r_ratio"), ratio(F.count(F.lit(1)), every).alias("all_ratio"))


@query("a28_label_winner", "WITH c AS (SELECT o_custkey AS district, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2) SELECT district, label FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY n DESC, label DESC) AS k FROM c) WHERE k = 1")
def _(spark, sf):
    counts = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("district"), F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return windows.label_winner(counts)


@query("a30_spherical_centroid", B.sql("blocks", """SELECT round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM (SELECT sum(area * cos(radians(lat / 1e6)) * cos(radians(lon / 1e6))) AS x,
  sum(area * cos(radians(lat / 1e6)) * sin(radians(lon / 1e6))) AS y, sum(area * sin(radians(lat / 1e6))) AS z FROM blocks)"""))  # fmt: skip
def _(spark, sf):
    return rounded(metrics.spherical_centroid(B.blocks(spark, sf)), "lat", "lon")


@query("a31_f32_run_weights", B.sql("submissions", "SELECT config, n, round(coalesce(10 - 9 * (n - min(n) OVER ())::DOUBLE / nullif(max(n) OVER () - min(n) OVER (), 0), 10), 6) AS weight FROM (SELECT config, count(*) AS n FROM submissions GROUP BY 1)"))
def _(spark, sf):
    return rounded(windows.run_weights(B.submissions(spark, sf).groupBy("config").agg(F.count(F.lit(1)).alias("n"))), "weight")


@query("a32_failing_runs", B.sql("statlog", "SELECT run AS config, generation AS seq, f AS failed, f >= 5 AS stop FROM (SELECT *, sum(open) OVER (PARTITION BY run ORDER BY generation ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::BIGINT AS f FROM statlog)"))
def _(spark, sf):
    finishes = B.statlog(spark, sf).select(F.col("run").alias("config"), F.col("generation").alias("seq"), (F.col("open") == 0).alias("ok"))
    return windows.failing(finishes, 10, 5)


@query("a34_smaller_body", "WITH c AS (SELECT n_regionkey AS state, n_nationkey AS body, count(*) AS seats FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT state, body, seats, seats = min(seats) OVER (PARTITION BY state) AS upper_house FROM c")
def _(spark, sf):
    from pyspark.sql import Window

    seats = B.table(spark, sf, "nation").join(B.table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    seats = seats.groupBy(F.col("n_regionkey").alias("state"), F.col("n_nationkey").alias("body")).agg(F.count(F.lit(1)).alias("seats"))
    return seats.withColumn("upper_house", F.col("seats") == F.min("seats").over(Window.partitionBy("state")))


# ---------------------------------------------------------------- windows and rankings


@query("w01_last_n", B.sql("statlog", "SELECT run, generation, kmpp, min(kmpp) OVER w AS low, max(kmpp) OVER w AS high, count(kmpp) OVER w AS n FROM statlog WINDOW w AS (PARTITION BY run ORDER BY generation ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    return windows.last_n(B.statlog(spark, sf), "kmpp", 20)


@query("w02_variability", B.sql("statlog", "SELECT run, generation, round((max(kmpp) OVER w - min(kmpp) OVER w) / kmpp, 6) AS variability, count(kmpp) OVER w AS n FROM statlog WINDOW w AS (PARTITION BY run ORDER BY generation ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    return rounded(windows.variability(B.statlog(spark, sf), "kmpp", 20), "variability")


@query("w03_range_variability", B.sql("statlog", "SELECT run, generation, round((max(kmpp) OVER w - min(kmpp) OVER w) / kmpp, 6) AS variability FROM statlog WINDOW w AS (PARTITION BY run ORDER BY generation RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    return rounded(windows.range_variability(B.statlog(spark, sf), "kmpp", 30), "variability")


@query("w04_carry_generation", B.sql("statlog", "SELECT run, line_no, last_value(g IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INT AS generation FROM (SELECT run, generation AS line_no, CASE WHEN event_type = 'click' THEN generation END AS g FROM statlog)"))
def _(spark, sf):
    log = B.statlog(spark, sf)
    return windows.carry_generation(log.select("run", F.col("generation").alias("line_no"), F.when(F.col("event_type") == "click", F.col("generation")).alias("generation")))


@query("w05_after_last_gap", B.sql("statlog", "SELECT run, generation, kmpp FROM (SELECT *, max(CASE WHEN open > 0 THEN generation END) OVER (PARTITION BY run) AS g FROM statlog) WHERE g IS NULL OR generation > g"))
def _(spark, sf):
    return windows.after_last_gap(B.statlog(spark, sf), "open").select("run", "generation", "kmpp")


@query("w06_running_best", B.sql("statlog", "SELECT run, generation, kmpp FROM (SELECT *, min(kmpp) OVER (PARTITION BY run ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM statlog) WHERE m IS NULL OR kmpp < m"))
def _(spark, sf):
    return windows.running_best(B.statlog(spark, sf), "kmpp").select("run", "generation", "kmpp")


@query("w07_rank_by_population", B.sql("blocks sums", "SELECT district, pop, row_number() OVER (ORDER BY pop, district)::INT AS turn FROM sums"))
def _(spark, sf):
    return windows.rank_by_population(metrics.district_sums(B.blocks(spark, sf)))


@query("w08_top_left_rank", B.sql("blocks", """SELECT district, lon AS x, lat AS y, (row_number() OVER (ORDER BY lat DESC, lon, district) - 1)::INT AS number FROM
  (SELECT *, row_number() OVER (PARTITION BY district ORDER BY lat DESC, lon) AS k FROM blocks) WHERE k = 1"""))  # fmt: skip
def _(spark, sf):
    return windows.top_left_rank(B.blocks(spark, sf))


POINTS = [(0.0, 0.0), (50.0, 1.0), (300.0, 2.0)]


@query("w10_interpolation", B.sql("statlog", "SELECT event_id, round(CASE WHEN kmpp <= 0 THEN 0 WHEN kmpp < 50 THEN kmpp / 50 WHEN kmpp < 300 THEN 1 + (kmpp - 50) / 250 ELSE 2 END, 6) AS factor FROM statlog"))
def _(spark, sf):
    return B.statlog(spark, sf).select("event_id", F.round(geo.interpolate(F.col("kmpp"), POINTS), 6).alias("factor"))


@query("t02_districts_by_column", B.sql("blocks sums", "SELECT district, pop, area FROM sums ORDER BY area DESC, district"))
def _(spark, sf):
    return metrics.district_sums(B.blocks(spark, sf)).select("district", "pop", "area").orderBy(F.desc("area"), "district")


@query("t03_top_places", B.sql("blocks", "SELECT place, pop FROM places ORDER BY pop DESC, place DESC LIMIT 5", PLACES))
def _(spark, sf):
    return metrics.place_splits(B.blocks(spark, sf)).select("place", "pop").orderBy(F.desc("pop"), F.desc("place")).limit(5)


@query("t04_best_per_config", B.sql("submissions", "SELECT config, id, path, kmpp FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY kmpp, id) AS k FROM submissions WHERE kmpp IS NOT NULL) WHERE k = 1"))
def _(spark, sf):
    return windows.best_per(B.submissions(spark, sf).select("config", "id", "path", "kmpp"), "config", "kmpp", "id")


@query("t05_send_threshold", B.sql("submissions", "SELECT config, kmpp AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY kmpp) AS k FROM submissions WHERE kmpp > 0) WHERE k = 10"))
def _(spark, sf):
    return windows.nth_best(B.submissions(spark, sf).select("config", "id", "kmpp"), "config", "kmpp")


@query("t06_newest_winner", B.sql("submissions", "SELECT config, id, kmpp FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY kmpp, id) AS k FROM submissions WHERE kmpp IS NOT NULL) WHERE k = 1 ORDER BY id DESC LIMIT 1"))
def _(spark, sf):
    best = windows.best_per(B.submissions(spark, sf).select("config", "id", "kmpp"), "config", "kmpp", "id")
    return best.orderBy(F.desc("id")).limit(1)


@query("t07_keep_runs", B.sql("statlog", "SELECT *, rank > 10 AS bad FROM (SELECT run % 5 AS config, run, best, row_number() OVER (PARTITION BY run % 5 ORDER BY best, run)::INT AS rank FROM (SELECT run, min(kmpp) AS best FROM statlog GROUP BY 1))"))
def _(spark, sf):
    runs = B.statlog(spark, sf).groupBy("run").agg(F.min("kmpp").alias("best")).select((F.col("run") % 5).alias("config"), "run", "best")
    return windows.split_runs(runs, "best", 10)


@query("t08_tail_lines", B.sql("statlog", "SELECT run, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY line_no DESC) AS k FROM (SELECT run, generation AS line_no, CASE WHEN generation % 40 = 0 THEN '#' ELSE '' END || event_type AS line FROM statlog)) WHERE k <= 10 OR starts_with(line, '#')"))
def _(spark, sf):
    log = B.statlog(spark, sf)
    lines = log.select("run", F.col("generation").alias("line_no"), F.concat(F.when(F.col("generation") % 40 == 0, "#").otherwise(""), F.col("event_type")).alias("line"))
    return windows.tail_lines(lines, 10)


@query("t09_last_points", B.sql("statlog", "SELECT run, generation, kmpp, spread FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY generation DESC) AS k FROM statlog) WHERE k <= 10"))
def _(spark, sf):
    return windows.latest(B.statlog(spark, sf).select("run", "generation", "kmpp", "spread"), "run", "generation", 10)


@query("t10_best_ok_record", B.sql("submissions", "SELECT config, id, kmpp FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY kmpp, id) AS k FROM submissions WHERE kmpp >= 1e-6 AND config <> 'error') WHERE k = 1"))
def _(spark, sf):
    ok = B.submissions(spark, sf).where("kmpp >= 1e-6 AND config <> 'error'").select("config", "id", "kmpp")
    return windows.best_per(ok, "config", "kmpp", "id")


@query("a29_best_spread_per_run", B.sql("statlog", "SELECT run, min(spread) AS spread, arg_min(generation, (spread, generation)) AS generation FROM statlog GROUP BY 1"))
def _(spark, sf):
    return B.statlog(spark, sf).groupBy("run").agg(F.min("spread").alias("spread"), F.min_by("generation", F.struct("spread", "generation")).alias("generation"))


# ---------------------------------------------------------------- joins, sets, predicates


@query("j02_demographics_by_recno", B.sql("blocks demographics", "SELECT ubid, coalesce(total, 0) AS total FROM blocks LEFT JOIN demographics ON ubid = recno"))
def _(spark, sf):
    return _demographic_blocks(spark, sf).select("ubid", "total")


@query("j04_place_default", B.sql("blocks", "SELECT ubid, coalesce(p.place, 99999)::INT AS place FROM blocks LEFT JOIN (SELECT ubid, place FROM blocks WHERE ubid % 3 = 0) p USING (ubid)"))
def _(spark, sf):
    b = B.blocks(spark, sf)
    known = b.where("ubid % 3 = 0").select("ubid", "place")
    return b.select("ubid").join(known, "ubid", "left").fillna(schema.NO_PLACE, ["place"])


@query("j05_place_names", B.sql("blocks", "SELECT place, pop, coalesce(p_name, '') AS name FROM places LEFT JOIN part ON place = p_partkey", PLACES))
def _(spark, sf):
    names = B.table(spark, sf, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"))
    return metrics.place_splits(B.blocks(spark, sf)).select("place", "pop").join(names, "place", "left").fillna("", ["name"])


@query("j07_blocks_with_demographics", B.sql("blocks demographics", "SELECT ubid FROM blocks WHERE ubid IN (SELECT recno FROM demographics)"))
def _(spark, sf):
    return B.blocks(spark, sf).join(B.demographics(spark, sf), F.col("ubid") == F.col("recno"), "left_semi").select("ubid")


@query("j08_blocks_of_top_places", B.sql("blocks", "SELECT ubid FROM blocks WHERE place IN (SELECT place FROM places ORDER BY pop DESC, place DESC LIMIT 5)", PLACES))
def _(spark, sf):
    b = B.blocks(spark, sf)
    top = metrics.place_splits(b).orderBy(F.desc("pop"), F.desc("place")).limit(5)
    return b.join(top, "place", "left_semi").select("ubid")


@query("j10_new_submissions", B.sql("submissions", "SELECT id, path FROM submissions WHERE path NOT IN (SELECT 'u' || c_custkey FROM customer WHERE c_acctbal > 0)"))
def _(spark, sf):
    known = B.table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("u"), "c_custkey").alias("path"))
    return B.submissions(spark, sf).join(known, "path", "left_anti").select("id", "path")


@query("j11_seen_hashes", B.sql("submissions", "SELECT sha256(props) AS sha, count(*) AS copies FROM submissions GROUP BY 1"))
def _(spark, sf):
    return B.submissions(spark, sf).groupBy(F.sha2("props", 256).alias("sha")).agg(F.count(F.lit(1)).alias("copies"))


@query("j12_links_from_faces", B.sql("blocks edges", "SELECT l.place AS a, r.place AS b FROM edges e JOIN blocks l ON e.a = l.ubid JOIN blocks r ON e.b = r.ubid WHERE l.place <> r.place GROUP BY 1, 2"))
def _(spark, sf):
    e, face = B.edges(spark, sf), B.blocks(spark, sf).select("ubid", "place")
    left = e.join(face.withColumnsRenamed({"ubid": "a", "place": "pa"}), "a").join(face.withColumnsRenamed({"ubid": "b", "place": "pb"}), "b")
    return left.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()


CORNERS = "corners AS (SELECT ubid, lon + dx * 1000 AS x, lat + dy * 1000 AS y FROM blocks, (SELECT unnest([0, 0, 1, 1]) AS dx, unnest([0, 1, 0, 1]) AS dy))"


def shared_vertices(vertices: DataFrame, least: int = 2, key: str = "ubid") -> DataFrame:
    """Polygons (a < b) with at least ``least`` vertices in common.  vertices: key, x, y.

    A vertex belongs to a few polygons, so the join's rows follow the vertices.
    """
    one, two = vertices.withColumnRenamed(key, "a"), vertices.withColumnRenamed(key, "b")
    met = one.join(two.hint("merge"), ["x", "y"]).where("a < b")  # not sent around whole: it has a row a vertex
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


@query("j13_shared_vertices", B.sql("blocks", "SELECT p.ubid AS a, q.ubid AS b, count(*) AS shared FROM corners p JOIN corners q ON p.x = q.x AND p.y = q.y AND p.ubid < q.ubid GROUP BY 1, 2 HAVING count(*) >= 2", CORNERS))
def _(spark, sf):
    corner = F.explode(F.array(*(F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y")) for dx in (0, 1000) for dy in (0, 1000))))
    return shared_vertices(B.blocks(spark, sf).select("ubid", corner.alias("v")).select("ubid", "v.x", "v.y"))


@query("j14_range_join_buckets", B.sql("blocks", "SELECT bx AS bucket, count(*) AS n FROM (SELECT unnest(range(lon // 7000, (lon + 1000 + ubid % 5 * 2000) // 7000 + 1)) AS bx FROM blocks) GROUP BY 1"))
def _(spark, sf):
    low, high = F.floor(F.col("lon") / 7000), F.floor((F.col("lon") + 1000 + F.col("ubid") % 5 * 2000) / 7000)
    return B.blocks(spark, sf).select(F.explode(F.sequence(low, high)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("j15_nearest_center", B.sql("blocks sums", """SELECT ubid, district FROM (SELECT b.ubid, s.district, row_number() OVER (PARTITION BY b.ubid ORDER BY ((lon - area_x / s.area) ** 2 + (lat - area_y / s.area) ** 2) * (1 + s.district / 10.0), s.district) AS k FROM blocks b, sums s) WHERE k = 1"""))
def _(spark, sf):
    b = B.blocks(spark, sf)
    centers = metrics.district_centers(b).select("district", F.col("land_x").alias("cx"), F.col("land_y").alias("cy"), (1 + F.col("district") / 10).alias("weight"))
    return graph.nearest(b, centers)


@query("u01_undirected_edges", B.sql("blocks edges both", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM both_ways"))
def _(spark, sf):
    return graph.undirected(graph.both_ways(B.edges(spark, sf)))


@query("u02_district_adjacency", B.sql("blocks edges", "SELECT DISTINCT least(x.district, y.district) AS d1, greatest(x.district, y.district) AS d2 FROM edges e JOIN blocks x ON e.a = x.ubid JOIN blocks y ON e.b = y.ubid WHERE x.district <> y.district"))
def _(spark, sf):
    return graph.district_adjacency(B.edges(spark, sf), B.blocks(spark, sf))


@query("u03_union_of_sources", B.sql("submissions", "SELECT id, config FROM submissions UNION ALL SELECT o_orderkey, o_orderpriority FROM orders"))
def _(spark, sf):
    orders = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("config"))
    return B.submissions(spark, sf).select("id", "config").unionByName(orders)


@query("u05_number_labels", B.sql("submissions", "SELECT config, dense_rank() OVER (ORDER BY config)::INT AS number FROM (SELECT DISTINCT config FROM submissions WHERE config <> 'error')"))
def _(spark, sf):
    from pyspark.sql import Window

    labels = B.submissions(spark, sf).where("config <> 'error'").select("config").distinct()
    return labels.withColumn("number", F.dense_rank().over(Window.orderBy("config")))


@query("p01_ubid_parts", "SELECT u, (u // 10000000000000) % 100 AS state, (u // 10000000000) % 1000 AS county, (u // 10000) % 1000000 AS tract, u % 10000 AS block FROM (SELECT o_orderkey * 7919000003 AS u FROM orders)")
def _(spark, sf):
    u = B.table(spark, sf, "orders").select((F.col("o_orderkey") * 7919000003).alias("u"))
    return u.select("u", *(c.alias(k) for k, c in schema.ubid_parts(F.col("u")).items()))


@query("p09_acceptance", B.sql("statlog", "SELECT run, generation FROM statlog WHERE open = 0 AND spread < 500 AND spread / 1000 < 0.25"))
def _(spark, sf):
    return B.statlog(spark, sf).where((F.col("open") == 0) & (F.col("spread") < 500) & (F.col("spread") / 1000 < 0.25)).select("run", "generation")


@query("p10_send_decision", B.sql("submissions", "SELECT id, (id % 11 = 0) OR (kmpp IS NOT NULL AND coalesce(kmpp <= CASE WHEN id % 2 = 0 THEN 40.0 END, true) AND coalesce(spread <= CASE WHEN id % 3 = 0 THEN 300.0 END, true)) AS send FROM submissions"))
def _(spark, sf):
    s = B.submissions(spark, sf).withColumns({"send_anything": F.col("id") % 11 == 0, "max_kmpp": F.when(F.col("id") % 2 == 0, 40.0), "max_spread": F.when(F.col("id") % 3 == 0, 300.0)})
    return windows.send_decision(s).select("id", "send")


@query("p15_edge_blocks", B.sql("blocks edges both", "SELECT DISTINCT x.ubid, x.district FROM both_ways e JOIN blocks x ON e.a = x.ubid JOIN blocks y ON e.b = y.ubid WHERE x.district <> y.district"))
def _(spark, sf):
    return graph.edge_blocks(B.edges(spark, sf), B.blocks(spark, sf))


@query("p07_viewport", B.sql("blocks", "SELECT ubid FROM blocks WHERE lon BETWEEN 5000 AND 20000 AND lat BETWEEN 2000 AND 15000"))
def _(spark, sf):
    return B.blocks(spark, sf).where(F.col("lon").between(5000, 20000) & F.col("lat").between(2000, 15000)).select("ubid")


# ---------------------------------------------------------------- scalar functions


@query("f01_summary_line", B.sql("submissions", "SELECT id, kmpp, spread FROM submissions"))
def _(spark, sf):
    s = B.submissions(spark, sf)
    line = F.concat(F.lit("#Best Km/p: Km/p="), F.col("kmpp").cast("string"), F.lit(" spread="), F.col("spread").cast("string"), F.lit(" std=1.5 gen=7"))
    found = text.summary_line(line)
    return s.select("id", found["kmpp"].alias("kmpp"), found["spread"].alias("spread"))


@query("f11_sizes", "SELECT c_custkey, c_custkey * CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END AS bytes FROM customer")
def _(spark, sf):
    unit = F.element_at(F.array(*(F.lit(x) for x in ("", "k", "M", "G"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return B.table(spark, sf, "customer").select("c_custkey", text.size_bytes(F.concat(F.col("c_custkey").cast("string"), unit)).alias("bytes"))


@query("f17_clean_int", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey * 12345 END AS n FROM orders")
def _(spark, sf):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.format_number(F.col("o_orderkey") * 12345, 0))
    return B.table(spark, sf, "orders").select("o_orderkey", text.clean_int(raw).alias("n"))


@query("f20_time_stamps", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, epoch_us(ts) // 1000 AS ms FROM events")
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", text.stamp(F.col("ts")).alias("stamp"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("f23_great_circle", "SELECT c_custkey, round(2 * 3956 * asin(least(1.0, sqrt(sin(radians(b - a) / 2) ** 2 + cos(radians(a)) * cos(radians(b)) * sin(radians(d - c) / 2) ** 2))), 4) AS miles FROM (SELECT c_custkey, c_custkey % 90 AS a, c_custkey % 67 AS b, c_custkey % 180 AS c, c_custkey % 121 AS d FROM customer)")
def _(spark, sf):
    k = F.col("c_custkey")
    return B.table(spark, sf, "customer").select("c_custkey", F.round(geo.great_circle_miles(k % 90, k % 180, k % 67, k % 121), 4).alias("miles"))


@query("f26_log_density", B.sql("blocks", "SELECT ubid, round(ln(pop::DOUBLE / area + 1), 6) AS density FROM blocks"))
def _(spark, sf):
    return B.blocks(spark, sf).select("ubid", F.round(geo.log_density(F.col("pop"), F.col("area")), 6).alias("density"))


@query("f37_result_json", B.sql("submissions", "SELECT id, coalesce((json_extract(props, '$.k'))::INT, 5) AS k FROM submissions"))
def _(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return B.submissions(spark, sf).select("id", F.coalesce(k, F.lit(5)).alias("k"))


@query("f38_hashes", B.sql("submissions", "SELECT id, sha256(path) AS sha, base64(encode(path)) AS coded FROM submissions"))
def _(spark, sf):
    return B.submissions(spark, sf).select("id", F.sha2("path", 256).alias("sha"), F.base64(F.col("path").cast("binary")).alias("coded"))


# ---------------------------------------------------------------- graph


@query("g01_neighbours", B.sql("blocks edges both", "SELECT a, count(*) AS degree FROM both_ways GROUP BY 1"))
def _(spark, sf):
    return graph.neighbours(B.edges(spark, sf)).select("a", "degree")


REACH = """own AS (SELECT e.a, e.b FROM both_ways e JOIN blocks x ON e.a = x.ubid JOIN blocks y ON e.b = y.ubid WHERE x.district = y.district),
reach AS (SELECT ubid AS s, ubid AS t FROM blocks UNION SELECT r.s, o.b FROM reach r JOIN own o ON o.a = r.t),
parts AS (SELECT t AS ubid, min(s) AS component FROM reach GROUP BY 1)"""


@query("g02_district_groups", B.sql("blocks edges both", "SELECT ubid, component, district FROM parts JOIN blocks USING (ubid)", REACH))
def _(spark, sf):
    return graph.district_groups(B.edges(spark, sf), B.blocks(spark, sf)).select("ubid", "component", "district")


GROUPS = REACH + """, sized AS (SELECT district, component, count(*) AS size FROM parts JOIN blocks USING (ubid) GROUP BY 1, 2)"""


@query("g03_largest_groups", B.sql("blocks edges both", "SELECT district, component, size, row_number() OVER (PARTITION BY district ORDER BY size DESC, (component = first)::INT DESC, component DESC) = 1 AS kept FROM (SELECT *, min(component) OVER (PARTITION BY district) AS first FROM sized)", GROUPS))
def _(spark, sf):
    return graph.largest_groups(graph.district_groups(B.edges(spark, sf), B.blocks(spark, sf)))


@query("g04_fixed_contiguity")
def _(spark, sf):
    return graph.fix_contiguity(B.edges(spark, sf), B.blocks(spark, sf)).select("ubid", "district")
