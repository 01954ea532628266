"""Registered queries: solvers, rasters, formats and streams over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import drawing, graph, raster, rings
from wardline.plans import bindings as B
from wardline.plans import solvers, turns
from wardline.shared import shared_folder as folder
from wardline.sources import binary, files, sinks, upix
from wardline.streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def squares(blocks: DataFrame) -> DataFrame:
    """Each block as a square of 1000 by 1000 around the grid."""
    at = lambda dx, dy: F.struct((F.col("lon") + dx).cast("double").alias("x"), (F.col("lat") + dy).cast("double").alias("y"))
    return blocks.select("ubid", F.array(F.array(at(0, 0), at(1000, 0), at(1000, 1000), at(0, 1000), at(0, 0))).alias("rings"))


@query("g06_repaired_connectivity")
def _(spark, sf):
    b, e = B.blocks(spark, sf), B.edges(spark, sf)
    cut = e.where("a % 40 NOT IN (9, 29) OR b <> a + 1")
    return graph.repair_connectivity(b, cut)


def _pairs(spark, sf) -> DataFrame:
    return graph.district_adjacency(B.edges(spark, sf), B.blocks(spark, sf)).select(F.lit("now").alias("map"), "d1", "d2")


@query("g08_district_colors")
def _(spark, sf):
    alone = B.blocks(spark, sf).select(F.lit("now").alias("map"), F.col("district").alias("d1"), F.col("district").alias("d2")).distinct()
    return graph.colors(_pairs(spark, sf).unionByName(alone), "map").select("district", "color")


@query("g08_colors_differ", B.sql("blocks edges", """, p AS (SELECT DISTINCT x.district AS d1, y.district AS d2 FROM (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) e JOIN blocks x ON e.a = x.ubid JOIN blocks y ON e.b = y.ubid WHERE x.district <> y.district)
SELECT district, count(d2) AS neighbours, 0::BIGINT AS alike, true AS in_palette FROM (SELECT DISTINCT district FROM blocks) d LEFT JOIN p ON d1 = district GROUP BY district"""))
def _(spark, sf):
    """Each district's neighbours, and how many of them have its color: none."""
    pairs, found = _pairs(spark, sf), QUERIES["g08_district_colors"](spark, sf)
    ways = pairs.select(F.col("d1").alias("district"), F.col("d2").alias("other")).union(pairs.select("d2", "d1"))
    met = ways.join(found.select(F.col("district").alias("other"), F.col("color").alias("c2")), "other")
    met = found.join(met, "district", "left").groupBy("district").agg(F.count("other").alias("neighbours"), F.count_if(F.col("color") == F.col("c2")).alias("alike"), F.max("color").alias("top"))
    return met.select("district", "neighbours", "alike", (F.col("top") < 14).alias("in_palette"))


def draw_sql(seed, *columns: str) -> str:
    """solvers.draw in SQL."""
    return f"(('0x' || substr(md5({' || '.join([f"'{seed}'", *(f"':' || {c}" for c in columns)])}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE"


SEEDS_SQL = f"""one AS (SELECT ubid, {draw_sql(3, "ubid")} AS u FROM blocks ORDER BY u, ubid LIMIT 7), own AS (SELECT ubid, (row_number() OVER (ORDER BY u, ubid) - 1)::INT AS district FROM one),
near AS (SELECT e.b AS ubid, district, {draw_sql(4, "e.b")} AS v FROM own JOIN both_ways e ON e.a = own.ubid WHERE e.b NOT IN (SELECT ubid FROM own)),
picked AS (SELECT district, arg_min(ubid, v) AS ubid FROM near GROUP BY 1)"""


@query("v01_random_seeds", B.sql("blocks edges both", "SELECT ubid, district FROM own UNION ALL SELECT ubid, min(district) FROM picked GROUP BY 1", SEEDS_SQL))
def _(spark, sf):
    return solvers.random_seeds(B.blocks(spark, sf), B.edges(spark, sf), 7, 3).where("district IS NOT NULL").select("ubid", "district")


GRAB_SQL = f"""goal AS (SELECT sum(pop) / 7.0::DOUBLE AS target FROM blocks),
c AS (SELECT district, pop, area_x::DOUBLE / area AS cx, area_y::DOUBLE / area AS cy FROM sums),
rim AS (SELECT x.district, count(*) AS rim, avg(sqrt((x.lon - c.cx) ** 2 + (x.lat - c.cy) ** 2)) AS r FROM blocks x JOIN c USING (district)
  WHERE EXISTS (SELECT 1 FROM both_ways e JOIN blocks y ON e.b = y.ubid WHERE e.a = x.ubid AND y.district <> x.district) GROUP BY 1),
d AS (SELECT c.*, coalesce(rim, 0) AS rim, r FROM c LEFT JOIN rim USING (district)),
around AS (SELECT e.a AS ubid, y.district AS nd, count(*) AS n FROM both_ways e JOIN blocks y ON e.b = y.ubid GROUP BY 1, 2),
m AS (SELECT b.ubid, a.nd AS taker, t.pop AS tp, o.pop AS op, sqrt((lon - t.cx) ** 2 + (lat - t.cy) ** 2) / t.r AS t_far, sqrt((lon - o.cx) ** 2 + (lat - o.cy) ** 2) / o.r AS o_far, t.rim AS t_rim,
    (coalesce((SELECT n FROM around w WHERE w.ubid = b.ubid AND w.nd = b.district), 0) - a.n)::DOUBLE / (SELECT sum(n) FROM around w WHERE w.ubid = b.ubid) AS neighbours,
    (SELECT sum((target - z.pop) / nullif((lon - z.cx) ** 2 + (lat - z.cy) ** 2, 0)) FROM d z, goal) AS pull, (t.pop - o.pop)::DOUBLE / o.pop AS gap
  FROM around a JOIN blocks b USING (ubid) JOIN d t ON t.district = a.nd JOIN d o ON o.district = b.district, goal
  WHERE a.nd <> b.district AND NOT (o.rim <= 1 OR (o.pop > 1 AND t.pop > target AND t.pop > o.pop))),
f AS (SELECT ubid, taker, CASE WHEN t_rim <= 1 THEN 0 ELSE coalesce(t_far - 1, 0) END AS edge, coalesce(1 - o_far, 0) AS other_edge, neighbours, CASE WHEN op <= 1 THEN 10.0 WHEN tp > op THEN 3 * gap ELSE gap END AS pop,
    1.0::DOUBLE AS lock, coalesce(pull / nullif(avg(pull) OVER (PARTITION BY taker), 0), 0) AS field, {draw_sql(0, "ubid", "taker")} AS random FROM m)"""


def _moves(spark, sf):
    b = B.blocks(spark, sf).withColumn("lock", F.lit(0))
    return b, B.edges(spark, sf), b.agg(F.sum("pop")).first()[0] / 7


@query("a20_score_ranges", B.sql("blocks edges both sums", "SELECT term, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (UNPIVOT (SELECT edge, other_edge, neighbours, pop::DOUBLE AS pop, lock, field, random FROM f) ON edge, other_edge, neighbours, pop, lock, field, random INTO NAME term VALUE v) GROUP BY 1", GRAB_SQL))
def _(spark, sf):
    return solvers.score_ranges(solvers.grab_features(*_moves(spark, sf))).select("term", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("v04_v05_grab_scores", B.sql("blocks edges both sums", "SELECT ubid, taker, round(edge * 1.2 + other_edge + neighbours * 0.3 + pop * 0.5 + lock * 0.1 + field * 0.001 + random * 0.1, 6) AS score FROM f", GRAB_SQL))
def _(spark, sf):
    return solvers.grab_scores(*_moves(spark, sf)).select("ubid", "taker", F.round("score", 6).alias("score"))


@query("v03_best_grabs", B.sql("blocks edges both sums", """SELECT taker, arg_min(ubid, (score, ubid)) AS ubid, round(min(score), 6) AS score FROM (
  SELECT ubid, taker, edge * 1.2 + other_edge + neighbours * 0.3 + pop * 0.5 + lock * 0.1 + field * 0.001 + random * 0.1 AS score FROM f) s JOIN d ON d.district = s.taker, goal WHERE d.pop < target OR score <= 0 GROUP BY taker""", GRAB_SQL))
def _(spark, sf):
    """What each district would take if it were the first to act."""
    solver = turns.TurnSolver(7)
    return solver.first_grabs(B.blocks(spark, sf), B.edges(spark, sf)).select("taker", "ubid", F.round("score", 6).alias("score"))


@query("v02_grab_solver")
def _(spark, sf):
    solver = turns.TurnSolver(7, seed=3, last=6, kmpp_share=0.02, spread_share=0.05, pop_factor=turns.schedule([(0, 0.5), (100, 1.0)]))
    return solver.run(B.blocks(spark, sf), B.edges(spark, sf)).select("ubid", "district")


@query("v09_nearest_solver")
def _(spark, sf):
    done = solvers.Nearest().run(B.blocks(spark, sf), 7, seed=3, edges=B.edges(spark, sf), last=6, kmpp_share=0.02, spread_share=0.1, by_weight=True)
    return done.select("ubid", "district")


COUNTY_SQL = """, c AS (SELECT *, lon // 4000 AS county FROM blocks), t AS (SELECT sum(pop) / 12.0 AS target FROM c),
k AS (SELECT county, row_number() OVER (ORDER BY county) AS n FROM (SELECT county FROM c GROUP BY 1 HAVING abs(sum(pop) - (SELECT target FROM t)) <= 0.3 * (SELECT target FROM t))),
p AS (SELECT place, row_number() OVER (ORDER BY place) + (SELECT count(*) FROM k) AS n FROM (SELECT place FROM c WHERE county NOT IN (SELECT county FROM k) AND place NOT IN (0, 99999) GROUP BY 1 HAVING abs(sum(pop) - (SELECT target FROM t)) <= 0.3 * (SELECT target FROM t)))
SELECT ubid, (coalesce(k.n, p.n) - 1)::INT AS district FROM c LEFT JOIN k USING (county) LEFT JOIN p USING (place)"""


@query("v12_county_city_start", B.sql("blocks", "").rstrip() + COUNTY_SQL)
def _(spark, sf):
    b = B.blocks(spark, sf).withColumn("county", F.floor(F.col("lon") / 4000))
    return solvers.county_city_start(b, b.agg(F.sum("pop")).first()[0] / 12, 0.3)


MAPS_SQL = f"""WITH party AS (SELECT trial, cell, CASE WHEN row_number() OVER (PARTITION BY trial ORDER BY u, cell) <= 10 THEN 'o' ELSE 'x' END AS label
  FROM (SELECT trial, cell, {draw_sql(1, "trial", "cell")} AS u FROM (SELECT c_custkey AS trial FROM customer) t, range(25) c(cell))),
won AS (SELECT map, trial, d, count(*) FILTER (label = 'x') >= count(*) FILTER (label = 'o') AS x FROM (SELECT *, CASE WHEN map = 0 THEN cell // 5 ELSE cell % 5 END AS d FROM party, (SELECT unnest([0, 1])::INT AS map)) GROUP BY 1, 2, 3)
SELECT map, seats, count(*) AS n FROM (SELECT map, trial, count(*) FILTER (x) AS seats FROM won GROUP BY 1, 2) GROUP BY 1, 2"""


@query("v14_synthetic_maps", MAPS_SQL)
def _(spark, sf):
    maps = [[c // 5 for c in range(25)], [c % 5 for c in range(25)]]
    return solvers.synthetic_maps(spark, maps, 10, B.table(spark, sf, "customer").select(F.col("c_custkey").alias("trial")))


@query("r01_filled_polygons", B.sql("blocks", "SELECT ubid, ((lon // 250) + dx)::INT AS x, ((100000 - lat) // 250 - 1 - dy)::INT AS y FROM blocks, range(4) a(dx), range(4) b(dy)"))
def _(spark, sf):
    return raster.fill(squares(B.blocks(spark, sf)), 0.0, 100000.0, 250.0, 250.0)


@query("s21_raw_raster", B.sql("blocks", "SELECT ubid, ((lon // 250) + dx)::INT AS x, ((16000000 - lat) // 250 - 1 - dy)::INT AS y FROM blocks, range(4) a(dx), range(4) b(dy) WHERE lat < 16000000"))
def _(spark, sf):
    out = folder(spark)
    pixels = raster.clip(raster.fill(squares(B.blocks(spark, sf)), 0.0, 16_000_000.0, 250.0, 250.0), 65_535, 65_535)
    upix.write(raster.pixel_lists(pixels), out, 160, 64_000)
    return upix.read(spark, out, split=4096)


@query("k08_pixels_by_block", B.sql("blocks", "SELECT ubid, 16::INT AS pixels FROM blocks"))
def _(spark, sf):
    lists = raster.pixel_lists(raster.fill(squares(B.blocks(spark, sf)), 0.0, 100000.0, 250.0, 250.0))
    return lists.select("ubid", F.size("pixels").alias("pixels"))


@query("r05_point_plot", B.sql("blocks", """SELECT x, y, arg_max(district, ubid) AS district FROM (SELECT ubid, district, coalesce(floor((lon - x0)::DOUBLE / nullif(x1 - x0, 0) * 200 * 0.999::DOUBLE), 0)::INT AS x,
  199 - coalesce(floor((lat - y0)::DOUBLE / nullif(y1 - y0, 0) * 200 * 0.999::DOUBLE), 0)::INT AS y FROM blocks, (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM blocks)) GROUP BY 1, 2"""))  # fmt: skip
def _(spark, sf):
    return raster.point_plot(B.blocks(spark, sf), 200, 200)


PAINT_SQL = """SELECT ((lon // 500) + dx)::INT AS x, ((100000 - lat) // 500 - 1 - dy)::INT AS y, trunc(CASE WHEN place = 1 THEN r * 0.5 + 127.5 ELSE r END)::INT AS r, trunc(CASE WHEN place = 1 THEN g * 0.5 + 127.5 ELSE g END)::INT AS g,
  trunc(CASE WHEN place = 1 THEN b * 0.5 + 127.5 ELSE b END)::INT AS b FROM (SELECT *, trunc(district * 37 % 256 * s)::INT AS r, trunc(district * 91 % 256 * s)::INT AS g, trunc(district * 173 % 256 * s)::INT AS b
  FROM (SELECT *, 1 - 0.5::DOUBLE * least(255, trunc(v / max(v) OVER () * 255)) / 255.0::DOUBLE AS s FROM (SELECT *, ln(pop::DOUBLE / area + 1) AS v FROM blocks))), range(2) a(dx), range(2) c(dy)"""


@query("r06_j09_painted_pixels", B.sql("blocks", PAINT_SQL))
def _(spark, sf):
    b = B.blocks(spark, sf)
    colors = spark.range(7).select(F.col("id").cast("int").alias("district"), *((F.col("id") * k % 256).cast("int").alias(c) for c, k in zip("rgb", (37, 91, 173), strict=True)))
    return raster.paint(raster.fill(squares(b), 0.0, 100000.0, 500.0, 500.0), b, colors, density=True, marked=b.where("place = 1"))


SCRIPT = """# two views of one map
--loadSolution now --colorsIn shades --pngW 80 --pngH 8000 --minlon 0 --maxlon 40000 --minlat 0 --maxlat 4000000 --pngout whole.png
--pngW 20 --pngH 30 --minlon 10000 --maxlond 10000 --maxlat 30000 --minlatd -15000 --pngout part.png
done --pngout never.png"""
SCRIPT_SQL = """SELECT path, x, y, district * 37 % 256 AS r, district * 91 % 256 AS g, district * 173 % 256 AS b FROM (
  SELECT path, district, ((lon - x0) // 500 + dx)::INT AS x, ((y0 - lat) // 500 - 1 - dy)::INT AS y, w, h FROM blocks, range(2) a(dx), range(2) c(dy), (VALUES ('whole.png', 0, 4000000, 80, 8000), ('part.png', 10000, 30000, 20, 30)) v(path, x0, y0, w, h))
  WHERE x >= 0 AND y >= 0 AND x < w AND y < h"""


def _drawn(spark, sf) -> DataFrame:
    b = B.blocks(spark, sf)
    shades = spark.range(7).select(F.lit("file:shades").alias("colors"), F.col("id").cast("int").alias("district"), *((F.col("id") * k % 256).cast("int").alias(c) for c, k in zip("rgb", (37, 91, 173), strict=True)))
    palette = spark.range(14).select(F.col("id").cast("int").alias("color"), *(F.lit(9).alias(c) for c in "rgb"))
    asked = drawing.pictures(spark.createDataFrame([("s", SCRIPT)], "script string, text string"))
    return drawing.draw(asked, squares(b), b, B.edges(spark, sf), b.select(F.lit("now").alias("solution"), "ubid", "district"), palette, shades)


@query("r08_drawing_script", B.sql("blocks", SCRIPT_SQL))
def _(spark, sf):
    return _drawn(spark, sf).select("path", "x", "y", "r", "g", "b")


@query("k10_r04_tiles", B.sql("blocks", f"SELECT path, (x // 64)::INT AS tx, (y // 64)::INT AS ty, count(*) AS painted, sum(r + 256 * g + 65536 * b)::BIGINT AS colors FROM ({SCRIPT_SQL}) GROUP BY 1, 2, 3"))
def _(spark, sf):
    made = drawing.tiles(_drawn(spark, sf), ["path"], 64)

    def read(parts):
        for part in parts:
            images = [raster.decode_png(bytes(c)).astype("int64") for c in part["content"]]
            sums = [(int((i[:, :, 3] > 0).sum()), int((i[:, :, :3] @ [1, 256, 65536])[i[:, :, 3] > 0].sum())) for i in images]
            yield part[["path", "tx", "ty"]].assign(painted=[s[0] for s in sums], colors=[s[1] for s in sums])

    return made.mapInPandas(read, "path string, tx int, ty int, painted long, colors long")


@query("r04_collisions", B.sql("blocks", """, p AS (SELECT ubid, ((lon // 250) + dx)::INT AS x, ((16000000 - lat) // 250 - 1 - dy)::INT AS y FROM blocks, range(6) a(dx), range(6) b(dy))
SELECT ubid, count(*) AS pixels, count(*) FILTER (ubid > first) AS collisions FROM (SELECT *, min(ubid) OVER (PARTITION BY x, y) AS first FROM p) GROUP BY ubid"""))
def _(spark, sf):
    wide = squares(B.blocks(spark, sf)).withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p.x + F.when(p.x == ring[2].x, 500).otherwise(0)).alias("x"), (p.y + F.when(p.y == ring[2].y, 500).otherwise(0)).alias("y")))))
    return drawing.collisions(raster.fill(wide, 0.0, 16_000_000.0, 250.0, 250.0))


@query("g09_district_outlines", B.sql("blocks", """SELECT district, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM (SELECT district, lon + 1000 * a AS x1, lat + 1000 * b AS y1, lon + 1000 * c AS x2, lat + 1000 * d AS y2
  FROM blocks, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (0, 0, 0, 1)) s(a, b, c, d)) GROUP BY district, x1, y1, x2, y2 HAVING count(*) = 1"""))  # fmt: skip
def _(spark, sf):
    return raster.outlines(squares(B.blocks(spark, sf)), B.blocks(spark, sf))


RINGS_SQL = """SELECT district, 1000000.0::DOUBLE * sum(cells) AS area, sum(CASE WHEN m IN (1, 2, 4, 8, 7, 11, 13, 14) THEN 1 WHEN m IN (6, 9) THEN 2 ELSE 0 END)::BIGINT AS corners,
  (sum(CASE WHEN m IN (1, 2, 4, 8) THEN 1 WHEN m IN (6, 9) THEN 2 WHEN m IN (7, 11, 13, 14) THEN -1 ELSE 0 END) / 4)::BIGINT AS shells_less_holes FROM (
  SELECT district, sum(1 << (2 * b + a)) AS m, sum((a + b = 0)::INT) AS cells FROM blocks, range(2) p(a), range(2) q(b) GROUP BY district, lon + 1000 * a, lat + 1000 * b) GROUP BY district"""


@query("g09_u06_district_rings", B.sql("blocks", RINGS_SQL))
def _(spark, sf):
    b = B.blocks(spark, sf)
    ring = rings.rings(squares(b), b).groupBy("district", "ring", "area").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("ring") == F.col("shell")).cast("int")).alias("is_shell"))
    return ring.groupBy("district").agg(F.sum("area").alias("area"), F.sum("n").alias("corners"), F.sum(2 * F.col("is_shell") - 1).cast("long").alias("shells_less_holes"))


@query("k01_s13_dsz_round_trip", B.sql("blocks", "SELECT (ubid % 7)::VARCHAR AS solution_id, count(*) AS blocks, count(DISTINCT district) AS districts FROM blocks GROUP BY 1"))
def _(spark, sf):
    from pyspark.sql import Window

    rows = B.blocks(spark, sf).select((F.col("ubid") % 7).alias("solution_id"), (F.row_number().over(Window.partitionBy(F.col("ubid") % 7).orderBy("ubid")) - 1).alias("idx"), "district")
    coded = sinks.dsz_files(rows)

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch["solution_id"], batch["content"], strict=True):
                for f in binary.decode_dsz(content):
                    yield f.assign(solution_id=name)

    back = coded.mapInPandas(decode, "solution_id string, idx int, district short")
    return back.groupBy("solution_id").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("district").alias("districts"))


@query("k02_s14_solution_round_trip", B.sql("blocks", "SELECT ubid + 1000000000 AS ubid, district FROM blocks"))
def _(spark, sf):
    out = folder(spark)
    sinks.write_solution(B.blocks(spark, sf).withColumn("ubid", F.col("ubid") + 1_000_000_000), out)
    return files.solution_csv(spark, out).select("ubid", F.col("district").cast("int").alias("district"))


@query("k06_s12_links_round_trip", B.sql("blocks edges", "SELECT a, b FROM edges"))
def _(spark, sf):
    out = folder(spark)
    sinks.link_lines(B.edges(spark, sf)).write.text(out)
    return files.links(spark, out, B.blocks(spark, sf))


@query("k16_run_configs", "SELECT n_name AS state, 'Body' AS body, (n_regionkey <= 1) AS disabled FROM nation")
def _(spark, sf):
    n = B.table(spark, sf, "nation").select(F.col("n_name").alias("state"), F.lit("Body").alias("body"), F.lit("Body").alias("short"), F.col("n_regionkey").alias("seats"))
    return sinks.run_configs(n).select("state", "body", F.get_json_object("config", "$.disabled").cast("boolean").alias("disabled"))


# ---------------------------------------------------------------- streams


def _event_stream(spark, sf) -> DataFrame:
    schema = B.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


@query("st01_best_so_far", B.sql("submissions", "SELECT config, min(kmpp) AS kmpp, arg_min(id, (kmpp, id)) AS id, count(*) AS n FROM submissions WHERE kmpp >= 1e-6 GROUP BY 1"))
def _(spark, sf):
    s = _event_stream(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("config"), F.col("value").alias("kmpp"))
    return streams.run_to_end(streams.best_so_far(s), folder(spark), "complete")


@query("st02_received_once", B.sql("submissions", "SELECT DISTINCT sha256(props) AS sha FROM submissions"))
def _(spark, sf):
    # hashes are forgotten after 30 days, so the state does not grow for ever
    s = streams.received(_event_stream(spark, sf).select(F.col("props").alias("body"), F.col("ts").cast("timestamp").alias("ts")), late="30 days")
    return streams.run_to_end(s.select("sha"), folder(spark), "append")


@query("st03_last_n", B.sql("statlog", "SELECT run, generation, min(kmpp) OVER w AS low, max(kmpp) OVER w AS high, (count(kmpp) OVER w)::INT AS n FROM statlog WINDOW w AS (PARTITION BY run ORDER BY generation ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    out = folder(spark)
    B.statlog(spark, sf).select("run", "generation", "kmpp").write.parquet(out)
    s = streams.file_stream(spark, out, "run long, generation int, kmpp double")
    return streams.run_to_end(streams.last_n_stream(s, 20), folder(spark), "append")


@query("st04_failure_monitor", B.sql("statlog", "SELECT run::VARCHAR AS config, generation::BIGINT AS seq, f AS failed, f >= 5 AS stop FROM (SELECT *, sum(open) OVER (PARTITION BY run ORDER BY generation ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::BIGINT AS f FROM statlog)"))
def _(spark, sf):
    out = folder(spark)
    B.statlog(spark, sf).select(F.col("run").cast("string").alias("config"), F.col("generation").cast("long").alias("seq"), (F.col("open") == 0).alias("ok")).write.parquet(out)
    s = streams.file_stream(spark, out, "config string, seq long, ok boolean")
    return streams.run_to_end(streams.failure_monitor(s, 10, 5), folder(spark), "append")
