"""Registered queries: files of several formats, written from the sample tables and read back."""

from __future__ import annotations

import base64
import gzip
import io
import json
import tarfile
import urllib.parse
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators import metrics, plots, projection, rings, windows
from wardline.plans import bindings as B
from wardline.shared import release, save_by
from wardline.shared import shared_folder as folder
from wardline.sources import binary, files, folders, keyed, metadata, sheets, sinks
from wardline.streaming import streams, tail

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# ---------------------------------------------------------------- election workbooks


def sheet_xml(name: str, rows: list[list[str]]) -> str:
    """A sheet whose equal neighbours are runs, with the endless empty cells that spreadsheet programs leave behind."""
    out = [f'<table:table table:name="{escape(name)}">']
    for row in rows:
        out.append("<table:table-row>")
        k = 0
        while k < len(row):
            n = next((j for j in range(k, len(row)) if row[j] != row[k]), len(row)) - k
            kind = f'office:value-type="float" office:value="{row[k]}"' if row[k].isdigit() else 'office:value-type="string"'
            out.append(f'<table:table-cell {kind} table:number-columns-repeated="{n}"><text:p>{escape(row[k])}</text:p></table:table-cell>' if row[k] else f'<table:table-cell table:number-columns-repeated="{n}"/>')
            k += n
        out.append('<table:table-cell table:number-columns-repeated="16376"/></table:table-row>')
    return "".join(out) + '<table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row></table:table>'


def workbook(tables: dict[str, list[list[str]]]) -> bytes:
    names = "office table text".split()
    head = " ".join(f'xmlns:{n}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for n in names)
    body = "".join(sheet_xml(n, rows) for n, rows in tables.items())
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("content.xml", f'<?xml version="1.0"?><office:document-content {head}><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>')
    return buffer.getvalue()


def _election_files(spark, sf) -> DataFrame:
    """Cells of one workbook a state, written by Spark and read back."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("district")
        state, votes = f"S{int(part['state'].iloc[0]):02d}", part[sheets.PARTIES]
        won = votes.to_numpy().argmax(1)
        rows = [sheets.HEADER, [""], [state, "", *(str(int((won == k).sum())) for k in range(len(sheets.PARTIES)))]]
        rows += [[state, str(d), *(f"{v:,}" for v in vs), ""] for d, vs in zip(part["district"], votes.to_numpy().tolist(), strict=True)]
        return pd.DataFrame({"name": [f"{state}.ods"], "content": [workbook({state: rows, "unopposed": [["State"]]})]})

    out = folder(spark)
    sinks.write_files(B.races(spark, sf).groupBy("state").applyInPandas(build, "name string, content binary"), out)
    return sheets.expand(sheets.read_runs(spark, out))


@query("s36_election_sheets", B.sql("races", "SELECT 'S' || lpad(state::VARCHAR, 2, '0') AS state, district::INT AS dist, d, r, g, l, other FROM races"))
def _(spark, sf):
    votes, _ = sheets.election(_election_files(spark, sf))
    return votes.select("state", "dist", *sheets.PARTIES)


SEATS_SQL = """, w AS (SELECT *, 'S' || lpad(state::VARCHAR, 2, '0') AS s, greatest(d, r, g, l, other) AS m FROM races),
x AS (SELECT s, sum(d)::BIGINT AS d, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(l)::BIGINT AS l, sum(other)::BIGINT AS o, count(*) FILTER (d = m) AS sd, count(*) FILTER (r = m AND d < m) AS sr,
  count(*) FILTER (g = m AND d < m AND r < m) AS sg, count(*) FILTER (l = m AND d < m AND r < m AND g < m) AS sl, count(*) FILTER (other = m AND d < m AND r < m AND g < m AND l < m) AS so FROM w GROUP BY s),
t AS (SELECT sum(d)::BIGINT AS d, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(l)::BIGINT AS l, sum(o)::BIGINT AS o, sum(sd)::BIGINT AS sd, sum(sr)::BIGINT AS sr, sum(sg)::BIGINT AS sg, sum(sl)::BIGINT AS sl, sum(so)::BIGINT AS so FROM x)
SELECT 0 AS part, '' AS sheet, 'State,D,R,G,L,other,D,R,G,L,other' AS value
UNION ALL SELECT 1, s, concat_ws(',', s, d, r, g, l, o, sd, sr, sg, sl, so) FROM x UNION ALL SELECT 2, '', concat_ws(',', 'sums', d, r, g, l, o, sd, sr, sg, sl, so) FROM t
UNION ALL SELECT 3, '', concat_ws(',', 'total', d + r + g + l + o, '', '', '', '', sd + sr + sg + sl + so) FROM t"""


@query("k18_election_seats", B.sql("races", "").rstrip() + SEATS_SQL)
def _(spark, sf):
    return sheets.seats_lines(*sheets.election(_election_files(spark, sf)))


ALL_SQL = """, w AS (SELECT *, 'S' || lpad(state::VARCHAR, 2, '0') AS s, greatest(d, r, g, l, other) AS m, d + r + g + l + other AS n, (row_number() OVER (PARTITION BY state ORDER BY district) + 2)::INT AS line FROM races)
SELECT 0 AS part, '' AS sheet, 0 AS row, 'State,Dist,D,R,G,L,other,notes' AS value UNION ALL SELECT 1, s, line, concat_ws(',', s, district, d, r, g, l, other, '') FROM w
UNION ALL SELECT 2, '', 0, concat_ws(',', '', 'sums', sum(d)::BIGINT, sum(r)::BIGINT, sum(g)::BIGINT, sum(l)::BIGINT, sum(other)::BIGINT) FROM w UNION ALL SELECT 3, '', 0, concat_ws(',', '', 'total', sum(n)::BIGINT) FROM w
UNION ALL (SELECT 4, '', 0, concat_ws(',', 'smallest winner', s, district, m) FROM w WHERE m > 1 ORDER BY m, s, line LIMIT 1) UNION ALL (SELECT 5, '', 0, concat_ws(',', 'biggest winner', s, district, m) FROM w ORDER BY m DESC, s, line LIMIT 1)
UNION ALL (SELECT 6, '', 0, concat_ws(',', 'smallest election', s, district, n) FROM w WHERE n > 1 ORDER BY n, s, line LIMIT 1) UNION ALL (SELECT 7, '', 0, concat_ws(',', 'biggest election', s, district, n) FROM w ORDER BY n DESC, s, line LIMIT 1)
UNION ALL SELECT 8, '', 0, concat_ws(',', 'votes for winners', sum(m)::BIGINT) FROM w UNION ALL SELECT 9, '', 0, concat_ws(',', 'votes for others', sum(n - m)::BIGINT) FROM w"""


@query("k18_election_all", B.sql("races", "").rstrip() + ALL_SQL)
def _(spark, sf):
    return sheets.all_lines(sheets.election(_election_files(spark, sf))[0])


# ---------------------------------------------------------------- indented metadata

KEYS_SQL = """WITH i AS (SELECT r_regionkey AS f, -1 AS n, -1 AS s, 'R' || r_regionkey AS code, r_name AS a, NULL AS b, NULL AS c FROM region
UNION ALL SELECT n_regionkey, n_nationkey, -1, 'N' || n_nationkey, r_name, n_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, 'S' || s_suppkey, r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def _items(spark, sf) -> DataFrame:
    """(f, n, s, code, name, depth): regions, their nations and their suppliers."""
    r, n, s = (B.table(spark, sf, t) for t in ("region", "nation", "supplier"))
    none = F.lit(-1).cast("long")
    regions = r.select(F.col("r_regionkey").cast("long").alias("f"), none.alias("n"), none.alias("s"), F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit(0).alias("depth"))
    nations = n.select(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long"), none, F.concat(F.lit("N"), "n_nationkey"), F.col("n_name"), F.lit(1))
    suppliers = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long"), F.col("s_suppkey").cast("long"), F.concat(F.lit("S"), "s_suppkey"), F.col("s_name"), F.lit(2))
    return regions.union(nations).union(suppliers)


def _lists(spark, sf, line, head, tail: str, suffix: str) -> str:
    """A file for each region with its items in order."""
    each = _items(spark, sf).groupBy("f").agg(F.max(F.when(F.col("depth") == 0, F.col("name"))).alias("region"), F.sort_array(F.collect_list(F.struct("n", "s", "code", "name", "depth"))).alias("items"))
    whole = F.concat(head, F.array_join(F.transform("items", line), "\n"), F.lit(tail))
    out = folder(spark)
    sinks.write_files(each.select(F.concat(F.lit("f"), F.col("f"), F.lit(suffix)).alias("name"), whole.cast("binary").alias("content")), out)
    return out


@query("s37_label_paths", KEYS_SQL + "SELECT 'f' || f || '.sas' AS file, code, 'Places of' || chr(10) || a AS comment, concat_ws('>', '', a, b, c) AS path FROM i")
def _(spark, sf):
    blanks = F.array(F.lit(" "), F.lit("   "), F.lit("\t"))
    line = lambda x: F.concat(F.lit("  "), x["code"], F.lit("='"), F.get(blanks, x["depth"]), x["name"], F.lit("<br>'"))
    head = F.concat(F.lit("DATA one;\nLABEL\n/* Places of */\n/* "), F.col("region"), F.lit(" */\n"))
    found = metadata.label_records(metadata.texts(spark, _lists(spark, sf, line, head, "\n;\nINPUT X='not a label';", ".sas")))
    return found.select("file", F.col("codename").alias("code"), "comment", F.array_join("path", ">").alias("path"))


@query("s37_table_keys", KEYS_SQL + """SELECT 'file' || f AS file, 'P' || f AS "table", 5 + row_number() OVER (PARTITION BY f ORDER BY n, s) - 1 AS "column", (count(*) OVER (PARTITION BY f)) = 7 AS as_told, concat_ws('>', a, b, c) AS path FROM i""")
def _(spark, sf):
    line = lambda x: F.concat(F.repeat(F.lit("\t"), x["depth"]), x["name"])
    head = F.concat(F.lit("# file file"), F.col("f"), F.lit("\n# P"), F.col("f"), F.lit(". Places [7]\n# of one region\n"))
    found = metadata.table_keys(metadata.texts(spark, _lists(spark, sf, line, head, "\n", ".txt")))
    return found.select("file", "table", F.col("column").cast("long").alias("column"), (F.col("found") == F.col("expected")).alias("as_told"), F.array_join("path", ">").alias("path"))


# ---------------------------------------------------------------- live tail


@query("st07_live_tail", B.sql("statlog", """SELECT 'run' || run || '.log' AS file, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY run ORDER BY generation) - octet_length(encode(line)) - 1 AS at, line
  FROM (SELECT run, generation, 'generation: ' || generation || ' ' || event_type AS line FROM statlog)"""))
def _(spark, sf):
    log = B.statlog(spark, sf).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("generation", "event_type"))).alias("g"))  # one run's log is a file
    lines = F.transform("g", lambda x: F.concat(F.lit("generation: "), x["generation"], F.lit(" "), x["event_type"], F.lit("\n")))
    out = folder(spark)
    folders.put_many(log.select(F.concat(F.lit("run"), "run", F.lit(".log")).alias("name"), F.array_join(lines, "").cast("binary").alias("content")), out)
    found = streams.run_to_end(tail.live_tail(spark, out, "*.log", split=4096), folder(spark), "append")
    return found.select(F.substring_index("file", "/", -1).alias("file"), "at", "line")


# ---------------------------------------------------------------- keyed tables, samples, projection


@query("k15_upserted_table", """WITH o AS (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
SELECT c_custkey AS k, CASE WHEN o.k IS NULL THEN c_acctbal ELSE o.v END AS v FROM customer LEFT JOIN (SELECT * FROM o WHERE n = 1) o ON o.k = c_custkey WHERE o.k IS NULL OR o.k % 5 <> 0""")
def _(spark, sf):
    t = keyed.KeyedTable(spark, folder(spark), "k", "k long, v double", buckets=16)
    base = B.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").cast("double").alias("v"), F.lit(0).alias("at"))
    t.upsert(base, "base", "at")
    changes = B.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("k"), F.col("o_totalprice").cast("double").alias("v"), F.col("o_orderkey").alias("at"))
    t.upsert(changes, "orders", "at", gone="k % 5 = 0")
    t.upsert(changes.withColumn("v", F.lit(-1.0)), "orders", "at")  # the same batch again
    return t.read()


@query("s10_sorted_index", "SELECT c_custkey AS k, c_acctbal AS v, true AS found FROM customer WHERE c_custkey % 400 = 7 UNION ALL SELECT -5, NULL, NULL")
def _(spark, sf):
    rows = B.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").cast("double").alias("v"))
    out = folder(spark)
    keyed.write_index(rows, out, "k", 20)
    return keyed.look_up(spark, out, rows.where("k % 400 = 7").select("k").union(spark.range(1).select(F.lit(-5).cast("long"))), "k")


@query("t09_late_sample", B.sql("statlog", """SELECT run, generation, kmpp, spread FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5('4:' || run || ':' || generation), generation) AS k
  FROM (SELECT *, (min(generation) OVER (PARTITION BY run) + max(generation) OVER (PARTITION BY run)) / 2.0 AS middle FROM statlog) WHERE generation >= middle) WHERE k <= 10"""))
def _(spark, sf):
    return windows.late_sample(B.statlog(spark, sf).select("run", "generation", "kmpp", "spread"), seed=4)


PLANE_SQL = """, s AS (SELECT *, radians(lat / 1e6) AS la, radians(lon / 1e6) AS lo FROM blocks), c AS (SELECT sum(area * cos(la) * cos(lo)) AS x, sum(area * cos(la) * sin(lo)) AS y, sum(area * sin(la)) AS z FROM s),
o AS (SELECT atan2(z, sqrt(x * x + y * y)) AS la0, atan2(y, x) AS lo0 FROM c),
d AS (SELECT *, acos(greatest(-1.0, least(1.0, sin(la0) * sin(la) + cos(la0) * cos(la) * cos(lo - lo0)))) AS a FROM s, o),
p AS (SELECT ubid, 6378137.0 * k * cos(la) * sin(lo - lo0) AS px, 6378137.0 * k * (cos(la0) * sin(la) - sin(la0) * cos(la) * cos(lo - lo0)) AS py FROM (SELECT *, coalesce(a / nullif(sin(a), 0), 1.0) AS k FROM d)),
e AS (SELECT least(max(px) - min(px), max(py) - min(py)) AS low FROM p), f AS (SELECT min(2.0 ** n) AS scale FROM range(40) t(n), e WHERE low * 2.0 ** n >= 50000)
SELECT ubid, scale, round(px * scale / 100)::BIGINT AS px, round(py * scale / 100)::BIGINT AS py FROM p, f"""


@query("p16_rescaled_plane", B.sql("blocks", "").rstrip() + PLANE_SQL)
def _(spark, sf):
    b = B.blocks(spark, sf)
    fitted = projection.fit(b)
    out = projection.apply(b.select("ubid", "lon", "lat"), fitted).crossJoin(fitted.select("scale"))
    near = lambda c: F.round(F.col(c) / 100).cast("long").alias(c)  # noqa: E731  to a hundredth of the least step between blocks
    return out.select("ubid", "scale", near("px"), near("py"))


# ---------------------------------------------------------------- binary files, each of a bounded run of blocks

#: Blocks of a file.
BLOCKS = 10_000
FILE_SQL = f"'f' || ubid // {BLOCKS}"


def _per_file(rows: DataFrame, encode, suffix: str, out: str, by=None) -> str:
    """One file of ``encode(rows as pandas)`` for each run of blocks (or value of ``by``)."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{part['__file'].iloc[0]}{suffix}"], "content": [encode(part)]})

    name = F.concat(F.lit("f"), F.floor(F.col("ubid") / BLOCKS)) if by is None else by
    folders.put_many(rows.withColumn("__file", name).groupBy("__file").applyInPandas(build, "name string, content binary"), out)
    return out


def _base(path: str = "path"):
    return F.substring_index(path, "/", -1)


def square_rings(lon: int, lat: int) -> list[list[tuple[float, float]]]:
    return [[(float(lon + a), float(lat + b)) for a, b in ((0, 0), (0, 1000), (1000, 1000), (1000, 0), (0, 0))]]


@query("s22_s26_shape_bundles", B.sql("blocks", f"SELECT {FILE_SQL} || '.zip' AS file, '36' || lpad(ubid::VARCHAR, 13, '0') AS blockid, ubid % 13 = 0 AS water, 1::BIGINT AS rings, 5::BIGINT AS points, lon::DOUBLE AS x, lat::DOUBLE AS y FROM blocks"))
def _(spark, sf):
    def bundle(part: pd.DataFrame) -> bytes:
        part, buffer = part.sort_values("ubid"), io.BytesIO()
        rows = [(f"36{u:013d}", 0 if u % 13 == 0 else 5, 7) for u in part["ubid"]]
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("tl.shp", binary.encode_shapes([square_rings(x, y) for x, y in zip(part["lon"], part["lat"], strict=True)]))
            z.writestr("tl.dbf", binary.encode_dbase([("GEOID10", "C", 15), ("ALAND10", "N", 9), ("AWATER10", "N", 9)], rows))
        return buffer.getvalue()

    found = binary.bundles(spark, _per_file(B.blocks(spark, sf).select("ubid", "lon", "lat"), bundle, ".zip", folder(spark)))
    return found.select(_base().alias("file"), "blockid", "water", F.size("rings").cast("long").alias("rings"), F.size(F.col("rings")[0]).cast("long").alias("points"), F.col("box")[0].alias("x"), F.col("box")[1].alias("y"))


@query("a23_s23_part_histogram", "SELECT parts, count(*) AS polygons FROM (SELECT l_orderkey, count(*) AS parts FROM lineitem GROUP BY 1) GROUP BY 1")
def _(spark, sf):
    """Parts of the shapes in shapefiles: an order is a shape with a part for each of its lines."""

    def encode(part: pd.DataFrame) -> bytes:
        shapes = [[ring for n in ns for ring in square_rings(int(n) * 2000, int(u))] for u, ns in zip(part["ubid"], part["lines"], strict=True)]
        return binary.encode_shapes(shapes, 3)

    orders = B.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("ubid")).agg(F.collect_list("l_linenumber").alias("lines"))
    found = binary.shape_files(spark, _per_file(orders, encode, ".shp", folder(spark)))
    return metrics.size_histogram(found, F.size("rings"), "parts", "polygons")


@query("g10_district_shapes", B.sql("blocks", "SELECT district, 1000000.0::DOUBLE * count(*) AS area FROM blocks GROUP BY 1"))
def _(spark, sf):
    """District outlines written as shapefiles, a district each, and read back: shells run with the clock, holes against it."""
    b = B.blocks(spark, sf)
    square = F.array(*(F.struct((F.col("lon") + x).cast("double").alias("x"), (F.col("lat") + y).cast("double").alias("y")) for x, y in ((0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0))))
    corners = rings.rings(b.select("ubid", F.array(square).alias("rings")), b)
    out = folder(spark)
    sinks.write_files(rings.shape_files(corners), out)
    found = binary.shape_files(spark, out).select(F.regexp_extract("path", r"district(\d+)\.shp", 1).cast("int").alias("district"), F.explode("rings").alias("ring"))
    return found.groupBy("district").agg((-F.sum(rings.signed_area(F.col("ring")))).alias("area"))


@query("s09_k03_dataset_files", B.sql("blocks", f"SELECT {FILE_SQL} || '.pb' AS file, row_number() OVER (PARTITION BY ubid // {BLOCKS} ORDER BY ubid)::INT - 1 AS idx, ubid, lon::INT AS lon, -lat::INT AS lat, pop::INT AS pop, area, place FROM blocks"))
def _(spark, sf):
    def encode(part: pd.DataFrame) -> bytes:
        part = part.sort_values("ubid")
        points = [int(v) for x, y in zip(part["lon"], part["lat"], strict=True) for v in (x, -y)]
        return binary.encode_dataset({"points": points} | {c: [int(v) for v in part[c]] for c in ("pop", "area", "ubid", "place")})

    found = binary.dataset_blocks(spark, _per_file(B.blocks(spark, sf), encode, ".pb", folder(spark)))
    return found.select(_base().alias("file"), "idx", "ubid", "lon", "lat", "pop", "area", "place")


@query("s17_s19_place_maps", B.sql("blocks", "SELECT ubid, place::BIGINT AS place, place % 3 = 0 AS marked FROM blocks"))
def _(spark, sf):
    b, maps, lists = B.blocks(spark, sf).select("ubid", "place"), folder(spark), folder(spark)
    _per_file(b, lambda p: binary.encode_place_map(p[["ubid", "place"]].to_numpy()), ".gz", maps)
    _per_file(b.where("place % 3 = 0"), lambda p: binary.encode_id_list(p["ubid"].to_numpy()), ".gz", lists)
    marked = binary.id_list(spark, lists).select("ubid", F.lit(True).alias("marked"))
    return binary.place_map(spark, maps).join(marked, "ubid", "left").select("ubid", "place", F.coalesce("marked", F.lit(False)).alias("marked"))


@query("s20_k08_raster_files", B.sql("blocks", "SELECT ubid, ((lon // 500) + dx)::INT AS x, (lat // 500 + dy)::INT AS y, ubid % 13 = 0 AS is_water FROM blocks, range(2) a(dx), range(2) b(dy)"))
def _(spark, sf):
    def encode(part: pd.DataFrame) -> bytes:
        xy = [[v for dx in (0, 1) for dy in (0, 1) for v in (x // 500 + dx, y // 500 + dy)] for x, y in zip(part["lon"].tolist(), part["lat"].tolist(), strict=True)]
        return binary.encode_raster([(u, [] if u % 13 == 0 else p, p if u % 13 == 0 else []) for u, p in zip(part["ubid"].tolist(), xy, strict=True)])

    return binary.raster_pixels(spark, _per_file(B.blocks(spark, sf).select("ubid", "lon", "lat"), encode, ".mppb", folder(spark))).drop("path")


@query("s29_k09_binary_logs", B.sql("statlog", "SELECT 'run' || run || '.log' AS file, generation, kmpp, (spread * 100)::INT AS max_pop FROM statlog"))
def _(spark, sf):
    def encode(part: pd.DataFrame) -> bytes:
        part = part.sort_values("generation")
        return binary.encode_log([{"generation": int(g), "kmpp": float(k), "max_pop": int(p)} for g, k, p in zip(part["generation"], part["kmpp"], part["max_pop"], strict=True)])

    log = B.statlog(spark, sf).select("run", "generation", "kmpp", F.round(F.col("spread") * 100).cast("int").alias("max_pop"))
    found = binary.statlog_binary(spark, _per_file(log, encode, ".log", folder(spark), by=F.concat(F.lit("run"), "run")))
    return found.select(_base().alias("file"), "generation", "kmpp", "max_pop")


@query("t12_newest_member", B.sql("submissions", "SELECT path || '.zip' AS file, 'uf1_' || arg_max(id, (date_trunc('minute', ts), 'uf1_' || id || '.dat')) || '.dat' AS member FROM submissions WHERE config = 'error' GROUP BY 1"))
def _(spark, sf):
    """The newest member of each zip file whose name matches, the largest name among equals."""

    def encode(part: pd.DataFrame) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for id_, ts, good in zip(part["id"], part["ts"], part["good"], strict=True):
                z.writestr(zipfile.ZipInfo(f"{'uf1' if good else 'geo'}_{id_}.dat", tuple(ts.timetuple()[:5]) + (0,)), str(id_))
        return buffer.getvalue()

    subs = B.submissions(spark, sf).select("id", "path", F.col("ts").cast("timestamp").alias("ts"), (F.col("config") == "error").alias("good"))
    found = binary.zip_members(spark, _per_file(subs, encode, ".zip", folder(spark), by=F.col("path")), r"^uf1_.*\.dat$")
    return metrics.newest(found.withColumn("file", _base()), "file", "modified", "member")


SUBMITTED_SQL = """SELECT CASE WHEN id % 3 = 0 THEN 's' || id || '.json' ELSE 's' || id || '.tar.gz' END AS file, CASE WHEN id % 3 = 1 THEN 'NC_House' ELSE 'c' || config END AS n, CASE WHEN id % 2 = 0 THEN 'dsz' || id END AS solution
  FROM submissions WHERE id % 3 <> 0 OR id % 2 = 0"""


#: Submission files that stand on disk at once.
AT_ONCE = 1 << 18


@query("s31_s33_submission_scan", B.sql("submissions", SUBMITTED_SQL))
def _(spark, sf):
    """JSON files and tar.gz archives of one folder; a JSON without solution and summary is none.

    A file system holds only so many files: about ``AT_ONCE`` of them are written, scanned and deleted at a time, until all submissions are through.
    """

    def pack(parts):
        for part in parts:
            names, contents = [], []
            for id_, config in zip(part["id"].tolist(), part["config"], strict=True):
                solution = f"dsz{id_}".encode() if id_ % 2 == 0 else None
                if id_ % 3 == 0:
                    body = {"n": f"c{config}", "ok": True} | ({"bestKmpp.dsz": base64.b64encode(solution).decode()} if solution else {})
                    names.append(f"s{id_}.json")
                    contents.append(json.dumps(body).encode())
                else:
                    said = urllib.parse.urlencode({"localpath": "x", "path": f"old/NC_House/{id_}"} if id_ % 3 == 1 else {"config": f"c{config}"})
                    buffer = io.BytesIO()
                    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
                        for name, content in (("vars", said.encode()), ("solution", solution)):
                            if content is not None:
                                info = tarfile.TarInfo(f"run/{name}")
                                info.size = len(content)
                                tar.addfile(info, io.BytesIO(content))
                    names.append(f"s{id_}.tar.gz")
                    contents.append(buffer.getvalue())
            yield pd.DataFrame({"name": names, "content": contents})

    subs, tasks = B.submissions(spark, sf).select("id", "config"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, -(-subs.count() // AT_ONCE))
    dealt = subs.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds))).repartition(min(rounds, tasks), "round")
    scanned = folder(spark)
    for some in save_by(dealt, "round", rounds):
        out = folder(spark)
        folders.put_many(some.repartition(tasks, "id").mapInPandas(pack, "name string, content binary"), out)
        found = files.submissions(spark, out).select(_base().alias("file"), "n", F.decode("solution", "UTF-8").alias("solution"))
        found.write.mode("append").parquet(scanned)
        folders.remove(spark, out)
        release(some)
    return spark.read.schema(found.schema).parquet(scanned)


@query("s08_gzip_lines", B.sql("blocks", f"SELECT {FILE_SQL} || CASE WHEN ubid // {BLOCKS} % 2 = 0 THEN '.txt.gz' ELSE '.txt' END AS file, 'block ' || ubid AS line FROM blocks"))
def _(spark, sf):
    even = F.floor(F.col("ubid") / BLOCKS) % 2 == 0
    name = F.concat(F.lit("f"), F.floor(F.col("ubid") / BLOCKS), F.when(even, ".txt.gz").otherwise(".txt"))

    def encode(part: pd.DataFrame) -> bytes:
        said = "".join(f"block {u}\n" for u in part["ubid"]).encode()
        return gzip.compress(said) if part["__file"].iloc[0].endswith(".gz") else said

    return files.lines(spark, _per_file(B.blocks(spark, sf).select("ubid"), encode, "", folder(spark), by=name))


@query("p13_large_enough", B.sql("submissions", "SELECT path || '.txt' AS file, count(*)::BIGINT AS length FROM submissions GROUP BY 1 HAVING count(*) >= 8"))
def _(spark, sf):
    out = folder(spark)
    folders.put_many(B.submissions(spark, sf).groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.concat("path", F.lit(".txt")).alias("name"), F.repeat(F.lit("x"), F.col("n")).cast("binary").alias("content")), out)
    return files.large_enough(spark, out, 8)


@query("s27_j07_race_files", """WITH c AS (SELECT l_suppkey AS recno, count(*) AS total, count(*) FILTER (l_linenumber = 1) AS white, count(*) FILTER (l_linenumber > 1) + (l_suppkey % 5 = 0)::INT AS black FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey AS ubid, total, white, black, white + black <= total AS valid FROM c JOIN supplier ON s_suppkey = recno""")
def _(spark, sf):
    """Race counts by record number, joined to the blocks that have the record."""
    one, k = F.count_if(F.col("l_linenumber") == 1), F.col("l_suppkey")
    c = B.table(spark, sf, "lineitem").groupBy(k.alias("LOGRECNO")).agg(F.count(F.lit(1)).alias("total"), one.alias("white"), F.count_if(F.col("l_linenumber") > 1).alias("b"))
    c = c.select("LOGRECNO", "total", "white", (F.col("b") + (F.col("LOGRECNO") % 5 == 0).cast("int")).alias("black"), *(F.lit(0).alias(x) for x in ("native", "asian", "pacific", "other")))
    out = folder(spark)
    c.write.option("header", True).csv(out)
    blocks = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ubid"), F.col("s_suppkey").alias("recno"))
    return blocks.join(files.race_counts(spark, out), F.col("recno") == F.col("LOGRECNO")).select("ubid", "total", "white", "black", "valid")


# ---------------------------------------------------------------- logs, pages and queries as text

LOG_SQL = """SELECT run, generation, 'generation: ' || generation || chr(10) || CASE WHEN open <> 0 THEN 'gen ' || generation || ': ' || open || ' in no district (pop=' || format('{:.0f}', spread) || ')' ELSE 'generation ' || generation || ':' END
  || ' ' || format('{:.11g}', kmpp / 7) || ' Km/person to pop center; ' || format('{:.11g}', kmpp) || ' Km/person to land center' || chr(10) || 'population avg=' || format('{:.0f}', spread) || ' std=' || format('{:.9g}', kmpp / 3000000)
  || chr(10) || 'max=' || format('{:.0f}', spread * 9) || ' (dist# ' || generation % 7 + 1 || ')  min=' || format('{:.0f}', spread) || ' (dist# 1)  median=' || format('{:.0f}', spread * 2) || ' (dist# 3)'
  || CASE WHEN generation % 2 = 0 THEN chr(10) || 'kmpp var per 5000=' || format('{:.6f}', kmpp / 1000) || ', spread var per 5000=0.250000' ELSE '' END || chr(10) AS value FROM statlog"""


@query("k09_solver_log", B.sql("statlog", LOG_SQL))
def _(spark, sf):
    s, v, wide = B.statlog(spark, sf), F.col("kmpp"), F.col("spread")
    stats = s.select(
        "run", "generation", F.col("open").alias("free"), wide.alias("free_pop"), (v / 7).alias("kmpp"), v.alias("land_kmpp"), wide.alias("average"), (v / 3_000_000).alias("std"), (wide * 9).alias("max_pop"), (F.col("generation") % 7).alias("max_district"),
        wide.alias("min_pop"), F.lit(0).alias("min_district"), (wide * 2).alias("median_pop"), F.lit(2).alias("median_district"), F.when(F.col("generation") % 2 == 0, v / 1000).alias("kmpp_var"), F.lit(0.25).alias("spread_var"),
    )
    return sinks.solver_lines(stats)


@query("f41_query_text", "SELECT c_custkey AS k, 'name=' || replace(c_name, '#', '%23') || '&path=a%26b+' || c_custkey AS query, c_name AS name, 'a&b ' || c_custkey AS path FROM customer")
def _(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.create_map(F.lit("path"), F.concat(F.lit("a&b "), "c_custkey"), F.lit("name"), F.col("c_name")).alias("args"))
    said = text.query_text(F.col("args"))
    back = text.query_decoded(F.concat(F.lit("name=old&"), said))
    return c.select("k", said.alias("query"), back["name"].alias("name"), back["path"].alias("path"))


@query("r12_state_pages", "SELECT 'S_' || c_nationkey || '.html' AS file, count(*) AS rows, sum(octet_length(encode(replace(c_name, '&', '&amp;'))))::BIGINT AS characters FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    """A page for each state with its best results, written and read back."""
    best = B.table(spark, sf, "customer").select(F.concat(F.lit("S/"), "c_nationkey").alias("state"), F.col("c_name").alias("config"), F.col("c_acctbal").alias("kmpp"))
    out = folder(spark)
    sinks.write_files(sinks.pages(best, "state", "kmpp"), out)
    page = spark.read.text(out, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_extract_all("value", F.lit(r"<tr><td>([^<]*)</td><td>[^<]*</td></tr>"), F.lit(1)).alias("names"))
    return page.select("file", F.size("names").cast("long").alias("rows"), F.aggregate("names", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)).alias("characters"))


# ---------------------------------------------------------------- plots

#: The log's points of each kind of event, on a picture of 320 by 200.
PLOTTED = """SELECT name, x, y, floor((x - x0) / (x1 - x0) * 319)::INT AS col, floor((y - y0) / (y1 - y0) * 199)::INT AS row_
FROM (SELECT event_type AS name, generation::DOUBLE AS x, kmpp AS y FROM statlog WHERE kmpp IS NOT NULL),
     (SELECT min(generation)::DOUBLE AS x0, max(generation)::DOUBLE AS x1, min(kmpp) AS y0, max(kmpp) AS y1 FROM statlog WHERE kmpp IS NOT NULL)"""


def plotted(spark, sf) -> DataFrame:
    return B.statlog(spark, sf).select(F.col("event_type").alias("name"), F.col("generation").alias("x"), F.col("kmpp").alias("y"))


@query("r11_line_plot", B.sql("statlog", f"""SELECT name, col AS "column", min({{'x': x, 'y': y, 'r': row_}}).r AS enters, min(row_) AS low, max(row_) AS high, max({{'x': x, 'y': y, 'r': row_}}).r AS leaves
FROM ({PLOTTED}) GROUP BY name, col"""))
def _(spark, sf):
    """A line for each kind of event, by what it does in each pixel column."""
    return plots.lines(plotted(spark, sf), 320, 200)


@query("r11_bar_plot", B.sql("statlog", f"""SELECT col AS "column", max(row_) AS top FROM ({PLOTTED}) GROUP BY col"""))
def _(spark, sf):
    """A bar for each pixel column, up to its highest point."""
    return plots.bars(plotted(spark, sf), 320, 200)
