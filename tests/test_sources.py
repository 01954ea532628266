import gzip
import io
import struct
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.plans import formats, records
from wardline.sources import binary, files, folders, sinks


def line(width, **at):
    out = [" "] * width
    for key, v in at.items():
        k = int(key[1:])
        out[k : k + len(v)] = v
    return "".join(out)


def test_geography_2010(spark, tmp_path):
    row = line(500, c0="PLST  ", c8="750", c18="0000042", c27="48", c29="001", c45="00464", c50="C1", c54="000001", c60="1", c61="1001", c198="00000000000123", c318="000000007", c336="+10.5000000", c347="-120.2500000")
    county = line(500, c0="PLST  ", c8="050")
    (tmp_path / "geo").write_text(row + "\n" + county + "\n")
    got = files.geography(spark, str(tmp_path / "geo")).collect()
    assert [(r.ubid, r.recno, r.lon, r.lat, r.pop, r.area, r.place) for r in got] == [(480010000011001, 42, -120250000, 10500000, 7, 123, 464)]


def test_geography_2020(spark, tmp_path):
    f = [""] * 97
    for k, v in {0: "PLST", 2: "750", 7: "42", 12: "48", 14: "001", 29: "00464", 30: "C9", 32: "000001", 34: "1001", 84: "123", 85: "0", 90: "7", 92: "+10.5", 93: "-120.25"}.items():
        f[k] = v
    (tmp_path / "geo.pl").write_text("|".join(f) + "\n")
    r = files.geography(spark, str(tmp_path / "geo.pl")).first()
    assert (r.ubid, r.recno, r.lon, r.lat, r.pop, r.area, r.place) == (480010000011001, 42, -120250000, 10500000, 7, 123, 0)


def test_demographics_links_and_solutions(spark, tmp_path):
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("a,b,c,d,LOGRECNO,total\nx,x,x,x,0000042,17\n")
    demo = files.demographics(spark, str(tmp_path / "d.csv.gz"), 4, {"total": 5})
    blocks = spark.createDataFrame([(480010000011001, 42), (480010000011002, 43)], "ubid long, recno int")
    assert {r.recno: r.total for r in files.join_demographics(blocks, demo).collect()} == {42: 17, 43: 0}
    (tmp_path / "links").write_text("480010000011001,480010000011002\n480010000011001,999999999999999\n")
    assert [tuple(r) for r in files.links(spark, str(tmp_path / "links"), blocks).collect()] == [(480010000011001, 480010000011002)]
    (tmp_path / "s.csv").write_text("480010000011001, 1\n480010000011002;2\n5,1\n")
    got = files.solution_csv(spark, str(tmp_path / "s.csv"), districts=1, blocks=blocks)
    assert {r.ubid: r.district for r in got.collect()} == {480010000011001: 0, 480010000011002: None}
    assert [files.solution_kind(x) for x in ("a.dsz", "b/c.csv.gz", "x.text")] == ["dsz", "csv", "text"]


def test_place_names(spark, tmp_path):
    (tmp_path / "p").write_text("OH|39|00464|Adena village|Incorporated Place|A|Harrison County\r\n")
    r = files.place_names(spark, str(tmp_path / "p")).first()
    assert (r.place, r.name, r.counties) == (464, "Adena village", "Harrison County")


def test_run_log_text(spark, tmp_path):
    (tmp_path / "log").write_text("generation 0: 5.5 Km/person\npopulation avg=10 std=2.5\nmax=12 (dist# 1)  min=8 (dist# 2)\ngen 1: 3 in no district (pop=9) 5.25 Km/person\n#Best Km/p: Km/p=5.25 spread=4 std=2.5\n")
    rows = {r.generation: r for r in files.statlog_text(spark, str(tmp_path / "log")).collect()}
    assert (rows[0].kmpp, rows[0].std, rows[0].max_pop, rows[0].min_pop, rows[1].nod_pop) == (5.5, 2.5, 12.0, 8.0, 9.0)
    assert files.summary_lines(spark, str(tmp_path / "log")).first().spread == 4.0


def test_submissions(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": "XX_House", "ok": true, "statsum": "s", "b": {"Kmpp": 1.5}}')
    (tmp_path / "b.json").write_text('{"n": "XX_House", "ok": false, "statsum": "s"}')
    (tmp_path / "c.json").write_text("no json")
    got = files.json_submissions(spark, str(tmp_path)).collect()
    assert [(r.n, r.b.Kmpp) for r in got] == [("XX_House", 1.5)]


def test_best_log_later_lines_win(spark, tmp_path):
    (tmp_path / "best").write_text("a\t1.5\nb\t2.5\na\t0.5\n")
    got = files.best_log(spark, str(tmp_path / "best"), "name string, kmpp double")
    assert {r.name: r.kmpp for r in got.collect()} == {"a": 0.5, "b": 2.5}


def test_dsz_and_place_map(spark, tmp_path):
    d = np.array([0, 1, -1, 252])
    (tmp_path / "x.dsz").write_bytes(binary.encode_dsz(d))
    assert [r.district for r in binary.dsz(spark, str(tmp_path / "x.dsz")).orderBy("idx").collect()] == [0, 1, None, 252]
    (tmp_path / "map.gz").write_bytes(binary.encode_place_map(np.array([[5, 7], [6, 8]])))
    assert [tuple(r)[1:] for r in binary.place_map(spark, str(tmp_path / "map.gz")).collect()] == [(5, 7), (6, 8)]
    with pytest.raises(ValueError):
        next(binary.decode_dsz(struct.pack("<III", 3, 0, 0)))


def test_dataset_message(spark, tmp_path):
    columns = {"points": [-5, 6, 7, 8], "pop": [1, 2], "area": [3, 4], "ubid": [10, 11], "recno": [20, 21], "edges": [0, 1], "place": [0, 9]}
    (tmp_path / "d.pb").write_bytes(binary.encode_dataset(columns))
    got = binary.dataset_blocks(spark, str(tmp_path / "d.pb")).orderBy("idx").collect()
    assert [(r.ubid, r.lon, r.lat, r.pop, r.place) for r in got] == [(10, -5, 6, 1, 0), (11, 7, 8, 2, 9)]
    assert [tuple(r)[1:] for r in binary.dataset_edges(spark, str(tmp_path / "d.pb")).collect()] == [(0, 1)]


def test_binary_log(spark, tmp_path):
    entry = {"generation": 100, "kmpp": 1.5, "average": 10.0, "std": 2.0, "max_pop": 12, "min_pop": 8, "median_pop": 10}
    (tmp_path / "log.gz").write_bytes(binary.encode_log([entry, entry | {"generation": 200, "nod_pop": 3}]))
    got = binary.statlog_binary(spark, str(tmp_path / "log.gz")).orderBy("generation").collect()
    assert [(r.generation, r.kmpp, r.nod_pop) for r in got] == [(100, 1.5, None), (200, 1.5, 3)]


def shape_bundle():
    ring = np.array([[0, 0], [1, 0], [1, 1], [0, 0]], "<f8")
    body = struct.pack("<i4dii", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + ring.tobytes()
    record = struct.pack(">ii", 1, len(body) // 2) + body
    shp = struct.pack(">i", 9994) + b"\0" * 20 + struct.pack(">i", (100 + len(record)) // 2) + b"\0" * 72 + record
    fields = [("GEOID10", "C", 15), ("ALAND10", "N", 5), ("AWATER10", "N", 5)]
    head = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in fields) + b"\r"
    row = b" " + b"480010000011001" + b"    0" + b"   12"
    dbf = struct.pack("<4xIHH20x", 1, 32 + len(head), len(row)) + head + row
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.shp", shp)
        z.writestr("x.dbf", dbf)
    return out.getvalue()


def test_shape_bundle(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(shape_bundle())
    r = binary.bundles(spark, str(tmp_path / "x.zip")).first()
    assert (r.blockid, r.water, len(r.rings[0]), r.rings[0][1].x) == ("480010000011001", True, 4, 1.0)


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(123456, 0), (7, 1)], "ubid long, district int")
    assert [r.value for r in sinks.solution_lines(a).collect()] == ["0000000007,2", "0000123456,1"]
    assert [r.value for r in sinks.solution_lines(a, base=0, fixed=True).collect()] == ["000000000701", "000012345600"]
    with pytest.raises(ValueError):
        sinks.solution_lines(spark.createDataFrame([(7, 1)], "ubid long, district int"))
    assert sinks.report_text(a.orderBy("ubid"), "csv") == "ubid,district\n7,1\n123456,0\n"
    svg = sinks.scatter_svg(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "spread double, kmpp double"))
    assert svg.count("<circle") == 2
    leg = spark.createDataFrame([("Ohio", "House", "House", 1)], "state string, body string, short string, seats int")
    assert '"disabled":true' in sinks.run_configs(leg).first().config
    assert sinks.without(a, a.limit(1).select(F.col("ubid")), "ubid").count() == 1


def test_folders_are_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "FILES", 3)
    rows = [(f"s{k}.json", f'{{"n": "c{k}", "ok": true, "statsum": "s"}}'.encode()) for k in range(40)]
    assert folders.put_many(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "in")) == 40
    (tmp_path / "in" / "_half.json").write_text("{}")
    assert len(list((tmp_path / "in").glob("*/*.json"))) == 40
    found = folders.listing(spark, str(tmp_path / "in"))
    got = folders.contents(found, str(tmp_path / "in")).collect()
    assert {(r.path.rpartition("/")[2], bytes(r.content)) for r in got} == set(rows) and all(r.length == len(r.content) for r in got)
    assert [r.path.rpartition("/")[2] for r in folders.listing(spark, got[0].path).collect()] == [got[0].path.rpartition("/")[2]]
    plan = files.submissions(spark, str(tmp_path / "in"))._jdf.queryExecution().toString()
    assert "binaryFile" not in plan  # whose list of files is the driver's
    assert {r.n for r in files.submissions(spark, str(tmp_path / "in")).collect()} == {f"c{k}" for k in range(40)}


def test_numbers_longer_than_their_padding_stay_whole(spark):
    got = spark.range(1).select(*(records.zeros(F.lit(n), 5).alias(f"c{n}") for n in (7, 12345, 119999))).first()
    assert tuple(got) == ("00007", "12345", "119999")


def test_run_logs_are_written_and_listed_in_tasks(spark, tmp_path):
    log = spark.range(30).select((F.col("id") % 3).alias("run"), F.col("id").cast("int").alias("generation"), F.col("id").cast("double").alias("kmpp"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.txt").write_text("generation 7: 1.5 Km/person\n")
    sinks.write_statlogs(log, str(tmp_path / "out"), 2)
    assert {p.parent.name for p in (tmp_path / "out").glob("*/*/log.txt")} == {"run=0", "run=1", "run=2"}
    rows = files.statlog_text(spark, str(tmp_path / "out"))
    assert "FileScan text" not in rows._jdf.queryExecution().toString()  # whose list of files is the driver's
    assert {(int(r.run.split("run=")[1][0]), r.generation, r.kmpp) for r in rows.collect()} == {(k % 3, k, float(k)) for k in range(0, 30, 2)}


def test_binary_logs_are_listed_in_tasks(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"run{k}.log").write_bytes(binary.encode_log([{"generation": 7, "kmpp": float(k), "max_pop": k}]))
    rows = binary.statlog_binary(spark, str(tmp_path))
    assert "binaryFile" not in rows._jdf.queryExecution().toString()
    assert {(r.path.rpartition("/")[2], r.kmpp, r.max_pop) for r in rows.collect()} == {(f"run{k}.log", float(k), k) for k in range(5)}


def test_submission_files_are_gone_before_more_are_written(spark, monkeypatch, same):
    put, written = folders.put_many, []

    def watched(some, out):
        assert not any(Path(before.removeprefix("file:")).exists() for before, _ in written)
        written.append((out, put(some, out)))
        return written[-1][1]

    monkeypatch.setattr(folders, "put_many", watched)
    monkeypatch.setattr(formats, "AT_ONCE", 400, raising=False)
    same(formats.QUERIES["s31_s33_submission_scan"], formats.ORACLE_SQL["s31_s33_submission_scan"])
    assert sum(n for _, n in written) == 1000 and max(n for _, n in written) < 500
    assert not Path(written[-1][0].removeprefix("file:")).exists()
