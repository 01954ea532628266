"""Numbers and queries as text, log lines, pages and long frames."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators import raster, windows
from wardline.sources import binary, files, sinks


def test_general_numbers_are_as_c_prints_them(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -2.5, 100.0, 1e-5, 9.9999999999e-5, 123456.789, 1e11, 99999999999.6, 1e300, 3e-300, 0.1, 5e10, *(rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 15) for _ in range(200))]
    for digits in (3, 9, 11):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.general(F.col("v"), digits).alias("t")).collect()
        assert {r.v: r.t for r in got} == {v: f"{v:.{digits}g}" for v in values}


def test_query_text_round_trip(spark):
    args = [{"a": "1 2", "ü": "&=%", "": "x", "z": ""}, {}]
    df = spark.createDataFrame([(a,) for a in args], "args map<string,string>")
    assert [r[0] for r in df.select(text.query_decoded(text.query_text(F.col("args")))).collect()] == args
    odd = spark.createDataFrame([("a=1&a=2&b&=&&c=d=e",)], "t string").select(text.query_decoded(F.col("t"))).first()[0]
    assert odd == {"a": "2", "b": "", "": "", "c": "d=e"}


def test_solver_lines_are_read_back(spark, tmp_path):
    columns = "run string, generation int, free int, free_pop double, kmpp double, land_kmpp double, average double, std double, max_pop long, max_district int, min_pop long, min_district int, median_pop long, median_district int, kmpp_var double, spread_var double"
    rows = [("r", 0, 4, 812.0, 31.25, 30.5, 990.0, 12.75, 1500, 2, 700, 0, 1000, 1, None, None), ("r", 100, 0, 0.0, 29.125, 28.0, 990.0, 3.5, 1100, 1, 900, 2, 1000, 0, 0.25, 0.5)]
    lines = sinks.solver_lines(spark.createDataFrame(rows, columns), 200).orderBy("generation")
    said = "".join(r.value + "\n" for r in lines.collect())
    assert said.splitlines()[1] == "gen 0: 4 in no district (pop=812) 31.25 Km/person to pop center; 30.5 Km/person to land center"
    assert "max=1100 (dist# 2)  min=900 (dist# 3)  median=1000 (dist# 1)\nkmpp var per 200=0.250000, spread var per 200=0.500000\n" in said
    (tmp_path / "log").write_text(said)
    got = files.statlog_text(spark, str(tmp_path / "log")).orderBy("generation").collect()
    assert [(r.generation, r.kmpp, r.std, r.max_pop, r.min_pop, r.nod_pop) for r in got] == [(0, 31.25, 12.75, 1500, 700, 812), (100, 29.125, 3.5, 1100, 900, None)]


def test_pages_hold_their_rows(spark):
    best = spark.createDataFrame([("A/B", "x<y", 2.0), ("A/B", "z", 1.0), ("C", None, None)], "state string, config string, kmpp double")
    got = {r.name: bytes(r.content).decode() for r in sinks.pages(best, "state", "kmpp").collect()}
    assert got.keys() == {"A_B.html", "C.html"} and got["A_B.html"].index("<td>z</td><td>1.0</td>") < got["A_B.html"].index("x&lt;y") and "<td></td><td></td>" in got["C.html"]


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_long_frames_equal_short_ones(spark, monkeypatch, n):
    rng = random.Random(n)
    rows = [(r, g, None if rng.random() < 0.1 else rng.random()) for r in range(3) for g in range((5, 40, 97)[r])]
    log = spark.createDataFrame(rows, "run int, generation int, kmpp double")
    want = sorted(map(tuple, windows.last_n(log, "kmpp", n).collect()), key=str)
    monkeypatch.setattr(windows, "SHORT", 0)
    assert sorted(map(tuple, windows.last_n(log, "kmpp", n).collect()), key=str) == want


def test_clip_and_plot_script(spark):
    pixels = spark.createDataFrame([(1, x, y) for x in (-1, 0, 3, 4) for y in (-1, 1, 2)], "ubid int, x int, y int")
    assert sorted((r.x, r.y) for r in raster.clip(pixels, 4, 2).collect()) == [(0, 1), (3, 1)]
    log = spark.createDataFrame([("a", 2, 1.5, 9.0), ("a", 1, 2.0, 8.0), ("b", 1, 7.0, 7.0)], "run string, generation int, kmpp double, spread double")
    script, series = sinks.plot_script(log, "a")
    assert script.splitlines()[1:3] == ["1 2.0", "2 1.5"] and series == "[[1, 2.0, 8.0], [2, 1.5, 9.0]]"
    assert "<td>b</td>" in sinks.leaderboard_html(spark.createDataFrame([("b", 1.0)], "config string, kmpp double"))


def test_raster_message_keeps_land_and_water(spark, tmp_path):
    (tmp_path / "r").write_bytes(binary.encode_raster([(5, [1, 2, 300, 4], []), (6, [7, 8], [9, 10])]))
    got = binary.raster_pixels(spark, str(tmp_path / "r")).drop("path").collect()
    assert sorted(map(tuple, got)) == [(5, 1, 2, False), (5, 300, 4, False), (6, 7, 8, False), (6, 9, 10, True)]


def test_shapes_and_tables_round_trip():
    rings = [[(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0), (5.0, 5.0)]]
    got = list(binary.shapes(binary.encode_shapes([rings, [], rings[1:]])))
    assert [g["rings"] for g in got] == [rings, [], rings[1:]] and got[0]["box"] == [0, 0, 6, 5]
    names, rows = binary.dbase(binary.encode_dbase([("NAME", "C", 6), ("N", "N", 5)], [("é b", 12), ("", None), ("x", 1.5)]))
    assert names == ["NAME", "N"] and rows == [{"NAME": "é b", "N": 12}, {"NAME": "", "N": None}, {"NAME": "x", "N": 1.5}]
