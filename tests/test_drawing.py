"""Drawing scripts, tiles and collisions."""

import numpy as np
from pyspark.sql import functions as F

from wardline.operators import drawing, graph, raster

SCRIPT = """# a comment --pngW 7
--loadSolution one.dsz  --pngW 4 --pngH 2 // size
--minlon 0 --maxlond 4 --minlat -1 --maxlat 1
recolor --pngout a.png
--loadSolution s3://x/two.dsz renumber --maxlat 9 --minlatd -2 --pngout b.png
--colorsIn c.txt -px r.upix --colorsOut d.txt clearpx --pngout e.png
done --pngout never.png nonsense
"""


def test_scripts_fold_into_pictures(spark):
    scripts = [("s", SCRIPT), ("bad", "--pngW 3 --pngout a.png bogus --pngout b.png"), ("open", "--pngout"), ("number", "--pngW x --pngout a"), ("none", "")]
    got = drawing.pictures(spark.createDataFrame(scripts, "script string, text string")).orderBy("script", "place").collect()
    rows = [r for r in got if r.script == "s"]
    assert [(r.kind, r.path, r.solution, r.renumbered, r.colors, r.pixels) for r in rows] == [
        ("png", "a.png", "one.dsz", False, "recolor:one.dsz", None), ("png", "b.png", "s3://x/two.dsz", True, "recolor:s3://x/two.dsz:renumbered", None),
        ("colors", "d.txt", "s3://x/two.dsz", True, "file:c.txt", "r.upix"), ("png", "e.png", "s3://x/two.dsz", True, "file:c.txt", None),
    ]
    assert [(r.width, r.height, r.minlon, r.maxlon, r.minlat, r.maxlat) for r in rows[:2]] == [(4, 2, 0, 4, -1, 1), (4, 2, 0, 4, 7, 9)]
    assert {r.script: r.bad for r in got} == {"s": None, "bad": "bogus", "open": "--pngout", "number": "x", "none": None}


def test_pictures_are_drawn_together(spark):
    square = lambda x, y: [[{"x": float(x + a), "y": float(y + b)} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]]
    cells = [(x + 4 * y, x, y) for x in range(4) for y in range(2)]
    blocks = spark.createDataFrame([(u, x, y) for u, x, y in cells], "ubid long, lon long, lat long")
    polygons = spark.createDataFrame([(u, square(x, y)) for u, x, y in cells], "ubid long, rings array<array<struct<x: double, y: double>>>")
    edges = spark.createDataFrame([(u, u + 1) for u, x, y in cells if x < 3] + [(u, u + 4) for u, x, y in cells if y < 1], "a long, b long")
    districts = {"one": lambda x, y: x // 2, "two": lambda x, y: 5 - y}
    assignments = spark.createDataFrame([(s, u, d(x, y)) for s, d in districts.items() for u, x, y in cells], "solution string, ubid long, district int")
    palette = spark.createDataFrame([(k, 10 + k, 20 + k, 30 + k) for k in range(14)], "color int, r int, g int, b int")
    files = spark.createDataFrame([("file:c", 0, 1, 2, 3)], "colors string, district int, r int, g int, b int")
    text = "--pngW 4 --pngH 2 --maxlon 4 --maxlat 2 --loadSolution one recolor --pngout a --maxlon 2 --pngW 2 --loadSolution two renumber --pngout b --colorsIn c --pngout c"
    asked = drawing.pictures(spark.createDataFrame([("s", text)], "script string, text string"))
    got = drawing.draw(asked, polygons, blocks, edges, assignments, palette, files).collect()
    by = {p: {(r.x, r.y): (r.r, r.g, r.b) for r in got if r.path == p} for p in "abc"}
    assert by["a"].keys() == {(x, y) for x in range(4) for y in range(2)} and by["b"].keys() == {(x, y) for x in range(2) for y in range(2)}
    assert by["a"][0, 0] == by["a"][1, 1] != by["a"][2, 0] == by["a"][3, 1]
    assert by["b"][0, 0] == (10, 20, 30) != by["b"][0, 1]  # the top row is number 0
    assert by["c"][1, 0] == (1, 2, 3) and by["c"][1, 1] == (128, 128, 128)


def test_tiles_hold_the_pixels(spark):
    rows = [("p", x, y, x, y, 7) for x in range(70) for y in range(40) if (x + y) % 3]
    pixels = spark.createDataFrame(rows, "path string, x int, y int, r int, g int, b int")
    whole = np.zeros((64, 96, 4), np.uint8)
    for t in drawing.tiles(pixels, ["path"], 32).collect():
        whole[t.ty * 32 : t.ty * 32 + 32, t.tx * 32 : t.tx * 32 + 32] = raster.decode_png(bytes(t.content))
    want = np.zeros_like(whole)
    for _, x, y, r, g, b in rows:
        want[y, x] = (r, g, b, 255)
    assert (whole == want).all()
    some = drawing.tiles(pixels.limit(1), ["path"], 4, drawing.BACKGROUND).first()
    assert (raster.decode_png(bytes(some.content))[:, :, 3] == 255).all()


def test_collisions_count_later_blocks(spark):
    pixels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (2, 1, 0), (3, 0, 0), (3, 5, 5)], "ubid long, x int, y int")
    assert {tuple(r) for r in drawing.collisions(pixels).collect()} == {(1, 1, 0), (2, 2, 1), (3, 2, 1)}


def test_colors_of_many_maps(spark):
    pairs = [("m", a, b) for a in range(5) for b in range(5)] + [("n", 0, 1), ("n", 9, 9)]
    got = graph.colors(spark.createDataFrame(pairs, "map string, d1 int, d2 int"), "map").collect()
    assert len({r.color for r in got if r.map == "m"}) == 5 and sorted(r.district for r in got if r.map == "n") == [0, 1, 9]
    assert spark.createDataFrame(got).groupBy("map", "district").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
