"""Rings of district outlines against a plain tracer on random grids."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.operators import rings


def square(x, y, turn=False):
    ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
    return [[{"x": float(a), "y": float(b)} for a, b in (ring[::-1] if turn else ring)]]


def inside(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            hit = not hit
    return hit


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_cover_their_cells(spark, seed):
    rng = random.Random(seed)
    cells = {(x, y): int(rng.random() < (0.45, 0.75)[seed - 1]) for x in range(12) for y in range(12)}
    cells |= {(x + 20, y): 2 for x in range(5) for y in range(5) if 0 < x < 4 or 0 < y < 4} | {(22, 2): 3}
    rows = [(i, square(*c, rng.random() < 0.5), d) for i, (c, d) in enumerate(cells.items())]
    polygons = spark.createDataFrame(rows, "ubid long, rings array<array<struct<x: double, y: double>>>, district int")
    found = rings.rings(polygons, polygons.select("ubid", "district")).collect()
    parts = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.ring, r.place)):
        parts[r.district, r.shell, r.ring, r.area].append((r.x, r.y))
    for (_, shell, ring, signed), points in parts.items():
        assert len(set(points)) == len(points) >= 4 and area(points) == signed and (signed > 0) == (shell == ring)
    for d in {0, 1, 2, 3}:
        polygons_of = defaultdict(list)
        for (district, shell, ring, _), points in parts.items():
            if district == d:
                polygons_of[shell].append((ring == shell, points))
        assert all(sum(is_shell for is_shell, _ in p) == 1 for p in polygons_of.values())
        covers = lambda x, y: sum(all(inside(x, y, pts) == is_shell for is_shell, pts in p) for p in polygons_of.values())  # noqa: B023, E731
        for (x, y), district in cells.items():
            assert covers(x + 0.5, y + 0.5) == (district == d)


def test_wkt_of_a_district_with_a_hole(spark):
    rows = [(x * 3 + y, square(x, y), 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(50, square(9, 9), 1), (51, square(1, 1), 2), (52, square(30, 30), None)]
    polygons = spark.createDataFrame(rows, "ubid long, rings array<array<struct<x: double, y: double>>>, district int")
    got = {r.district: r.wkt for r in rings.wkt(rings.rings(polygons, polygons.select("ubid", "district"))).collect()}
    assert got.keys() == {1, 2} and got[2].startswith("POLYGON ((") and got[2].count(",") == 4
    assert got[1].startswith("MULTIPOLYGON (((") and got[1].count("((") == 2 and got[1].count("), (") == 2


def test_blocks_with_holes_keep_them(spark):
    ring = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in [(a, a), (b, a), (b, b), (a, b), (a, a)]]
    polygons = spark.createDataFrame([(1, [ring(0, 9), ring(2, 4)[::-1]], 1)], "ubid long, rings array<array<struct<x: double, y: double>>>, district int")
    out = rings.rings(polygons, polygons.select("ubid", "district")).select("ring", "area", (F.col("ring") == F.col("shell")).alias("own")).distinct()
    assert sorted((r.area, r.own) for r in out.collect()) == [(-4.0, False), (81.0, True)]


def test_no_blocks_no_rings(spark):
    polygons = spark.createDataFrame([], "ubid long, rings array<array<struct<x: double, y: double>>>, district int")
    assert rings.wkt(rings.rings(polygons, polygons.select("ubid", "district"))).collect() == []
