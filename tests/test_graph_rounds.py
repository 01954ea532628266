"""Components by rounds and shortest ways out, against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import graph, rings
from wardline.plans import measures


def plain(nodes, edges):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("few", [0, 12, 10**6])
def test_components_with_and_without_the_last_step(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(1)
    nodes = [*range(200), *range(1000, 1040)]
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1039)] + [(3, 9999), (9999, 150), (7, 7), (8, 3), (3, 8)]
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "ubid long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.ubid: r.component for r in got.collect()} == plain(nodes, edges)


def test_components_of_nothing(spark):
    none = graph.components(spark.createDataFrame([], "ubid long"), spark.createDataFrame([], "a long, b long"))
    assert none.collect() == []


def test_shortest_ways_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL_BLOCKS", 3)
    rng = random.Random(2)
    rows = [(k, 0, rng.randrange(500), rng.randrange(500)) for k in range(150)] + [(k, 150 + k // 5 * 5, 700 + rng.randrange(300), rng.randrange(400) * 3) for k in range(150, 200)]
    rows += [(200 + k, 200, 50_000 + k, 50_000) for k in range(3)] + [(300 + k, 300 + k, 60, 60) for k in range(6)]  # far away; at one place
    got = {r.component: tuple(r.way) for r in graph.ways_out(spark.createDataFrame(rows, "ubid long, component long, lon long, lat long")).collect()}
    want = {}
    for a, c, x1, y1 in rows:
        for b, d, x2, y2 in rows:
            if c != d:
                want[c] = min(want.get(c, (1 << 60, 0, 0)), ((x1 - x2) ** 2 + (y1 - y2) ** 2, min(a, b), max(a, b)))
    want.pop(0)  # the largest does not ask
    assert got == want


def test_contiguity_by_weighted_centres(spark):
    rng = random.Random(3)
    wide, rows = 12, {}
    for k in range(144):
        rows[k] = (k, k % wide * 10, k // wide * 10, 1, rng.randrange(1, 5), k % wide // 3 if rng.random() < 0.85 else rng.randrange(4))
    edges = [(k, k + 1) for k in rows if k % wide != wide - 1] + [(k, k + wide) for k in rows if k + wide in rows]
    centres = {d: (rng.uniform(0, 110), rng.uniform(0, 110), rng.uniform(0.2, 4)) for d in range(4)}
    blocks = spark.createDataFrame(list(rows.values()), "ubid long, lon long, lat long, pop long, area long, district int")
    known = spark.createDataFrame([(d, *c) for d, c in centres.items()], "district int, cx double, cy double, weight double")
    got = {r.ubid: r.district for r in graph.fix_contiguity(spark.createDataFrame(edges, "a long, b long"), blocks, known).collect()}
    parts = plain(rows, [(a, b) for a, b in edges if rows[a][5] == rows[b][5]])
    now = {}
    for d in range(4):
        own = [parts[x] for x in rows if rows[x][5] == d]
        best = max(set(own), key=lambda c: (own.count(c), c == min(own), c))
        now |= {x: d for x in rows if parts[x] == best}
    while len(now) < len(rows):
        given = {}
        for x in rows.keys() - now.keys():
            offers = {now[b] for a, b in edges if a == x and b in now} | {now[a] for a, b in edges if b == x and a in now}
            if offers:
                given[x] = min(offers, key=lambda d: (((rows[x][1] - centres[d][0]) ** 2 + (rows[x][2] - centres[d][1]) ** 2) * centres[d][2], d))
        now |= given
    assert got == now


def test_map_tables_are_not_sent_through_the_driver(spark):
    b = spark.range(8).select(F.col("id").alias("ubid"), (F.col("id") % 2).alias("district"), *(F.col("id").alias(c) for c in ("lon", "lat", "pop", "area")))
    e = b.select(F.col("ubid").alias("a"), (F.col("ubid") + 1).alias("b"))
    point = F.struct(F.col("ubid").cast("double").alias("x"), F.col("ubid").alias("y"))
    segments = b.select(F.col("ubid").alias("id"), "district", point.alias("p"), point.alias("q"))
    shared = measures.shared_vertices(b.select("ubid", F.col("lon").alias("x"), F.col("lat").alias("y")))
    for made in (graph.with_districts(e, b), rings.successors(segments), shared, graph.district_groups(e, b)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
