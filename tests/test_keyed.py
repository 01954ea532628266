"""Upserts and index look-ups that touch only what they must, samples, and the fitted projection."""

import os
import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import projection, windows
from wardline.sources import keyed


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_survives_a_failure_and_a_rerun(spark, tmp_path, monkeypatch):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", "k", "k long, v string", buckets=8)
    rows = lambda pairs: spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(pairs)], "k long, v string, at int")
    assert t.upsert(rows([(k, f"v{k}") for k in range(40)]), "first", "at") == 1 and t.read().count() == 40
    before = files(tmp_path)
    changes = rows([(3, "old"), (3, "new"), (100, "more"), (5, "gone")])
    monkeypatch.setattr(keyed.KeyedTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.upsert(changes, "second", "at", gone="v = 'gone'")
    monkeypatch.undo()
    assert t.version() == 1 and {r.k: r.v for r in t.read().collect()}[3] == "v3"
    assert t.upsert(changes, "second", "at", gone="v = 'gone'") == 2 == t.upsert(changes, "second", "at")
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {k: f"v{k}" for k in range(40) if k != 5} | {3: "new", 100: "more"}
    assert before <= files(tmp_path) and t.read(1).count() == 40  # the version before can still be read
    kept = [f for f in t._manifest(2)["folders"].values() if "/1-" in f]
    assert len(kept) >= 5  # at most three of eight buckets were written anew


def test_two_writers_cannot_both_win(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", "k", "k long", buckets=2)
    t.upsert(spark.range(3).select(F.col("id").alias("k")), "a", "k")
    with pytest.raises(RuntimeError):
        t._publish(1, {})
    assert t.version() == 1 and t.read().count() == 3
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, f"file://{tmp_path}/t", "k", "k long", buckets=3).upsert(spark.range(1).select(F.col("id").alias("k")), "b", "k")


def test_look_up_reads_few_ranges(spark, tmp_path):
    rows = spark.range(10_000).select((F.col("id") * 3).alias("k"), F.col("id").cast("string").alias("v"))
    keyed.write_index(rows, str(tmp_path), "k", 50)
    out = keyed.look_up(spark, str(tmp_path), spark.createDataFrame([(30,), (33,), (29_997,), (31,), (99_999,)], "k long"), "k")
    assert {(r.k, r.v, r.found) for r in out.collect()} == {(30, "10", True), (33, "11", True), (29_997, "9999", True), (31, None, None), (99_999, None, None)}
    plan = out._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*range#\d+ IN \(0,49\)", plan), plan


def test_sample_is_the_same_for_any_partitions(spark):
    log = spark.createDataFrame([(r, g, float(g), 1.0) for r in range(3) for g in range(0, 10_000, 50)], "run long, generation long, kmpp double, spread double")
    draws = [sorted(map(tuple, windows.late_sample(log.repartition(n), seed=1).collect())) for n in (1, 5)]
    assert draws[0] == draws[1] and len(draws[0]) == 30 and all(r[1] >= 4975 for r in draws[0])
    assert draws[0] != sorted(map(tuple, windows.late_sample(log, seed=2).collect()))
    assert windows.late_sample(log)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_power_of_two_equals_the_loops(spark):
    def loops(short, long):
        scale = 1.0
        while short * scale < 50_000.0:
            scale *= 2.0
        while long * scale > 1_000_000_000.0:
            scale *= 0.5
        return scale

    sides = [(s, s * w) for s in (0.001, 1.0, 48.828125, 50_000 / 1024, 24_999.9, 25_000.0, 49_999.0, 50_000.0, 3e9, 4e12) for w in (1.0, 3.0, 20_000.0, 7e6)]
    got = spark.createDataFrame(sides, "s double, l double").select("s", "l", projection.power_of_two(F.col("s"), F.col("l")).alias("f")).collect()
    assert all(r.f == loops(r.s, r.l) for r in got)


def test_projection_of_one_point_and_of_none(spark):
    one = spark.createDataFrame([(7, 10_000_000, 45_000_000, 3)], "ubid long, lon long, lat long, area long")
    assert [(r.px, r.py) for r in projection.apply(one, projection.fit(one)).collect()] == [(0, 0)]
    assert projection.apply(one.limit(0), projection.fit(one.limit(0))).collect() == []
