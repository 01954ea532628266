"""Raw rasters: the same pixels however a file is cut, and whatever its byte order."""

import random

import numpy as np
import pytest

from wardline.sources import upix


def raster(order, seed=1, records=120):
    rng = random.Random(seed)
    out, want = np.array([1, 640, 480], order + "u4").tobytes(), []
    for k in range(records):
        ubid = rng.choice([k, 0xFFFFFFFF, 5 << 32 | 0xFFFFFFFF, 360010001001000 + k])
        pixels = [(rng.randrange(640), rng.randrange(480)) for _ in range(rng.choice([0, 0, 1, 2, 5, 40]))]
        out += np.array([ubid], order + "u8").tobytes() + np.array(pixels, order + "u2").tobytes() + b"\xff" * 4
        want += [(ubid, *p) for p in pixels]
    return out, sorted(want)


@pytest.mark.parametrize("order", ["<", ">"])
def test_every_cut_gives_the_same_pixels(tmp_path, monkeypatch, order):
    content, want = raster(order)
    monkeypatch.setattr(upix, "CHUNK", 7)  # records go over several chunks
    (tmp_path / "r.upix").write_bytes(content)
    for split in (4, 20, 100, 1000, 10**6):
        with open(tmp_path / "r.upix", "rb") as f:
            got = []
            for start in range(upix.HEADER, len(content), split):
                for ids, xy in upix.pixels_of(f, order, start, min(start + split, len(content)), len(content)):
                    got += zip(ids.tolist(), *xy.T.tolist(), strict=True)
        assert sorted(got) == want


def test_one_and_seven_partitions(spark, tmp_path):
    content, want = raster(">", 2)
    (tmp_path / "r.upix").write_bytes(content)
    path = str(tmp_path / "r.upix")
    for n in (1, 7):
        df = upix.read(spark, path, split=-(-len(content) // n // 4) * 4)
        assert df.rdd.getNumPartitions() == n and sorted(map(tuple, df.collect())) == want
    assert upix.size(path) == (640, 480)
    (tmp_path / "bad").write_bytes(b"\2\0\0\0" * 4)
    with pytest.raises(ValueError):
        upix.size(str(tmp_path / "bad"))


def test_many_ranges_in_few_tasks(spark, tmp_path):
    """A task takes many small ranges, also of several files."""
    content, want = raster("<", 3, 400)
    for k in range(3):
        (tmp_path / f"{k}.upix").write_bytes(content)
    df = upix.read(spark, str(tmp_path), split=20)
    assert 3 * len(content) // 20 > 5 * upix.TASKS >= 5 * df.rdd.getNumPartitions()
    assert sorted(map(tuple, df.collect())) == sorted(want * 3)


def test_write_and_read(spark, tmp_path):
    rows = [(k, [{"x": k, "y": j} for j in range(k % 4)]) for k in range(50)]
    lists = spark.createDataFrame(rows, "ubid long, pixels array<struct<x: int, y: int>>").repartition(3)
    upix.write(lists, str(tmp_path / "out"), 50, 4)
    assert sorted(map(tuple, upix.read(spark, str(tmp_path / "out"), 64).collect())) == [(k, k, j) for k in range(50) for j in range(k % 4)]
    upix.write(lists.limit(0), str(tmp_path / "none"), 1, 1)
    assert upix.read(spark, str(tmp_path / "none")).collect() == []
