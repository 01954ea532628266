"""Lines and bars by pixel against plain Python."""

import random
from collections import defaultdict

from wardline.operators import plots

SCHEMA = "name string, x double, y double"


def plain(rows, width, height):
    rows = [r for r in rows if None not in r[1:] and all(abs(v) < float("inf") for v in r[1:])]
    x0, x1, y0, y1 = (f(r[k] for r in rows) for k in (1, 2) for f in (min, max))
    at = lambda v, a, b, size: int((v - a) / (b - a) * (size - 1)) if b > a else 0
    cells = defaultdict(list)
    for name, x, y in sorted(rows, key=lambda r: r[1:]):
        cells[name, at(x, x0, x1, width)].append(at(y, y0, y1, height))
    return {(*k, v[0], min(v), max(v), v[-1]) for k, v in cells.items()}


def test_lines_and_bars_equal_plain_python(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.uniform(-50, 50), rng.gauss(0, 9)) for _ in range(3000)]
    rows += [("a", None, 1.0), ("b", 1.0, None), ("a", float("nan"), 2.0), ("b", 3.0, float("inf")), (None, 0.5, 0.5), (None, 0.5, 0.25)] + rows[:50]
    points = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows, 40, 30)
    got = [tuple(r) for r in plots.lines(points, 40, 30).collect()]
    assert len(got) == len(want) and set(got) == want
    tops = {c: max(w[4] for w in want if w[1] == c) for c in {w[1] for w in want}}
    assert dict(map(tuple, plots.bars(points, 40, 30).collect())) == tops


def test_plots_of_few_points(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert plots.lines(empty).count() == plots.bars(empty).count() == 0 and "polyline" not in plots.lines_svg(empty) and "<line" not in plots.bars_svg(empty, target=1.0)
    one = spark.createDataFrame([("<a>", 1.0, 2.0), ("b", 1.0, 2.0)], SCHEMA)
    assert {tuple(r) for r in plots.lines(one).collect()} == {("<a>", 0, 0, 0, 0, 0), ("b", 0, 0, 0, 0, 0)}
    svg = plots.lines_svg(one)
    assert svg.count("<polyline") == 2 and "&lt;a&gt;" in svg and "#900" in svg and "#00b" in svg
    two = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 4.0)], SCHEMA)
    assert 'y1="49.5"' in plots.bars_svg(two, 10, 100, target=2.0) and plots.bars_svg(two, 10, 100).count("<line") == 2
