import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline import schema
from wardline.functions import geo, text


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first().v


def fields(spark, columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_summary_line(spark):
    line = F.lit("#Best Km/p: Km/p=36.125437 spread=1742.000000 std=318.250125 gen=40200")
    assert fields(spark, text.summary_line(line)) == {"kmpp": 36.125437, "spread": 1742.0, "std": 318.250125}


def test_analyzer_texts(spark):
    old = F.lit("generation 0: 35.250118125 Km/person\npopulation avg=512040 std=0.25012573\nmax=512040 (dist# 1)  min=512039 (dist# 5)")
    new = F.lit("generation 0: 16.125331625 Km/person to pop center; 19.500412375 Km/person to land center\npopulation avg=650210 std=290.125875\nmax=650900 (dist# 4)  min=649500 (dist# 2)")
    a, b = fields(spark, text.analyzer_text(old)), fields(spark, text.analyzer_text(new))
    assert (a["kmpp"], a["spread"], a["std"]) == (35.250118125, 1.0, 0.25012573)
    assert (b["kmpp"], b["land_kmpp"], b["spread"]) == (16.125331625, 19.500412375, 1400.0)


def test_log_lines(spark, value):
    assert fields(spark, text.log_line(F.lit("gen 7: 12 in no district (pop=345) 1.5 Km/person")))["nod_pop"] == 345.0
    assert fields(spark, text.log_line(F.lit("generation 100: 2.5 Km/person")))["generation"] == 100
    assert fields(spark, text.log_line(F.lit("nothing")))["kmpp"] is None
    assert fields(spark, text.variability_line(F.lit("kmpp var per 5000=0.25 spread var per 5000=0.5"))) == {"kmpp_var": 0.25, "spread_var": 0.5}
    assert value(text.run_seconds(F.lit("#District calculation: 15320.125437 sec user time, 17.25 system sec"))) == 15320.125437


def test_small_text_functions(value):
    assert value(text.size_bytes(F.lit("5M"))) == 5_000_000
    assert value(text.clean_int(F.lit("1,234"))) == 1234 and value(text.clean_int(F.lit(""))) == 0
    assert value(text.indent_width(F.lit("\t  x"))) == 10
    assert value(text.clean_label(F.lit("a&nbsp; b<br>c"))) == "a b c"
    assert value(text.truthy(F.lit("Yes"))) is True and value(text.truthy(F.lit(None).cast("string"))) is False
    assert value(text.query_args(F.lit("a=1&b=2"))) == {"a": "1", "b": "2"}
    assert value(text.merge_args(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2")))) == {"a": "2"}
    assert value(text.human_size(F.lit(1500))) == "1.5k"


def test_ubid(value):
    u = schema.ubid(F.lit("48"), F.lit("001"), F.lit("999999"), F.lit("9999"))
    assert value(u) == 480019999999999
    parts = schema.ubid_parts(u)
    assert [value(parts[k]) for k in ("state", "county", "tract", "block")] == [48, 1, 999999, 9999]
    assert value(schema.block_id(F.lit(" 123 "))) == 123 and value(schema.block_id(F.lit("x1"))) == -1


def test_interpolation(value):
    points = [(0.0, 0.0), (1.0, 1.0), (11.0, 2.0)]
    assert [value(geo.interpolate(F.lit(float(x)), points)) for x in (-1, 0.5, 6, 12)] == [0.0, 0.5, 1.5, 2.0]


def test_pixel_centres(value):
    d = lambda x: F.lit(float(x))
    assert [value(geo.row_below(d(y), 10.0, 1.0)) for y in (9.4, 9.6)] == [1, 0]
    assert [value(geo.row_centre(F.lit(r), 10.0, 1.0)) for r in (0, 1, 9)] == [9.5, 8.5, 0.5]
    assert [value(geo.pixel_row(d(y), 10.0, 1.0)) for y in (9.6, 9.01, 8.99)] == [0, 0, 1]
    assert [value(geo.column_right(d(x), 0.0, 1.0)) for x in (0.49, 0.55, 1.45)] == [0, 1, 1]
    assert [value(geo.column_left(d(x), 0.0, 1.0)) for x in (1.49, 1.55, 2.45)] == [0, 1, 1]


def test_line_pixels(value):
    assert [tuple(p) for p in value(geo.line_pixels(F.lit(0), F.lit(0), F.lit(3), F.lit(1)))] == [(0, 0), (1, 0), (2, 1), (3, 1)]


@settings(max_examples=10, deadline=None)
@given(st.floats(-80, 80), st.floats(-170, 170), st.floats(-80, 80), st.floats(-170, 170))
def test_great_circle_is_symmetric(spark, a, b, c, d):
    ll = lambda *x: geo.great_circle_miles(*(F.lit(v) for v in x))
    there, back = spark.range(1).select(ll(a, b, c, d), ll(c, d, a, b)).first()
    assert there == pytest.approx(back, abs=1e-6) and 0 <= there <= 3956 * 3.1416
