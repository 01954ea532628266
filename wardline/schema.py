"""Schemas of the districting tables, and block ids (ubid: state, county, tract, block digits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_PLACE = 99999
MICRO = 1_000_000
#: Equatorial circumference in km, over the microdegrees of a full circle.
KM_PER_MICRODEGREE = 40075.013481 / 360_000_000.0


def _struct(text: str) -> T.StructType:
    out = T.StructType()
    for part in text.split(","):
        name, kind = part.split()
        out.add(name, {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "short": T.ShortType(), "binary": T.BinaryType(), "ts": T.TimestampType()}[kind])
    return out


BLOCKS = _struct("ubid long, recno int, lon int, lat int, pop int, area long, place int, district short")
EDGES = _struct("a long, b long")
ASSIGNMENT = _struct("idx int, district short")
PLACE_NAMES = _struct("state string, fips string, place int, name string, kind string, kind_code string, counties string")
STATLOG = _struct("generation int, kmpp double, average double, std double, max_pop int, min_pop int, median_pop int, nod_blocks int, nod_pop int, kmpp_variability double, spread_variability double")
BEST_RUN = T.StructType([T.StructField("n", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("t", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("d", T.StringType()), T.StructField("b", _struct("Kmpp double, Spread double, Std double")), T.StructField("ok", T.BooleanType())])
RESULT = T.StructType([*[f for f in BEST_RUN.fields if f.name != "d"], T.StructField("bestKmpp.dsz", T.StringType()), T.StructField("statsum", T.StringType()), T.StructField("binlog", T.StringType())])
RUN_CONFIG = T.StructType([
    T.StructField("st", T.StringType()), T.StructField("name", T.StringType()),
    *[T.StructField(k, T.StructType([T.StructField("args", T.ArrayType(T.StringType())), T.StructField("kwargs", T.MapType(T.StringType(), T.StringType()))])) for k in ("solver", "drend", "common")],
    T.StructField("weight", T.DoubleType()), T.StructField("disabled", T.BooleanType()), T.StructField("sendAnything", T.BooleanType()),
    T.StructField("maxkmpp", T.DoubleType()), T.StructField("maxspread", T.DoubleType()),
])


def ubid(state: Column, county: Column, tract: Column, block: Column) -> Column:
    """Numeric block id from its parts (digits or numbers)."""
    s, c, t, b = (x.cast("long") for x in (state, county, tract, block))
    return s * 10_000_000_000_000 + c * 10_000_000_000 + t * 10_000 + b


def ubid_parts(u: Column) -> dict[str, Column]:
    exact = lambda down, size: ((u - u % down) / down).cast("long") % size
    return {"state": exact(10_000_000_000_000, 100), "county": exact(10_000_000_000, 1000), "tract": exact(10_000, 1_000_000), "block": u % 10_000}


def ubid_text(u: Column, digits: int = 15) -> Column:
    return F.lpad(u.cast("string"), digits, "0")


def block_id(raw: Column) -> Column:
    """Leading digits of a block-id field, -1 where there are none or more than 19."""
    return F.coalesce(F.regexp_extract(F.trim(raw), r"^(\d{1,19})$", 1).try_cast("long"), F.lit(-1).cast("long"))
