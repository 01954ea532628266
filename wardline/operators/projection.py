"""Fit, then apply: projection of block points to whole numbers around their centre.

The fit is one pass for the centre and one for the extents, and gives one row.  It is a table, so that new blocks or a stream can be
brought into the same plane later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.geo import azimuthal

#: Metres of the sphere's radius, and bounds of the shorter and of the longer side (fixed values).
RADIUS = 6_378_137.0
SHORTEST, LONGEST = 50_000.0, 1_000_000_000.0


def power_of_two(short: Column, long: Column, low: float = SHORTEST, high: float = LONGEST) -> Column:
    """What doubling until ``short`` reaches ``low``, then halving while ``long`` is above ``high``, comes to."""
    ups = F.greatest(F.lit(0.0), F.ceil(F.log2(F.lit(low) / short)).cast("double"))
    # the logarithm can be off by one where the ratio is a power of two
    ups = F.when((ups > 0) & (short * F.pow(F.lit(2.0), ups - 1) >= low), ups - 1).when(short * F.pow(F.lit(2.0), ups) < low, ups + 1).otherwise(ups)
    up = F.pow(F.lit(2.0), ups)
    downs = F.greatest(F.lit(0.0), F.ceil(F.log2(long * up / F.lit(high))).cast("double"))
    downs = F.when((downs > 0) & (long * up * F.pow(F.lit(0.5), downs - 1) <= high), downs - 1).when(long * up * F.pow(F.lit(0.5), downs) > high, downs + 1).otherwise(downs)
    return F.when((short > 0) & (long > 0), up * F.pow(F.lit(0.5), downs)).otherwise(1.0)


def _plane(points: DataFrame, fit: DataFrame) -> DataFrame:
    x, y = azimuthal(F.radians(F.col("lat") / 1e6), F.radians(F.col("lon") / 1e6), F.col("lat0"), F.col("lon0"))
    return points.crossJoin(F.broadcast(fit)).withColumns({"px": x * RADIUS, "py": y * RADIUS})  # one row


def fit(blocks: DataFrame) -> DataFrame:
    """One row (lat0, lon0, scale): the area-weighted centre on the sphere in radians, and the power of two that makes the shorter side of the
    extents at least 50,000 and the longer at most 1,000,000,000.  blocks: lon, lat in microdegrees, area."""
    lat, lon = F.radians(F.col("lat") / 1e6), F.radians(F.col("lon") / 1e6)
    x, y, z = (F.sum(F.col("area") * v) for v in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)))
    centre = blocks.agg(x.alias("x"), y.alias("y"), z.alias("z")).where("x IS NOT NULL")
    centre = centre.select(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("lat0"), F.atan2("y", "x").alias("lon0"))
    sides = _plane(blocks, centre).agg((F.max("px") - F.min("px")).alias("w"), (F.max("py") - F.min("py")).alias("h"))
    return centre.crossJoin(sides).select("lat0", "lon0", power_of_two(F.least("w", "h"), F.greatest("w", "h")).alias("scale"))


def apply(points: DataFrame, fitted: DataFrame) -> DataFrame:
    """``points`` (a table or a stream) with px, py: whole numbers, x to the east and y to the north."""
    out = _plane(points, fitted)
    return out.withColumns({c: (F.col(c) * F.col("scale")).cast("long") for c in ("px", "py")}).drop("lat0", "lon0", "scale")
