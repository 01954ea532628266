"""Distances, projections, grey levels and raster arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.schema import KM_PER_MICRODEGREE

MILES = 3956.0  # earth radius of the great-circle distance


def degrees_to_micro(text: Column) -> Column:
    """Degrees as text or number -> microdegrees, truncated toward zero."""
    return (text.cast("double") * 1_000_000).cast("int")


def great_circle_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance of points in degrees."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MILES * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def planar_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return planar(x1, y1, x2, y2) * KM_PER_MICRODEGREE


def box_pixels(minx: Column, miny: Column, maxx: Column, maxy: Column, width: int) -> Column:
    """Height in pixels of a degree box drawn ``width`` wide, longitudes shrunk by the mean latitude."""
    aspect = F.try_divide(maxy - miny, (maxx - minx) * F.cos(F.radians((maxy + miny) / 2)))
    return F.floor(aspect * width + 0.5).cast("int")


def log_density(pop: Column, area: Column) -> Column:
    return F.when(area == 0, 0.0).otherwise(F.log1p(F.try_divide(pop.cast("double"), area)))


def grey_level(value: Column, top: Column, levels: int = 255) -> Column:
    return F.least(F.lit(levels), F.coalesce((F.try_divide(value, top) * levels).cast("int"), F.lit(0)))


def blend(under: Column, over: Column, alpha: float) -> Column:
    return (under * (1 - alpha) + over * alpha).cast("int")


def row_below(y: Column, maxy: float, height: float) -> Column:
    """Row of the first pixel centre at or below y; rows count down from maxy."""
    return F.ceil((F.lit(maxy) - y) / height - 0.5).cast("int")


def row_above(y: Column, maxy: float, height: float) -> Column:
    return F.floor((F.lit(maxy) - y) / height - 0.5).cast("int")


def column_right(x: Column, minx: float, width: float) -> Column:
    return F.ceil((x - minx) / width - 0.5).cast("int")


def column_left(x: Column, minx: float, width: float) -> Column:
    return F.floor((x - minx) / width - 0.5).cast("int")


def row_centre(row: Column, maxy: float, height: float) -> Column:
    return F.lit(maxy) - (row + 0.5) * height


def pixel_row(y: Column, maxy: float, height: float) -> Column:
    """The row whose pixel holds y."""
    return F.floor((F.lit(maxy) - y) / height).cast("int")


def crossing(x1: Column, y1: Column, x2: Column, y2: Column, y: Column) -> Column:
    """x at which a segment crosses the scan line y; null where it doesn't.  The lower end counts."""
    meets = (F.least(y1, y2) <= y) & (y < F.greatest(y1, y2))
    return F.when(meets, x1 + F.try_divide((y - y1) * (x2 - x1), y2 - y1))


def line_pixels(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Pixels of a line as an array of (x, y), one for each step along its longer side."""
    n = F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))
    at = lambda a, b, i: F.floor(a + F.coalesce(F.try_divide((b - a) * i, n), F.lit(0.0)) + 0.5).cast("int")
    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.struct(at(x1, x2, i).alias("x"), at(y1, y2, i).alias("y")))


def jitter(u: Column, period: float, t: Column) -> Column:
    return u * 0.5 * (F.cos(t * (2 * math.pi / period)) + 1)


def annealed(factor: float, t: Column) -> Column:
    return factor * (F.cos(t / 1000.0) + 1)


def azimuthal(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Azimuthal equidistant projection on the unit sphere; all angles in radians."""
    dl = lon - lon0
    cos_c = F.sin(lat0) * F.sin(lat) + F.cos(lat0) * F.cos(lat) * F.cos(dl)
    c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_c)))
    k = F.coalesce(F.try_divide(c, F.sin(c)), F.lit(1.0))
    return k * F.cos(lat) * F.sin(dl), k * (F.cos(lat0) * F.sin(lat) - F.sin(lat0) * F.cos(lat) * F.cos(dl))


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through ``points`` (ascending x), flat beyond both ends."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= points[0][0], float(points[0][1])).otherwise(out)
