"""Polygons to pixels, pixels to images, and district outlines."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.geo import blend, column_left, column_right, crossing, grey_level, log_density, row_above, row_below


def segments(polygons: DataFrame) -> DataFrame:
    """(ubid, x1, y1, x2, y2) of all rings.  polygons: ubid, rings array<array<struct<x, y>>>."""
    ring = polygons.select("ubid", F.explode("rings").alias("ring"))
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("p"), F.slice("ring", 2, F.size("ring") - 1).alias("q"))
    return ring.where(F.size("ring") > 1).select("ubid", F.explode(pairs).alias("s")).select("ubid", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def fill(polygons: DataFrame, minx: float, maxy: float, pixel_w: float, pixel_h: float) -> DataFrame:
    """(ubid, x, y) of pixels whose centre lies inside, by sorted crossings of each pixel row (even-odd)."""
    s = segments(polygons)
    top, low = F.greatest("y1", "y2"), F.least("y1", "y2")
    rows = F.sequence(row_below(top, maxy, pixel_h), row_above(low, maxy, pixel_h))
    some = row_below(top, maxy, pixel_h) <= row_above(low, maxy, pixel_h)
    hits = s.where(some).withColumn("y", F.explode(rows))
    at = F.lit(maxy) - (F.col("y") + 0.5) * pixel_h
    hits = hits.select("ubid", "y", crossing(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), at).alias("cut")).where("cut IS NOT NULL")
    w = Window.partitionBy("ubid", "y").orderBy("cut")
    spans = hits.withColumns({"k": F.row_number().over(w), "until": F.lead("cut").over(w)}).where("k % 2 = 1 AND until IS NOT NULL")
    left, right = column_right(F.col("cut"), minx, pixel_w), column_left(F.col("until"), minx, pixel_w)
    return spans.where(left <= right).select("ubid", F.explode(F.sequence(left, right)).alias("x"), "y").distinct()


def pixel_lists(pixels: DataFrame) -> DataFrame:
    """Pixels of each block as one array; a block's faces come together, a pixel counts once."""
    return pixels.groupBy("ubid").agg(F.sort_array(F.collect_set(F.struct("x", "y"))).alias("pixels"))


def clip(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def paint(pixels: DataFrame, blocks: DataFrame, colors: DataFrame, density: bool = False, marked: DataFrame | None = None) -> DataFrame:
    """(x, y, r, g, b): district colors, shaded by density and blended with white where marked."""
    shown = pixels.join(blocks.select("ubid", "district", "pop", "area"), "ubid").join(colors, "district", "left").fillna(128, ["r", "g", "b"])
    if density:
        shade = log_density(F.col("pop"), F.col("area"))
        top = blocks.agg(F.max(shade).alias("top"))
        shown = shown.join(top).withColumn("shade", 1 - 0.5 * grey_level(shade, F.col("top")) / 255.0)
        shown = shown.withColumns({c: (F.col(c) * F.col("shade")).cast("int") for c in "rgb"})
    if marked is not None:
        shown = shown.join(marked.select("ubid", F.lit(True).alias("m")), "ubid", "left")
        shown = shown.withColumns({c: F.when(F.col("m"), blend(F.col(c), F.lit(255), 0.5)).otherwise(F.col(c)) for c in "rgb"})
    # the highest block id is painted last
    return shown.groupBy("x", "y").agg(F.max_by(F.struct("r", "g", "b"), "ubid").alias("c")).select("x", "y", "c.*")


def point_plot(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y, district) with points scaled into the picture, 0.999 of its size."""
    e = blocks.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    at = lambda v, a, b, n: F.coalesce(F.floor(F.try_divide((F.col(v) - F.col(a)).cast("double"), F.col(b) - F.col(a)) * n * 0.999), F.lit(0)).cast("int")
    spots = blocks.join(e).select("ubid", "district", at("lon", "x0", "x1", width).alias("x"), (F.lit(height - 1) - at("lat", "y0", "y1", height)).cast("int").alias("y"))
    return spots.groupBy("x", "y").agg(F.max_by("district", "ubid").alias("district"))


def encode_png(image: np.ndarray) -> bytes:
    """RGBA bytes (height, width, 4) as a PNG file."""
    height, width = image.shape[:2]
    raw = np.hstack([np.zeros((height, 1), np.uint8), image.reshape(height, -1)]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(content: bytes) -> np.ndarray:
    """RGBA bytes of a PNG file as ``encode_png`` writes it (8 bits a channel, no filters)."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, data, width, height = 8, b"", 0, 0
    while at < len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, color, interlaced) != (8, 6, 0):
                raise ValueError("only pictures of 8-bit RGBA")
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width * 4 + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].reshape(height, width, 4)


def png(pixels: DataFrame, width: int, height: int) -> bytes:
    """RGBA picture of (x, y, r, g, b) rows, one a pixel; the picture is made on the driver, so its size is bounded."""
    if width * height > 100_000_000:
        raise ValueError("a picture of more than 100 million pixels: cut it into tiles")
    image = np.zeros((height, width, 4), np.uint8)
    got = clip(pixels, width, height).toPandas()
    image[got["y"], got["x"], :3] = got[["r", "g", "b"]].to_numpy()
    image[got["y"], got["x"], 3] = 255
    return encode_png(image)


def outlines(polygons: DataFrame, assignment: DataFrame) -> DataFrame:
    """(district, x1, y1, x2, y2): segments that only one block of the district has."""
    s = segments(polygons).join(assignment.select("ubid", "district"), "ubid")
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    s = s.where(p != q).select("district", F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    once = s.groupBy("district", "p", "q").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.select("district", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def wkt_outlines(polygons: DataFrame, assignment: DataFrame) -> DataFrame:
    """(district, wkt): each outline as a set of lines, in order."""
    num = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    line = F.concat(F.lit("("), num("x1"), F.lit(" "), num("y1"), F.lit(", "), num("x2"), F.lit(" "), num("y2"), F.lit(")"))
    lines = outlines(polygons, assignment).select("district", line.alias("line"))
    return lines.groupBy("district").agg(F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.sort_array(F.collect_list("line")), ", "), F.lit(")")).alias("wkt"))
