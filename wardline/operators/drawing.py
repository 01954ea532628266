"""Pictures drawn on the executors: scripts of drawing commands, tiles, and pixels that collide.

A script changes a state (solution, colors, size, bounds) and now and then asks for a picture.  The fold over its commands is
one expression; it gives a row for each picture, and all pictures of all scripts are then drawn in one plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators import graph, raster

#: Commands with and without an argument (fixed values).
WITH_ARGUMENT = ["--loadSolution", "--pngout", "--colorsIn", "--colorsOut", "--pngW", "--pngH", "--minlon", "--minlond", "--maxlon", "--maxlond", "--minlat", "--minlatd", "--maxlat", "--maxlatd", "-px", "--mppb"]
ALONE = ["renumber", "recolor", "clearpx", "done"]
#: Color of pixels without a block (fixed value).
BACKGROUND = (0xD0, 0xD0, 0xD0)

_STATE = {
    "pending": "string", "done": "boolean", "bad": "string", "solution": "string", "renumbered": "boolean", "colors": "string", "pixels": "string", "width": "int", "height": "int",
    "minlon": "double", "maxlon": "double", "minlat": "double", "maxlat": "double",
}
_SHOWN = [k for k in _STATE if k not in ("pending", "done", "bad")]


def _fold(state: Column, token: Column, out_type: str) -> Column:
    """The state after one more token."""
    pending = state["pending"]
    live, free = ~state["done"] & state["bad"].isNull(), pending.isNull()
    number = token.try_cast("double")
    on = lambda name: live & (pending == name)
    alone = lambda name: live & free & (token == name)

    def bound(name: str, other: str) -> Column:
        """A bound, as given or as a distance from the other one."""
        return F.when(on(f"--{name}"), number).when(on(f"--{name}d"), number + state[other]).otherwise(state[name])

    recolored = F.concat(F.lit("recolor:"), F.coalesce(state["solution"], F.lit("")), F.when(state["renumbered"], F.lit(":renumbered")).otherwise(F.lit("")))
    renumbered = F.concat(F.lit("recolor:"), F.coalesce(state["solution"], F.lit("")), F.lit(":renumbered"))
    unread = live & ~free & pending.isin("--pngW", "--pngH", *(f"--{b}{d}" for b in ("minlon", "maxlon", "minlat", "maxlat") for d in ("", "d"))) & number.isNull()
    new = {
        "pending": F.when(live & free & token.isin(WITH_ARGUMENT), token),
        "done": state["done"] | F.coalesce(alone("done"), F.lit(False)),
        "bad": F.when(live & ((free & ~token.isin(WITH_ARGUMENT + ALONE)) | unread), token).otherwise(state["bad"]),
        "solution": F.when(on("--loadSolution"), token).otherwise(state["solution"]),
        "renumbered": F.when(on("--loadSolution"), False).when(alone("renumber"), True).otherwise(state["renumbered"]),
        "colors": F.when(on("--colorsIn"), F.concat(F.lit("file:"), token)).when(alone("renumber"), renumbered).when(alone("recolor"), recolored).otherwise(state["colors"]),
        "pixels": F.when(on("-px") | on("--mppb"), token).when(~alone("clearpx") | F.isnull(alone("clearpx")), state["pixels"]),
        "width": F.when(on("--pngW"), number.cast("int")).otherwise(state["width"]), "height": F.when(on("--pngH"), number.cast("int")).otherwise(state["height"]),
        "minlon": bound("minlon", "maxlon"), "maxlon": bound("maxlon", "minlon"), "minlat": bound("minlat", "maxlat"), "maxlat": bound("maxlat", "minlat"),
    }
    asked = F.when(on("--pngout"), F.lit("png")).when(on("--colorsOut"), F.lit("colors"))
    shown = F.struct(asked.alias("kind"), token.alias("path"), *(state[k].alias(k) for k in _SHOWN))
    outs = F.when(asked.isNotNull(), F.concat(state["outs"], F.array(shown)).cast(out_type)).otherwise(state["outs"])
    return F.struct(*(new[k].cast(t).alias(k) for k, t in _STATE.items()), outs.alias("outs"))


def pictures(scripts: DataFrame, width: int = 1000, height: int = 1000) -> DataFrame:
    """(script, place, kind, path, solution, ...): what each of ``scripts`` (script, text) asks for, in order, with the state it asks in.
    Everything after ``done`` is ignored.  ``bad`` is set on a script whose commands cannot be read, which asks for nothing more."""
    out_type = f"array<struct<kind:string,path:string,{','.join(f'{k}:{_STATE[k]}' for k in _SHOWN)}>>"
    start = {"pending": None, "done": False, "bad": None, "solution": None, "renumbered": False, "colors": None, "pixels": None, "width": width, "height": height, "minlon": 0.0, "maxlon": 0.0, "minlat": 0.0, "maxlat": 0.0}
    first = F.struct(*(F.lit(start[k]).cast(t).alias(k) for k, t in _STATE.items()), F.array().cast(out_type).alias("outs"))
    bare = F.regexp_replace("text", r"(?m)(^|(?<=\s))(#|//).*$", " ")
    tokens = F.filter(F.split(bare, r"\s+"), lambda t: t != "")
    end = scripts.select("script", F.aggregate(tokens, first, lambda s, t: _fold(s, t, out_type)).alias("s"))
    bad = F.coalesce(F.col("s.bad"), F.when(~F.col("s.done"), F.col("s.pending"))).alias("bad")
    return end.select("script", bad, F.posexplode_outer("s.outs").alias("place", "o")).select("script", "place", "bad", "o.*")


def renumbered(assignments: DataFrame, blocks: DataFrame) -> DataFrame:
    """``assignments`` (solution, ubid, district) with each solution's districts numbered by their topmost, then leftmost block."""
    corner = F.max(F.struct("lat", (-F.col("lon")).alias("west"))).alias("c")
    tops = assignments.join(blocks.select("ubid", "lon", "lat"), "ubid").where("district IS NOT NULL").groupBy("solution", "district").agg(corner)
    order = Window.partitionBy("solution").orderBy(F.col("c.lat").desc(), F.col("c.west").desc(), "district")  # a row a district
    return assignments.join(tops.select("solution", "district", (F.row_number().over(order) - 1).alias("number")), ["solution", "district"], "left").select("solution", "ubid", F.col("number").alias("district"))


def draw(asked: DataFrame, polygons: DataFrame, blocks: DataFrame, edges: DataFrame, assignments: DataFrame, palette: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """(script, place, path, x, y, r, g, b): the pixels of all pictures in ``asked`` (``pictures``).

    assignments: (solution, ubid, district).  palette: (color, r, g, b) by number, for maps that are colored so that neighbours differ.
    colors: (colors, district, r, g, b) of color files.  The highest block id is painted last; blocks without a color are grey.
    """
    asked = asked.where("kind = 'png' AND bad IS NULL").select("script", "place", "path", "solution", "renumbered", "colors", "width", "height", "minlon", "maxlon", "minlat", "maxlat")
    plain, again = assignments.withColumn("renumbered", F.lit(False)), renumbered(assignments, blocks).withColumn("renumbered", F.lit(True))
    both = plain.select("solution", "ubid", "district", "renumbered").unionByName(again)
    used = both.join(asked.select("solution", "renumbered").distinct(), ["solution", "renumbered"], "left_semi")
    # colors so that neighbours differ, of the solutions that a script recolors
    source = F.concat(F.lit("recolor:"), "solution", F.when(F.col("renumbered"), F.lit(":renumbered")).otherwise(F.lit("")))
    wanted = both.withColumn("colors", source).join(asked.select("colors").distinct(), "colors", "left_semi").where("district IS NOT NULL")
    ends = edges.join(wanted.select(F.col("ubid").alias("a"), "colors", F.col("district").alias("d1")), "a").join(wanted.select(F.col("ubid").alias("b"), "colors", F.col("district").alias("d2")), ["b", "colors"])
    pairs = ends.where("d1 <> d2").select("colors", "d1", "d2").unionByName(wanted.select("colors", F.col("district").alias("d1"), F.col("district").alias("d2")))
    rgb = graph.colors(pairs, "colors").join(palette, "color").select("colors", "district", "r", "g", "b")
    if colors is not None:
        rgb = rgb.unionByName(colors.select("colors", "district", "r", "g", "b"))

    # a picture's settings ride along in the key of the shapes
    view = F.struct("ubid", "script", "place", F.col("minlon").alias("x0"), F.col("maxlat").alias("y0"), F.try_divide(F.col("maxlon") - F.col("minlon"), F.col("width")).alias("w"), F.try_divide(F.col("maxlat") - F.col("minlat"), F.col("height")).alias("h"))
    sizes = asked.where("maxlon > minlon AND maxlat > minlat AND width > 0 AND height > 0")
    shapes = polygons.crossJoin(F.broadcast(sizes)).select(view.alias("ubid"), "rings")  # a row a picture
    u = lambda c: F.col(f"ubid.{c}")
    pixels = raster.fill(shapes, u("x0"), u("y0"), u("w"), u("h")).select(u("ubid").alias("ubid"), u("script").alias("script"), u("place").alias("place"), "x", "y")
    pixels = pixels.join(F.broadcast(sizes), ["script", "place"]).where(F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1))
    shown = pixels.join(used, ["solution", "renumbered", "ubid"], "left").join(rgb, ["colors", "district"], "left").fillna(128, ["r", "g", "b"])
    return shown.groupBy("script", "place", "path", "x", "y").agg(F.max_by(F.struct("r", "g", "b"), "ubid").alias("c")).select("script", "place", "path", "x", "y", "c.*")


def tiles(pixels: DataFrame, by: list[str], size: int = 256, background: tuple[int, int, int] | None = None) -> DataFrame:
    """(*by, tx, ty, content): PNG tiles of ``size`` pixels a side, made on the executors; no task holds more than a tile.
    pixels: (*by, x, y, r, g, b), one a place.  Without ``background``, places without a pixel are transparent."""

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((size, size, 4), np.uint8)
        if background:
            image[:] = (*background, 255)
        image[part["y"] % size, part["x"] % size] = np.column_stack([part[["r", "g", "b"]].to_numpy(np.uint8), np.full(len(part), 255, np.uint8)])
        return part[[*by, "tx", "ty"]].head(1).assign(content=raster.encode_png(image))

    cut = pixels.select(*by, F.floor(F.col("x") / size).cast("int").alias("tx"), F.floor(F.col("y") / size).cast("int").alias("ty"), "x", "y", "r", "g", "b")
    kinds = dict(cut.dtypes)
    return cut.groupBy(*by, "tx", "ty").applyInPandas(encode, ", ".join([*(f"{c} {kinds[c]}" for c in [*by, "tx", "ty"]), "content binary"]))


def collisions(pixels: DataFrame) -> DataFrame:
    """(ubid, pixels, collisions): how many pixels each block has, and how many a block with a lesser id has painted before.
    pixels: (ubid, x, y)."""
    first = F.min("ubid").over(Window.partitionBy("x", "y"))
    return pixels.withColumn("first", first).groupBy("ubid").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("first") < F.col("ubid")).alias("collisions"))
