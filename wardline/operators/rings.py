"""Closed rings of district outlines: shells, their holes, and WKT polygons.

Each border segment runs with its district on the left.  A segment's successor starts where it ends; where several
do, it is the one that turns most to the left, so parts that only touch in a point stay apart.  The rings are the cycles of
that list: pointer doubling finds for each segment the least segment of its cycle and how far away it is, in as many
rounds as the longest ring has binary digits.  A ring that comes through one point more than once is cut
there.  A ring with positive area is a shell; a hole lies in the shell that is met first below it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.graph import keyed
from wardline.shared import release
from wardline.shared import save as saved
from wardline.sources.binary import encode_shapes


def signed_area(points: Column) -> Column:
    """Of a closed ring, an array of struct<x, y>: positive if it runs against the clock."""
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda p, q: p.x * q.y - q.x * p.y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v.cast("double")) / 2


def directed_segments(polygons: DataFrame) -> DataFrame:
    """(ubid, p, q) of polygons (ubid, rings array<array<struct<x, y>>>), the inside on the left.  The first ring is a shell, and so are those
    that run the same way round; the others are holes."""
    first = F.get("rings", F.lit(0))
    ring = polygons.where(F.size("rings") > 0).select("ubid", F.explode("rings").alias("ring"), (signed_area(first) < 0).alias("turn"))
    ring = ring.where(F.size("ring") > 1).select("ubid", F.when(F.col("turn"), F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("p"), F.slice("ring", 2, F.size("ring") - 1).alias("q"))
    point = lambda c: F.struct(F.col(f"s.{c}.x").cast("double").alias("x"), F.col(f"s.{c}.y").cast("double").alias("y")).alias(c)
    return ring.select("ubid", F.explode(pairs).alias("s")).select("ubid", point("p"), point("q")).where("p <> q")


def borders(polygons: DataFrame, assignment: DataFrame) -> DataFrame:
    """(district, p, q): the segments at a district's border; those that two of its blocks run through in opposite directions are gone."""
    s = directed_segments(polygons).join(keyed(assignment.where("district IS NOT NULL").select("ubid", "district")), "ubid")
    way = F.when(F.col("p") < F.col("q"), 1).otherwise(-1)
    net = s.groupBy("district", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).agg(F.sum(way).alias("net")).where("net <> 0")
    return net.select("district", F.when(F.col("net") > 0, F.col("low")).otherwise(F.col("high")).alias("p"), F.when(F.col("net") > 0, F.col("high")).otherwise(F.col("low")).alias("q"))


def successors(segments: DataFrame) -> DataFrame:
    """(id, next) of segments (id, district, p, q): the next is the one that turns most to the left."""
    ahead = segments.select("district", F.col("p").alias("q"), F.col("id").alias("next"), F.col("q").alias("r"))
    both = segments.select("id", "district", "p", "q").join(keyed(ahead), ["district", "q"])
    ax, ay, bx, by = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y"), F.col("r.x") - F.col("q.x"), F.col("r.y") - F.col("q.y")
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    return both.groupBy("id").agg(F.max_by("next", F.struct(turn, -F.col("next"))).alias("next"))


def cycles(links: DataFrame) -> DataFrame:
    """(id, ring, place) of a permutation (id, next): the least id of the cycle, and the place in it, from 0 at that id.

    A row knows the least id among itself and the ``step - 1`` after it, and how far that is; in a round the step doubles.
    When no row learns of a lesser one, all have the least of their cycle.
    """
    state = saved(links.select("id", F.col("next").alias("far"), F.col("id").alias("least"), F.lit(0).cast("long").alias("off")))
    step = 1
    while True:
        other = state.select(F.col("id").alias("far"), F.col("far").alias("far2"), F.col("least").alias("least2"), F.col("off").alias("off2"))
        less = F.col("least2") < F.col("least")
        new = saved(state.join(keyed(other), "far").select("id", F.col("far2").alias("far"), F.least("least", "least2").alias("least"), F.when(less, F.col("off2") + step).otherwise(F.col("off")).alias("off"), less.alias("learned")))
        release(state)
        state, step = new.drop("learned"), 2 * step
        state.saved_path = new.saved_path
        if new.where("learned").isEmpty():
            sizes = new.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
            return new.join(keyed(sizes), "least").select("id", F.col("least").alias("ring"), ((F.col("size") - F.col("off")) % F.col("size")).alias("place"))


def cut_where_twice(links: DataFrame, placed: DataFrame) -> DataFrame:
    """``links`` with rings cut in a point that they come through more than once: the way into each visit but the first goes on
    where the visit before it did.  placed: (id, ring, place, p)."""
    visits = Window.partitionBy("ring", "p").orderBy("place")
    whole = Window.partitionBy("ring", "p")
    seen = placed.withColumns({"n": F.count(F.lit(1)).over(whole), "k": F.row_number().over(visits), "id_before": F.lag("id").over(visits), "last": F.max_by("id", "place").over(whole)}).where("n > 1")
    # what led to this visit's segment now leads to the one before it; what led to the first, to the last
    swaps = seen.select(F.col("id").alias("next"), F.coalesce("id_before", "last").alias("instead"))
    return links.join(keyed(swaps), "next", "left").select("id", F.coalesce("instead", "next").alias("next"))


def rings(polygons: DataFrame, assignment: DataFrame) -> DataFrame:
    """(district, ring, place, x, y, area, shell): the corners of each district's rings in order; ``shell`` is the ring around it, a shell
    its own.  Points on a straight line between others are left out."""
    segments = saved(borders(polygons, assignment).withColumn("id", F.monotonically_increasing_id()))
    links = saved(successors(segments))
    placed = saved(cycles(links).join(keyed(segments), "id"))
    twice = placed.groupBy("ring", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        cut = saved(cut_where_twice(links, placed))
        release(placed)
        placed = saved(cycles(cut).join(keyed(segments), "id"))
    area = placed.groupBy("ring").agg((F.sum(F.col("p.x") * F.col("q.y") - F.col("q.x") * F.col("p.y")) / 2).alias("area"))
    placed = saved(placed.join(keyed(area), "ring"))
    inside = parents(placed)
    around = Window.partitionBy("ring").orderBy("place")
    ring = Window.partitionBy("ring")
    before = F.coalesce(F.lag("p").over(around), F.max_by("p", "place").over(ring))
    straight = (F.col("p.x") - F.col("b.x")) * (F.col("q.y") - F.col("p.y")) == (F.col("p.y") - F.col("b.y")) * (F.col("q.x") - F.col("p.x"))
    corners = placed.withColumn("b", before).where(~straight)
    corners = corners.withColumn("place", F.row_number().over(around) - 1)
    return corners.join(keyed(inside), "ring", "left").select("district", "ring", "place", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "area", F.coalesce("shell", "ring").alias("shell"))


def parents(placed: DataFrame) -> DataFrame:
    """(ring, shell) of holes.  Below a hole's lowest segment with the district beneath it, the border met first is its shell's or
    that of another hole of that shell.  placed: (ring, district, p, q, area)."""
    west = (F.col("q.x") < F.col("p.x")) & (F.col("area") < 0)
    mid = F.struct(((F.col("p.y") + F.col("q.y")) / 2).alias("y"), ((F.col("p.x") + F.col("q.x")) / 2).alias("x"))
    holes = saved(placed.where(west).groupBy("district", "ring").agg(F.min(mid).alias("m")).select("district", "ring", F.col("m.x").alias("x"), F.col("m.y").alias("y")))
    floors = placed.where(F.col("q.x") > F.col("p.x")).select("district", F.col("ring").alias("under"), (F.col("area") > 0).alias("is_shell"), "p", "q")
    # columns about as wide as a floor segment is long on average, so that few segments are seen by a hole
    width = floors.agg(F.avg(F.col("q.x") - F.col("p.x"))).first()[0] or 1.0
    column = lambda c: F.floor(c / width).cast("long")
    floors = floors.withColumn("column", F.explode(F.sequence(column(F.col("p.x")), column(F.col("q.x")))))
    at = F.col("p.y") + (F.col("q.y") - F.col("p.y")) * ((F.col("x") - F.col("p.x")) / (F.col("q.x") - F.col("p.x")))
    met = holes.withColumn("column", column(F.col("x"))).join(keyed(floors), ["district", "column"]).where((F.col("p.x") <= F.col("x")) & (F.col("x") < F.col("q.x")))
    met = met.withColumn("at", at).where(F.col("at") < F.col("y"))
    up = saved(met.groupBy("ring").agg(F.max_by(F.struct("under", "is_shell"), F.struct("at", "under")).alias("u")).select("ring", "u.under", "u.is_shell"))
    while not up.where("NOT is_shell").isEmpty():  # holes below holes
        over = up.select(F.col("ring").alias("under"), F.col("under").alias("u2"), F.col("is_shell").alias("s2"))
        new = saved(up.join(keyed(over), "under", "left").select("ring", F.coalesce("u2", "under").alias("under"), F.coalesce("s2", "is_shell").alias("is_shell")))
        release(up)
        up = new
    return up.select("ring", F.col("under").alias("shell"))


def wkt(corners: DataFrame) -> DataFrame:
    """(district, wkt): POLYGON or MULTIPOLYGON of each district's rings, a shell before its holes."""
    num = lambda c: F.format_string("%.6f", F.col(c))
    point = F.concat(num("x"), F.lit(" "), num("y"))
    ring = corners.groupBy("district", "shell", "ring").agg(F.sort_array(F.collect_list(F.struct("place", point.alias("at")))).alias("points"))
    text = F.concat(F.lit("("), F.array_join(F.transform(F.concat("points", F.slice("points", 1, 1)), lambda p: p["at"]), ", "), F.lit(")"))
    ring = ring.select("district", "shell", F.struct((F.col("ring") != F.col("shell")).alias("hole"), "ring", text.alias("text")).alias("r"))
    polygon = ring.groupBy("district", "shell").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    polygon = polygon.select("district", F.struct("shell", F.concat(F.lit("("), F.array_join(F.transform("rs", lambda r: r.text), ", "), F.lit(")")).alias("text")).alias("p"))
    all_ = polygon.groupBy("district").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    many = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform("ps", lambda p: p.text), ", "), F.lit(")"))
    return all_.select("district", F.when(F.size("ps") == 1, F.concat(F.lit("POLYGON "), F.get("ps", F.lit(0)).text)).otherwise(many).alias("wkt"))


def shape_files(corners: DataFrame) -> DataFrame:
    """(name, content): each district's rings as a polygon shapefile, one shape for each shell with its holes; shells run with the clock."""
    ring = corners.groupBy("district", "shell", "ring").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y")), asc=False).alias("points"))

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        shapes = []
        for _, own in part.sort_values(["shell", "ring"]).groupby("shell"):
            own = own.assign(hole=own["ring"] != own["shell"]).sort_values("hole", kind="stable")
            shapes.append([[(p["x"], p["y"]) for p in [*points, points[0]]] for points in own["points"]])
        return pd.DataFrame({"name": [f"district{part['district'].iloc[0]}.shp"], "content": [encode_shapes(shapes)]})

    return ring.groupBy("district").applyInPandas(encode, "name string, content binary")
