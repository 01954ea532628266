"""Adjacency graphs: edges (a, b), each undirected pair once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.shared import release
from wardline.shared import save as saved


def keyed(table: DataFrame) -> DataFrame:
    """``table``, whose rows grow with the map, for a join by key: never sent through the driver, however small it seems."""
    return table.hint("merge")


def undirected(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, smaller id first, without self-links."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def neighbours(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("neighbours"), F.count(F.lit(1)).alias("degree"))


def with_districts(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """edges with the districts of both ends: da, db.  ``assignment``: ubid, district."""
    d = assignment.select("ubid", "district")
    left = edges.join(keyed(d.withColumnsRenamed({"ubid": "a", "district": "da"})), "a")
    return left.join(keyed(d.withColumnsRenamed({"ubid": "b", "district": "db"})), "b").select("a", "b", "da", "db")


def district_adjacency(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Distinct unordered pairs of districts that touch; null is "no district"."""
    crossing = with_districts(edges, assignment).where("NOT (da <=> db)")
    low = F.when(F.col("da").isNull() | F.col("db").isNull(), None).otherwise(F.least("da", "db"))
    return crossing.select(low.alias("d1"), F.greatest("da", "db").alias("d2")).distinct()


def edge_blocks(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Blocks that have a neighbour in another district."""
    pairs = with_districts(both_ways(edges), assignment)
    return pairs.where("da IS NOT NULL AND NOT (da <=> db)").select(F.col("a").alias("ubid"), F.col("da").alias("district")).distinct()


#: Contracted edges that one task may finish.
FEW_EDGES = 100_000


def components(nodes: DataFrame, edges: DataFrame, known: bool = False) -> DataFrame:
    """(ubid, component): smallest ubid reachable.  ``known`` says that ids are distinct and that both ends of all edges are among them.

    In a round each component hooks to its least neighbour, pointers are jumped to the roots, and edges are contracted:
    those within a component go, and of several between two one stays.  So rounds shrink; once ``FEW_EDGES`` are left, one task ends it.
    """
    ids = nodes.select("ubid")
    if not known:
        ids = ids.distinct()
        edges = edges.join(keyed(ids.select(F.col("ubid").alias("a"))), "a", "left_semi").join(keyed(ids.select(F.col("ubid").alias("b"))), "b", "left_semi")
    wires, maps = saved(undirected(edges)), []
    while (left := wires.count()) > FEW_EDGES:
        near = both_ways(wires).groupBy("a").agg(F.min("b").alias("near"))
        moved = saved(near.select(F.col("a").alias("component"), F.least("a", "near").alias("to")))
        while True:
            up = moved.select(F.col("component").alias("to"), F.col("to").alias("next"))
            jumped = saved(moved.join(keyed(up), "to").select("component", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("changed")))
            release(moved)
            moved = jumped
            if jumped.where("changed").isEmpty():
                break
        maps.append(moved.select("component", "to"))
        end = lambda c: keyed(moved.select(F.col("component").alias(c), F.col("to").alias(f"{c}2")))  # noqa: B023, E731
        new = wires.join(end("a"), "a").join(end("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        new = saved(undirected(new))
        release(wires)
        wires = new
    if left:
        maps.append(wires.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_least_reachable, "component long, to long"))
    label = ids.withColumn("component", F.col("ubid"))
    for m in maps:
        label = label.join(keyed(m), "component", "left").select("ubid", F.coalesce("to", "component").alias("component"))
    label = saved(label)
    release(wires)
    return label


def _least_reachable(pairs: pd.DataFrame) -> pd.DataFrame:
    """(component, to) of few edges (a, b): the least id that each reaches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, b in pairs[["a", "b"]].itertuples(index=False):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return pd.DataFrame({"component": list(root), "to": [find(x) for x in list(root)]})


def district_groups(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(ubid, district, component): connected parts of each district."""
    placed = blocks.where("district IS NOT NULL").select("ubid", "district")
    own = with_districts(edges, placed).where("da = db").select("a", "b")
    return components(placed.select("ubid"), own, known=True).join(keyed(placed), "ubid")


def largest_groups(groups: DataFrame) -> DataFrame:
    """(component, district, size, kept): the largest part of each district stays.  Among equals the
    district's first part stays, else that found last."""
    parts = groups.groupBy("district", "component").agg(F.count(F.lit(1)).alias("size"))
    per = Window.partitionBy("district")
    first = (F.col("component") == F.min("component").over(per)).cast("int")
    parts = parts.withColumn("first", first)
    rank = F.row_number().over(per.orderBy(F.col("size").desc(), F.col("first").desc(), F.col("component").desc()))
    return parts.select("district", "component", "size", (rank == 1).alias("kept"))


def land_centres(blocks: DataFrame) -> DataFrame:
    """(district, cx, cy): area-weighted, the plain mean where a district has no area."""
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col("area") * F.col(c).cast("double")), F.sum("area")), F.avg(c))
    return blocks.where("district IS NOT NULL").groupBy("district").agg(mean("lon").alias("cx"), mean("lat").alias("cy"))


def fix_contiguity(edges: DataFrame, blocks: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """``blocks`` with every part of a district but its largest given to adjacent districts.

    Orphans join, round after round, the neighbouring district whose land centre is nearest; with ``centers`` (district, cx, cy,
    weight; a row a district) that whose centre has the least weighted squared distance.
    """
    groups = district_groups(edges, blocks)
    kept = largest_groups(groups).where("kept").select("component")
    whole = groups.join(keyed(kept), "component", "left_semi").select("ubid", "district")
    state = saved(blocks.drop("district").join(keyed(whole), "ubid", "left"))
    wires = saved(both_ways(edges))
    while True:
        centre = land_centres(state).withColumn("weight", F.lit(1.0)) if centers is None else centers.select("district", "cx", "cy", "weight")
        orphans = state.where("district IS NULL").select("ubid", "lon", "lat")
        offers = orphans.join(keyed(wires.withColumnRenamed("a", "ubid")), "ubid").join(keyed(state.where("district IS NOT NULL").select(F.col("ubid").alias("b"), "district")), "b").join(centre, "district")
        far = ((F.col("lon") - F.col("cx")) * (F.col("lon") - F.col("cx")) + (F.col("lat") - F.col("cy")) * (F.col("lat") - F.col("cy"))) * F.col("weight")
        chosen = saved(offers.groupBy("ubid").agg(F.min_by("district", F.struct(far, "district")).alias("given")))
        if chosen.isEmpty():
            release(wires, chosen)
            return state
        new = saved(state.join(keyed(chosen), "ubid", "left").withColumn("district", F.coalesce("district", "given")).drop("given"))
        release(state, chosen)
        state = new


def nearest(points: DataFrame, centers: DataFrame, weight: bool = True) -> DataFrame:
    """(ubid, district) of the centre at the least weighted squared distance, lowest district on ties.

    ``centers`` has one row a district (at most 253): an array of them rides along with each block,
    so the rows are not multiplied.
    """
    listed = centers.agg(F.sort_array(F.collect_list(F.struct("district", "cx", "cy", "weight"))).alias("cs"))
    apart = lambda c: ((F.col("lon") - c.cx) * (F.col("lon") - c.cx) + (F.col("lat") - c.cy) * (F.col("lat") - c.cy)) * (c.weight if weight else F.lit(1.0))
    best = F.array_min(F.transform("cs", lambda c: F.struct(apart(c).alias("far"), c.district.alias("district"))))
    return points.join(listed).select("ubid", best.getField("district").alias("district"))


#: Blocks of a finest cell, and times that a square is quartered at most.
CELL_BLOCKS, MOST_LEVELS = 32, 24


def ways_out(label: DataFrame) -> DataFrame:
    """(component, way struct<far, a, b>): the shortest way (squared distance, then ids) from each component but the largest to another.

    The square around all blocks is quartered again and again.  On each level a component keeps pairs of an own cell
    and a cell with others' blocks, of which the boxes are no farther apart than the surest way so far is long; only
    pairs that are left on the last level have their blocks compared.  label: ubid, component, lon, lat.
    """
    e = label.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"), F.count(F.lit(1))).first()
    side, levels = max(e[1] - e[0], e[3] - e[2], 1) * 1.0000001, 1
    at = lambda c, low, n: F.floor((F.col(c) - F.lit(low)) / F.lit(side) * (1 << n)).cast("long")
    while levels < MOST_LEVELS and label.groupBy(at("lon", e[0], levels), at("lat", e[2], levels)).count().agg(F.max("count")).first()[0] > CELL_BLOCKS:
        levels += 2
    box = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    placed = saved(label.withColumns({"gx": at("lon", e[0], levels), "gy": at("lat", e[2], levels)}))
    point = placed.select("component", "gx", "gy", F.col("lon").alias("x0"), F.col("lon").alias("x1"), F.col("lat").alias("y0"), F.col("lat").alias("y1"))
    fine = saved(point.groupBy("component", "gx", "gy").agg(*box))
    sizes = saved(label.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    largest = sizes.agg(F.max(F.struct("n", "component")).alias("m")).first()["m"]["component"]
    pairs = sizes.where(F.col("component") != largest).select("component", *(F.lit(0).cast("long").alias(c) for c in ("ax", "ay", "bx", "by")))
    up = lambda c, n: F.shiftright(F.col(c), n)
    for level in range(1, levels + 1):
        cells = fine.withColumns({"gx": up("gx", levels - level), "gy": up("gy", levels - level)})
        own = cells.groupBy("component", "gx", "gy").agg(*box)
        own = own.select("component", up("gx", 1).alias("ax"), up("gy", 1).alias("ay"), F.col("gx").alias("cx"), F.col("gy").alias("cy"), F.struct("x0", "x1", "y0", "y1").alias("p"))
        all_ = cells.groupBy("gx", "gy").agg(*box, F.min("component").alias("low"), F.max("component").alias("high"))
        all_ = all_.select(up("gx", 1).alias("bx"), up("gy", 1).alias("by"), F.col("gx").alias("dx"), F.col("gy").alias("dy"), F.struct("x0", "x1", "y0", "y1").alias("q"), "low", "high")
        met = pairs.join(keyed(own), ["component", "ax", "ay"]).join(keyed(all_), ["bx", "by"]).where("low <> component OR high <> component")
        gap = lambda a, b: F.greatest(F.lit(0), F.col(f"p.{a}") - F.col(f"q.{b}"), F.col(f"q.{a}") - F.col(f"p.{b}"))
        reach = lambda a, b: F.greatest(F.col(f"p.{b}") - F.col(f"q.{a}"), F.col(f"q.{b}") - F.col(f"p.{a}"))
        square = lambda x, y: x * x + y * y
        met = saved(met.select("component", "cx", "cy", "dx", "dy", square(gap("x0", "x1"), gap("y0", "y1")).alias("near"), square(reach("x0", "x1"), reach("y0", "y1")).alias("sure")))
        sure = met.groupBy("component").agg(F.min("sure").alias("best"))
        pairs = met.join(keyed(sure), "component").where("near <= best").select("component", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by"))
    left = placed.select("component", F.col("gx").alias("ax"), F.col("gy").alias("ay"), F.col("ubid").alias("a"), "lon", "lat")
    right = placed.select(F.col("component").alias("other"), F.col("gx").alias("bx"), F.col("gy").alias("by"), F.col("ubid").alias("b"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    far = (F.col("lon") - F.col("x")) * (F.col("lon") - F.col("x")) + (F.col("lat") - F.col("y")) * (F.col("lat") - F.col("y"))
    met = pairs.join(keyed(left), ["component", "ax", "ay"]).join(keyed(right), ["bx", "by"]).where("component <> other")
    return met.groupBy("component").agg(F.min(F.struct(far.alias("far"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("way"))


def repair_connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bridging edges (a, b) that join all components by the least total distance.

    In each round every component but the largest takes the shortest way out of it, which are joined in; the number of
    components falls to half at least.  Blocks without a place are left out.
    """
    placed = saved(nodes.where("lon IS NOT NULL AND lat IS NOT NULL").select("ubid", "lon", "lat"))
    bridges, wires = nodes.sparkSession.createDataFrame([], "a long, b long"), saved(edges.select("a", "b"))
    while True:
        label = saved(components(placed.select("ubid"), wires).join(keyed(placed), "ubid"))
        if label.select("component").distinct().limit(2).count() < 2:
            return bridges
        new = saved(ways_out(label).select("way.a", "way.b").distinct())
        bridges, wires = bridges.unionByName(new), saved(wires.unionByName(new))


def color_districts(adjacency: list[tuple[int, int]], districts: list[int], colors: int = 14) -> dict[int, int]:
    """Colors of districts (at most 253, so on the driver) such that neighbours differ; the search for
    each district starts behind the color before.  Falls back to district mod ``colors``."""
    if len(districts) > 253:
        raise ValueError("more than 253 districts")
    touch: dict[int, set[int]] = {d: set() for d in districts}
    for a, b in adjacency:
        if a in touch and b in touch and a != b:
            touch[a].add(b)
            touch[b].add(a)
    order, found = sorted(districts), {}

    def place(k: int, start: int) -> bool:
        if k == len(order):
            return True
        used = {found[n] for n in touch[order[k]] if n in found}
        for step in range(colors):
            c = (start + step) % colors
            if c not in used:
                found[order[k]] = c
                if place(k + 1, (c + 1) % colors):
                    return True
                del found[order[k]]
        return False

    return found if place(0, 0) else {d: d % colors for d in order}


def colors(pairs: DataFrame, key: str, n: int = 14) -> DataFrame:
    """(``key``, district, color) for each map of ``pairs`` (key, d1, d2; a district without neighbours stands beside itself).  A map has at
    most 253 districts, so it is one task's work; a larger one raises."""
    kind = dict(pairs.dtypes)[key]

    def color(part: pd.DataFrame) -> pd.DataFrame:
        touch = list(part[["d1", "d2"]].drop_duplicates().itertuples(index=False, name=None))
        found = color_districts(touch, sorted({int(d) for pair in touch for d in pair}), n)
        return pd.DataFrame({key: [part[key].iloc[0]] * len(found), "district": list(found), "color": list(found.values())})

    slim = pairs.select(key, "d1", "d2").distinct()
    return slim.groupBy(key).applyInPandas(color, f"{key} {kind}, district int, color int")


def nearest_other(points: DataFrame, cell: float = 0.002) -> DataFrame:
    """(id, other, miles): the nearest other point by great circle, the smallest id among equals.

    points: id, lat, lon in degrees.  Points are dealt to cells of space on the unit sphere; whoever is at
    most a cell's width away stands in a neighbouring cell, and whoever has nobody that near asks again
    with cells four times as wide, so only lonely points see wide cells.
    """
    from wardline.functions.geo import great_circle_miles

    lat, lon = F.radians("lat"), F.radians("lon")
    placed = saved(points.select("id", "lat", "lon", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")))
    asking, found = placed, None
    while True:
        at = lambda c, d=0: (F.floor(F.col(c) / cell) + d).cast("long")  # noqa: E731, B023
        around = F.explode(F.array(*(F.struct(*((at(c, d)).alias("g" + c) for c, d in zip("xyz", (i, j, k), strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
        left = asking.select("id", "lat", "lon", "x", "y", "z", around.alias("g")).select("*", "g.*").drop("g")
        right = placed.select(*(F.col(c).alias("o_" + c) for c in placed.columns), *(at(c).alias("g" + c) for c in "xyz"))
        chord = F.sqrt(sum((F.pow(F.col(c) - F.col("o_" + c), F.lit(2)) for c in "yz"), F.pow(F.col("x") - F.col("o_x"), F.lit(2))))
        miles = F.round(great_circle_miles(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")), 6)
        met = left.join(right, ["gx", "gy", "gz"]).where((F.col("id") != F.col("o_id")) & ((chord <= cell) | F.lit(cell >= 2)))
        near = saved(met.groupBy("id").agg(F.min(F.struct(miles.alias("miles"), F.col("o_id").alias("other"))).alias("n")).select("id", "n.other", "n.miles"))
        found = near if found is None else found.unionByName(near)
        asking = saved(asking.join(near, "id", "left_anti"))
        if cell >= 2 or asking.isEmpty():  # the sphere's width: a single point has no other
            return found
        cell *= 4
