"""Solvers as iterated DataFrame steps.  Districts, at most 253, are small tables; blocks and edges stay
distributed, and every step is joins and aggregates.  All draws come from hashes of (seed, id)."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.geo import interpolate, planar
from wardline.operators import graph
from wardline.schema import KM_PER_MICRODEGREE
from wardline.shared import release
from wardline.shared import save as saved


def draw(seed: int, *columns: str):
    """Uniform in (0, 1) from the first 52 bits of an md5 of seed and columns: reruns agree whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def random_seeds(blocks: DataFrame, edges: DataFrame, districts: int, seed: int) -> DataFrame:
    """blocks with district null but for one random block a district and one free neighbour of it."""
    first = blocks.select("ubid").orderBy(draw(seed, "ubid"), "ubid").limit(districts)  # one row a district
    first = first.withColumn("district", F.row_number().over(Window.orderBy(draw(seed, "ubid"), "ubid")) - 1)
    near = first.join(graph.both_ways(edges).withColumnRenamed("a", "ubid"), "ubid").select(F.col("b").alias("ubid"), "district")
    near = near.join(first.select("ubid"), "ubid", "left_anti")
    near = near.groupBy("district").agg(F.min_by("ubid", draw(seed + 1, "ubid")).alias("ubid")).groupBy("ubid").agg(F.min("district").alias("district"))
    return blocks.drop("district").join(first.unionByName(near), "ubid", "left")


class Monitor:
    """The last ``n`` values of kmpp and spread; says when both have stopped moving."""

    def __init__(self, n: int, target: float, kmpp_share: float, spread_share: float) -> None:
        self.kmpp, self.spread = deque(maxlen=n), deque(maxlen=n)
        self.target, self.kmpp_share, self.spread_share = target, kmpp_share, spread_share

    def stopped(self, kmpp: float, spread: float) -> bool:
        self.kmpp.append(kmpp)
        self.spread.append(spread)
        if len(self.kmpp) < self.kmpp.maxlen or not kmpp or not self.target:
            return False
        moved = (max(self.kmpp) - min(self.kmpp)) / kmpp, (max(self.spread) - min(self.spread)) / self.target
        return moved[0] < self.kmpp_share and moved[1] < self.spread_share


def kmpp_and_spread(placed: DataFrame, districts: int) -> tuple[float, float]:
    """Kilometres per person to the district's land centre, and the largest less the smallest population."""
    d = placed.groupBy("district").agg(F.sum("pop").alias("dpop"), *(F.try_divide(F.sum(F.col("area") * F.col(c).cast("double")), F.sum("area")).alias(f"c{c}") for c in ("lon", "lat")))
    d = saved(d)  # a row a district
    far = planar(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")) * F.col("pop")
    moment = placed.join(F.broadcast(d), "district").agg(F.sum(far), F.sum("pop")).first()
    pops = [r.dpop for r in d.collect()]
    release(d)
    pops += [0] * (districts - len(pops))
    return ((moment[0] or 0.0) / moment[1] * KM_PER_MICRODEGREE if moment[1] else math.inf), float(max(pops) - min(pops))


# ---------------------------------------------------------------- nearest neighbour


@dataclass
class Nearest:
    """Each block joins the district whose weighted centre is nearest; centres drift to their area
    centre and weights follow the population."""

    drift: float = 0.01
    grow: float = 1.01
    shrink: float = 0.99

    def start(self, blocks: DataFrame, districts: int, seed: int) -> list[tuple]:
        rows = blocks.select("ubid", "lon", "lat").orderBy(draw(seed, "ubid"), "ubid").limit(districts).collect()
        return [(d, float(r.lon), float(r.lat), 1.0) for d, r in enumerate(rows)]

    def step(self, blocks: DataFrame, centers: list[tuple], target: float) -> tuple[DataFrame, list[tuple]]:
        spark = blocks.sparkSession
        c = spark.createDataFrame(centers, "district int, cx double, cy double, weight double")
        placed = saved(blocks.drop("district").join(graph.keyed(graph.nearest(blocks, c)), "ubid"))
        sums = placed.groupBy("district").agg(F.sum("pop").alias("pop"), F.try_divide(F.sum(F.col("area") * F.col("lon").cast("double")), F.sum("area")).alias("ax"), F.try_divide(F.sum(F.col("area") * F.col("lat").cast("double")), F.sum("area")).alias("ay"))
        own = {r.district: r for r in sums.collect()}  # a row a district
        out = []
        for d, x, y, w in centers:
            r = own.get(d)
            pop = r.pop if r else 0
            if r and r.ax is not None:
                x, y = x + self.drift * (r.ax - x), y + self.drift * (r.ay - y)
            out.append((d, x, y, w * (self.grow if pop > target else self.shrink if pop < target else 1.0)))
        return placed, out

    def run(self, blocks: DataFrame, districts: int, generations: int | None = None, seed: int = 1, edges: DataFrame | None = None, last: int = 5000, kmpp_share: float = 0.0005, spread_share: float = 0.0005, by_weight: bool = False) -> DataFrame:
        """Blocks with districts after ``generations`` steps, or without that number when kmpp and spread have stopped moving for
        ``last`` steps; with edges, parts are made contiguous at the end, ``by_weight`` by the weighted centres of the last step."""
        target = blocks.agg(F.sum("pop")).first()[0] / districts
        centers = self.start(blocks, districts, seed)
        placed, done = blocks, 0
        monitor = Monitor(last, target, kmpp_share, spread_share)
        while generations is None or done < generations:
            if done:
                release(placed)
            before = centers
            placed, centers = self.step(blocks, centers, target)
            done += 1
            if generations is None and monitor.stopped(*kmpp_and_spread(placed, districts)):
                break
        if edges is None:
            return placed
        spark = blocks.sparkSession
        known = spark.createDataFrame(before, "district int, cx double, cy double, weight double") if by_weight and done else None
        return graph.fix_contiguity(edges, placed, known)


# ---------------------------------------------------------------- edge grab

#: Weights of a grab score's terms.
WEIGHTS = {"edge": 1.2, "other_edge": 1.0, "neighbours": 0.3, "pop": 0.5, "lock": 0.1, "field": 0.001, "random": 0.1}
LOCKED = 60


def grab_features(blocks: DataFrame, edges: DataFrame, target: float, seed: int = 0, generation: int = 0) -> DataFrame:
    """(ubid, taker, over, the terms of WEIGHTS) of every block that borders another district.

    blocks: ubid, lon, lat, pop, area, district, lock.  Banned moves have no row: a district's last
    edge block, and an oversized taker from a smaller district.
    """
    wires = graph.both_ways(edges)
    d = blocks.where("district IS NOT NULL").groupBy("district").agg(
        F.sum("pop").alias("dpop"), F.try_divide(F.sum(F.col("area") * F.col("lon").cast("double")), F.sum("area")).alias("cx"), F.try_divide(F.sum(F.col("area") * F.col("lat").cast("double")), F.sum("area")).alias("cy")
    )
    rim = graph.edge_blocks(edges, blocks).join(blocks.select("ubid", "lon", "lat"), "ubid").join(d, "district")
    rim = rim.groupBy("district").agg(F.count(F.lit(1)).alias("rim"), F.avg(planar(F.col("lon"), F.col("lat"), F.col("cx"), F.col("cy"))).alias("mean_r"))
    d = saved(d.join(rim, "district", "left").fillna({"rim": 0}))
    listed = d.agg(F.collect_list(F.struct("dpop", "cx", "cy")).alias("ds"))  # a row a district

    around = wires.join(blocks.select(F.col("ubid").alias("b"), F.col("district").alias("nd")), "b").groupBy(F.col("a").alias("ubid"), "nd").agg(F.count(F.lit(1)).alias("n"))
    degree = wires.groupBy(F.col("a").alias("ubid")).agg(F.count(F.lit(1)).alias("degree"))
    here = blocks.select("ubid", "lon", "lat", "district", F.coalesce("lock", F.lit(0)).alias("lock"))
    own = around.select("ubid", F.col("nd").alias("district"), F.col("n").alias("own_n"))
    moves = around.where("nd IS NOT NULL").select("ubid", F.col("nd").alias("taker"), F.col("n").alias("taker_n")).join(here, "ubid").where("NOT (taker <=> district)")
    moves = moves.join(own, ["ubid", "district"], "left").join(degree, "ubid")
    t = d.select(F.col("district").alias("taker"), F.col("dpop").alias("tp"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("rim").alias("t_rim"), F.col("mean_r").alias("t_r"))
    o = d.select("district", F.col("dpop").alias("op"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("rim").alias("o_rim"), F.col("mean_r").alias("o_r"))
    m = moves.join(t, "taker").join(o, "district", "left").join(listed)
    free = F.col("district").isNull()
    banned = ~free & ((F.col("o_rim") <= 1) | ((F.col("op") > 1) & (F.col("tp") > target) & (F.col("tp") > F.col("op"))))
    m = m.where(~banned)
    away = lambda x, y: planar(F.col("lon"), F.col("lat"), F.col(x), F.col(y))
    edge = F.when(F.col("t_rim") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(away("tx", "ty"), F.col("t_r")) - 1, F.lit(0.0)))
    other = F.when(free, -0.4).otherwise(F.coalesce(1 - F.try_divide(away("ox", "oy"), F.col("o_r")), F.lit(0.0)))
    gap = F.try_divide(F.col("tp") - F.col("op"), F.col("op").cast("double"))
    pop = F.when(free, -0.9).when(F.col("op") <= 1, 10.0).when(F.col("tp") > F.col("op"), 3 * gap).otherwise(gap)
    neigh = F.when(free, -1.0).otherwise((F.coalesce("own_n", F.lit(0)) - F.col("taker_n")) / F.col("degree"))
    pull = F.aggregate("ds", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_divide(target - x.dpop, (F.col("lon") - x.cx) * (F.col("lon") - x.cx) + (F.col("lat") - x.cy) * (F.col("lat") - x.cy)), F.lit(0.0)))
    m = m.withColumn("pull", pull)
    field = F.coalesce(F.try_divide(F.col("pull"), F.avg("pull").over(Window.partitionBy("taker"))), F.lit(0.0))
    terms = {"edge": edge, "other_edge": other, "neighbours": neigh, "pop": pop, "lock": F.col("lock") / 5.0 + 1, "field": field, "random": draw(seed + generation, "ubid", "taker")}
    return m.select("ubid", "taker", (F.col("tp") > target).alias("over"), *(terms[k].alias(k) for k in WEIGHTS))


def grab_scores(blocks: DataFrame, edges: DataFrame, target: float, seed: int = 0, generation: int = 0, factors: dict[str, float] | None = None) -> DataFrame:
    """(ubid, taker, score, over): the weighted sum of a move's terms; lower is better."""
    k = WEIGHTS | (factors or {})
    found = grab_features(blocks, edges, target, seed, generation)
    score = sum((F.col(c) * k[c] for c in list(WEIGHTS)[1:]), F.col("edge") * k["edge"])
    return found.select("ubid", "taker", score.alias("score"), "over")


def score_ranges(features: DataFrame) -> DataFrame:
    """(term, low, high) over all moves."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("term"), F.col(k).alias("v")) for k in WEIGHTS))).alias("t")
    return features.select(each).select("t.*").groupBy("term").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def grab_step(blocks: DataFrame, edges: DataFrame, target: float, generation: int, seed: int = 0) -> DataFrame:
    """One synchronous step: every district takes its best block, conflicts go to the better score.

    Districts at or above the target take only on odd generations, and only at scores of 0 or less.
    """
    scores = grab_scores(blocks, edges, target, seed, generation).where(~F.col("over") | ((F.lit(generation) % 2 == 1) & (F.col("score") <= 0)))
    best = scores.groupBy("taker").agg(F.min_by("ubid", F.struct("score", "ubid")).alias("ubid"), F.min("score").alias("score"))
    taken = best.groupBy("ubid").agg(F.min_by("taker", F.struct("score", "taker")).alias("taker"))
    out = blocks.join(taken, "ubid", "left")
    lock = F.when(F.col("taker").isNotNull(), LOCKED).otherwise(F.greatest(F.coalesce("lock", F.lit(0)) - 1, F.lit(0)))
    return saved(out.withColumn("district", F.coalesce("taker", "district")).withColumn("lock", lock.cast("int")).drop("taker"))


def grab_run(blocks: DataFrame, edges: DataFrame, districts: int, generations: int, seed: int = 0, fix_after: int = 500) -> DataFrame:
    """Random seeds and ``generations`` steps; contiguity is repaired each step after ``fix_after`` and at the end."""
    target = blocks.agg(F.sum("pop")).first()[0] / districts
    state = saved(random_seeds(blocks, edges, districts, seed).withColumn("lock", F.lit(0)))
    for g in range(generations):
        state = grab_step(state, edges, target, g, seed)
        if g > fix_after:
            state = graph.fix_contiguity(edges, state)
    return graph.fix_contiguity(edges, state)


def default_generations(blocks, districts, kind: str = "grab"):
    """Of numbers or of columns."""
    if kind == "nearest":
        return 15_000
    return F.floor(10 * blocks / districts).cast("long") if isinstance(blocks, Column) else 10 * blocks // districts


def pop_ratio_factor(generation, points: list[tuple[float, float]]):
    return interpolate(generation, points)


# ---------------------------------------------------------------- county and city start


def county_city_start(blocks: DataFrame, target: float, tolerance: float = 0.05) -> DataFrame:
    """(ubid, district): counties, then cities outside them, of about the target's population are districts.

    blocks: ubid, pop, county, place (0 or 99999: no city).
    """
    near = lambda c: F.abs(F.col(c) - target) <= tolerance * target
    counties = blocks.groupBy("county").agg(F.sum("pop").alias("p")).where(near("p")).select("county", F.row_number().over(Window.orderBy("county")).alias("k"))
    used = counties.count()
    rest = blocks.join(counties, "county", "left_anti").where("place NOT IN (0, 99999)")
    cities = rest.groupBy("place").agg(F.sum("pop").alias("p")).where(near("p")).select("place", (F.row_number().over(Window.orderBy("place")) + used).alias("c"))
    out = blocks.join(counties, "county", "left").join(cities, "place", "left")
    return out.select("ubid", (F.coalesce("k", "c") - 1).cast("int").alias("district"))


# ---------------------------------------------------------------- synthetic maps


def synthetic_maps(spark, maps: list[list[int]], minority: int, trials: int | DataFrame, seed: int = 1) -> DataFrame:
    """(map, seats, n): how often x, with all but ``minority`` of the cells, wins so many districts.

    Each trial, a number or a row (trial) of a table, shuffles the cells by hash; ties in a district go to the larger label.
    """
    size = len(maps[0])
    each = spark.range(trials).withColumnRenamed("id", "trial") if isinstance(trials, int) else trials
    cells = each.select("trial", F.posexplode(F.sequence(F.lit(0), F.lit(size - 1))).alias("cell", "_"))
    order = Window.partitionBy("trial").orderBy(draw(seed, "trial", "cell"), "cell")
    party = cells.select("trial", "cell", F.when(F.row_number().over(order) <= minority, "o").otherwise("x").alias("label"))
    layout = spark.createDataFrame([(m, c, d) for m, grid in enumerate(maps) for c, d in enumerate(grid)], "map int, cell int, district int")
    # the layout rides along: by its size alone Spark would send the trials' cells through the driver
    counts = party.join(F.broadcast(layout), "cell").groupBy("map", "trial", "district").agg(F.count_if(F.col("label") == "x").alias("x"), F.count_if(F.col("label") == "o").alias("o"))
    seats = counts.groupBy("map", "trial").agg(F.count_if(F.col("x") >= F.col("o")).alias("seats"))
    return seats.groupBy("map", "seats").agg(F.count(F.lit(1)).alias("n"))
