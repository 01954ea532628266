"""The grab solver with its turn order, run until it stops improving.

In a generation every district takes one block, in order of population, each seeing what those before it took.
A district looks at itself and at the districts that it touches, and changes two of them; so districts that
share no such neighbour can act at the same time.  The driver orders them (at most 253) into levels, in which
each stands behind all earlier ones that it could meet, and a level is one Spark job.

A block's row holds its neighbours with their districts.  Moves since the state was last written ride along as a
small map, so a level reads the blocks once, without a shuffle of blocks, and ends in one row a taker.  The
districts' sums are whole numbers and are brought up to date from the moves alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.geo import planar
from wardline.operators import graph
from wardline.plans.solvers import LOCKED, WEIGHTS, Monitor
from wardline.schema import KM_PER_MICRODEGREE
from wardline.shared import release, save

#: Moves that ride along before the state is written anew.
KEPT_MOVES = 64
SUMS = ("n", "pop", "area", "area_x", "area_y")


def levels(order: list[int], seen: list[tuple[int | None, list[int]]]) -> list[list[int]]:
    """Districts in groups that may act at once: each stands behind all earlier ones in ``order`` with which it shares a
    district or a free block.  ``seen``: (district or None, districts of its neighbours) of blocks."""
    touch: dict[object, set] = {d: {d} for d in order}
    for k, (own, around) in enumerate(seen):
        for d in around:
            if own is None:
                touch.setdefault(d, {d}).add(("free", k))  # all takers of one free block meet there
            elif d != own:
                touch.setdefault(own, {own}).add(d)
                touch.setdefault(d, {d}).add(own)
    level: dict[int, int] = {}
    for d in order:
        level[d] = 1 + max((level[e] for e in level if touch[d] & touch[e]), default=0)
    return [[d for d in order if level[d] == k] for k in range(1, max(level.values(), default=0) + 1)]


def schedule(points: list[tuple[int, float]]) -> Callable[[int], float]:
    """A weight by generation: linear between the points, flat before the first and after the last."""
    known = sorted(points)

    def at(generation: int) -> float:
        (x0, y0), (x1, y1) = max((p for p in known if p[0] <= generation), default=known[0]), min((p for p in known if p[0] >= generation), default=known[-1])
        return y0 if x0 == x1 else y0 + (y1 - y0) * (generation - x0) / (x1 - x0)

    return at


def with_neighbours(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """blocks (ubid, lon, lat, pop, area, district, until) with nb: their neighbours (b, d) in order."""
    far = blocks.select(F.col("ubid").alias("b"), F.col("district").alias("d"))
    near = graph.both_ways(edges).join(far, "b").groupBy(F.col("a").alias("ubid")).agg(F.sort_array(F.collect_list(F.struct("b", "d"))).alias("nb"))
    columns = ["ubid", "lon", "lat", "pop", "area", F.col("district").cast("int").alias("district"), F.col("until").cast("int").alias("until")]
    none = F.array().cast("array<struct<b:bigint,d:int>>")
    return blocks.select(*columns).join(near, "ubid", "left").withColumn("nb", F.coalesce("nb", none))


@dataclass
class TurnSolver:
    """Stops by itself after ``last`` generations in which kmpp moved by less than ``kmpp_share`` and the spread by less than
    ``spread_share`` of a district's population.  ``pop_factor`` gives the weight of the population ratio in a generation."""

    districts: int
    seed: int = 0
    last: int = 5000
    kmpp_share: float = 0.0005
    spread_share: float = 0.0005
    fix_after: int = 500
    pop_factor: Callable[[int], float] = lambda g: WEIGHTS["pop"]
    most: int | None = None
    history: list[tuple[int, float, float, int]] = field(default_factory=list)
    wide: int = 0

    def run(self, blocks: DataFrame, edges: DataFrame) -> DataFrame:
        """blocks (ubid, lon, lat, pop, area, district; null is free) with their last districts.  ``history`` gets
        (generation, kmpp, spread, free blocks)."""
        self._start(blocks, edges)
        monitor = Monitor(self.last, self.target, self.kmpp_share, self.spread_share)
        generation = 0
        while self.most is None or generation < self.most:
            kmpp, free, seen = self._stats()
            pops = [s[1] for s in self.sums]
            self.history.append((generation, kmpp, max(pops) - min(pops), free))
            if monitor.stopped(kmpp, max(pops) - min(pops)):
                break
            self._generation(generation, seen)
            if generation > self.fix_after:
                self._fix(edges)
            generation += 1
        return self._now().select("ubid", "lon", "lat", "pop", "area", "district")

    def first_grabs(self, blocks: DataFrame, edges: DataFrame) -> DataFrame:
        """(taker, score, ubid, ...): the block that each district would take first."""
        self._start(blocks, edges)
        return self.best(list(range(self.districts)), 0, self._centres())

    # ------------------------------------------------------------ state

    def _start(self, blocks: DataFrame, edges: DataFrame) -> None:
        self.spark = blocks.sparkSession
        self.state = save(with_neighbours(blocks.withColumn("until", F.lit(0)), edges))
        self.moves: dict[int, tuple[int, int]] = {}
        self.order = list(range(self.districts))
        self._sum_up()
        self.target = self.state.agg(F.sum("pop")).first()[0] / self.districts

    def _sum_up(self) -> None:
        times = lambda c: F.sum(F.col("area").cast("long") * F.col(c)).cast("long")
        sums = self.state.where("district IS NOT NULL").groupBy("district").agg(F.count(F.lit(1)), F.sum("pop").cast("long"), F.sum("area").cast("long"), times("lon"), times("lat"))
        self.sums = [[0] * len(SUMS) for _ in range(self.districts)]
        for d, *values in sums.collect():  # a row a district
            self.sums[d] = values

    def _centres(self) -> list[tuple]:
        return [(s[1], s[3] / s[2] if s[2] else None, s[4] / s[2] if s[2] else None) for s in self.sums]

    def _row(self, **more) -> DataFrame:
        """One row of what the driver knows: a map of at most KEPT_MOVES + 253 moves and lists by district."""
        types = {"moved": "map<bigint,struct<d:int,until:int>>", "ds": "array<struct<pop:bigint,cx:double,cy:double>>", "ds0": "array<struct<pop:bigint,cx:double,cy:double>>", "takers": "array<int>", "target": "double", "generation": "int", "seed": "int", "factor": "double"}
        known = {"moved": self.moves, "ds": self._centres(), "target": self.target} | more
        return self.spark.createDataFrame([tuple(known.values())], ", ".join(f"{k} {types[k]}" for k in known))

    def _now(self, row: DataFrame | None = None) -> DataFrame:
        row = self._row() if row is None else row
        move = F.col("moved")[F.col("ubid")]
        around = F.transform("nb", lambda x: F.struct(x.b.alias("b"), F.coalesce(F.col("moved")[x.b].d, x.d).alias("d")))
        return self.state.crossJoin(F.broadcast(row)).withColumns({"district": F.coalesce(move.d, "district"), "until": F.coalesce(move.until, "until"), "nb": around})

    def _write(self, state: DataFrame) -> None:
        old, self.state = self.state, save(state.select(*self.state.columns))
        self.moves = {}
        release(old)

    def _fix(self, edges: DataFrame) -> None:
        whole = graph.fix_contiguity(edges, self._now().select("ubid", "lon", "lat", "pop", "area", "district", "until"))
        self._write(with_neighbours(whole, edges))
        self._sum_up()

    # ------------------------------------------------------------ a generation

    def _stats(self) -> tuple[float, int, list]:
        """kmpp, free blocks, and the distinct (district, districts around) of blocks at a border."""
        centre = F.get("ds", F.col("district"))
        far = planar(F.col("lon"), F.col("lat"), centre.cx, centre.cy) * F.col("pop")
        around = F.array_sort(F.array_distinct(F.filter(F.transform("nb", lambda x: x.d), lambda d: d.isNotNull())))
        border = F.exists(around, lambda d: ~d.eqNullSafe(F.col("district")))
        out = self._now().agg(F.sum(far), F.sum("pop"), F.count_if(F.col("district").isNull()), F.collect_set(F.when(border, F.struct("district", around.alias("around"))))).first()
        return (out[0] or 0.0) / out[1] * KM_PER_MICRODEGREE if out[1] else 0.0, out[2], [(r.district, list(r.around)) for r in out[3]]

    def _generation(self, generation: int, seen: list) -> None:
        self.order.sort(key=lambda d: self.sums[d][1])  # stable: equals keep their order
        first = self._centres()
        acting = [d for d in self.order if self.sums[d][1] < self.target or generation % 2 == 1]
        for takers in levels(acting, seen):
            self.wide = max(self.wide, len(takers))
            self._turn(takers, generation, first)
        if len(self.moves) > KEPT_MOVES:
            self._write(self._now())

    def _turn(self, takers: list[int], generation: int, first: list[tuple]) -> None:
        """One level: its takers' best blocks, at once."""
        for r in self.best(takers, generation, first).collect():  # a row a taker
            self.moves[r.ubid] = (r.taker, generation + LOCKED)
            change = (1, r.pop, r.area, r.area * r.lon, r.area * r.lat)
            self.sums[r.taker] = [a + b for a, b in zip(self.sums[r.taker], change, strict=True)]
            if r.district is not None:
                self.sums[r.district] = [a - b for a, b in zip(self.sums[r.district], change, strict=True)]

    def best(self, takers: list[int], generation: int, first: list[tuple]) -> DataFrame:
        """(taker, score, ubid, district, pop, area, lon, lat): each taker's best block.  The pull of populations is that of ``first``,
        the districts at the generation's start; all else is as it stands now."""
        row = self._row(ds0=first, takers=takers, generation=generation, seed=self.seed, factor=float(self.pop_factor(generation)))
        return self.spark.sql(BEST, blocks=self._now(row))


#: One statement, since it is planned anew for each level; ``draw`` in SQL ends the terms.  Columns of the driver's row: ds, ds0, takers, target, ...
BEST = f"""
WITH rims AS (SELECT map_from_entries(collect_list(struct(district, struct(rim, r)))) AS rims FROM (
    SELECT district, count(1) AS rim, avg(sqrt((lon - o.cx) * (lon - o.cx) + (lat - o.cy) * (lat - o.cy))) AS r FROM (
      SELECT district, lon, lat, get(ds, district) AS o FROM {{blocks}} WHERE district IS NOT NULL AND exists(nb, x -> NOT (x.d <=> district))) GROUP BY district)),
m AS (SELECT *, get(ds, taker) AS t, get(ds, district) AS o FROM (SELECT *, explode(array_intersect(array_distinct(transform(nb, x -> x.d)), takers)) AS taker FROM {{blocks}}) WHERE NOT (taker <=> district)),
f AS (SELECT /*+ BROADCAST(rims) */ m.*, rims[taker] AS tr, rims[district] AS od, try_divide(t.pop - o.pop, CAST(o.pop AS DOUBLE)) AS gap,
    sqrt((lon - t.cx) * (lon - t.cx) + (lat - t.cy) * (lat - t.cy)) AS t_far, sqrt((lon - o.cx) * (lon - o.cx) + (lat - o.cy) * (lat - o.cy)) AS o_far,
    aggregate(ds0, 0.0D, (acc, x) -> acc + coalesce(try_divide(target - x.pop, (lon - x.cx) * (lon - x.cx) + (lat - x.cy) * (lat - x.cy)), 0.0D)) AS pull FROM m CROSS JOIN rims),
g AS (SELECT *, avg(pull) OVER (PARTITION BY taker) AS mean_pull FROM f
    WHERE NOT coalesce(district IS NOT NULL AND (coalesce(od.rim, 0) <= 1 OR (o.pop > 1 AND t.pop > target AND t.pop > o.pop)), false)),
s AS (SELECT taker, ubid, district, pop, area, lon, lat, t.pop >= target AS over,
    (CASE WHEN district IS NULL THEN -0.4D ELSE coalesce(1 - try_divide(o_far, od.r), 0.0D) END) * {WEIGHTS["other_edge"]}D
    + (CASE WHEN district IS NULL THEN -1.0D ELSE (size(filter(nb, x -> x.d = district)) - size(filter(nb, x -> x.d = taker))) / size(nb) END) * {WEIGHTS["neighbours"]}D
    + (CASE WHEN district IS NULL THEN -0.9D WHEN o.pop <= 1 THEN 10.0D WHEN t.pop > o.pop THEN 3 * gap ELSE gap END) * factor
    + (greatest(until - generation, 0) / 5.0D + 1) * {WEIGHTS["lock"]}D
    + coalesce(try_divide(pull, mean_pull), 0.0D) * {WEIGHTS["field"]}D
    + ((CAST(conv(substring(md5(CAST(concat_ws(':', CAST(generation + seed AS STRING), CAST(ubid AS STRING), CAST(taker AS STRING)) AS BINARY)), 1, 13), 16, 10) AS BIGINT) + 0.5D) / {float(1 << 52)}D) * {WEIGHTS["random"]}D
    + (CASE WHEN coalesce(tr.rim, 0) <= 1 THEN 0.0D ELSE coalesce(try_divide(t_far, tr.r) - 1, 0.0D) END) * {WEIGHTS["edge"]}D AS score FROM g)
SELECT taker, m.* FROM (SELECT taker, min(struct(score, ubid, district, pop, area, lon, lat)) AS m FROM s WHERE NOT over OR score <= 0 GROUP BY taker)
"""
