"""The grab solver against a plain sequential double."""

import hashlib
import math
from collections import deque

import pytest

from wardline.operators import graph
from wardline.plans import solvers, turns

WIDE = 50


def grid(spark, n, districts, free=lambda i: False):
    rows = [(i, i % WIDE * 1000, i // WIDE * 1000, (i * 7919) % 97 + 1, i % 5 + 1, None if free(i) else min(districts - 1, i % WIDE * districts // WIDE)) for i in range(n)]
    pairs = [(i, i + 1) for i in range(n) if i % WIDE != WIDE - 1 and i + 1 < n] + [(i, i + WIDE) for i in range(n - WIDE)]
    return rows, pairs, spark.createDataFrame(rows, "ubid long, lon long, lat long, pop long, area long, district int"), spark.createDataFrame(pairs, "a long, b long")


def draw(seed, *values):
    return (int(hashlib.md5(":".join(map(str, (seed, *values))).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


class Double:
    """One district after the other, each reading all blocks."""

    def __init__(self, rows, pairs, districts, seed):
        self.b = {r[0]: list(r) + [0] for r in rows}  # ubid, lon, lat, pop, area, district, until
        self.nb = {u: [] for u in self.b}
        for x, y in pairs:
            self.nb[x].append(y)
            self.nb[y].append(x)
        self.n, self.seed, self.order = districts, seed, list(range(districts))
        self.target = sum(r[3] for r in rows) / districts

    def sums(self):
        out = [[0, 0, 0, 0] for _ in range(self.n)]
        for r in self.b.values():
            if r[5] is not None:
                for k, v in enumerate((r[3], r[4], r[4] * r[1], r[4] * r[2])):
                    out[r[5]][k] += v
        return [(p, x / a, y / a) if a else (p, None, None) for p, a, x, y in out]

    def take(self, d, generation, first):
        ds, best = self.sums(), None
        far = lambda r, c: math.sqrt((r[1] - c[1]) ** 2 + (r[2] - c[2]) ** 2)
        rim = {}
        for u, r in self.b.items():
            if r[5] is not None and any(self.b[x][5] != r[5] for x in self.nb[u]):
                rim.setdefault(r[5], []).append(far(r, ds[r[5]]))
        mean = {k: sum(v) / len(v) for k, v in rim.items()}
        moves = []
        for u, r in self.b.items():
            o = r[5]
            around = [self.b[x][5] for x in self.nb[u]]
            if o == d or d not in around:
                continue
            if o is not None and (len(rim.get(o, [])) <= 1 or (ds[o][0] > 1 and ds[d][0] > self.target and ds[d][0] > ds[o][0])):
                continue
            pull = sum((self.target - p) / ((r[1] - x) ** 2 + (r[2] - y) ** 2) for p, x, y in first if x is not None and (r[1] - x) ** 2 + (r[2] - y) ** 2)
            moves.append((u, r, o, around, pull))
        for u, r, o, around, pull in moves:
            t_pop, w = ds[d][0], solvers.WEIGHTS
            edge = 0.0 if len(rim.get(d, [])) <= 1 or not mean[d] else far(r, ds[d]) / mean[d] - 1
            if o is None:
                other, near, pop = -0.4, -1.0, -0.9
            else:
                other = 1 - far(r, ds[o]) / mean[o] if mean.get(o) else 0.0
                near = (around.count(o) - around.count(d)) / len(around)
                gap = (t_pop - ds[o][0]) / ds[o][0] if ds[o][0] else 0
                pop = 10.0 if ds[o][0] <= 1 else 3 * gap if t_pop > ds[o][0] else gap
            mean_pull = sum(m[4] for m in moves) / len(moves)
            score = other * w["other_edge"] + near * w["neighbours"] + pop * w["pop"] + (max(r[6] - generation, 0) / 5.0 + 1) * w["lock"]
            score += pull / mean_pull * w["field"] + draw(self.seed + generation, u, d) * w["random"] + edge * w["edge"]
            if (t_pop < self.target or score <= 0) and (best is None or (score, u) < best):
                best = score, u
        if best:
            self.b[best[1]][5:] = [d, generation + solvers.LOCKED]

    def run(self, last, kmpp_share, spread_share, most=None):
        kept, generation = deque(maxlen=last), 0
        while most is None or generation < most:
            ds = self.sums()
            moment = sum(math.sqrt((r[1] - ds[r[5]][1]) ** 2 + (r[2] - ds[r[5]][2]) ** 2) * r[3] for r in self.b.values() if r[5] is not None)
            pops = [s[0] for s in ds]
            kept.append((moment, max(pops) - min(pops)))
            k, s = zip(*kept, strict=True)
            if len(kept) == last and (max(k) - min(k)) / k[-1] < kmpp_share and (max(s) - min(s)) / self.target < spread_share:
                break
            self.order.sort(key=lambda d: pops[d])
            first = ds
            for d in [d for d in self.order if pops[d] < self.target or generation % 2 == 1]:
                self.take(d, generation, first)
            generation += 1
        return generation, {u: r[5] for u, r in self.b.items()}


@pytest.mark.parametrize(("n", "districts", "free", "most"), [(1500, 9, lambda i: False, None), (300, 4, lambda i: i % 50 % 12 > 3, 8)])
def test_turns_equal_one_after_the_other(spark, monkeypatch, n, districts, free, most):
    monkeypatch.setattr(turns, "KEPT_MOVES", 12)
    rows, pairs, blocks, edges = grid(spark, n, districts, free)
    solver = turns.TurnSolver(districts, seed=5, last=4, kmpp_share=0.01, spread_share=0.06, most=most)
    got = {r.ubid: r.district for r in solver.run(blocks, edges).collect()}
    generation, want = Double(rows, pairs, districts, 5).run(4, 0.01, 0.06, most)
    assert got == want and len(solver.history) - (most is None) == generation >= 3
    assert solver.wide >= 2  # some districts acted at once
    assert sum(d is None for d in want.values()) < sum(r[5] is None for r in rows) or most is None


def test_turns_repair_contiguity(spark):
    rows, pairs, blocks, edges = grid(spark, 200, 3)
    blocks = blocks.selectExpr("ubid", "lon", "lat", "pop", "area", "if(ubid = 110, 2, district) AS district")
    solver = turns.TurnSolver(3, fix_after=0, most=2)
    done = solver.run(blocks, edges)
    parts = graph.district_groups(edges, done).select("district", "component").distinct().count()
    assert parts == 3 and done.where("district IS NULL").isEmpty()


def test_levels_keep_the_order():
    chain = [(d, sorted({d, e})) for d in range(6) for e in (d - 1, d + 1) if 0 <= e < 6]
    assert turns.levels([0, 3, 1, 4, 2, 5], chain) == [[0, 3], [1, 4], [2, 5]]
    assert turns.levels([0, 1], [(None, [0, 1])]) == [[0], [1]]
    assert turns.levels([0, 1], [(None, [0]), (None, [1])]) == [[0, 1]]


def test_schedule_is_flat_outside_its_points():
    factor = turns.schedule([(100, 1.0), (0, 0.5), (200, 0.0)])
    assert [factor(g) for g in (-5, 0, 50, 100, 150, 900)] == [0.5, 0.5, 0.75, 1.0, 0.5, 0.0]


def test_monitor_stops_when_both_rest():
    m = solvers.Monitor(3, 100.0, 0.01, 0.02)
    assert [m.stopped(k, s) for k, s in [(10, 50), (10, 50), (9, 50), (9, 49), (9, 40), (9, 40), (9, 40)]] == [False, False, False, False, False, False, True]


def test_nearest_solver_stops_by_itself(spark):
    _, _, blocks, edges = grid(spark, 300, 4)
    done = solvers.Nearest().run(blocks, 4, seed=2, last=3, kmpp_share=0.2, spread_share=0.5)
    assert done.where("district IS NULL").isEmpty() and done.select("district").distinct().count() <= 4
