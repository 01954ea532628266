"""Vector operators: near-duplicates through ITQ codes, exact top-k through a VA-file scan.

Near-duplicates.  Iterative quantisation learns rotations whose sign bits balance the variance;
the bits of all rotations, cut into substrings, are the keys of multi-index Hamming tables.  Equal
vectors are one class; classes that share a table key are compared by their original vectors in
double precision.  A pair counts in the first table in which it meets.  Keys with more than
``BUCKET`` classes are dealt to tasks as pairs of sub-blocks, so every pair is still compared and
no task holds the whole key; a task returns sums and one spanning edge a vector, never pairs.
Substring length follows log2 of the row count, the number of tables the target recall at the
threshold, so the work per vector stays level as the table grows.

Exact top-k.  A vector-approximation file is written once: for each block of rows a cell number of one byte
for every dimension, beside the vectors themselves.  A first scan of the cells bounds every inner product
from below; the k-th largest lower bound of all blocks is the query's limit.  A second scan keeps the rows whose upper
bound reaches it.  Only of those are exact vectors read, in order of their bounds until the k-th result is certain.

Defined cases: vectors that are null or empty, or hold null or non-finite components, and rows with a null id
take no part (near_duplicates returns them alone, and zero vectors too); vectors of different
length are not compared; equal vectors and repeated rows count as rows; a search never returns
rows with the query's own id, and an id repeated among the queries is answered once, for its
smallest vector; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import save
from wardline.llm.components import components

SAMPLE, ITERATIONS, TARGET = 20_000, 40, 0.995
BUCKET, GROUP = 2048, 20_000
BLOCK, QUERIES, CELLS = 8192, 4096, 256


def valid(vec: str):
    """Not null or empty, and all components finite (a null component makes it false)."""
    x = F.col(vec)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite, F.lit(False))


# ---------------------------------------------------------------- near-duplicates


def itq(x: np.ndarray, rotations: int, seed: int = 11) -> np.ndarray:
    """(dim x rotations*dim) projection: principal axes, each time turned to fit sign codes."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x)
    v, out = x @ axes, []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ITERATIONS):
            a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        out.append(axes @ r)
    return np.hstack(out)


def table_plan(n: int, dim: int, cosine: float, target: float = TARGET) -> tuple[int, int, int]:
    """(substring bits, tables, rotations) for n vectors."""
    bits = min(30, max(8, round(math.log2(max(n, 2))) - 3))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    tables = math.ceil(math.log(1 - target) / math.log(1 - agree))
    return bits, tables, math.ceil(bits * tables / dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def table_keys(x: np.ndarray, w: np.ndarray, bits: int, tables: int) -> np.ndarray:
    on = (unit(x) @ w[:, : bits * tables] >= 0).reshape(len(x), tables, bits)
    return (on @ (1 << np.arange(bits))).astype(np.int32)


def linked_pairs(x: np.ndarray, sub: np.ndarray, lo: int, hi: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with enough cosine: within one sub-block (lo == hi) or between two."""
    x = unit(x)  # products of the vectors themselves can leave the range of doubles
    left, right = np.flatnonzero(sub == lo), np.flatnonzero(sub == hi)
    for at in range(0, len(left), 512):
        i = left[at : at + 512]
        a, b = np.nonzero(x[i] @ x[right].T >= cosine)
        i, j = i[a], right[b]
        keep = i < j if lo == hi else slice(None)
        yield i[keep], j[keep]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs, for each of n indices."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def compare_buckets(part: pd.DataFrame, cosine: float, kind: str) -> pd.DataFrame:
    """(node, links, root) for all keys of one group of rows."""
    part = part.sort_values(["t", "key", "lo", "hi", "rep"], kind="stable")
    where = part[["t", "key", "lo", "hi"]].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, [len(where)]])
    reps, counts, sub = part["rep"].to_numpy(), part["n"].to_numpy(), part["sub"].to_numpy()
    vec, keys = part["vec"].tolist(), part["keys"].tolist()
    out = []
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        if e - s < 2:
            continue
        x = np.stack([np.frombuffer(v, kind) for v in vec[s:e]]).astype(float)
        own, t, firsts, seconds = None, int(where[s, 0]), [], []
        for i, j in linked_pairs(x, sub[s:e], int(where[s, 2]), int(where[s, 3]), cosine):
            if t and len(i):
                own = np.stack([np.frombuffer(v, np.int32) for v in keys[s:e]]) if own is None else own
                new = np.ones(len(i), bool)
                for k in range(t):
                    new &= own[i, k] != own[j, k]
                i, j = i[new], j[new]
            firsts.append(i)
            seconds.append(j)
        i, j = np.concatenate(firsts or [np.empty(0, int)]), np.concatenate(seconds or [np.empty(0, int)])
        if len(i):
            n = counts[s:e]
            links = np.bincount(i, n[j], e - s) + np.bincount(j, n[i], e - s)
            hit = np.flatnonzero(links)
            out.append(pd.DataFrame({"node": reps[s:e][hit], "links": links[hit].astype(np.int64), "root": reps[s:e][spanning(e - s, i, j)][hit]}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")


def near_duplicates(rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
    kind = "<f4" if dict(rows.dtypes)["vec"] == "array<float>" else "<f8"
    usable = valid("vec") & F.exists("vec", lambda v: v != 0) & F.col("vec_id").isNotNull()
    classes = rows.where(usable).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = save(classes.withColumn("dim", F.size("vec")))
    found = []
    for dim, total in sorted(tuple(r) for r in classes.groupBy("dim").count().collect()):  # one row a vector length
        same = classes.where(F.col("dim") == dim)
        bits, tables, rotations = table_plan(total, dim, cosine, target)
        some = same.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()  # the bounded fit
        w = spark.sparkContext.broadcast(itq(unit(np.array([r.vec for r in some], float)), rotations))

        def code(batches: Iterator[pd.DataFrame], w=w, bits=bits, tables=tables) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.stack(batch["vec"].to_list()).astype(kind)
                keys = table_keys(x.astype(float), w.value, bits, tables)
                yield pd.DataFrame({"rep": batch["rep"], "n": batch["n"], "vec": [v.tobytes() for v in x], "keys": [k.tobytes() for k in keys], "each": list(keys)})

        coded = save(same.select("rep", "n", "vec").mapInPandas(code, "rep long, n long, vec binary, keys binary, each array<int>"))
        met = coded.select("rep", F.posexplode("each").alias("t", "key"))
        full = met.groupBy("t", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "key", F.ceil(F.col("c") / BUCKET).cast("int").alias("parts"))
        placed = coded.select("rep", "n", "vec", "keys", F.posexplode("each").alias("t", "key")).join(full, ["t", "key"])
        placed = placed.withColumn("sub", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
        placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        placed = placed.withColumns({"lo": F.least("sub", "with"), "hi": F.greatest("sub", "with")})
        groups = max(1, total * tables // GROUP)
        placed = placed.withColumn("group", F.pmod(F.xxhash64("t", "key", "lo", "hi"), F.lit(groups)))
        compare = lambda part: compare_buckets(part, cosine, kind)
        found.append(save(placed.drop("parts", "with").groupBy("group").applyInPandas(compare, "node long, links long, root long")))
    made = spark.createDataFrame([], "node long, links long, root long")
    for f in found:
        made = made.unionByName(f)
    links = made.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(made.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = classes.select("vec", "rep", "n").join(links.withColumnRenamed("node", "rep"), "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("of"))
    single = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where(usable).join(known, "vec").select("vec_id", F.col("links").alias("n_links"), F.col("of").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


# ---------------------------------------------------------------- exact top-k


def whole_numbers(vec: str, scale: int = 64):
    """floor(scale * x) of each component, x as double."""
    return F.transform(F.col(vec), lambda v: F.floor(v.cast("double") * scale).cast("long"))


APPROXIMATE, EXACT = ["dim", "d", "d_ids", "low", "width", "cells"], ["dim", "d", "d_ids", "kind", "vecs"]


def smallest_kind(x: np.ndarray) -> str:
    """The smallest signed type that holds the whole numbers x."""
    return np.min_scalar_type(-1 - int(max(x.max(), -1 - x.min()))).str


def vector_file(rows: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of about ``BLOCK`` rows (id, vec), and their number: cells beside exact vectors, read by columns."""
    count = max(1, -(-rows.count() // BLOCK))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.stack(part["vec"].to_list()).astype(np.int64)
        low = x.min(axis=0)
        width = np.maximum(1, -(-(x.max(axis=0) - low + 1) // CELLS))  # whole numbers in a cell
        kind = smallest_kind(x)
        return pd.DataFrame({
            "dim": part["dim"].iloc[:1], "d": part["d"].iloc[:1], "d_ids": [part["id"].to_numpy(np.int64).tobytes()], "low": [low.tobytes()],
            "width": [width.tobytes()], "cells": [((x - low) // width).astype(np.uint8).tobytes()], "kind": [kind], "vecs": [x.astype(kind).tobytes()],
        })

    dealt = rows.withColumns({"dim": F.size("vec"), "d": F.pmod(F.xxhash64("id", "vec"), F.lit(count)).cast("int")})
    return save(dealt.groupBy("dim", "d").applyInPandas(pack, "dim int, d int, d_ids binary, low binary, width binary, cells binary, kind string, vecs binary")), count


def query_blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of about ``QUERIES`` queries (id, vec, limit), and their number."""
    count = max(1, -(-queries.count() // QUERIES))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.stack(part["vec"].to_list()).astype(np.int64)
        kind = smallest_kind(x)
        return pd.DataFrame({
            "dim": part["dim"].iloc[:1], "q": part["q"].iloc[:1], "q_ids": [part["id"].to_numpy(np.int64).tobytes()], "q_kind": [kind], "q_vecs": [x.astype(kind).tobytes()],
            "limits": [part["limit"].to_numpy(float).tobytes()],
        })

    dealt = queries.withColumns({"dim": F.size("vec"), "q": F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")})
    return dealt.groupBy("dim", "q").applyInPandas(pack, "dim int, q int, q_ids binary, q_kind string, q_vecs binary, limits binary"), count


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; in doubles where they stay below 2**53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def bounds(r) -> Iterator[tuple[int, float, np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, limit, rows that are not its own, lower, upper bounds) for each query of a pair of blocks."""
    ids, q_ids, limits = np.frombuffer(r.d_ids, np.int64), np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.limits, float)
    low, width = np.frombuffer(r.low, np.int64), np.frombuffer(r.width, np.int64)
    corner = (low + np.frombuffer(r.cells, np.uint8).reshape(-1, r.dim).astype(np.int64) * width).astype(float)
    asked, reach = np.frombuffer(r.q_vecs, r.q_kind).reshape(-1, r.dim).astype(float), (width - 1).astype(float)
    for at in range(0, len(asked), 256):
        some = asked[at : at + 256]
        base = some @ corner.T
        slack = 1e-9 * np.abs(base).max(initial=1.0)
        up, down = np.maximum(some, 0) @ reach + slack, np.minimum(some, 0) @ reach - slack
        for k in range(len(some)):
            other = np.flatnonzero(ids != q_ids[at + k])
            yield int(q_ids[at + k]), float(limits[at + k]), other, base[k, other] + down[k], base[k, other] + up[k]


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): rows and queries have (id, vec) of whole numbers."""
    file, n_file = vector_file(rows)
    asked = save(queries.groupBy("id").agg(F.min("vec").alias("vec")))

    def met(limited: DataFrame) -> DataFrame:
        """Every block of queries with the cells of every block of rows once, under a key of its own.

        Spark takes either side for as small as it was before its rows were repeated and would broadcast it whole: the join is by key.
        """
        some, n_some = query_blocks(limited)
        every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        cells = file.select(*APPROXIMATE, every("q", n_some)).hint("merge")
        return some.select("*", every("d", n_file)).join(cells, ["dim", "q", "d"])

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                found = [(q, r.d, low if len(low) <= k else np.partition(low, len(low) - k)[len(low) - k :]) for q, _, _, low, _ in bounds(r)]
                yield pd.DataFrame(found, columns=["id", "d", "best"])

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                asked, found = np.frombuffer(r.q_vecs, r.q_kind).reshape(-1, r.dim).astype(np.int64), []
                for n, (q, limit, other, _, high) in enumerate(bounds(r)):
                    near = np.flatnonzero(high >= limit)
                    if len(near):
                        near = near[np.argsort(-high[near], kind="stable")]
                        found.append((q, r.dim, r.d, asked[n].tobytes(), other[near].astype(np.int32).tobytes(), high[near].tobytes()))
                yield pd.DataFrame(found, columns=["query_id", "dim", "d", "vec", "at", "bound"])

    def read(near: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in block.itertuples():
            ids, x = np.frombuffer(b.d_ids, np.int64), np.frombuffer(b.vecs, b.kind).reshape(-1, b.dim)
            for r in near.itertuples():
                vec, at, bound = np.frombuffer(r.vec, np.int64)[None], np.frombuffer(r.at, np.int32), np.frombuffer(r.bound, float)
                got_i, got_s, step = np.empty(0, np.int64), np.empty(0, np.int64), max(64, 2 * k)
                for i in range(0, len(at), step):
                    if len(got_s) >= k and bound[i] < got_s[k - 1]:
                        break  # no candidate further on can reach the k-th result
                    rows = at[i : i + step]
                    got_i, got_s = np.append(got_i, ids[rows]), np.append(got_s, inner(vec, x[rows].astype(np.int64))[0])
                    best = np.lexsort((got_i, -got_s))[:k]
                    got_i, got_s = got_i[best], got_s[best]
                out.append((np.full(len(got_i), r.query_id), got_i, got_s))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    best = met(asked.withColumn("limit", F.lit(float("-inf")))).mapInPandas(lower, "id long, d int, best array<double>")
    largest = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("best")))), 1, k).alias("best")
    best = best.groupBy("id", F.col("d") % 256).agg(largest).groupBy("id").agg(largest)  # k values for each 256th of the blocks
    limit = F.when(F.size("best") >= k, F.element_at("best", -1)).otherwise(float("-inf"))
    limits = save(best.select("id", limit.alias("limit")))
    near = met(asked.join(limits.hint("merge"), "id")).mapInPandas(within, "query_id long, dim int, d int, vec binary, at binary, bound binary")
    hits = near.groupBy("dim", "d").cogroup(file.select(*EXACT).groupBy("dim", "d")).applyInPandas(read, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows a block
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of the search over ``embeddings``.
TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
