"""Near-duplicate documents: min-max hashing for candidates, full sets for every link.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so
``PERMUTATIONS`` evaluations make twice as many values; bands of ``ROWS`` values are bucket keys.
With 28 bands of 4, a pair at similarity 0.8 misses every bucket with probability 4e-7.

Documents with equal shingle sets are one class and go on as its smallest doc_id.  In a bucket
all members are compared with one centre, the member that shares most buckets with most others.
Members that are like the centre are one component.  Others may still be linked, to each other or
to members, but then by shingles that the centre lacks: if s and m are similar enough and s is not
like the centre c, s has fewer shingles in common with c than similarity to m asks for, so s and m
share a shingle outside c, unless m is smaller than c and both lie in c nearly whole.  So a star
whose members are not one component yet falls apart into smaller groups, one for each shingle outside
the centre (the rarest first, and no more of them than prefix filtering needs) and one for the members
nearly inside it.  Groups of at most ``SMALL`` members are settled in one task.  The members of a larger
one, mostly copies of one text that were each edited in other places, have too little apart from it for smaller
groups; they are dealt to blocks, and every two blocks are compared in a task of their own.  A task returns
what joins components, never all pairs, so the job ends after this one step however large a group is.

Defined cases: null, empty and blank texts have no shingles and stay alone; texts of fewer than
``SHINGLE`` words are one shingle; rows with a null id stay alone; repeated rows share a class;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import likely, release, save
from wardline.llm.components import components
from wardline.llm.vectors import spanning

BANDS, ROWS = 28, 4
PERMUTATIONS = BANDS * ROWS // 2
SHINGLE, PERCENT = 5, 80
SMALL, TASK_SHINGLES = 256, 1_000_000  # members of a group compared in one task, shingles of its groups together
BLOCK, BLOCK_SHINGLES = 1024, 500_000  # members of a block of a larger group, and their shingles, on average
COMMON, COLUMNS = 8, 4096  # members from which a shingle gets a column of a matrix, columns multiplied at once
CHUNK = 1 << 15  # shingles hashed at once

_rng = np.random.default_rng(20240501)
_flip = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]
_odd = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
_place = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_band = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_salt = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the lower-cased text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(words) - n + 1
    total = h[:m] * _place[0]
    for j in range(1, n):
        total += h[j : j + m] * _place[j]
    return np.unique(mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    """PERMUTATIONS rows of (minimum, maximum)."""
    x, low, high = (s >> np.uint64(32)).astype(np.uint32), None, None
    for at in range(0, len(x), CHUNK):
        y = (x[None, at : at + CHUNK] ^ _flip) * _odd
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x7FEB352D)
        a, b = y.min(axis=1), y.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high], axis=1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _band).sum(axis=1) + _salt).view(np.int64)


def features(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): set_a, set_b name the shingle set."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, n)
                if not len(s):
                    out.append((doc_id, 0, None, None, None))
                    continue
                name = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                out.append((doc_id, len(s), name[0], name[1], band_keys(signature(s))))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_a", "set_b", "bands"]).astype({"set_a": "Int64", "set_b": "Int64"})

    kinds = "doc_id string, n_shingles long, set_a long, set_b long, bands array<long>"
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(rows, kinds).withColumn("doc_id", F.col("doc_id").cast("long"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, ..., s): packed sorted shingles of the documents in ``wanted`` (doc_id, ...)."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield part.drop(columns="text").assign(s=[shingles(x, n).tobytes() for x in part["text"]])

    one = likely(docs.select("doc_id", "text"), wanted).join(wanted, "doc_id").dropDuplicates(["doc_id"])
    return one.mapInPandas(sets, T.StructType(wanted.schema.fields).add("s", "binary"))


def overlaps(members: DataFrame, centres: DataFrame) -> DataFrame:
    """(u, v, common, rest) of the sets s of ``members`` (u, v, s) and t of ``centres`` (v, t); rest: shingles of u outside v."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            common, rest = [], []
            for a, b in zip(batch["s"], batch["t"], strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                hit = b[at] == a
                common.append(int(hit.sum()))
                rest.append(a[~hit].tobytes())
            yield pd.DataFrame({"u": batch["u"], "v": batch["v"], "common": common, "rest": rest})

    return members.join(centres, "v").select("u", "v", "s", "t").mapInPandas(compare, "u long, v long, common long, rest binary")


def outside_rows(stars: DataFrame) -> DataFrame:
    """(v, root, u, x): one row for each shingle x of u outside its centre v."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                x = [np.frombuffer(r, np.int64) for r in part["rest"]]
                again = {c: np.repeat(part[c].to_numpy(), [len(r) for r in x]) for c in ("v", "root", "u")}
                yield pd.DataFrame(again | {"x": np.concatenate(x) if x else []})

    return stars.select("v", "root", "u", "rest").mapInPandas(rows, "v long, root long, u long, x long")


def mixed(groups: DataFrame) -> DataFrame:
    """(g, root, many, who) of the groups that have two components, and two documents that the star
    of their own first centre f does not bring together; who names the members."""
    mark = F.pmod(F.xxhash64("u"), F.lit(1 << 31))  # sums of these cannot overflow
    ends = [end(c).alias(end.__name__ + c) for c in ("uc", "f") for end in (F.min, F.max)]
    seen = groups.groupBy("g", "root").agg(*ends, F.count(F.lit(1)).alias("many"), F.sum(mark).alias("who"))
    return seen.where("minuc <> maxuc AND (minf <> maxf OR minf = root)").select("g", "root", "many", "who")


def spread(stars: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(g, root, u, f, uc, un, mass, many): what may still be linked in each star, as smaller groups.

    A group is named by its centre and a shingle outside it, or by the centre alone for the members
    that lie in it nearly whole.  With the rarest outside shingles first, the number that a linked
    pair has in common bounds how many of them a member needs; of groups with the same members one stays."""
    comp = label.select(F.col("node").alias("u"), F.col("component").alias("uc"))
    stars = stars.join(comp, "u", "left").join(comp.withColumnsRenamed({"u": "v", "uc": "vc"}), "v", "left")
    stars = stars.withColumns({"uc": F.coalesce("uc", "u"), "vc": F.coalesce("vc", "v")})
    open_ = save(stars.groupBy("v", "root").agg(F.max(F.col("uc") != F.col("vc")).alias("open"), F.min("un").alias("least")).where("open").drop("open"))
    stars = stars.join(open_, ["v", "root"])
    partner = F.greatest("least", F.col("un") * percent / 100)  # words of the smallest that can be linked
    prefix = F.col("un") - F.ceil((F.col("un") + partner) * percent / (100 + percent) - 1e-6) + 1
    stars = save(stars.withColumn("spare", F.col("un") - F.col("common") - prefix))
    inside = (100 * F.col("common") >= percent * F.col("un")) & (~F.col("linked") | (F.col("un") < F.col("vn")))
    groups = outside_rows(stars).unionByName(stars.where(inside).select("v", "root", "u", F.lit(None).cast("long").alias("x")))
    groups = groups.withColumn("g", F.xxhash64("root", "v", "x")).join(stars.select("u", "v", "root", "f", "uc", "un", "mass", "spare"), ["u", "v", "root"])
    few = save(mixed(groups).select("g", "many"))
    each = Window.partitionBy("u", "v", "root")  # at most the shingles of a document
    groups = groups.join(few, "g")
    groups = groups.withColumn("rank", F.row_number().over(each.orderBy(F.desc("many"), "g")))
    # of the outside shingles (un - common) the last `spare` ones are not needed, frequent ones first
    groups = save(groups.where("x IS NULL OR rank > spare").select("g", "root", "u", "f", "uc", "un", "mass"))
    chosen = save(mixed(groups).groupBy("root", "many", "who").agg(F.min("g").alias("g")).select("g", "many"))
    out = save(groups.join(chosen, "g"))
    release(open_, few, stars, groups, chosen)
    return out


def within_small(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links inside groups of at most ``SMALL`` members, several groups to a task."""

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["g", "u"])
        found = []
        for _, one in part.groupby("g", sort=False):
            u, f, root = one["u"].to_numpy(), one["f"].to_numpy(), one["root"].iloc[0]
            comp, s = one["uc"].to_numpy().copy(), [np.frombuffer(x, np.uint64) for x in one["s"]]
            for i in range(len(u)):
                for j in range(i):
                    if comp[i] == comp[j] or (f[i] == f[j] and f[i] != root):
                        continue
                    a, b = (s[i], s[j]) if len(s[i]) < len(s[j]) else (s[j], s[i])
                    if 100 * len(a) < percent * len(b):
                        continue
                    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    if 100 * common >= percent * (len(a) + len(b) - common):
                        found.append((u[i], u[j]))
                        comp[comp == comp[i]] = comp[j]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    tasks = 1 + (groups.agg(F.sum("un")).first()[0] or 0) // TASK_SHINGLES
    dealt = groups.select("g", "root", "u", "f", "uc", F.pmod(F.xxhash64("g"), F.lit(tasks)).alias("task")).join(sets.withColumnRenamed("doc_id", "u"), "u")
    return dealt.groupBy("task").applyInPandas(pairs, "u long, v long")


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each set of ``left`` has in common with each of ``right``."""
    n, sets = len(left), left + right
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, x, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((n, len(right)), np.float32)  # exact, as sets stay far below 2 ** 24
    often = times >= COMMON
    column, at = np.cumsum(often) - 1, often[x]
    cols, rows = column[x[at]], who[at]
    order = np.argsort(cols, kind="stable")
    cols, rows = cols[order], rows[order]
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(cols, [first, first + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[rows[a:b], cols[a:b] - first] = 1
        common += m[:n] @ m[n:].T
    at = ~often[x] & (times[x] > 1)
    x, who = x[at], who[at]
    order = np.lexsort((who, x))  # one shingle's sets stand together, those of ``left`` first
    x, who = x[order], who[order]
    for step in range(1, COMMON - 1):
        pair = (x[step:] == x[:-step]) & (who[:-step] < n) & (who[step:] >= n)
        np.add.at(common, (who[:-step][pair], who[step:][pair] - n), 1)
    return common


def within_large(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links inside groups of any size, between components; every two blocks of a group are compared once."""

    def pairs(unit: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(unit["lo"].iloc[0]), int(unit["hi"].iloc[0])
        left, right = (unit[unit["sub"] == k].sort_values("u") for k in (lo, hi))
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        read = lambda part: [np.frombuffer(x, np.uint64) for x in part["s"]]
        common = in_common(read(left), read(right))
        a, b = left["uc"].to_numpy(), right["uc"].to_numpy()
        size = left["un"].to_numpy()[:, None] + right["un"].to_numpy()[None, :]
        i, j = np.nonzero((100 * common >= percent * (size - common)) & (a[:, None] != b[None, :]))
        names, ends = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
        root = spanning(len(names), ends[: len(i)], ends[len(i) :])
        joined = root != np.arange(len(names))
        return pd.DataFrame({"u": names[joined], "v": names[root[joined]]})

    parts = F.ceil(F.greatest(F.max("many") / BLOCK, F.sum("un") / BLOCK_SHINGLES)).cast("int")
    dealt = groups.join(groups.groupBy("g").agg(parts.alias("parts")), "g").withColumn("sub", F.pmod(F.xxhash64("u"), "parts").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = dealt.select("g", "u", "uc", "un", "sub", F.least("sub", "with").alias("lo"), F.greatest("sub", "with").alias("hi"))
    return units.join(sets.withColumnRenamed("doc_id", "u"), "u").groupBy("g", "lo", "hi").applyInPandas(pairs, "u long, v long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    found = save(features(docs, n))
    classes = save(
        found.where("set_a IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    )
    names = save(found.drop("bands"))
    release(found)
    members = classes.select(F.explode("bands").alias("g"), F.col("rep").alias("u"), F.col("n").alias("un"))
    # what joins back to a hot key is saved first: Spark then splits the key's rows in the join
    many = save(members.groupBy("g").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    shared = save(members.join(many, "g"))
    reps = save(classes.select("set_a", "set_b", "rep"))
    release(classes, many)
    mass = shared.groupBy("u").agg(F.sum("many").alias("mass"))
    alike = 100 * F.col("common") >= percent * (F.col("un") + F.col("vn") - F.col("common"))
    central = F.struct(-F.col("mass"), F.col("u"))

    def starred(groups: DataFrame) -> DataFrame:
        centres = save(groups.groupBy("g").agg(F.min_by(F.struct(F.col("u").alias("v"), F.col("un").alias("vn"), F.col("mass").alias("vm")), central).alias("c")).select("g", "c.*"))
        stars = save(groups.join(centres, "g").where("u <> v").select("u", "v", "un", "vn", "vm", "mass").distinct())
        release(centres)
        return stars

    weighed = save(shared.select("g", "u", "un").join(mass, "u"))
    release(shared)
    bare = starred(weighed)
    first = bare.groupBy("u").agg(F.min(F.struct(-F.col("vm"), F.col("v"))).alias("f")).select("u", "f.v").withColumnRenamed("v", "f")
    stars = save(bare.join(first, "u").withColumn("root", F.col("v")))
    release(weighed, bare)
    # a set is made together with the names of its centres: only the centres' sets are read a second time
    of = stars.groupBy(F.col("u").alias("doc_id")).agg(F.collect_set("v").alias("of"))  # one for a band at most
    centres = stars.select(F.col("v").alias("doc_id"), F.lit(True).alias("centre")).distinct()
    wanted = save(of.join(centres, "doc_id", "full"))
    sets = save(shingle_sets(docs, wanted, n))
    release(wanted)
    members, centres = sets.select(F.col("doc_id").alias("u"), F.explode("of").alias("v"), "s"), sets.where("centre")
    common = overlaps(members, centres.select(F.col("doc_id").alias("v"), F.col("s").alias("t")))
    looked = save(stars.join(common, ["u", "v"]).withColumn("linked", alike))
    label = save(components(looked.where("linked").select("u", "v")))
    groups = spread(looked, label, percent)
    release(stars, looked)
    # what follows reads the sets of what may still be linked, and no others
    old, sets = sets, save(sets.select("doc_id", "s").join(groups.select(F.col("u").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    release(old)
    small, large = groups.where(F.col("many") <= SMALL), groups.where(F.col("many") > SMALL)
    links = [label.select(F.col("node").alias("u"), F.col("component").alias("v")), save(within_small(small, sets, percent))]
    if not large.isEmpty():
        links.append(save(within_large(large, sets, percent)))
    release(groups, sets)
    label = save(components(functools.reduce(DataFrame.unionByName, links)))

    reps = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("set_a", "set_b", F.coalesce("component", "rep").alias("of_set"))
    out = names.join(reps, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
