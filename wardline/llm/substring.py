"""Passages of ``LENGTH`` words or more that an earlier document has too: seed and extend.

Seeds are winnowed anchors: in each window of LENGTH words the smallest of its K-word hashes.  Two
equal windows pick the same anchor at the same place, so a shared passage always shares a seed.
Runs of windows with one anchor are rows (seed, hash of the run's whole text), which hold all places of
the run in a chunk of documents, so a passage that many documents have is a row a chunk.
Seeds that only one document has are dropped.  A run that occurs, as a whole, in an earlier
document is a match extended over all its windows at once.  What is left are the first documents
of each distinct run around a shared seed, whose texts agree only in part: there the match is
extended window by window, by the 128-bit hash of each window's words, to its maximal length.
Joins are on hashes, each distinct run stands for all its copies, and no group is ever paired up.

Defined cases: null text has no words; texts below LENGTH words lose nothing; a document's own
repeats are kept; rows with a null doc_id neither lose words nor cost others theirs; repeated rows
(equal id and text) are treated alike; an empty table gives an empty result; other columns pass
through ``dedup_text`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import likely, save, split_by_id

LENGTH, K = 50, 12
CHUNK_WORDS = 500_000  # words of the documents whose equal runs share a row
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of word ranges of one text, from prefix sums of two lanes of word hashes."""

    up, down = _powers(BASE, 1 << 12), _powers(INVERSE, 1 << 12)

    def __init__(self, words: list[bytes]):
        n = len(words)
        if n > len(Hashes.up):
            Hashes.up, Hashes.down = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)
        lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        self.sums = []
        for k in range(2):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(lanes[:, k] * Hashes.up[:n], out=s[1:])
            self.sums.append(s)

    def of(self, lane: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        s = self.sums[lane]
        x = (s[hi] - s[lo]) * Hashes.down[lo]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def anchors(h: Hashes, n: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, first window, last window) of the runs of windows with one anchor."""
    at = np.arange(n - k + 1)
    grams = h.of(0, at, at + k)
    value, where, span, width = grams, at, 1, length - k + 1
    while span < width:  # smallest, leftmost of `span` grams from each place on
        step = min(span, width - span)
        right, left = value[step:], value[: len(value) - step]
        take = right < left
        value = np.where(take, right, left)
        where = np.where(take, where[step:], where[: len(where) - step])
        span += step
    cut = np.flatnonzero(np.diff(where)) + 1
    first = np.concatenate([[0], cut])
    return grams[where[first]].view(np.int64), first, np.concatenate([cut, [len(where)]]) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """With text_key beside doc_id: rows that share an id but not a text are kept apart."""
    return docs.withColumn("__key", F.xxhash64("text"))


def find_runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(seed, run, chunk, least, most, places): each chunk's runs, their smallest and largest doc_id and
    (document's number in the chunk, first window, last window) of each place; with a null
    seed, the ids and keys of the chunk's documents."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, parts, ids, held = TaskContext.get().partitionId() << 32, [], [], 0

        def packed() -> pd.DataFrame:
            seed, run, doc, lo, hi = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((doc, run, seed))
            seed, run, places = seed[order], run[order], np.stack([doc, lo, hi], axis=1)[order].astype(np.int32)
            start = np.concatenate([[0], np.flatnonzero((seed[1:] != seed[:-1]) | (run[1:] != run[:-1])) + 1])
            names = np.array(ids, np.int64)
            of = names[places[:, 0], 0]
            buffer, ends = places.tobytes(), [*(12 * start[1:]).tolist(), 12 * len(places)]
            return pd.DataFrame({
                "seed": pd.array([*seed[start], None], "Int64"), "run": pd.array([*run[start], None], "Int64"), "chunk": chunk,
                "least": [*np.minimum.reduceat(of, start), 0], "most": [*np.maximum.reduceat(of, start), 0],
                "places": [*(buffer[i:j] for i, j in zip((12 * start).tolist(), ends, strict=True)), names.tobytes()],
            })

        for batch in batches:
            for doc_id, key, text in zip(batch["doc_id"].to_numpy(), batch["key"].to_numpy(), batch["text"], strict=True):
                words = text.encode("utf-8", "replace").split()
                if len(words) < length:
                    continue
                h = Hashes(words)
                seed, lo, hi = anchors(h, len(words), length, k)
                parts.append((seed, h.of(1, lo, hi + length).view(np.int64), np.full(len(lo), len(ids)), lo, hi))
                ids.append((doc_id, key))
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield packed()
                    chunk, parts, ids, held = chunk + 1, [], [], 0
        if parts:
            yield packed()

    have = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("__key").alias("key"), "text")
    return have.mapInPandas(runs, "seed long, run long, chunk long, least long, most long, places binary")


def unpacked(part: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, key, whole, partly) of a chunk: the runs that an earlier document has (a row's places
    after ``first``), and those whose first document this is."""
    names = np.frombuffer(part.loc[part["kind"] == 2, "places"].iloc[0], np.int64).reshape(-1, 2)
    found = {}
    for kind in (0, 1):
        own = part[part["kind"] == kind]
        places = np.frombuffer(b"".join(own["places"]), np.int32).reshape(-1, 3)
        first = np.repeat(own["first"].to_numpy(np.int64), own["places"].map(len).to_numpy(np.int64) // 12)
        of = names[places[:, 0], 0]
        places = places[of > first if kind == 0 else of == first]
        places = places[np.argsort(places[:, 0], kind="stable")]
        docs, start = np.unique(places[:, 0], return_index=True)
        for d, p in zip(docs.tolist(), np.split(places[:, 1:], start[1:]), strict=False):
            found.setdefault(d, [None, None])[kind] = [{"lo": lo, "hi": hi} for lo, hi in p.tolist()]
    out = [(*names[d].tolist(), *r) for d, r in found.items()]
    return pd.DataFrame(out, columns=["doc_id", "key", "whole", "partly"])


def hash_windows(docs: DataFrame, length: int) -> DataFrame:
    """(win_a, win_b, doc_id, key, at) of the windows in ``runs`` of each row of docs."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, key, text, runs in zip(batch["doc_id"].to_numpy(), batch["key"].to_numpy(), batch["text"], batch["runs"], strict=True):
                h = Hashes(text.encode("utf-8", "replace").split())
                at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in runs]))
                yield pd.DataFrame({"win_a": h.of(0, at, at + length).view(np.int64), "win_b": h.of(1, at, at + length).view(np.int64), "doc_id": doc_id, "key": key, "at": at})

    return docs.mapInPandas(windows, "win_a long, win_b long, doc_id long, key long, at int")


def covered_runs(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, key, runs): the windows lo..hi of each document that an earlier document has."""
    docs = _keyed(docs)
    packed = save(find_runs(docs, length, k))
    # what joins back to a hot seed is saved first: Spark then splits the seed's rows in the join
    runs = packed.where("seed IS NOT NULL")
    known = save(runs.groupBy("seed").agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a < b").select("seed"))
    runs = save(runs.join(known, "seed"))
    first = save(runs.groupBy("seed", "run").agg(F.min("least").alias("first")))
    several = save(first.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("seed"))
    runs = runs.join(first, ["seed", "run"]).where("most > first OR least = first")
    whole = runs.where("most > first").select("chunk", F.lit(0).alias("kind"), "first", "places")
    partly = runs.where("least = first").join(several, "seed").select("chunk", F.lit(1).alias("kind"), "first", "places")
    names = packed.where("seed IS NULL").select("chunk", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("first"), "places")
    spans = "array<struct<lo:int,hi:int>>"
    each = whole.unionByName(partly).unionByName(names).groupBy("chunk").applyInPandas(unpacked, f"doc_id long, key long, whole {spans}, partly {spans}")
    each = save(each)
    partly = each.where("partly IS NOT NULL")
    texts = likely(docs.select("doc_id", F.col("__key").alias("key"), "text"), partly).dropDuplicates(["doc_id", "key"])
    texts = texts.join(partly.groupBy("doc_id", "key").agg(F.first("partly").alias("runs")), ["doc_id", "key"])
    windows = save(hash_windows(texts.select("doc_id", "key", "text", "runs"), length))
    earliest = save(windows.groupBy("win_a", "win_b").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"))
    more = save(windows.join(earliest, ["win_a", "win_b"]).where("doc_id > a").select("doc_id", "key", F.col("at").alias("lo"), F.col("at").alias("hi")))
    more = more.groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    whole = each.where("whole IS NOT NULL").select("doc_id", "key", F.col("whole").alias("runs"))
    return whole.unionByName(more).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def cut(words: list[bytes], runs, length: int) -> list[bytes]:
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r["lo"]] += 1
        change[r["hi"] + length] -= 1
    return list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _with_runs(docs: DataFrame, length: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(row, runs): each whole row of docs, in a struct so that no column name can clash; and (row) of those that surely have no runs."""
    runs = save(covered_runs(docs, length, k).withColumnsRenamed({"doc_id": "of_id", "key": "of_key"}))
    some, rest = (x.select(F.struct(*x.columns).alias("row")) for x in split_by_id(docs, runs.select(F.col("of_id").alias("doc_id"))))
    return some.join(runs, (F.col("row.doc_id") == F.col("of_id")) & (F.xxhash64("row.text") == F.col("of_key")), "left").select("row", "runs"), rest


def digest(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, runs in zip(batch["doc_id"], batch["text"], batch["runs"], strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                kept = words if runs is None else cut(words, runs, length)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    some, rest = _with_runs(docs.select("doc_id", "text"), length, k)
    slim = some.unionByName(rest, allowMissingColumns=True).select(F.col("row.doc_id").cast("string").alias("doc_id"), "row.text", "runs")
    return slim.mapInPandas(rows, "doc_id string, n_words long, n_removed long, kept_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def dedup_text(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``docs`` with repeated passages cut out of text; a text that loses words becomes its kept
    words joined by one space."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if r is None else b" ".join(cut(t.encode("utf-8", "replace").split(), r, length)).decode() for t, r in zip(text, runs, strict=True)], dtype=object)

    some, rest = _with_runs(docs, length, k)
    return some.select(F.col("row").withField("text", kept("row.text", "runs")).alias("row")).union(rest).select("row.*")
