"""Language-model scores from a hierarchical Pitman-Yor model, seated by Gibbs sweeps.

Each context, the word before, is a restaurant of its own, whatever its frequency; text starts share
one.  The tables of all of them are the customers of the unigram restaurant, whose parent gives half
its mass to unseen words and half to the vocabulary in equal parts.  A Gibbs step takes all customers of
one dish out of a restaurant and seats them anew, given the tables of the restaurant's other dishes and the
parent without this dish's own tables (``seat``: the exact joint distribution of the number of tables).
A sweep does so for every dish of every restaurant at once, given the sweep before.  The scores
average the predictive probabilities of the sweeps after burn-in.  Discounts are fitted by the numbers
of dishes eaten once and twice; strengths are constants.

Texts are cut into chunks, whose distinct cells (word, word before) are dealt to buckets by word; the
number of buckets follows the text's length.  A bucket adds up the cells of its words over all chunks and
sorts its restaurants by the part that adds up their tables over all buckets after each sweep; who
has which place in a part is worked out once (``route``), after which only small numbers travel.
At the end each bucket answers each chunk's cells, and the chunk, tokenized once more, adds up its texts.
Logarithms travel to six decimals.  Nothing but a few sums goes to the driver, and no table is broadcast.  Tables that are no longer
needed are deleted on the way.

What is approximate: the ``SWEEPS - BURN_IN`` sweeps averaged are few; the dishes of a sweep are seated
side by side; customers beyond the first ``EXACT`` of a dish count as a continuous stream; words are told apart by 64-bit hashes, contexts by 48 bits of them.  All
contexts of a word meet in one bucket, so a word's distinct neighbours must fit a task.

Defined cases: null and empty texts are their end token; rows with a null id are dealt to a fold as
the text 'null'; repeated rows all count and get equal scores; without training rows every word is
unseen and the vocabulary empty; an empty table gives an empty result; other columns are not read.
``docs`` is read twice and must come in the same order, as a table does; if not, the scoring fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import crc_mod, release, save
from wardline.shared import save_by

FOLDS = 10
BUCKET_TOKENS, CHUNK_BYTES, WORD_BYTES = 1_000_000, 6_000_000, 6  # they bound a task's memory only
SWEEPS, BURN_IN = 5, 2
STRENGTH = (5.0, 50.0)  # of contexts, of the unigram restaurant
EXACT, UNSEEN = 512, 0.5
TOGETHER = 8000  # dishes times tables that are as fast to seat as few
END = b""  # no word is empty, so the empty string stands for the end token, and before the first word for the start


# ---------------------------------------------------------------- counting


def tokens(texts: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the number of each token's word, tokens of each text), each text with its end token."""
    texts = pc.take(texts.combine_chunks(), np.arange(len(texts)))  # a copy: kernels misread the offsets of slices
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = pc.list_flatten(lists).dictionary_encode()
    words, number = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    if END in words:  # white space at the ends of a text
        end = words.index(END)
        text, number = text[number != end], number[number != end]
    else:
        end = len(words)
        words.append(END)
    found = np.full(len(number) + len(texts), end, np.int64)
    found[np.arange(len(number)) + text] = number
    return words, found, np.bincount(text, minlength=len(texts)) + 1


def small(x: np.ndarray) -> bytes:
    """Numbers, most of them below 255, in a byte each; the others follow."""
    large = x >= 255
    return np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype(np.int64).tobytes()


def unsmall(b: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(b, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(b, np.int64, offset=n)
    return x


def narrow(x: np.ndarray, width: int) -> bytes:
    """Numbers in ``width`` bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def wide(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.int64)


def numbers(x: np.ndarray, top: int) -> bytes:
    return narrow(x, 3 if top < 1 << 24 else 4)


def unnumbers(b: bytes, n: int) -> np.ndarray:
    return wide(b, len(b) // n) if n else np.empty(0, np.int64)


NAME = np.uint64((1 << 48) - 1)
CELLS = "bucket int, chunk long, mark long, words binary, runs binary, before binary, n binary"
TEXTS = "chunk long, mark long, id binary, null binary, held binary, size binary, at binary"


def deal(docs: DataFrame, buckets: int, texts: bool) -> DataFrame:
    """CELLS: for each chunk and bucket the chunk's distinct cells by word, with their training counts.  TEXTS: for
    each chunk its texts and the cell at which each token stands.  Mark names the cells of a chunk."""
    kinds = TEXTS if texts else CELLS
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in kinds.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) - 1

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            words, word, size = tokens(t["text"])
            held = t["held"].to_numpy().astype(bool)
            key = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            of = (key % np.uint64(buckets)).astype(np.int64)
            before = np.concatenate([word[-1:], word[:-1]])  # each text ends with the end token
            at, cell = pd.factorize(word * len(words) + before)
            w, b = cell // len(words), cell % len(words)
            if len(words) ** 2 * buckets < 1 << 63:
                order = np.argsort((of[w] * len(words) + w) * len(words) + b)  # no two are equal, so every machine sorts alike
            else:
                order = np.lexsort((b, w, of[w]))
            mark = xxhash.xxh3_64_intdigest(key[w[order]].tobytes()) - (1 << 63)
            if texts:
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                ids = t["doc_id"]
                out = [(number, mark, pc.fill_null(ids, 0).to_numpy().tobytes(), ids.is_null().to_numpy().tobytes(), held.tobytes(), small(size), numbers(rank[at], len(cell)))]
            else:
                n = np.bincount(at, np.repeat(~held, size), len(cell)).astype(np.int64)[order]
                w, b = w[order], b[order]
                start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                runs = np.diff(np.append(start, len(w)))
                edges = np.searchsorted(of[w], np.arange(buckets + 1))
                ends = np.searchsorted(start, edges)
                out = [
                    (k, number, mark, key[w[start[e:f]]].tobytes(), small(runs[e:f]), narrow((key[b[i:j]] & NAME).astype(np.int64), 6), small(n[i:j]))
                    for k, (i, j, e, f) in enumerate(zip(edges[:-1], edges[1:], ends[:-1], ends[1:], strict=True))
                    if j > i
                ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        parts, pending = [], 0
        for batch in batches:
            reach = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = reach[start - 1] if start else 0
                stop = min(int(np.searchsorted(reach, done + CHUNK_BYTES - pending)) + 1, batch.num_rows)
                parts.append(batch.slice(start, stop - start))
                pending, start = pending + reach[stop - 1] - done, stop
                if pending >= CHUNK_BYTES:
                    number += 1
                    yield flush(parts)
                    parts, pending = [], 0
        if parts:
            number += 1
            yield flush(parts)

    return docs.select(F.col("doc_id").cast("string").cast("long").alias("doc_id"), "held", F.col("text").cast("string").alias("text")).mapInArrow(rows, kinds)


#: Of kind 0 a bucket's cells, of kind 1 its contexts for ``route``, of kind 2 the cells each chunk asks for.
BUILT = "kind int, bucket int, cells int, rooms int, runs binary, room binary, n binary, edges binary, names binary, sums binary, chunk binary, mark binary, size binary, at binary"


def build_bucket(part: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Cells in order of word and context, contexts in order of their part and name, whatever the order of chunks."""
    part = part.sort_values("chunk")
    words = np.frombuffer(b"".join(part["words"]), np.uint64)
    each = [len(x) // 8 for x in part["words"]]
    word = np.repeat(words, np.concatenate([unsmall(b, n) for b, n in zip(part["runs"], each, strict=True)]))
    size = part["before"].map(len).to_numpy(np.int64) // 6
    name = wide(b"".join(part["before"]), 6)
    n = np.concatenate([unsmall(b, k) for b, k in zip(part["n"], size, strict=True)])
    known, word = np.unique(word, return_inverse=True)
    names, room = np.unique(name, return_inverse=True)
    order = np.argsort(names % parts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    names = names[order]
    cell, at = np.unique(word * len(names) + place[room], return_inverse=True)
    n = np.bincount(at, n, len(cell)).astype(np.int64)
    word, room = cell // len(names), cell % len(names)
    runs = np.bincount(word, minlength=len(known))
    trained = np.bincount(word, n > 0, len(known))
    sums = [n.sum(), (trained > 0).sum(), (n == 1).sum(), (n == 2).sum(), (trained == 1).sum(), (trained == 2).sum()]
    edges = np.searchsorted(names % parts, np.arange(parts + 1)).astype(np.int32)
    customers = np.bincount(room, n, len(names)).astype(np.int64)
    both = {"bucket": part["bucket"].iloc[0], "cells": len(cell), "rooms": len(names), "edges": edges.tobytes()}
    rows = [
        both | {"kind": 0, "runs": small(runs), "room": numbers(room, len(names)), "n": small(n)},
        both | {"kind": 1, "names": narrow(names, 6), "n": small(customers), "sums": np.array(sums, np.int64).tobytes()},
        both | {"kind": 2, "chunk": part["chunk"].to_numpy(np.int64).tobytes(), "mark": part["mark"].to_numpy(np.int64).tobytes(), "size": size.tobytes(), "at": numbers(at, len(cell))},
    ]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in BUILT.split(", ")])


# ---------------------------------------------------------------- seating


def seat(rng: np.random.Generator, n: np.ndarray, first: np.ndarray, more: np.ndarray, discount: float) -> np.ndarray:
    """Numbers of tables of n customers of one dish each, drawn from their joint distribution: a customer joins a
    table with odds seated - discount, t tables taken together seated - discount * t, and opens the table
    after t of them with odds first + more * t."""
    tables = np.minimum(n, 1)
    u = rng.random(len(n))
    # Behind the first EXACT customers their number grows by a share of itself: t tables then lose odds as exp(-discount * t)
    # per e-fold and open others, which is a linear birth process; its solution tilts the odds so far and adds a mixed Poisson number
    large = np.flatnonzero(n > EXACT)
    gone = (EXACT / n[large]) ** discount
    q = more[large] / discount * (1 - gone)
    tilt = np.ones(len(n))
    tilt[large] = gone / (1 - q)
    lows = [1, 2, 4, 8, 16, 32, 64, 128, 256]
    for low, high in zip(lows, [*lows[1:], EXACT], strict=True):
        some = np.flatnonzero((n > low) & ((n <= high) | (high == EXACT)))
        mean = np.ones(len(some))
        reach = np.minimum(n[some], EXACT)
        i = 1
        while i < reach.max(initial=1):  # about the number of tables, to bound those that matter
            odds = first[some] + more[some] * mean
            mean += np.clip(reach - i, 0, i) * odds / (i - discount * mean + odds)
            i *= 2
        class_ = np.ceil(2 * np.log2(mean)).astype(int)
        rows_of = np.bincount(class_)
        top = rows = 0
        for c in np.flatnonzero(rows_of)[::-1].tolist():  # few dishes go with those of the class above
            rows += int(rows_of[c])
            if top and rows * 2 ** (top / 2) < TOGETHER:
                class_[class_ == c] = top
            else:
                top, rows = c, int(rows_of[c])
        for c in np.unique(class_).tolist():
            own, most = some[class_ == c], 2 ** (c / 2)
            spread = (most + most * most * (more[own] / np.maximum(first[own], 1e-300)).max()) ** 0.5
            width = int(min(high, most + 8 * spread + 6))
            step = max(1, 500_000 // min(high, width))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                rows = rows[np.argsort(-np.minimum(n[rows], EXACT), kind="stable")]
                tables[rows] = _exact(u[rows], np.minimum(n[rows], EXACT), first[rows], more[rows], discount, width, tilt[rows])
    lam = (q / (1 - q)) * rng.gamma(tables[large] + first[large] / np.maximum(more[large], 1e-12))
    tables[large] += rng.poisson(np.where(more[large] > 0, lam, first[large] / discount * (1 - gone)))
    return np.minimum(tables, n)


def _exact(u: np.ndarray, n: np.ndarray, first: np.ndarray, more: np.ndarray, discount: float, width: int, tilt: np.ndarray) -> np.ndarray:
    """One draw for each dish; n descends.  f has the odds of 1, 2, ... tables after so many customers."""
    width = min(width, int(n[0]))
    t = np.arange(1, width + 1, dtype=float)
    f = np.zeros((len(n), width))
    f[:, 0] = 1
    opens = first[:, None] + more[:, None] * t[:-1]
    active = np.searchsorted(-n, -np.arange(1, n[0]))  # dishes with more than i customers
    for i, k in enumerate(active, 1):
        top = min(i + 1, width)
        g = f[:k, :top] * (i - discount * t[:top])
        g[:, 1:] += f[:k, : top - 1] * opens[:k, : top - 1]
        f[:k, :top] = g / (g.sum(axis=1, keepdims=True) if i % 8 == 0 else i)
    total = np.cumsum(f * tilt[:, None] ** (t - 1), axis=1)
    return 1 + (total[:, :-1] <= u[:, None] * total[:, -1:]).sum(axis=1)


class Bucket:
    """A bucket's restaurants, and what it knows of the whole: sums are the tokens, the vocabulary and the
    numbers of dishes that fit the discounts."""

    def __init__(self, row, sums: np.ndarray):
        self.number, cells, self.rooms = int(row.bucket), int(row.cells), int(row.rooms)
        self.room, self.n = unnumbers(row.room, cells), unsmall(row.n, cells)
        at = np.frombuffer(row.edges, np.int32)
        self.edges = at
        runs, got = [], 0
        body = np.frombuffer(row.runs, np.uint8)
        got = self._words(body, cells)
        runs = unsmall(row.runs, got)
        self.word, self.n_words = np.repeat(np.arange(got), runs), got
        self.count = np.bincount(self.word, self.n, got).astype(np.int64)
        self.total, vocabulary, n1, n2, w1, w2 = (int(x) for x in sums)
        fit = lambda one, two: min(0.95, max(0.05, one / max(one + 2 * two, 1)))
        self.discount = (fit(n1, n2), fit(w1, w2))
        self.vocabulary, self.base = vocabulary, (1 - UNSEEN) / max(vocabulary, 1)

    @staticmethod
    def _words(body: np.ndarray, cells: int) -> int:
        """How many of the bytes are runs: they and what follows them for 255 add up to the cells."""
        n = len(body)
        for words in range(n, -1, -8):
            if words + 8 * int((body[:words] == 255).sum()) == n:
                return words
        raise ValueError("damaged runs")

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """The first state: a table for each dish in each restaurant."""
        tables = np.minimum(self.n, 1)
        return tables, np.minimum(self.guests(tables), 1)

    def guests(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, tables, self.n_words).astype(np.int64)

    def parent(self, guests: np.ndarray, up: np.ndarray, whole: tuple[int, int], gone=0) -> np.ndarray:
        """Probability in the unigram restaurant, of whose guests ``gone`` have left."""
        d, s = self.discount[1], STRENGTH[1]
        left = guests - gone
        fresh = (s + d * whole[0]) * np.where(self.count > 0, self.base, UNSEEN)
        return (left - d * np.minimum(up, left) + fresh[: len(left)]) / (s + whole[1] - gone)

    def sweep(self, k: int, tables: np.ndarray, up: np.ndarray, room_tables: np.ndarray, whole: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """New (tables, tables of the unigram restaurant), given the old ones and the tables of all buckets."""
        rng = np.random.default_rng([k, self.number])
        (d, up_d), (s, up_s) = self.discount, STRENGTH
        guests = self.guests(tables)
        w, left = self.word, guests[self.word] - tables
        fresh = (up_s + up_d * whole[0]) * self.base
        p = (left - up_d * np.minimum(up[w], left) + fresh) / (up_s + whole[1] - tables)
        others = room_tables[self.room] - tables
        new = seat(rng, self.n, (s + d * others) * p, d * p, d)
        guests = self.guests(new)
        again = seat(rng, guests, (up_s + up_d * (whole[0] - up)) * self.base, np.full(len(up), up_d * self.base), up_d)
        return new, again

    def predict(self, tables: np.ndarray, up: np.ndarray, room_tables: np.ndarray, customers: np.ndarray, whole: tuple[int, int]) -> np.ndarray:
        """Probability of each cell."""
        d, s = self.discount[0], STRENGTH[0]
        p = self.parent(self.guests(tables), up, whole)[self.word]
        return (self.n - d * tables + (s + d * room_tables[self.room]) * p) / (s + customers[self.room])

    def by_room(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.room, x, self.rooms).astype(np.int64)


# ---------------------------------------------------------------- exchange


TOTALS = -1  # the part, and the bucket, of sums over all buckets
SENT, MOVED = "part int, bucket int, size int, v binary", "kind int, part int, bucket int, size int, v binary"


def send(kind, number: int, edges: np.ndarray, v: np.ndarray, sums: list[int]) -> list[tuple]:
    out = [(kind, p, number, int(j - i), small(v[i:j])) for p, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
    return [*out, (kind, TOTALS, number, 0, np.array(sums, np.int64).tobytes())]


def total_row(part: pd.DataFrame) -> tuple:
    return 0, TOTALS, TOTALS, 0, sum(np.frombuffer(v, np.int64) for v in part["v"]).tobytes()


def frame(rows: list[tuple], kinds: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in kinds.split(", ")])


def first_sent(contexts: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                edges, names, v = np.frombuffer(r.edges, np.int32), r.names, unsmall(r.n, r.rooms)
                out = send(0, r.bucket, edges, v, np.frombuffer(r.sums, np.int64))
                cut = {p: names[6 * i : 6 * j] for p, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True))}
                yield frame([(*row[1:], cut.get(row[1], b"")) for row in out], SENT + ", names binary")

    return contexts.mapInPandas(rows, SENT + ", names binary")


def route(part: pd.DataFrame) -> pd.DataFrame:
    """Of kind 0 each bucket's contexts with their customers in all buckets, of kind 1 their places in the part."""
    part = part.sort_values("bucket")
    if (number := part["part"].iloc[0]) == TOTALS:
        return frame([total_row(part)], MOVED)
    names, at = np.unique(wide(b"".join(part["names"]), 6), return_inverse=True)
    sizes = part["size"].tolist()
    total = np.bincount(at, np.concatenate([unsmall(v, n) for v, n in zip(part["v"], sizes, strict=True)]), len(names)).astype(np.int64)
    edges = np.cumsum([0, *sizes])
    out = []
    for b, i, j in zip(part["bucket"].tolist(), edges[:-1], edges[1:], strict=True):
        out += [(0, number, b, int(j - i), small(total[at[i:j]])), (1, number, b, int(j - i), numbers(at[i:j], len(names)))]
    return frame(out, MOVED)


def add_up(sent: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
    """Each bucket's numbers, added up over all buckets."""
    sent, places = sent.sort_values("bucket"), places.sort_values("bucket")
    if len(sent) and (number := sent["part"].iloc[0]) == TOTALS:
        return frame([total_row(sent)], MOVED)
    if not len(sent):
        return frame([], MOVED)
    at = [unnumbers(v, n) for v, n in zip(places["v"], places["size"], strict=True)]
    total = np.bincount(np.concatenate(at), np.concatenate([unsmall(v, n) for v, n in zip(sent["v"], sent["size"], strict=True)])).astype(np.int64)
    return frame([(0, number, b, len(x), small(total[x])) for b, x in zip(sent["bucket"].tolist(), at, strict=True)], MOVED)


def in_order(replies: pd.DataFrame) -> np.ndarray:
    """A bucket's numbers for its contexts from the replies of all parts."""
    replies = replies.sort_values("part")
    found = [unsmall(v, n) for v, n in zip(replies["v"], replies["size"], strict=True)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def sums_of(replies: DataFrame) -> np.ndarray:
    return np.frombuffer(replies.where(F.col("bucket") == TOTALS).first().v, np.int64)


KNOWN = "k int, kind int, bucket int, part int, size int, v binary, up binary"


def known(k: int, replies: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """What a bucket is told of sweep k: replies (kind 1) and its own state (kind 0)."""
    told = replies.where(F.col("bucket") != TOTALS).select(F.lit(k).alias("k"), F.lit(1).alias("kind"), "bucket", "part", "size", "v", F.lit(None).cast("binary").alias("up"))
    if state is None:
        return told
    return told.unionByName(state.select(F.lit(k).alias("k"), F.lit(0).alias("kind"), "bucket", "part", "size", "v", "up"))


def state_of(b: Bucket, told: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tables, tables of the unigram restaurant, tables of each context in all buckets) after sweep k."""
    mine = told[told["k"] == k]
    own = mine[mine["kind"] == 0]
    rooms = in_order(mine[mine["kind"] == 1])
    return unsmall(own["v"].iloc[0], len(b.n)), unsmall(own["up"].iloc[0], b.n_words), rooms


STATE = "kind int, part int, bucket int, size int, v binary, up binary"


def sweeps(cells: DataFrame, contexts: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame, DataFrame, np.ndarray]], np.ndarray]:
    """(customers, [(sweep, replies, state, sums)] after burn-in, sums of the corpus)."""
    customers, places = save_by(first_sent(contexts).groupBy("part").applyInPandas(route, MOVED), "kind", 2)
    sums = sums_of(customers)
    release(contexts)

    def step(k: int, whole):
        def swept(part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in part.itertuples():
                b = Bucket(row, sums)
                tables, up = b.sweep(k, *state_of(b, told, k - 1), (int(whole[0]), int(whole[1]))) if k else b.start()
                moved = send(1, b.number, b.edges, b.by_room(tables), [int(up.sum()), int(b.guests(tables).sum())])
                out += [(0, 0, b.number, 0, small(tables), small(up)), *((*m, None) for m in moved)]
            return frame(out, STATE)

        return swept

    kept: list = []
    last = None
    for k in range(SWEEPS + 1):
        told = known(k - 1, last[1], last[2]) if last else known(0, customers.limit(0))
        state, sent = save_by(cells.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(step(k, last[3] if last else None), STATE), "kind", 2)
        replies = save(sent.select("part", "bucket", "size", "v").groupBy("part").cogroup(places.select("part", "bucket", "size", "v").groupBy("part")).applyInPandas(add_up, MOVED))
        release(sent)
        if last and last[0] <= BURN_IN:
            release(last[1], last[2])
        last = (k, replies, state, sums_of(replies))
        if k > BURN_IN:
            kept.append(last)
        forget(cells)
    release(places)
    return customers, kept, sums


def forget(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of what is over."""
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()


# ---------------------------------------------------------------- scoring


LOG = 1 << 20  # negative decimal logarithms travel as whole multiples of 1 / LOG, in three bytes
VALUES = "bucket int, cells int, p binary, count binary"


def cell_values(cells: DataFrame, customers: DataFrame, kept: list, sums: np.ndarray) -> DataFrame:
    """(bucket, p, count) of its cells: averaged probabilities, and training counts of the words."""
    told = known(-1, customers)
    for k, replies, state, _ in kept:
        told = told.unionByName(known(k, replies, state))
    whole = {k: (int(t[0]), int(t[1])) for k, _, _, t in kept}

    def values(part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in part.itertuples():
            b = Bucket(row, sums)
            guests = in_order(told[told["k"] == -1])
            p = sum(b.predict(*state_of(b, told, k), guests, whole[k]) for k in whole) / len(whole)
            out.append((b.number, len(p), narrow(np.minimum(np.rint(-np.log10(p) * LOG), (1 << 24) - 1), 3), small(b.count[b.word])))
        return frame(out, VALUES)

    return cells.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(values, VALUES)


ANSWERS = "chunk long, mark long, bucket int, size int, p binary, count binary"


def answers(asked: DataFrame, values: DataFrame) -> DataFrame:
    """For each chunk and bucket the values of the chunk's cells, in its order."""

    def rows(part: pd.DataFrame, value: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, v in zip(part.itertuples(), value.itertuples(), strict=True):
            p, count = wide(v.p, 3), unsmall(v.count, v.cells)
            size = np.frombuffer(row.size, np.int64)
            at, edges = unnumbers(row.at, int(size.sum())), np.cumsum([0, *size])
            for chunk, mark, i, j in zip(np.frombuffer(row.chunk, np.int64).tolist(), np.frombuffer(row.mark, np.int64).tolist(), edges[:-1], edges[1:], strict=True):
                out.append((chunk, mark, row.bucket, int(j - i), narrow(p[at[i:j]], 3), small(count[at[i:j]])))
        return frame(out, ANSWERS)

    return asked.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInPandas(rows, ANSWERS)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), "text", (crc_mod(id_col, FOLDS) == 0).alias("held"))
    rows, length = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], SCORED)
    buckets = max(1, -(-(length or 0) // (WORD_BYTES * BUCKET_TOKENS)))
    built = deal(docs, buckets, False).groupBy("bucket").applyInPandas(lambda part: build_bucket(part, buckets), BUILT)
    cells, contexts, asked = save_by(built, "kind", 3)
    forget(docs)
    slim = cells.select("bucket", "cells", "rooms", "runs", "room", "n", "edges")
    customers, kept, sums = sweeps(slim, contexts)
    values = save(cell_values(slim, customers, kept, sums))
    release(cells, customers, *(t for k in kept for t in k[1:3]))
    forget(docs)
    total, vocabulary = int(sums[0]), int(sums[1])

    def texts(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in part.itertuples():
            mine = answers.sort_values("bucket")
            if (mine["mark"] != row.mark).any():
                raise ValueError("the documents came in another order when they were read again: save them as a table first")
            logs = -wide(b"".join(mine["p"]), 3) / LOG
            count = np.concatenate([unsmall(v, n) for v, n in zip(mine["count"], mine["size"], strict=True)])
            base = np.log10((count + 0.1) / (total + 0.1 * (vocabulary + 1)))
            n = len(row.null)
            size = unsmall(row.size, n)
            at = unnumbers(row.at, int(size.sum()))
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            ids = pd.array(np.frombuffer(row.id, np.int64), dtype="Int64")
            ids[np.frombuffer(row.null, bool)] = pd.NA
            add = lambda x: np.add.reduceat(x[at], starts)  # noqa: B023, E731
            out.append(pd.DataFrame({"doc_id": ids, "held_out": np.frombuffer(row.held, bool), "n_tokens": size, "n_known": add((count > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(logs)}))
        return pd.concat(out) if out else frame([], SCORED)

    return deal(docs, buckets, True).groupBy("chunk").cogroup(answers(asked.select("bucket", "chunk", "mark", "size", "at"), values).groupBy("chunk")).applyInPandas(texts, SCORED)
