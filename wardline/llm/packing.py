"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

A round range-sorts the unplaced pieces together with the gaps of the open sequences by size,
largest first and gaps before pieces of the same size.  Along this order a piece takes the nearest
gap before it that no larger piece has taken: its successor, the smallest free gap that holds it.
Read gaps as opening and pieces as closing brackets and the sweep is bracket matching, which needs
no sequential pass: a running sum (a sum for each range partition, then an offset for each) gives
each bracket its depth, and at each depth a piece matches the row just before it if that is a gap.
So conflicts are resolved by rank.  A depth holds at most one gap and one piece of each size, which
bounds its rows by twice the capacity however many rows share a length.  Then gaps are updated and
the next round begins.  A gap that holds several pieces of the largest unplaced size offers as many
slots at once; pieces larger than every gap open as many new sequences as their sum needs.

Defined cases: null text is the empty text, which is its end token alone; repeated rows are packed
once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import save

CAPACITY = 2048
CACHED = 350_000  # entries of a generation of a worker's caches
KEPT = 60_000  # entries that stay in a cache between tasks


#: Byte-level vocabularies spell bytes that are no visible Latin-1 character as U+0100 and on, in order.
SPELLED = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)), range(256, 512), strict=False))


# How the tokenizer files that code word by word normalize and split text.
WORDWISE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "suffix": "</w>",
}


def by_words(spec: dict) -> bool:
    """Whether a tokenizer, as its file describes it, codes each word between white space by itself,
    and a lower-cased run of letters in it too."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == WORDWISE["normalizer"]
        and [s["type"] for s in splits] == WORDWISE["pre_tokenizer"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": WORDWISE["pattern"]}, "Removed", True)
        and (splits[1]["add_prefix_space"], splits[1]["use_regex"]) == (False, False)
        and (spec["model"]["type"], spec["model"].get("end_of_word_suffix"), spec["model"].get("dropout")) == ("BPE", WORDWISE["suffix"], None)
        and spec.get("post_processor") is None
    )


class Known(dict):
    """Codes of what has been asked for, in two generations: the older is dropped when the newer is full."""

    def __init__(self, code):
        self.code, self.old = code, {}

    def __missing__(self, key):
        found = self.old.get(key)
        self[key] = found = self.code(key) if found is None else found
        return found

    def bound(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()

    def trim(self) -> None:
        """Keep what was asked for first, which is what texts ask for most: an idle worker holds no more."""
        first, self.old = dict(islice((self.old | self).items(), KEPT)), {}
        self.clear()
        self.update(first)


class Encoder:
    """Texts -> their ids as little-endian bytes.

    A tokenizer that splits text at white space, and between letters and other signs but for
    contractions, before it merges, codes each word by itself; so words between ASCII white space are
    encoded once each and remembered, and plain words fall into runs of letters and of signs that are
    remembered too.  A run of letters is one piece, which goes to the merge model at once, its bytes
    spelled as the file does.  Words with apostrophes, opening angles or characters beyond Latin letters
    are encoded whole.  Whether a tokenizer is of this kind is read from its file (``by_words``); with
    any other one whole texts are encoded.
    """

    LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
    PLAIN = re.compile(f"[!-&(-;=-~{LETTER}]+")
    RUNS = re.compile(f"[{LETTER}]+|[^{LETTER}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words(json.loads(self.tokenizer.to_str()))
        self.ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.words, self.runs = Known(self.code_word), Known(self.code_run)
        self.merged = self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def code_run(self, run: str) -> bytes:
        if not run[0].isalpha():
            return self.whole(run)
        ids = self.ids
        return b"".join([ids[t.id] for t in self.merged(run if run.isascii() else run.encode().decode("latin-1").translate(SPELLED))])

    def code_word(self, word: bytes) -> bytes:
        text = word.decode()
        if not self.PLAIN.fullmatch(text):
            return self.whole(text)
        text = text.lower()
        return self.runs[text] if text.isalpha() else b"".join(map(self.runs.__getitem__, self.RUNS.findall(text)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            raw = text.encode("utf-8", "replace")
            if self.by_words:
                yield b"".join(map(self.words.__getitem__, raw.split()))
                self.words.bound()
                self.runs.bound()
            else:
                yield self.whole(raw.decode())


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, cut only beyond ``capacity``."""
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], coder.encode([t or "" for t in batch["text"]]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        coder.words.trim()
        coder.runs.trim()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(pieces, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


def match(docs: DataFrame, gaps: DataFrame, largest: int) -> DataFrame:
    """One sweep: (uid, length, bin) of the pieces that found a gap.  docs: uid, length; gaps: bin, gap."""
    held = F.greatest(F.floor(F.col("gap") / largest), F.lit(1)).cast("int")
    slots = gaps.withColumn("held", held).select(
        F.col("bin").alias("id"), F.explode(F.sequence(F.lit(1), F.col("held"))).alias("slot"), "gap", "held"
    )
    slots = slots.select("id", "slot", F.when(F.col("slot") < F.col("held"), largest).otherwise(F.col("gap") - (F.col("held") - 1) * largest).cast("long").alias("size"), F.lit(0).alias("kind"))
    rows = slots.unionByName(docs.select(F.col("uid").alias("id"), F.lit(0).alias("slot"), F.col("length").alias("size"), F.lit(1).alias("kind")))
    order = [F.col("size").desc(), F.col("kind"), F.col("id"), F.col("slot")]
    rows = save(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))

    step = F.when(F.col("kind") == 0, 1).otherwise(-1)
    sums = dict(rows.groupBy("range").agg(F.sum(step)).collect())  # a row for each partition
    ranges = sorted(sums)
    starts = dict(zip(ranges, accumulate([0, *(sums[r] for r in ranges)]), strict=False))
    offset = F.create_map(*(F.lit(x) for r in ranges for x in (r, starts[r])))[F.col("range")]
    along = Window.partitionBy("range").orderBy(*order)
    after = offset + F.sum(step).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("depth", after + F.col("kind"))
    at_depth = Window.partitionBy("depth").orderBy(*order)
    rows = rows.withColumn("before", F.lag(F.struct("kind", "id")).over(at_depth))
    return rows.where("kind = 1 AND before.kind = 0").select(F.col("id").alias("uid"), F.col("size").alias("length"), F.col("before.id").alias("bin"))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, bin) for each piece (uid, length <= capacity)."""
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("bin"))
    docs, placed = pieces.where(F.col("length") < capacity).select("uid", "length"), [full]
    gaps, opened, widest = spark.createDataFrame([], "bin long, gap long"), 0, 0
    while True:
        unfit = F.col("length") > widest
        n, largest, least, total, big, over = docs.agg(
            F.count(F.lit(1)), F.max("length"), F.min("length"), F.sum(F.when(unfit, F.col("length"))),
            F.count(F.when(unfit & (F.col("length") * 2 > capacity), 1)), F.count(F.when(unfit, 1)),
        ).first()
        if not n:
            break
        if over:
            new = max(-(-total // capacity), big)
            gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap")))
            opened += new
        found = save(match(docs, gaps.where(F.col("gap") >= least), largest))
        placed.append(found.select("uid", "bin"))
        docs = save(docs.join(found.select("uid"), "uid", "left_anti"))
        used = found.groupBy("bin").agg(F.sum("length").alias("used"))
        gaps = save(gaps.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"))
        widest = gaps.agg(F.max("gap")).first()[0] or 0
    return functools.reduce(DataFrame.unionByName, placed)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = save(token_pieces(docs, tokenizer_path, capacity).withColumn("uid", F.monotonically_increasing_id()))
    placed = best_fit(pieces.select("uid", "length"), capacity)
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "uid")  # at most `capacity` rows
    out = pieces.join(placed.withColumnRenamed("bin", "sequence_id"), "uid")
    return out.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).drop("uid")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    return pack(docs, tokenizer_path or default_tokenizer())
