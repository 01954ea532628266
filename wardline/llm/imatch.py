"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band, counted over all
documents.  Each of ``FAMILIES`` families halves it at random again and again; a text's signature in a
family hashes, sorted, its distinct terms within the smallest of those lexicons that still holds any
of them.  So short and long texts alike are hashed by one or two terms a family, and the share of equal
signatures estimates the share of band terms that two texts have in common.

Defined cases: a null text counts as empty; a text without band terms is hashed by all its terms, a
text without terms by none, so that all such are alike; equal texts have equal fingerprints.  Rows are
ordered by id, null first, and rows of one id by their texts; repeated rows are rows of their own.
Further columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import save

#: Terms of at least LOW and at most HIGH bits of idf: in at most an eighth, at least a 2048th of all documents.
LOW, HIGH = 3, 11
FAMILIES = 32
#: Terms of a lexicon that a Python worker holds (about 150 bytes each); a larger one is joined.
HELD = 1_000_000
#: Terms counted in a task before they are handed on.
COUNTED = 300_000
#: Rows of an Arrow batch that are turned into Python strings at a time.
FEW = 200
#: Documents of a range of ids.
RANGE = 2000

MULTIPLIERS = np.array([int(hashlib.md5(f"lexicon {k}".encode()).hexdigest()[:16], 16) | 1 for k in range(FAMILIES)], dtype=np.uint64)


def term_hash(term: bytes) -> int:
    return int.from_bytes(hashlib.md5(term).digest()[:8], "big")


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python strings at a time."""
    return (batch.slice(k, FEW) for batch in batches for k in range(0, batch.num_rows, FEW))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in _few(batches):
        for text in batch.column(0).to_pylist():
            seen.update(set((text or b"").split()))
            if len(seen) > COUNTED:
                yield pa.RecordBatch.from_pydict({"term": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
    yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen.keys()), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): in how many documents each term stands; counted in each task before the shuffle."""
    parts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_counted, "term binary, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low: int = LOW, high: int = HIGH) -> DataFrame:
    """(term, df) of the band, saved.  At most 2 ** high times a document's mean number of distinct terms."""
    n = docs.count()
    df = F.col("df").cast("decimal(38,0)")
    return save(document_frequencies(docs, text_col).where((df * (1 << low) <= n) & (df * (1 << high) >= n)))


def signatures(terms: list[bytes], hashes: list[int]) -> str:
    """Eight hexadecimal digits a family, for distinct terms and their hashes."""
    if not terms:
        return hashlib.md5(b"").hexdigest()[:8] * FAMILIES
    drawn = (np.array(hashes, dtype=np.uint64)[:, None] * MULTIPLIERS) >> np.uint64(32)
    level = np.frexp(drawn.min(0).astype(np.float64))[1]
    families, rows = np.nonzero((drawn < np.left_shift(np.uint64(1), level.astype(np.uint64))).T)
    out: list[list[int]] = [[] for _ in range(FAMILIES)]
    for k, r in zip(families.tolist(), rows.tolist(), strict=True):
        out[k].append(r)
    # the first eight digits of a single term's md5 are those of its hash
    return "".join(f"{hashes[r[0]] >> 32:08x}" if len(r) == 1 else hashlib.md5(b" ".join(sorted(terms[i] for i in r))).hexdigest()[:8] for r in out)


def fingerprint(text: str, held: dict[bytes, int]) -> str:
    words = set(text.encode().split())
    band = list(held.keys() & words)
    if band:
        return signatures(band, [held[t] for t in band])
    return signatures(words := list(words), [term_hash(t) for t in words])


def likeness(a: Column, b: Column) -> Column:
    """Share of the families in which two fingerprints agree."""
    same = lambda k: (F.substr(a, k * 8 + 1, F.lit(8)) == F.substr(b, k * 8 + 1, F.lit(8))).cast("int")
    agree = F.aggregate(F.sequence(F.lit(0), F.lit(FAMILIES - 1)), F.lit(0), lambda n, k: n + same(k))
    return F.when(a == b, 1.0).otherwise(agree / F.lit(float(FAMILIES)))


def fingerprint_texts(texts: DataFrame, words_in: DataFrame, held: int | None = None) -> DataFrame:
    """``texts`` (any columns and a ``text``) with ``fingerprint`` in place of the text.  A lexicon of up to
    ``held`` terms goes to every worker; of a larger one each text is sent its own terms, by a join."""
    held = HELD if held is None else held
    rest = [c for c in texts.columns if c != "text"]
    if words_in.limit(held + 1).count() <= held:
        known = texts.sparkSession.sparkContext.broadcast([bytes(r.term) for r in words_in.select("term").collect()])

        @F.pandas_udf("string")
        def sign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = {t: term_hash(t) for t in known.value}
            for part in parts:
                yield part.map(lambda t: fingerprint(t, own))

        return texts.select(*rest, sign(F.coalesce("text", F.lit(""))).alias("fingerprint"))

    # equal texts are signed once; a text has as many rows here as it has distinct terms
    keyed = save(texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__digest", F.sha2("text", 256)))
    once = keyed.groupBy("__digest").agg(F.first("text").alias("text"))
    words = once.select("__digest", F.explode_outer(F.array_distinct(F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("array<binary>")).alias("term"))
    words = words.join(words_in.select("term", F.lit(True).alias("band")), "term", "left")
    terms = words.groupBy("__digest").agg(F.collect_list(F.when(F.col("band"), F.col("term"))).alias("band"), F.collect_list("term").alias("terms"))

    @F.pandas_udf("string")
    def sign_terms(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ts: signatures(ts := [bytes(t) for t in ts], [term_hash(t) for t in ts]))

    terms = save(terms.select("__digest", sign_terms(F.when(F.size("band") > 0, F.col("band")).otherwise(F.col("terms"))).alias("fingerprint")))
    return keyed.join(terms, "__digest").select(*rest, "fingerprint")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = LOW, high: int = HIGH, held: int | None = None) -> DataFrame:
    """(``id_col``, fingerprint) of every document."""
    return fingerprint_texts(docs.select(id_col, F.col(text_col).alias("text")), lexicon(docs, text_col, low, high), held)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, bucket, bridge): texts dealt by ranges of ids and sorted within them.  Behind each range stands, as
    ``bridge``, the first document of the range after it; behind the last, that of the first.  Texts are shuffled once."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = min(20_000, -(-docs.count() // RANGE)) or 1
    cuts = rows.select(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts[: n - 1], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(cuts, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    # an id as (is it there, id), so that null comes first; ids go to Python as whole numbers or not at all
    key = F.struct(F.col("id").isNotNull().alias("there"), F.coalesce("id", F.lit(0)).alias("id"))
    firsts = rows.select("id").withColumn("bucket", range_of("id")).groupBy("bucket").agg(F.min(key).alias("first")).orderBy("bucket").collect()  # one row a range
    before = {r.bucket: firsts[k - 1].bucket for k, r in enumerate(firsts)}
    starts = [(r.bucket, r.first.there, r.first.id, before[r.bucket]) for r in firsts]
    starts = docs.sparkSession.createDataFrame(starts, "bucket int, there boolean, first long, before int")
    rows = rows.withColumn("bucket", range_of("id")).join(F.broadcast(starts), "bucket")
    opens = (F.col("id").isNotNull() == F.col("there")) & (F.coalesce("id", F.lit(0)) == F.col("first"))
    own, ahead = F.struct("bucket", F.lit(False).alias("bridge")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("bridge"))
    rows = rows.select("id", "text", F.explode(F.when(opens, F.array(own, ahead)).otherwise(F.array(own))).alias("to")).select("id", "text", "to.*")
    return rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "bridge", "id", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
#: The same without fingerprints, for lexicons too large for a worker.
BARE = "doc_id long, n_chars long, edited_sha256 string, text string, edited string, next string"


def edit(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edited_fingerprints(docs: DataFrame, held: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    words_in = lexicon(docs)
    held = HELD if held is None else held
    inline = words_in.limit(held + 1).count() <= held
    known = docs.sparkSession.sparkContext.broadcast([bytes(r.term) for r in words_in.select("term").collect()] if inline else [])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {t: term_hash(t) for t in known.value}
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64())] + [(c, pa.string()) for c in ("edited_sha256", "a", "b", "c")])
        schema = pa.schema([pa.field(c.split()[0], f.type) for c, f in zip((EDITED if inline else BARE).split(", "), schema, strict=True)])
        sign = (lambda t: fingerprint(t, own)) if inline else (lambda t: t)
        held_back = None  # the row that waits for its next one: (bucket, id, text, print)
        for batch in _few(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("bucket", "bridge", "id", "text"))
            for bucket, bridge, id_, text in zip(*columns, strict=True):
                if bridge and held_back is None:
                    continue  # of rows that share a first id, the first is the bridge
                print_ = sign(text)
                if held_back is not None and held_back[0] == bucket:
                    _, i, t, p = held_back
                    changed = edit(t, text)
                    out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), p, p if changed == t else sign(changed), print_))
                held_back = None if bridge else (bucket, id_, text, print_)
            yield pa.RecordBatch.from_pydict({f.name: pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)}, schema=schema)

    out = with_next(docs).select("bucket", "bridge", "id", "text").mapInArrow(walk, EDITED if inline else BARE)
    if not inline:
        out = save(out.withColumn("row", F.monotonically_increasing_id()))
        texts = out.select("row", "doc_id", "n_chars", "edited_sha256", F.posexplode(F.array("text", "edited", "next")).alias("which", "text"))
        texts = fingerprint_texts(texts, words_in, held)
        pick = lambda k: F.max(F.when(F.col("which") == k, F.col("fingerprint")))
        out = texts.groupBy("row", "doc_id", "n_chars", "edited_sha256").agg(pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint"), pick(2).alias("next_fingerprint"))
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    out = out.withColumns({"near_edited": near("edited_fingerprint"), "near_next": near("next_fingerprint")})
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


#: DuckDB SQL of ``edited_fingerprints`` over ``documents``.
SQL = rf"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r FROM documents),
e AS (SELECT r, doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS nxt FROM o),
d AS (SELECT *, left(text, n - n // 2) || left(nxt, n // 2) AS edited FROM e),
t AS (SELECT text, row_number() OVER (ORDER BY text) AS k FROM (SELECT text FROM d UNION SELECT edited FROM d) u),
w AS (SELECT text, k, unnest(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS term FROM t),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS term FROM o) x GROUP BY term),
lex AS (SELECT term FROM f WHERE df * {1 << LOW} <= (SELECT count(*) FROM o) AND df * {1 << HIGH} >= (SELECT count(*) FROM o)),
b AS (SELECT k, term, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS h FROM
        (SELECT w.k, w.term, lex.term IS NOT NULL AS band, bool_or(lex.term IS NOT NULL) OVER (PARTITION BY w.k) AS has_band FROM w LEFT JOIN lex USING (term)) y WHERE band OR NOT has_band),
m AS (SELECT s, ('0x' || substr(md5('lexicon ' || s), 1, 16))::UBIGINT | 1::UBIGINT AS mult FROM range({FAMILIES}) q(s)),
v AS (SELECT k, s, term, ((h::UHUGEINT * mult::UHUGEINT % 18446744073709551616::UHUGEINT) // 4294967296::UHUGEINT)::BIGINT AS v FROM b CROSS JOIN m),
l AS (SELECT *, min(v) OVER (PARTITION BY k, s) AS low FROM v),
g AS (SELECT k, s, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS part FROM l WHERE v < (1::BIGINT << CASE WHEN low = 0 THEN 0 ELSE length(bin(low)) END) GROUP BY k, s),
p AS (SELECT t.text, coalesce(string_agg(part, '' ORDER BY s), repeat(substr(md5(''), 1, 8), {FAMILIES})) AS print FROM t LEFT JOIN g USING (k) GROUP BY t.text)
SELECT d.doc_id, d.n AS n_chars, sha256(d.edited) AS edited_sha256, a.print AS fingerprint, b2.print AS edited_fingerprint,
       list_sum(list_transform(range({FAMILIES}), lambda i: (substr(a.print, 8 * i + 1, 8) = substr(b2.print, 8 * i + 1, 8))::INT)) / {FAMILIES}.0::DOUBLE AS near_edited,
       list_sum(list_transform(range({FAMILIES}), lambda i: (substr(a.print, 8 * i + 1, 8) = substr(c.print, 8 * i + 1, 8))::INT)) / {FAMILIES}.0::DOUBLE AS near_next
FROM d JOIN p a ON a.text = d.text JOIN p b2 ON b2.text = d.edited JOIN p c ON c.text = d.nxt
"""
