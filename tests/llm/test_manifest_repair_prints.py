"""Fingerprints, conversation repair and Merkle manifest on odd tables, against SQL, brute force and a plain tree."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pyarrow as pa
import pytest
from conftest import comparable

from wardline.llm import conversations, imatch, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, id string, grp string, part long, term string"
TURNS = "conv_id long, turn long, role string, text string, again string, gone int, digest string, conv string"


def arrow(df):
    return pa.Table.from_pandas(df.toPandas().convert_dtypes())


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql).df()


def documents(spark, n=90, seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{int(40 * rng.random() ** -0.7)}é"
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randrange(1, 60))).replace("w7", "\n")
        rows.append((i * 3, text, rng.choice(["en", None, ""]), rng.choice(["a", "é", "z", "", None, f"s{i}"]), len(text)))
    rows += [(None, "no id\nat all", None, None, None), (None, "no id\nat all", None, None, None), (7, None, "en", "a", 0), (8, "", "en", "a", 0), (10, " \n\t ", None, "a", 4)]
    rows += [(6, "other text for one id", "en", "a", 3), *[(12, "same row\nagain", "en", "hot", 14)] * 9, (2**39 + 1, "w1é " * 20_000, "de", "hot", 80_000), (-5, "first of all\n", "de", "hot", 1)]
    return spark.createDataFrame([(*r, 1, "i", "g", 2, "t") for r in rows], DOCS)


def turns(spark, seed=5):
    rng, rows = random.Random(seed), []
    for conv in range(60):
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 5, 8, 20])):
            turn += rng.choice([0, 1, 1, 1, 2])
            rows.append((conv, rng.choice([turn, turn, turn, None]) if conv % 9 == 0 else turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "a", None]), rng.choice(["Yes.", "No", " ", "", None, "Is it? \n", "Yes.", "longer text!"])))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, None, "assistant", "Ho."), *[(77, 4, "user", "Same.")] * 7]
    rows += [(90, k, "xyz"[k % 3], f"t{k}.") for k in range(2600)] + [(91, k, "us"[k % 2], "cut") for k in range(300)]
    return spark.createDataFrame([(*r, "x", 1, "d", "c") for r in rows], TURNS)


@pytest.mark.parametrize("held", [None, 0])
def test_fingerprints_equal_sql(spark, monkeypatch, held):
    monkeypatch.setattr(imatch, "RANGE", 11)  # several ranges, so that bridges matter
    monkeypatch.setattr(imatch, "COUNTED", 50)
    docs = documents(spark).repartition(3)
    out = imatch.edited_fingerprints(docs, held).toPandas()
    assert comparable(out) == comparable(oracle(imatch.SQL, documents=docs.select("doc_id", "text")))
    assert len(out) == docs.count()


def test_fingerprints_tell_likeness(spark):
    rng = random.Random(1)
    base = [f"t{k}" for k in range(3000)]
    texts = [rng.sample(base, 120) for _ in range(200)]
    near = [t[:-6] + rng.sample(base, 6) for t in texts]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *near])] + [(900, None), (901, "")]
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / imatch.FAMILIES
    assert sum(like(prints[i], prints[i + 200]) for i in range(200)) / 200 > 0.8
    assert sum(like(prints[i], prints[i + 1]) for i in range(199)) / 199 < 0.08
    assert prints[900] == prints[901] and len(prints[0]) == 8 * imatch.FAMILIES


def test_signatures_by_definition():
    rng = random.Random(4)
    for n in (0, 1, 2, 9, 300):
        terms = [f"w{rng.random()}".encode() for _ in range(n)]
        want = []
        for m in imatch.MULTIPLIERS.tolist():
            drawn = {t: (imatch.term_hash(t) * m % 2**64) >> 32 for t in terms}
            bound = 1 << min(drawn.values(), default=0).bit_length()
            want.append(hashlib.md5(b" ".join(sorted(t for t in terms if drawn[t] < bound))).hexdigest()[:8])
        assert imatch.signatures(terms, [imatch.term_hash(t) for t in terms]) == "".join(want)


def test_conversations_equal_sql(spark):
    rows = turns(spark)
    out = conversations.damaged_and_repaired(rows.repartition(5)).toPandas()
    small = rows.where("conv_id IS NULL OR conv_id <> 90")  # the recursion carries whole texts: too slow for the long one
    want = oracle(conversations.SQL, conversations=small.select("conv_id", "turn", "role", "text"))
    assert comparable(out[~(out.conv_id == 90)]) == comparable(want)
    long = out[out.conv_id == 90].iloc[0]
    assert long.audit.count("I") + len([r for r in range(2600) if zlib.crc32(f"90:{r}".encode()) % 20 != 0]) + sum(zlib.crc32(f"90:{r}".encode()) % 20 == 3 for r in range(2600)) == len(long.audit)


def cheapest(rows):
    """(cost, audit, roles) by trying all edits, with up to two turns put in at each place."""
    best = None
    per_row = [[("D", None)] if must else [("K", role[:1]), ("R", "u"), ("R", "a"), ("D", None)] for role, must, _ in rows]
    ends = ["", "u", "a", "ua", "au"]
    for put in itertools.product(ends, repeat=len(rows) + 1):
        for edits in itertools.product(*per_row):
            cost, audit, made = 0, "", ""
            for k, p in enumerate(put):
                cost, audit, made = cost + 5 * len(p), audit + "I" * len(p), made + p
                if k < len(rows):
                    letter, initial = edits[k]
                    cost += {"K": 0, "R": 1, "D": 2}[letter] + (5 if letter != "D" and rows[k][2] else 0)
                    audit, made = audit + letter, made + (initial or ("?" if letter != "D" else ""))
            body = made[1:] if made[:1] == "s" else made
            if body == "ua" * (len(body) // 2) and (body or not made) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, made
    return best


def test_repair_is_the_cheapest():
    rng = random.Random(8)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(0, 4))]
        r = conversations.Repair()
        for role, must, cut in rows:
            r.row(role, "x", must, cut and not must)
        assert r.result()[:2] == cheapest([(role, must, cut and not must) for role, must, cut in rows])[:2]


@pytest.mark.parametrize("block", [4, 512])
def test_long_audits_are_put_together(monkeypatch, block):
    rng = random.Random(9)
    rows = [(rng.choice(["system", "user", "assistant", "x"]), f"t{k}", rng.random() < 0.1, rng.random() < 0.1) for k in range(700)]
    monkeypatch.setattr(conversations, "BLOCK", 10**9)
    plain, parts = conversations.Repair(), conversations.Repair()
    for role, text, must, cut in rows:
        plain.row(role, text, must, cut and not must)
    monkeypatch.setattr(conversations, "BLOCK", block)
    for role, text, must, cut in rows:
        parts.row(role, text, must, cut and not must)
    assert parts.result() == plain.result() and (len(parts.blocks) > 3 or block > 4)


@pytest.mark.parametrize("per_part", [4, 1000])
def test_manifest_equals_sql(spark, monkeypatch, per_part):
    monkeypatch.setattr(merkle, "FAN", 3)  # several rounds of merging
    docs = documents(spark)
    out = merkle.document_manifest(docs, per_part).toPandas()
    # rows of one id can trade places: the SQL orders them by leaf too
    assert comparable(out) == comparable(oracle(merkle.SQL, documents=docs.select("doc_id", "text", "lang", "source", "n_chars")))
    assert not out.verified.all() and out.verified.any()


def test_fragments_merge_in_any_order():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 10, 28, 81, 100):
        leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
        level = leaves
        while len(level) > 1:
            level = [merkle.digest_of(level[k : k + 3]) for k in range(0, len(level), 3)]
        parts = [{(0, k): leaves[k]} for k in range(n)]
        rng.shuffle(parts)
        while len(parts) > 1:
            both = parts.pop() | parts.pop(rng.randrange(len(parts)))
            merkle.collapse(both, n)
            parts.append(both)
        assert parts[0] == {} if n == 0 else parts[0] == {(merkle.height(n), 0): level[0]} or n == 1


@pytest.mark.parametrize("name", ["op11_fingerprints", "op12_conversations", "op13_merkle"])
def test_empty_tables(spark, tmp_path, name):
    documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    turns(spark).limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_untampered_leaves_are_folded_too():
    leaf, other = merkle.digest_of(["a"]), merkle.digest_of(["b"])
    root = merkle.digest_of([leaf, other])
    assert merkle.verdict(leaf, None, [(0, [other])], root) == (root, True)
    assert merkle.verdict(leaf, None, [(0, [leaf])], root) == (merkle.digest_of([leaf, leaf]), False)  # a wrong sibling shows
    assert merkle.verdict(leaf, other, [(0, [other])], root) == (merkle.digest_of([other, other]), False)
