"""Merkle manifest of a dataset: a tree of leaves for each source, and a tree of the sources.

A node is H (SHA-256, in lower-case hexadecimal digits) of the digests of up to ``ARITY`` consecutive nodes below it.
Leaves are dealt by ranges of (source, id) into partitions.  Of these each makes a fragment: a sparse forest of
nodes keyed by (level, index), in which a run of siblings gives way to its parent as soon as it is whole;
how many siblings a run has follows from the number of the source's leaves.  Fragments merge by
union and the same collapse, an associative and commutative step, so a reduction tree brings
neighbouring partitions together until each source has its root alone.  A fragment holds at most
2 * (ARITY - 1) nodes a level, however many leaves it stands for, and only the first and the last source of a
partition have any.  Going down again, each partition asks for the few nodes beside its own and works out
its leaves' proofs.

Defined cases: a null source is a source of its own and the first; null ids come first within theirs and are never
tampered with; rows of one id are ordered by their leaves, so repeated rows are leaves of their own; an
empty text is a value (``0:``), a null one is ``-``; further columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import save

ARITY = 3
#: Leaves of a partition, and partitions at most; with more leaves partitions grow.
LEAVES, PARTITIONS = 20_000, 20_000
#: Fragments that one step of the reduction tree merges.
FAN = 16

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "grp string, level int, idx long, digest string"


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """H of values, each as its UTF-8 byte count, ``:`` and itself, or ``-``."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def height(leaves: int) -> int:
    """The level at which one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def collapse(nodes: dict[tuple[int, int], str], leaves: int) -> dict[tuple[int, int], str]:
    """Replaces whole runs in ``nodes`` by their parents, and returns all parents made."""
    made, size = {}, leaves
    by_level: dict[int, set[int]] = {}
    for level, k in nodes:
        by_level.setdefault(level, set()).add(k // ARITY)
    for level in range(height(leaves)):
        for run in by_level.get(level, ()):
            keys = [(level, k) for k in range(run * ARITY, min((run + 1) * ARITY, size))]
            if all(k in nodes for k in keys):
                made[level + 1, run] = nodes[level + 1, run] = digest_of([nodes.pop(k) for k in keys])
                by_level.setdefault(level + 1, set()).add(run // ARITY)
        size = -(-size // ARITY)
    return made


def _dealt(leaves: DataFrame, order: list[str], per_part: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (grp, *order, digest, ...) with part and place; spans (part, grp, first, n, low, leaves)."""
    parts = min(PARTITIONS, -(-leaves.count() // per_part)) or 1
    # a saved table's rows have fixed numbers, which spread repeated rows over partitions
    by = ["grp", *order, "digest", "tie"]
    rows = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = save(rows.drop("tie").withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    spans = rows.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    whole = Window.partitionBy("grp")  # a row for each partition of a group
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("part", "grp", "first", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("low"), F.sum("n").over(whole).alias("leaves"))
    return rows, save(spans)


def _numbered(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with idx, their place in their group, and its number of leaves."""
    rows = rows.join(spans.select("part", "grp", "first", "low", "leaves"), ["part", "grp"])
    return rows.withColumn("idx", F.col("low") + F.col("place") - F.col("first")).drop("place", "first", "low")


def _merged(rows: pd.DataFrame) -> tuple[dict, dict, int]:
    leaves = int(rows["leaves"].iloc[0])
    nodes = dict(zip(zip(rows["level"].tolist(), rows["idx"].tolist(), strict=True), rows["digest"], strict=True))
    return nodes, collapse(nodes, leaves), leaves


def _forest(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (grp, leaves, root) and all nodes (grp, level, idx, digest) that stood open in a fragment or were made by merging."""
    columns = ["grp", "level", "idx", "digest", "part", "leaves"]
    kept = f"{NODE}, part long, leaves long"

    def fragment(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for grp, own in pdf.assign(level=0).groupby("grp", sort=False):
            nodes, _, leaves = _merged(own)
            out += [(grp, level, k, d, key[0], leaves) for (level, k), d in nodes.items()]
        return pd.DataFrame(out, columns=columns)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, made, leaves = _merged(pdf)
        out = [(key[1], level, k, d, key[0], leaves, (level, k) in nodes) for (level, k), d in {**nodes, **made}.items()]
        return pd.DataFrame(out, columns=[*columns, "still"])

    own = _numbered(rows, spans).select("part", "grp", "idx", "digest", "leaves")
    nodes = save(own.groupBy("part").applyInPandas(fragment, kept))
    top = F.col("level") == _height(F.col("leaves"))
    tables, roots, open_ = nodes, nodes.where(top), nodes.where(~top)
    last = spans.agg(F.max("part")).first()[0] or 0
    while last > 0:  # the reduction tree: neighbours merge, a FAN-th of the fragments remain
        last //= FAN
        merged = save(open_.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "grp").applyInPandas(merge, f"{kept}, still boolean"))
        tables, roots = tables.unionByName(merged.drop("still")), roots.unionByName(merged.where(top).drop("still"))
        open_ = merged.where(F.col("still") & ~top).drop("still")
    return roots.select("grp", "leaves", F.col("digest").alias("root")), save(tables.select("grp", "level", "idx", "digest").distinct())


def _height(leaves: Column) -> Column:
    """``height`` as an expression: the powers of ARITY below the number of leaves."""
    return F.size(F.filter(F.array(*(F.lit(ARITY**k) for k in range(39))), lambda p: p < leaves))


def _asked(spans: DataFrame) -> DataFrame:
    """(part, grp, level, idx): the nodes beside each span, in the runs at its ends, on every level."""

    def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for part, grp, low, n, leaves in pdf[["part", "grp", "low", "n", "leaves"]].itertuples(index=False):
                first, last, size = low, low + n - 1, leaves
                for level in range(height(leaves)):
                    out += [(part, grp, level, k) for r in {first // ARITY, last // ARITY} for k in range(r * ARITY, min((r + 1) * ARITY, size)) if not first <= k <= last]
                    first, last, size = first // ARITY, last // ARITY, -(-size // ARITY)
            yield pd.DataFrame(out, columns=["part", "grp", "level", "idx"])

    return spans.where("n < leaves").mapInPandas(ask, "part long, grp string, level int, idx long")


def _runs(own: list[str], first: int, leaves: int, known: dict[tuple[int, int], str]) -> list[dict[int, list[str]]]:
    """For each level, the runs with nodes from ``first`` on above ``own`` leaves."""
    out, size = [], leaves
    for _ in range(height(leaves)):
        end = first + len(own)
        at = {r: [own[k - first] if first <= k < end else known[len(out), k] for k in range(r * ARITY, min((r + 1) * ARITY, size))] for r in range(first // ARITY, (end - 1) // ARITY + 1)}
        out.append(at)
        own, first, size = [digest_of(run) for run in at.values()], first // ARITY, -(-size // ARITY)
    return out


def _proofs(rows: DataFrame, spans: DataFrame, nodes: DataFrame, notes: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(leaf, steps, note)`` of every leaf: its proof is, for each level, its place in its run and the run's others.
    ``notes`` are (grp, note)."""
    beside = _asked(spans).join(nodes, ["grp", "level", "idx"]).select("part", "grp", "level", "idx", "digest")
    beside = beside.unionByName(spans.join(notes, "grp").select("part", "grp", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.col("note").alias("digest")))
    columns = [c.split()[0] for c in schema.split(", ")]

    def prove(pdf: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = {grp: dict(zip(zip(b["level"].tolist(), b["idx"].tolist(), strict=True), b["digest"], strict=True)) for grp, b in beside.groupby("grp", sort=False)}
        for grp, own in pdf.sort_values(["grp", "idx"]).groupby("grp", sort=False):
            runs = _runs(own["digest"].tolist(), int(own["idx"].iloc[0]), int(own["leaves"].iloc[0]), known.get(grp, {}))
            note = known.get(grp, {}).get((-1, 0))
            for leaf in own.itertuples(index=False):
                k, steps = leaf.idx, []
                for at in runs:
                    k, place = divmod(k, ARITY)
                    steps.append((place, at[k][:place] + at[k][place + 1 :]))
                out.append(finish(leaf, steps, note))
        return pd.DataFrame(out, columns=columns)

    return _numbered(rows, spans).groupBy("part").cogroup(beside.groupBy("part")).applyInPandas(prove, schema)


def fold(leaf: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a leaf and its proof."""
    for place, others in steps:
        leaf = digest_of([*others[:place], leaf, *others[place:]])
    return leaf


def verdict(digest: str, shown: str | None, steps: list[tuple[int, list[str]]], root: str) -> tuple[str, bool]:
    """(folded_root, verified): what follows from the digest shown, or else the leaf's own, and its siblings."""
    folded = fold(shown if isinstance(shown, str) else digest, steps)
    return folded, folded == root


def manifest(leaves: DataFrame, order: list[str], schema: str, per_part: int = LEAVES) -> DataFrame:
    """Proofs of ``leaves``, a saved table (grp string, *order, digest, shown) without nulls but in ``shown``, a digest to be verified
    in place of the leaf's.  Gives the order columns, whose ``schema`` is named, and leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows, spans = _dealt(leaves, order, per_part)
    subroots, nodes = _forest(rows, spans)
    # the tree of the groups: the same, with the groups as leaves of one group
    groups = save(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")))
    group_rows, group_spans = _dealt(groups, ["name"], per_part)
    tops, group_nodes = _forest(group_rows, group_spans)
    top = tops.first()  # one row at most
    root = top.root if top else ""
    no_notes = leaves.sparkSession.createDataFrame([], "grp string, note string")
    notes = _proofs(group_rows, group_spans, group_nodes, no_notes, lambda leaf, steps, _: (leaf.name, json.dumps([leaf.digest, steps])), "grp string, note string")

    def finish(leaf, steps: list[tuple[int, list[str]]], note: str) -> tuple:
        subroot, above = json.loads(note)
        steps = steps + above
        proof = digest_of([d for _, others in steps for d in others])
        return (*(getattr(leaf, c) for c in order), leaf.digest, subroot, root, proof, *verdict(leaf.digest, leaf.shown, steps, root))

    return _proofs(rows, spans, nodes, save(notes), finish, f"{schema}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_manifest(docs: DataFrame, per_part: int = LEAVES) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document; of those whose id has an even crc32 the
    text is verified without its newlines."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    tampered = (crc % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("grp"), F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"),
        leaf_digest([F.col(c) for c in FIELDS]).alias("digest"), F.when(tampered, leaf_digest(bare)).alias("shown"),
    )
    out = manifest(save(leaves), ["there", "id"], "there boolean, id long", per_part)
    return out.select(F.when(F.col("there"), F.col("id")).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _levels(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT grp, 0 AS level, idx, digest, n FROM {leaves} UNION ALL
      SELECT grp, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY grp, level, idx // 3, n)"""


def _steps(name: str, leaves: str, levels: str, key: str, first: int) -> str:
    """For each leaf and level: what stands left and right of its ancestor in the run."""
    own = "d.idx // (3 ** z.level)::BIGINT"
    return f"""{name} AS (SELECT d.{key} AS leaf_of, {first} + z.level AS step, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < {own}), '') AS l, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > {own}), '') AS w
      FROM {leaves} d JOIN (SELECT DISTINCT grp, level FROM {levels} WHERE n > 1) z ON z.grp = d.grp
      JOIN {levels} s ON s.grp = d.grp AND s.level = z.level AND s.idx // 3 = d.idx // (3 ** (z.level + 1))::BIGINT GROUP BY d.{key}, z.level)"""


_SAID = ", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
_BARE = _SAID.replace("text::VARCHAR", "translate(text, chr(10), '')")

#: DuckDB SQL of ``document_manifest`` over ``documents``.
SQL = f"""
WITH RECURSIVE crc AS (SELECT [list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) FOR k IN range(256)] AS t),
h AS (SELECT doc_id, source, sha256(concat({_SAID})) AS digest, sha256(concat({_BARE})) AS bare,
             xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 2 = 0 AND doc_id IS NOT NULL AS even FROM documents, crc),
d AS (SELECT doc_id, coalesce('1' || source, '0') AS grp, digest, CASE WHEN even THEN bare ELSE digest END AS shown, row_number() OVER (ORDER BY doc_id) AS r,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM h),
{_levels("lv", "d")},
g AS (SELECT '' AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1),
{_levels("gv", "g")},
{_steps("s1", "d", "lv", "r", 0)},
{_steps("s2", "g", "gv", "name", 1000)},
st AS (SELECT leaf_of AS r, step, l, w FROM s1 UNION ALL SELECT d.r, s2.step, s2.l, s2.w FROM d JOIN s2 ON s2.leaf_of = d.grp),
p AS (SELECT r, sha256(string_agg(l || w, '' ORDER BY step)) AS proof, list({{'l': l, 'r': w}} ORDER BY step) AS steps FROM st GROUP BY r),
q AS (SELECT digest AS root FROM gv WHERE n = 1)
SELECT d.doc_id, d.digest AS leaf, g.digest AS subroot, q.root, coalesce(p.proof, sha256('')) AS proof_sha256,
       list_reduce(list_prepend({{'l': d.shown, 'r': ''}}, coalesce(p.steps, [])), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root, folded_root = q.root AS verified
FROM d JOIN g ON g.name = d.grp LEFT JOIN p ON p.r = d.r CROSS JOIN q
"""
