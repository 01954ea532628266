"""Conversation structure repair: a forward Viterbi pass over four grammar states.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  Each row is kept, gets another
role or goes, and empty turns may be put in; the cheapest edits are found by one pass over a
conversation's rows in order, that carries for each grammar state (nothing yet, after s, after u, after
a) the least (cost, audit string) and a running hash of the repaired text.  So a conversation
of any length is read as a stream: a task holds one batch of rows and four states, never its texts.

Its rows meet in one task, since the hash of the whole repaired text can only be taken in order.
Whether a row repeats an earlier one is settled before, by a count of each conversation's equal texts,
so that no task remembers what it has seen.

Audits of one length and cost differ in a letter before either ends, and an audit fixes the repaired roles:
what is least up to a row stays least, whatever follows in that state.

Defined cases: nulls in any column count as one space, except that a null turn or id stays null in order, gaps and
result; rows of one turn are ordered by role and text (so repeated rows stand side by side); a role's
initial is its first character, and an empty role has none; rows without an id are one
conversation; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.shared import save

#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states.
START, SYSTEM, USER, ASSISTANT = range(4)
SPACE = " \t\n\x0b\x0c\r"
#: Letters of an audit after which its common beginnings are put away.
BLOCK = 512

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows as crc32 of ``conv:turn`` modulo 20 damages them; a dropped row stays as a mark."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat_ws(":", said(conv_col), said(turn_col)).cast("binary")) % 20
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), kind.alias("kind"))
    out = out.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return out.select("conv", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def seen_before(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: an earlier turn of the conversation has this role and text."""
    digest = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    rows = rows.withColumn("digest", F.when(~F.col("gone"), digest))
    # a null turn is the first of all; equal rows of one turn are told apart where they stand side by side
    turn: Column = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn"))
    firsts = rows.where("NOT gone").groupBy("conv", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).where("first <> last")
    # saved, so that Spark knows its size: the texts are shuffled for it only where it is large
    firsts = save(firsts.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first"))
    joined = rows.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return joined.withColumn("again", F.coalesce(turn > F.col("first"), F.lit(False))).drop("digest", "c", "d", "first")


class Repair:
    """The forward pass over one conversation's rows.

    A path is (cost, rank, rest of the audit, hash).  ``blocks`` holds what stands before the rests: the
    distinct beginnings, all of one length, in order; ``rank`` is a path's place among the last block's.
    """

    def __init__(self) -> None:
        self.paths: list = [(0, 0, "", hashlib.sha256()), None, None, None]
        self.blocks: list[list[tuple[int, str]]] = []
        self._close()

    @staticmethod
    def _best(paths: list, stay: tuple | None, steps: list[tuple[int, int, str, bytes]]):
        """The least of ``stay`` and of ``steps``: (state before, cost, letter, line)."""
        ways = [((p[0] + cost, p[1], p[2] + letter), s, line) for s, cost, letter, line in steps if (p := paths[s])]
        if not ways or (stay and stay[:3] < min(ways)[0]):
            return stay
        way, s, line = min(ways)
        after = paths[s][3].copy()
        after.update(line if s == START else b"\n" + line)
        return (*way, after)

    def _close(self) -> None:
        """Empty turns put in here: a user's after nothing, s or a, then an assistant's after u."""
        p = self.paths
        p[USER] = self._best(p, p[USER], [(s, INSERT, "I", b"user:") for s in (START, SYSTEM, ASSISTANT)])
        p[ASSISTANT] = self._best(p, p[ASSISTANT], [(USER, INSERT, "I", b"assistant:")])

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        old, initial = self.paths, role[:1]
        new = [p and (p[0] + DELETE, p[1], p[2] + "D", p[3]) for p in old]
        if not must_go:
            extra, body = TRUNCATED * truncated, b":" + text.encode()
            kept = role.encode() + body
            if initial == "s":
                new[SYSTEM] = self._best(old, new[SYSTEM], [(START, extra, "K", kept)])
            for to, name, sources in ((USER, "user", (START, SYSTEM, ASSISTANT)), (ASSISTANT, "assistant", (USER,))):
                cost, letter, line = (extra, "K", kept) if initial == name[0] else (extra + REROLE, "R", name.encode() + body)
                new[to] = self._best(old, new[to], [(s, cost, letter, line) for s in sources])
        self.paths = new
        self._close()
        if len(self.paths[START][2]) > 2 * BLOCK:
            self._put_away()

    def _put_away(self) -> None:
        cut = min(len(p[2]) for p in self.paths if p) - 8
        heads = sorted({(p[1], p[2][:cut]) for p in self.paths if p})
        self.paths = [p and (p[0], heads.index((p[1], p[2][:cut])), p[2][cut:], p[3]) for p in self.paths]
        self.blocks.append(heads)

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, hash) of the cheapest repair."""
        cost, rank, rest, done = min((p for p in (self.paths[START], self.paths[ASSISTANT]) if p), key=lambda p: p[:3])
        parts = [rest]
        for heads in reversed(self.blocks):
            rank, part = heads[rank]
            parts.append(part)
        return cost, "".join(reversed(parts)), done.hexdigest()


class Reading:
    """Counts and repair of one conversation, row by row."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.before, self.turns, self.low, self.high = None, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def row(self, turn: int | None, role: str, text: str, again: bool) -> None:
        here, before = (turn, role, text), self.before
        words = text.rstrip(SPACE)
        blank = not words
        duplicate = not blank and (again or here == before)
        truncated = not blank and not duplicate and words[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += before is not None and before[1][:1] + role[:1] not in ("su", "ua", "au")
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.before = here
        self.repair.row(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.result())


def repair(rows: DataFrame) -> DataFrame:
    """One row for each ``conv`` of ``rows`` (conv, turn, role, text, gone): its faults and its cheapest repair.
    Rows with ``gone`` count for nothing but that their conversation is there."""
    key = rows.schema["conv"]
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, reading, kind = None, None, pa.int64()
        types = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            kind, out = batch.schema.field("conv").type, []
            rows = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "again"))
            for conv, turn, role, text, gone, again in zip(*rows, strict=True):
                if reading is None or conv != here:
                    if reading is not None:
                        out.append((here, *reading.result()))
                    here, reading = conv, Reading()
                if not gone:
                    reading.row(turn, role, text, again)
            yield _batch(out, kind, types)
        if reading is not None:
            yield _batch([(here, *reading.result())], kind, types)

    def _batch(out: list[tuple], kind: pa.DataType, types: list) -> pa.RecordBatch:
        arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate([kind, *types])]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *columns])

    dealt = seen_before(rows).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.select("conv", "turn", "role", "text", "gone", "again").mapInArrow(walk, f"conv_id {key.dataType.simpleString()}, {RESULT}")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    return repair(damage(rows))


def _sql() -> str:
    """DuckDB SQL of ``damaged_and_repaired`` over ``conversations``: the same pass as a recursion over row numbers."""
    way = lambda p, cost, letter, line: f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + {cost}, 'a': {p}.a || '{letter}', 't': {f'{p}.t || chr(10) || ' if p[1] != '0' else ''}{line}}} END"  # noqa: E731
    least = lambda *ways: f"list_min([x FOR x IN [{', '.join(ways)}] IF x IS NOT NULL])"  # noqa: E731
    gone = lambda p: f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + {DELETE}, 'a': {p}.a || 'D', 't': {p}.t}} END"  # noqa: E731
    put_in = lambda p, role: way(p, INSERT, "I", f"'{role}:'")  # noqa: E731

    def said(p: str, role: str) -> str:
        kept = way(p, f"(CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END)", "K", "role || ':' || text")
        other = way(p, f"({REROLE} + CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END)", "R", f"'{role}:' || text")
        return f"CASE WHEN must_go THEN NULL WHEN left(role, 1) = '{role[0]}' THEN {kept} ELSE {other} END"

    system = f"CASE WHEN must_go OR left(role, 1) <> 's' THEN NULL ELSE {way('p0', f'(CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END)', 'K', 'role || chr(58) || text')} END"
    return rf"""
WITH RECURSIVE crc AS (SELECT [list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) FOR k IN range(256)] AS t),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT r.*, xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(k, '')]), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS kind FROM r, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
             regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS initial_before FROM n),
g AS (SELECT *, blank OR again AS must_go, cut AND NOT blank AND NOT again AS truncated FROM f),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS rn, {{'c': 0, 'a': '', 't': ''}} AS p0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS p1, {{'c': {INSERT}, 'a': 'I', 't': 'user:'}} AS p2,
             {{'c': {2 * INSERT}, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS p3 FROM conversations
      UNION ALL
      SELECT conv_id, rn, n0, n1, m2, {least('n3', put_in('m2', 'assistant'))} FROM (
        SELECT conv_id, rn, n0, n1, n3, {least('n2', put_in('n0', 'user'), put_in('n1', 'user'), put_in('n3', 'user'))} AS m2 FROM (
          SELECT p.conv_id, g.rn, {gone('p0')} AS n0, {least(gone('p1'), system)} AS n1, {least(gone('p2'), *(said(s, 'user') for s in ('p0', 'p1', 'p3')))} AS n2, {least(gone('p3'), said('p2', 'assistant'))} AS n3
          FROM p JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND g.rn = p.rn + 1) x) y),
e AS (SELECT conv_id, arg_max({least('p0', 'p3')}, rn) AS best FROM p GROUP BY conv_id),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (truncated) AS truncated,
             count(*) FILTER (initial_before IS NOT NULL AND initial_before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       best.c::BIGINT AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM e LEFT JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
