"""Operator 13: repair of a conversation's structure by shortest paths with small whole costs.

A conversation's turns lie before a machine that accepts role initials ``(s?(ua)+)?``. A node is (turns read, state); edits are arcs: Keep (0),
Rerole to user or assistant (3), Delete (4), Insert of an empty user or assistant turn (3); a truncated turn that is not deleted adds 3, a blank
or repeated one must be deleted. Costs are at most 6, so Dial's algorithm runs from the goals with 7 buckets in a ring: a node's distance is
recorded once, nodes leave the buckets in order of distance, and no heap is needed. The audit is then the lexicographically least walk from the start
over tight arcs (those whose cost is the difference of the distances), by the edits' initials D, I, K, R. Given the state, the role that an edit must
give is forced, so the initials alone say what was done.

Rows are dealt by conversation and sorted within their partitions; a task reads them as a stream. The first pass carries no text, only a
digest of role and text and the faults found by built-in functions, and holds of one conversation its digests and a few bytes a turn. The second
streams the texts, each conversation behind its audit, and holds none of them. A result is one row a conversation with an audit of one
letter an edit and a digest that is sequential by nature, so one task streams a conversation, however long.

Defined cases: null roles and texts count as one space; a null turn comes first; rows of equal turn are ordered by the digest of role and text, so
equal ones lie side by side; rows without conv_id are one conversation with a null id; a role is known by its first letter, and any but s, u, a
(an empty role too) can only be reroled or deleted; texts of any length are never held together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselark.llm.common import WHITE, column, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
RING = REROLE + TRUNCATED + 1
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
#: The state that a role's initial leads to, by state; the role that any edit but Keep must give, by state.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FORCED = ("user", "user", "assistant", "user")
#: States that an initial leads to a state from.
BEFORE = tuple([(state, initial) for state in range(4) for initial, to in NEXT[state].items() if to == target] for target in range(4))
FINE, CUT, LOST = range(3)
NO_ROLE = "-"


def cheapest(initials: str, faults: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits. initials: one letter a turn (NO_ROLE for other roles); faults: FINE, CUT (truncated) or LOST (blank or repeated)."""
    n = len(initials)
    far = array("q", [-1]) * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(RING)]
    for state in GOALS:
        far[4 * n + state] = 0
        ring[0].append(4 * n + state)
    d, waiting = 0, len(GOALS)

    def reach(node: int, distance: int) -> int:
        if far[node] < 0 or distance < far[node]:
            far[node] = distance
            ring[distance % RING].append(node)
            return 1
        return 0

    while waiting and not 0 <= far[START] < d:
        bucket = ring[d % RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if far[node] != d:  # reached at less since it was put here
                continue
            at, state = node >> 2, node & 3
            for earlier, initial in BEFORE[state]:
                if initial != "s":
                    waiting += reach(4 * at + earlier, d + INSERT)
            if at:
                before, fault = node - state - 4, faults[at - 1]
                waiting += reach(before + state, d + DELETE)
                if fault != LOST:
                    more = d + TRUNCATED * (fault == CUT)
                    for earlier, initial in BEFORE[state]:
                        if initial == initials[at - 1]:
                            waiting += reach(before + earlier, more + KEEP)
                        if initial != "s":
                            waiting += reach(before + earlier, more + REROLE)
        d += 1
    return far[START], "".join(tight_walk(initials, faults, far))


def tight_walk(initials: str, faults: bytes, far: array) -> Iterator[str]:
    """The least initials of edits along arcs whose cost is the difference of the distances."""
    at, state, n = 0, START, len(initials)
    while at < n or state not in GOALS:
        left = far[4 * at + state]
        forced = NEXT[state][FORCED[state][0]]
        more = TRUNCATED * (at < n and faults[at] == CUT)
        tight = lambda at, state, cost: far[4 * at + state] >= 0 and far[4 * at + state] + cost == left
        kept = NEXT[state].get(initials[at]) if at < n and faults[at] != LOST else None
        if at < n and tight(at + 1, state, DELETE):
            yield "D"
            at += 1
        elif tight(at, forced, INSERT):
            yield "I"
            state = forced
        elif kept is not None and tight(at + 1, kept, KEEP + more):
            yield "K"
            at, state = at + 1, kept
        else:
            yield "R"
            at, state = at + 1, forced


class Conversation:
    """What is known of a conversation's turns so far."""

    def __init__(self) -> None:
        self.initials, self.faults, self.seen = bytearray(), bytearray(), set()
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.least = self.most = None
        self.distinct, self.last = 0, None

    def add(self, turn: int | None, initial: str, digest: bytes, blank: bool, cut: bool) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.distinct += turn != self.most
            self.most = turn
        known = initial if initial in ("s", "u", "a") else NO_ROLE
        if self.last is not None:
            self.n["illegal"] += self.last + known not in ("su", "ua", "au")
        self.last = known
        fault = "blank" if blank else "duplicate" if digest in self.seen else "truncated" if cut else None
        if fault:
            self.n[fault] += 1
        self.seen.add(digest)
        self.initials += known.encode()
        self.faults.append(FINE if fault is None else CUT if fault == "truncated" else LOST)

    def plan(self) -> dict:
        cost, audit = cheapest(self.initials.decode(), bytes(self.faults))
        return {"gaps": 0 if self.least is None else self.most - self.least + 1 - self.distinct, **self.n, "cost": cost, "audit": audit}


PLAN = [*((c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", T.StringType())]


def turns_of(conversations: DataFrame, times: Column) -> DataFrame:
    """conv_id, turn, role, text, times (how often the row counts) and mark (digest of role and text)."""
    space = lambda c: F.coalesce(column(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(column("conv_id").alias("conv_id"), column("turn").cast("long").alias("turn"), space("role"), space("text"), times.cast("int").alias("times"))
    return rows.withColumn("mark", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


def _schema(turns: DataFrame, fields: list) -> T.StructType:
    return T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *(T.StructField(c, t) for c, t in fields)])


def repair_plans(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of turns_of(), those without a row that counts included."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    rows = turns.select("conv_id", "turn", "mark", "times", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    schema = _schema(turns, PLAN)

    def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_id, kind = None, None, None
        for b in batches:
            done, kind = [], b.schema.field("conv_id").type
            for own_id, turn, mark, times, initial, blank, cut in zip(*(b[c].to_pylist() for c in b.schema.names), strict=True):
                if now is None or own_id != conv_id:
                    if now is not None:
                        done.append({"conv_id": conv_id, **now.plan()})
                    now, conv_id = Conversation(), own_id
                for _ in range(times):
                    now.add(turn, initial, mark, blank, cut)
            yield batch(done, kind)
        if now is not None:
            yield batch([{"conv_id": conv_id, **now.plan()}], kind)

    def batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        long = pa.int64()
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", kind), *((c, pa.string() if c == "audit" else long) for c, _ in PLAN)]))

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "mark").mapInArrow(plans, schema)


REPAIRED = [("place", T.LongType()), ("edit", T.StringType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType())]


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), turn (null if inserted), role, text of each turn after repair. A conversation's rows lie in one
    partition, one after the other by place."""
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "mark", "times", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = plans.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("mark", "binary"), ("times", "int"), ("role", "string"), ("text", "string"))), "audit")
    stream = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "mark")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv_id, kind = "", 0, START, 0, None, None
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv_id, place, "I", None, FORCED[state], ""))
                state, at, place = NEXT[state][FORCED[state][0]], at + 1, place + 1

        def taken() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *(c for c, _ in REPAIRED)])

        for b in batches:
            kind = b.schema.field("conv_id").type
            for own_id, which, turn, times, role, text, plan in zip(*(b[c].to_pylist() for c in ("conv_id", "kind", "turn", "times", "role", "text", "audit")), strict=True):
                if which == 0:
                    inserts()
                    audit, at, state, place, conv_id = plan, 0, START, 0, own_id
                    continue
                for _ in range(times):
                    inserts()
                    edit, at = audit[at], at + 1
                    if edit == "D":
                        continue
                    given = role if edit == "K" else FORCED[state]
                    out.append((conv_id, place, edit, turn, given, text))
                    state, place = NEXT[state][given[0]], place + 1
            yield taken()
            out.clear()
        inserts()
        if out:
            yield taken()

    return stream.mapInArrow(repair, _schema(turns, REPAIRED))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, for the rows of repaired_turns() as they lie."""
    schema = _schema(repaired, [("repaired_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_id, kind = None, None, None
        for b in batches:
            done, kind = [], b.schema.field("conv_id").type
            for own_id, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or own_id != conv_id:
                    if now is not None:
                        done.append((conv_id, now.hexdigest()))
                    now, conv_id = hashlib.sha256(), own_id
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
            yield batch(done, kind)
        if now is not None:
            yield batch([(conv_id, now.hexdigest())], kind)

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], schema.names)

    return repaired.select("conv_id", "role", "text").mapInArrow(digest, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """turns_of() the rows damaged by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its full stops and marks, 3 repeats it, 4 makes it the user's."""
    named = F.concat_ws(":", *(F.coalesce(column(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("fault"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = rows.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    rows = rows.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role").cast("string")))
    return turns_of(rows, F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plans = written(repair_plans(turns))
    own = digests(repaired_turns(turns, plans)).withColumnRenamed("conv_id", "_of")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return plans.join(own, plans["conv_id"].eqNullSafe(own["_of"]), "left").select(*plans.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


OP13_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(crc, b)), 4294967295), 4294967295) % 20 AS harm
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM named
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS white FROM damaged
), marked AS (
  SELECT conv_id, turn, i, left(role, 1) AS x, chr(10) || role || ':' || text AS line, text,
    CASE WHEN trim(text, white) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, white), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id
), ways AS (
  SELECT conv_id, n AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS v0, {'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS vs,
    {'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'} AS vu, {'c': 0::BIGINT, 'a': '', 't': ''} AS va FROM counts
  UNION ALL
  SELECT conv_id, i, list_sort([b0, {'c': 3 + vu.c, 'a': 'I' || vu.a, 't': chr(10) || 'user:' || vu.t}])[1], list_sort([bs, {'c': 3 + vu.c, 'a': 'I' || vu.a, 't': chr(10) || 'user:' || vu.t}])[1],
    vu, list_sort([ba, {'c': 3 + vu.c, 'a': 'I' || vu.a, 't': chr(10) || 'user:' || vu.t}])[1]
  FROM (
    SELECT *, list_sort([bu, {'c': 3 + ba.c, 'a': 'I' || ba.a, 't': chr(10) || 'assistant:' || ba.t}])[1] AS vu FROM (
      SELECT w.conv_id, w.i - 1 AS i,
        list_sort([{'c': 4 + v0.c, 'a': 'D' || v0.a, 't': v0.t}, {'c': k + vs.c + CASE WHEN x = 's' THEN 0 ELSE 1000000000 END, 'a': 'K' || vs.a, 't': line || vs.t},
          {'c': k + vu.c + CASE WHEN x = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || vu.a, 't': line || vu.t}, {'c': 3 + k + vu.c, 'a': 'R' || vu.a, 't': chr(10) || 'user:' || text || vu.t}])[1] AS b0,
        list_sort([{'c': 4 + vs.c, 'a': 'D' || vs.a, 't': vs.t}, {'c': k + vu.c + CASE WHEN x = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || vu.a, 't': line || vu.t},
          {'c': 3 + k + vu.c, 'a': 'R' || vu.a, 't': chr(10) || 'user:' || text || vu.t}])[1] AS bs,
        list_sort([{'c': 4 + vu.c, 'a': 'D' || vu.a, 't': vu.t}, {'c': k + va.c + CASE WHEN x = 'a' THEN 0 ELSE 1000000000 END, 'a': 'K' || va.a, 't': line || va.t},
          {'c': 3 + k + va.c, 'a': 'R' || va.a, 't': chr(10) || 'assistant:' || text || va.t}])[1] AS bu,
        list_sort([{'c': 4 + va.c, 'a': 'D' || va.a, 't': va.t}, {'c': k + vu.c + CASE WHEN x = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || vu.a, 't': line || vu.t},
          {'c': 3 + k + vu.c, 'a': 'R' || vu.a, 't': chr(10) || 'user:' || text || vu.t}])[1] AS ba
      FROM ways w JOIN (SELECT *, CASE fault WHEN 'none' THEN 0 WHEN 'truncated' THEN 3 ELSE 1000000000 END AS k FROM marked) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i
    )
  )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(substr(v0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 0
"""
