"""Repair of conversations whose turns were lost, emptied, repeated, cut off or given a wrong role.

A row's first fault counts: blank (nothing but white space), duplicate (its role and text stood earlier in the conversation) or truncated
(its last character that is no white space isn't one of ``.!?``). Edits turn a conversation's rows into one whose roles' initials read
``(s?(ua)+)?``: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty text of user or assistant) 5; blank rows and duplicates
must be deleted, truncated rows that stay cost 5 more. The audit is the edits' initials in order; of the cheapest the ASCII-least is taken.

Each conversation is solved by depth-first branch-and-bound with an explicit stack. A node is (rows read, what the last role written was); the
search tries the edits in ASCII order, so it meets audits in ascending order and a node need only be looked at again by a strictly cheaper prefix
(its dominance table). Prefixes that, with the bound of the rows left, don't beat the incumbent are cut. The bound drops one condition, that
the conversation end behind an assistant, so it misses the optimum by a constant at most and the search looks at each node a few times: time and
memory follow the rows.

Spark brings each conversation's rows in order to one worker, which reads them as a stream: first to decide (a few bytes a row are kept), then,
behind the decided audit, to write the repaired rows. No text is held beyond a batch.

Cases: null roles and texts are one space; null turns come first; rows of one turn are in order of role and text; rows without a conv_id are one
conversation; a role that begins with none of s, u, a must be changed or deleted, an empty one too; an empty conversation or table gives no row.
Texts are taken whole; other columns are ignored. Duplicates are told by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._batches import small_batches
from weft.session import materialize, table

#: Costs of edits, white space, closing marks.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SPACES, CLOSING = " \t\n\x0b\f\r", ".!?"

# a row's code: its role (0 s, 1 u, 2 a, 3 any other) + 4 if it must go + 8 if it is truncated
_MUST, _TRUNCATED = 4, 8
# states: 0 nothing written, 1 behind the system's turn, 2 behind the user's, 3 behind the assistant's
_AFTER = (2, 2, 3, 2)  # behind the one role that may be written in each state, besides a first system's turn
_ENDS = (True, False, False, True)
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, role) to the state behind a kept row


def _bounds(codes: bytes) -> list[int]:
    """At [4 * i + state]: what rows i, i + 1, ... cost at least, wherever the conversation may end."""
    n = len(codes)
    out = [0] * (4 * n + 4)
    for i in range(n - 1, -1, -1):
        code, after = codes[i], 4 * i + 4
        least = [out[after + q] + DELETE for q in range(4)]
        if not code & _MUST:
            more = CUT_OFF if code & _TRUNCATED else 0
            for q in range(4):
                least[q] = min(least[q], out[after + _AFTER[q]] + REROLE + more)
                kept = _KEPT.get((q, code & 3))
                if kept is not None:
                    least[q] = min(least[q], out[after + kept] + KEEP + more)
        base = list(least)
        for q in range(4):
            out[4 * i + q] = min(base[q], base[_AFTER[q]] + INSERT)
    return out


def _edits(codes: bytes, i: int, state: int) -> list[tuple[int, int, int, int]]:
    """(rows read, state, cost, letter) behind each edit that may follow, in ASCII order of the letters."""
    insert = (i, _AFTER[state], INSERT, 73)
    if i == len(codes):
        return [insert]
    code = codes[i]
    out = [(i + 1, state, DELETE, 68), insert]
    if not code & _MUST:
        more = CUT_OFF if code & _TRUNCATED else 0
        kept = _KEPT.get((state, code & 3))
        if kept is not None:
            out.append((i + 1, kept, KEEP + more, 75))
        out.append((i + 1, _AFTER[state], REROLE + more, 82))
    return out


def _first_incumbent(codes: bytes, bounds: list[int]) -> int:
    """Cost of the repair that follows the bounds and mends its end by inserting."""
    i = state = cost = 0
    while i < len(codes):
        i, state, more, _ = min((e for e in _edits(codes, i, state) if e[3] != 73), key=lambda e: e[2] + bounds[4 * e[0] + e[1]])
        cost += more
    while not _ENDS[state]:
        state, cost = _AFTER[state], cost + INSERT
    return cost


def cheapest_repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equal ones that with the ASCII-least audit."""
    n, bounds = len(codes), _bounds(codes)
    best, audit = _first_incumbent(codes, bounds), None  # until the search has found a repair, one of equal cost may still be less
    seen = [best + 1] * (4 * n + 4)
    path, stack = bytearray(), [(0, 0, 0, 0, 0)]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        least = cost + bounds[4 * i + state]
        if cost >= seen[4 * i + state] or least > best or (least == best and audit is not None):
            continue
        seen[4 * i + state] = cost
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        if i == n and _ENDS[state]:
            best, audit = cost, bytes(path)
            continue  # more could only be inserted
        for j, then, more, own in reversed(_edits(codes, i, state)):
            stack.append((j, then, cost + more, depth + 1, own))
    return best, audit.decode()


def _plain(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _code() -> Column:
    role = F.coalesce(F.get(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int") - 1), F.lit(3))
    rest = F.rtrim("text", F.lit(SPACES))
    cut = ~F.substring(rest, -1, 1).isin(*CLOSING)
    return F.when(rest == "", role + _MUST).when(cut, role + _TRUNCATED).otherwise(role)


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


class _Faults:
    """One conversation's rows as they come: a code and two hashes each, and what its turns span."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.codes = conv_id, bytearray()
        self.hashes = array("q"), array("q")
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, code: int, one: int, two: int) -> None:
        self.codes.append(code)
        self.hashes[0].append(one)
        self.hashes[1].append(two)
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def row(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8).copy()
        keys = np.stack([np.frombuffer(h, np.int64) for h in self.hashes], 1)
        again = np.ones(len(codes), bool)
        again[np.unique(keys, axis=0, return_index=True)[1]] = False
        blank = codes & _MUST > 0
        again &= ~blank
        truncated = (codes & _TRUNCATED > 0) & ~again
        role = (codes & 3).astype(np.int64)
        pair = 4 * role[:-1] + role[1:]
        illegal = len(pair) - int(np.isin(pair, (4 * 0 + 1, 4 * 1 + 2, 4 * 2 + 1)).sum())
        codes = role + _MUST * (blank | again) + _TRUNCATED * truncated
        cost, audit = cheapest_repair(codes.astype(np.uint8).tobytes())
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, int(blank.sum()), int(again.sum()), int(truncated.sum()), illegal, cost, audit)


def repair_plans(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, gaps (turns missing between its first and last), blank, duplicate, truncated (rows by first fault),
    illegal (neighbours whose roles' initials are none of su, ua, au), cost, audit."""
    known = _plain(small_batches(rows), conv_id, turn, role, text)
    kind = known.schema["conv_id"].dataType.simpleString()
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {kind}, {', '.join(f'{x} bigint' for x in figures)}, audit string"

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, out = None, [], None

        def written(of: list[tuple]) -> pa.RecordBatch:
            names = ["conv_id", *figures, "audit"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in of], t) for i, t in enumerate([out, *[pa.int64()] * len(figures), pa.string()])], names)

        for batch in batches:
            out = batch.schema.field("conv_id").type
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "one", "two")), strict=True):
                if own is None or not _same(own.conv_id, key):
                    if own is not None:
                        done.append(own.row())
                    own = _Faults(key)
                own.add(*row)
            if len(done) >= 1000:
                yield written(done)
                done = []
        if own is not None:
            yield written([*done, own.row()])

    features = _in_order(known).select("conv_id", "turn", _code().alias("code"), F.xxhash64("role", "text").alias("one"), F.xxhash64(F.lit(1), "text", "role").alias("two"))
    return features.mapInArrow(decide, schema)


def _repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Conversations' repaired rows, in order and next to each other in their partitions."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    plan = plans.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("own"), "audit")
    both = _in_order(rows.withColumns({"own": F.lit(1), "audit": F.lit(None).cast("string")}).unionByName(plan), "own")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, state = "", 0, 0, 0
        for batch in batches:
            out = []
            for key, turn, role, text, own, plan in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "own", "audit")), strict=True):
                if not own:
                    audit, at, place, state = plan, 0, 0, 0
                    written = None
                else:
                    written = (turn, role, text, audit[at])
                    at += 1
                edits = [written] if written else []
                while at < len(audit) and audit[at] == "I":
                    edits.append((None, None, "", "I"))
                    at += 1
                for t, r, x, letter in edits:
                    if letter != "D":
                        system = letter == "K" and r[:1] == "s"
                        r = r if letter == "K" else "assistant" if state == 2 else "user"
                        state = 1 if system else _AFTER[state]
                        out.append((key, place, t, r, x, letter))
                        place += 1
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv_id", "place", "turn", "role", "text", "edit"])

    return both.mapInArrow(write, f"conv_id {kind}, place bigint, turn bigint, role string, text string, edit string")


def repair_conversations(rows: DataFrame, plans: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows: conv_id, place (from 0), turn (null where inserted), role, text, edit (K, R or I)."""
    plans = materialize(repair_plans(rows, conv_id, turn, role, text), "plans") if plans is None else plans
    return _repaired(_plain(small_batches(rows), conv_id, turn, role, text), plans)


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of each repaired conversation's ``role:text``, joined by line feeds; none for those of which nothing stays."""
    repaired = repair_conversations(rows, plans)
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, own, kind = None, None, None

        def written(of: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in of], kind), pa.array([r[1] for r in of], pa.string())], ["conv_id", "sha256"])

        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if running is not None:
                        done.append((own, running.hexdigest()))
                    running, own = hashlib.sha256(), key
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield written(done)
        if running is not None:
            yield written([(own, running.hexdigest())])

    return repaired.mapInArrow(digest, f"conv_id {kind}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults dealt by a hash of ``conv_id:turn``: dropped, emptied, cut off, repeated or given the user's role."""
    known = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    dealt = known.withColumn("fault", F.crc32(key) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", CLOSING, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def op11_repair_conversations(spark, sf_dir: str) -> DataFrame:
    """Conversations after damage, repaired: figures, cost, audit and digest of every conversation."""
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    plans = materialize(repair_plans(rows), "plans")
    digests = repaired_digests(rows, plans)
    every = given.select(F.col("conv_id").alias("conv")).distinct()
    found = every.join(plans, F.col("conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    found = found.join(digests, F.col("conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    figures = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return found.select(F.col("conv").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(none)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a fold over each conversation's rows: of every state the cheapest (cost, audit, text)."""
    dear = 1 << 40

    def add(v: str, cost: str, letter: str, line: str | None) -> str:
        text = f"{v}.r" if line is None else f"CASE WHEN {v}.r = '' THEN '' ELSE {v}.r || chr(10) END || {line}"
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'r': {text}}}"

    def when(condition: str, v: str) -> str:
        return f"CASE WHEN {condition} THEN {v} ELSE {{'c': {dear}, 'a': '', 'r': ''}} END"

    least = lambda *vs: f"list_min([{', '.join(vs)}])"
    cut = f"CASE WHEN truncated THEN {CUT_OFF} ELSE 0 END"
    keep = lambda v, initial: when(f"initial = '{initial}' AND NOT gone", add(v, cut, "K", "role || ':' || text"))
    rerole = lambda v, role: when("NOT gone", add(v, f"{REROLE} + {cut}", "R", f"'{role}:' || text"))
    drop = lambda v: add(v, str(DELETE), "D", None)
    users = [x for v in ("v0", "v1", "v3") for x in (keep(v, "u"), rerole(v, "user"))]
    insert = lambda v, role: add(v, str(INSERT), "I", f"'{role}:'")
    byte = "list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), dealt AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda crc, b: {byte}), 4294967295) % 20 AS fault
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE fault <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faults AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next
  FROM numbered
), judged AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND open AS truncated FROM faults
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS v0, {{'c': {dear}::BIGINT, 'a': '', 'r': ''}} AS v1,
    {{'c': {INSERT}::BIGINT, 'a': 'I', 'r': 'user:'}} AS v2, {{'c': {2 * INSERT}::BIGINT, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS v3
  FROM figures
  UNION ALL
  SELECT conv_id, i, b0, b1, c2, {least('b3', insert('c2', 'assistant'))} FROM (
    SELECT *, {least('b2', insert('b0', 'user'), insert('b1', 'user'), insert('b3', 'user'))} AS c2 FROM (
      SELECT s.conv_id, j.i, {drop('v0')} AS b0, {least(drop('v1'), keep('v0', 's'))} AS b1, {least(drop('v2'), *users)} AS b2,
        {least(drop('v3'), keep('v2', 'a'), rerole('v2', 'assistant'))} AS b3
      FROM steps s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.i + 1))
), solved AS (SELECT s.conv_id AS conv, f.*, {least('v0', 'v3')} AS v FROM steps s JOIN figures f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(v.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN solved ON o.conv_id IS NOT DISTINCT FROM conv
"""


OP11_SQL = _sql()
