"""Conversation structure repair: the cheapest edits that give every conversation the order its roles must have.

Rows are repartitioned by conversation and sorted by turn; `mapInPandas` then reads each partition as a stream. What
is carried from batch to batch for the open conversation is the state of a dynamic program: for each of four automaton
states (nothing yet, after system, user, assistant) the least cost, the order among the least audits, and a running
hash of the repaired text. So neither turns nor texts are held. Backpointers are four bytes a row and go to a file of
the task beyond `spill_rows` rows; a lost executor repeats the task from the shuffle files. Costs differ by a bounded
amount between states, so steps are looked up: (costs, order, kind of row) -> step.

Faults of a row, the first that holds: blank (nothing but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that is no white space is none of . ! ?). Edits: Keep 0, Rerole to user or
assistant 1, Delete 2 (blank and duplicate rows must go), Insert an empty user or assistant turn 5; a truncated row
that stays adds 5. Of equally cheap audits the least in ASCII order counts; it decides all edits.

Defined cases: null role and text are one space; null turns sort first; rows of a null conv_id are one conversation;
equal turns are ordered by role and text, so repeated rows are neighbours; a conversation without rows left has zeros,
an empty audit and the hash of the empty string; an empty table gives an empty result; other columns are not read; a
gap count beyond 2^63-1 is 2^63-1. A role's initial is its first character; an empty role has none.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE = "KRD"
INSERT = "I"
INSERT_COST, DELETE_COST, REROLE_COST, TRUNCATED_COST = 5, 2, 1, 5
#: States: nothing yet, after system, after user, after assistant; the state that follows by a user or assistant turn.
FOLLOWS = (2, 2, 3, 2)
NAMED = {2: "user", 3: "assistant"}
ACCEPTED = (0, 3)
#: A state this much dearer than the cheapest can't be on a cheapest way: two inserts, a deleted system row, an insert.
FAR = 2 * INSERT_COST + DELETE_COST + INSERT_COST
MUST_GO = 0
INITIALS = {"s": 0, "u": 1, "a": 2}
LARGEST = 2**63 - 1


def damaged(conversations: DataFrame) -> DataFrame:
    """Every row under one of twenty fates, by the checksum of `conv_id:turn`: lost, emptied, without . ! ?, repeated, made a user's, or left.

    Lost rows stay as rows with `lost` set, so that their conversations are still known.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(20)).alias("fate"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate").isin(0, 1), F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("lost"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """Rows with their faults, by conversation and turn: one shuffle, two sorts that spill. A boolean column `lost` marks rows
    that are there for their conversation only.

    The window over equal rows reuses the partitioning by conversation.
    """
    lost = F.col("lost") if dict(conversations.dtypes).get("lost") == "boolean" else F.lit(False)
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), lost.alias("lost")
    ).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    by = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
    of_null = F.lit(0).cast(dict(conversations.dtypes)["conv_id"])
    return rows.withColumn("again", nth > 1).withColumn("fault", fault).sortWithinPartitions(*by).select(
        # pandas would turn numbers with nulls among them into floats
        F.coalesce("conv_id", of_null).alias("conv"), F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", "fault", "lost",
    )


@cache
def step(costs: tuple, order: tuple, kind: int) -> tuple[tuple, tuple, int, tuple, bytes]:
    """New costs (from the least), new order, what was taken off, the ways (state, from, insert, edit), backpointers.

    costs: None for a state that no way leads to. order: the place of each state's least audit among those of all.
    kind: MUST_GO, or 1 + 2 * (0 system, 1 user, 2 assistant, 3 other) + (1 if truncated).
    """
    found: dict[int, tuple] = {}
    for p, cost in enumerate(costs):
        if cost is None:
            continue
        for inserted in (0, 1):
            at, so_far = (FOLLOWS[p], cost + INSERT_COST) if inserted else (p, cost)
            edits = [(DELETE, at, DELETE_COST)]
            if kind != MUST_GO:
                initial, truncated = divmod(kind - 1, 2)
                dear = TRUNCATED_COST * truncated
                to = {0: 1 if at == 0 else None, 1: 2, 2: 3}.get(initial)
                if to == 1 or (to and FOLLOWS[at] == to):
                    edits.append((KEEP, to, dear))
                edits.append((REROLE, FOLLOWS[at], REROLE_COST + dear))
            for edit, to, more in edits:
                key = (so_far + more, order[p], INSERT * inserted + edit)
                if to not in found or key < found[to][0]:
                    found[to] = (key, p, inserted, edit)
    least = min(f[0][0] for f in found.values())
    kept = {q: f for q, f in found.items() if f[0][0] - least <= FAR}
    by_audit = sorted(kept, key=lambda q: kept[q][0][1:])
    new_costs = tuple(kept[q][0][0] - least if q in kept else None for q in range(4))
    new_order = tuple(by_audit.index(q) if q in kept else None for q in range(4))
    ways = tuple((q, p, inserted, edit) for q, (_, p, inserted, edit) in sorted(kept.items()))
    back = bytes(kept[q][1] | kept[q][2] << 2 | "DKR".index(kept[q][3]) << 3 if q in kept else 255 for q in range(4))
    return new_costs, new_order, least, ways, back


class Backpointers:
    """Four bytes a row; those of `spill_rows` rows at a time go to a file of the task."""

    def __init__(self, spill_rows: int):
        self.most, self.held, self.file, self.spilled = 4 * spill_rows, bytearray(), None, 0

    def add(self, row: bytes) -> None:
        self.held += row
        if len(self.held) >= self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.spilled += len(self.held)
            self.held = bytearray()

    def audit(self, state: int, inserted: int) -> str:
        """The edits, read from the last row to the first."""
        out = bytearray(b"I" * inserted)
        part, left = self.held, self.spilled
        while True:
            for at in range(len(part) - 4, -1, -4):
                code = part[at + state]
                out.append(b"DKR"[code >> 3])
                if code & 4:
                    out += b"I"
                state = code & 3
            if not left:
                break
            left -= self.most
            self.file.seek(left)
            part = self.file.read(self.most)
        out.reverse()
        if self.file:
            self.file.close()
        return out.decode()


class Conversation:
    """What is carried along the rows of one conversation."""

    def __init__(self, spill_rows: int):
        self.costs, self.order, self.cost = (0, None, None, None), (0, None, None, None), 0
        self.hashes = {0: hashlib.sha256()}
        self.back = Backpointers(spill_rows)
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.initial = 0, None
        self.first = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.turn = turn
            self.first = turn if self.first is None else self.first
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        kind = MUST_GO if fault in ("blank", "duplicate") else 1 + 2 * INITIALS.get(initial, 3) + (fault == "truncated")
        self.costs, self.order, taken, ways, back = step(self.costs, self.order, kind)
        self.cost += taken
        self.back.add(back)
        old, said = self.hashes, f":{text}"
        self.hashes = {}
        for q, p, inserted, edit in ways:
            h = old[p].copy()
            at = p
            if inserted:
                h.update(f"{chr(10) if at else ''}{NAMED[FOLLOWS[at]]}:".encode())
                at = FOLLOWS[at]
            if edit != DELETE:
                h.update(f"{chr(10) if at else ''}{role if edit == KEEP else NAMED[q]}{said}".encode())
            self.hashes[q] = h

    def end(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        ends = []
        for p, cost in enumerate(self.costs):
            if cost is not None:
                ends += [((cost, self.order[p], ""), p, 0)] if p in ACCEPTED else []
                ends += [((cost + INSERT_COST, self.order[p], INSERT), p, 1)] if FOLLOWS[p] in ACCEPTED else []
        (cost, _, _), state, inserted = min(ends)
        h = self.hashes[state]
        if inserted:
            h.update(f"\n{NAMED[FOLLOWS[state]]}:".encode())
        gaps = 0 if self.first is None else min(self.turn - self.first + 1 - self.turns, LARGEST)
        f = self.faults
        return gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost + cost, self.back.audit(state, inserted), h.hexdigest()


class Spool:
    """The rows of one conversation for a second reading; beyond `most` characters they go to a file of the task."""

    def __init__(self, most: int):
        self.most, self.size, self.held, self.file = most, 0, [], None

    def add(self, role: str, text: str) -> None:
        self.held.append((role, text))
        self.size += len(text)
        if self.size > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.held, self.file)
            self.held, self.size = [], 0

    def rows(self) -> Iterator[tuple[str, str]]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.held


def _streamed(batches: Iterator[pd.DataFrame], spill_rows: int, spool: int | None = None) -> Iterator[tuple]:
    """(conv_id, Conversation, Spool) at the end of each conversation, whatever batches it came in."""
    key, now, rows = None, None, None
    for b in batches:
        for conv, no_conv, turn, no_turn, role, text, fault, lost in zip(*(b[c].tolist() for c in b.columns)):
            own = None if no_conv else conv
            if now is None or own != key:
                if now is not None:
                    yield key, now, rows
                key, now, rows = own, Conversation(spill_rows), Spool(spool) if spool else None
            if not lost:
                now.add(None if no_turn else turn, role, text, fault)
                if spool:
                    rows.add(role, text)
    if now is not None:
        yield key, now, rows


def _frames(rows: Iterator[tuple], names: list[str], size) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= 4_000_000:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held, n = [], 0
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


DIGEST = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def audits(conversations: DataFrame, spill_rows: int = 1 << 20) -> DataFrame:
    """One row for each conversation: what is wrong with it, the cheapest repair and the hash of its outcome."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((key, *now.end()) for key, now, _ in _streamed(batches, spill_rows))
        yield from _frames(rows, ["conv_id", *DIGEST], lambda r: 200 + len(r[7]))

    kind = dict(conversations.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return sorted_turns(conversations).mapInPandas(run, schema)


def repaired(conversations: DataFrame, spill_rows: int = 1 << 20, spool: int = 1 << 26) -> DataFrame:
    """The repaired conversations: conv_id, nth (from 0), role, text, edit (K, R or I)."""

    def edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for key, now, rows in _streamed(batches, spill_rows, spool):
            state, nth, read = 0, 0, rows.rows()
            for edit in now.end()[6]:
                role, text = ("", "") if edit == INSERT else next(read)
                if edit == DELETE:
                    continue
                state = FOLLOWS[state] if edit != KEEP else {"s": 1, "u": 2, "a": 3}[role[:1]]
                yield key, nth, role if edit == KEEP else NAMED[state], text, edit
                nth += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(edited(batches), ["conv_id", "nth", "role", "text", "edit"], lambda r: 100 + len(r[3]))

    return sorted_turns(conversations).mapInPandas(run, f"conv_id {dict(conversations.dtypes)['conv_id']}, nth long, role string, text string, edit string")


def report(conversations: DataFrame) -> DataFrame:
    """The digest that the query returns."""
    return audits(damaged(conversations))


#: The same rows, for DuckDB: checksums bit by bit, and the dynamic program as a recursion that carries whole texts.
ORACLE_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
fates AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                           lambda c, z: xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)))),
             CAST(4294967295 AS BIGINT)) % 20 AS fate
  FROM named),
turns AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fates)),
placed AS (
  SELECT *, left(role, 1) AS initial, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM turns),
faults AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
follows(p, q, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
leads(p, pos, cost, audit, turns_kept) AS (
  SELECT p, p, 0, '', CAST([] AS VARCHAR[]) FROM follows UNION ALL SELECT p, q, 5, 'I', [role || ':'] FROM follows),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': 0, 'audit': '', 'turns_kept': CAST([] AS VARCHAR[])} AS way FROM counted
  UNION ALL
  SELECT conv_id, i + 1, q, min(way) FROM (
    SELECT b.conv_id, b.i, o.q, {'cost': b.way.cost + l.cost + o.cost, 'audit': b.way.audit || l.audit || o.edit,
                                 'turns_kept': b.way.turns_kept || l.turns_kept || o.turns_kept} AS way
    FROM best b JOIN leads l ON l.p = b.q JOIN follows n ON n.p = l.pos
    JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1,
    LATERAL (
      SELECT l.pos AS q, 2 AS cost, 'D' AS edit, CAST([] AS VARCHAR[]) AS turns_kept
      UNION ALL
      SELECT n.q, 1 + 5 * CAST(f.fault = 'truncated' AS INTEGER), 'R', [n.role || ':' || f.text] WHERE f.fault NOT IN ('blank', 'duplicate')
      UNION ALL
      SELECT CASE f.initial WHEN 's' THEN 1 ELSE n.q END, 5 * CAST(f.fault = 'truncated' AS INTEGER), 'K', [f.role || ':' || f.text]
      WHERE f.fault NOT IN ('blank', 'duplicate') AND ((f.initial = 's' AND l.pos = 0) OR f.initial = left(n.role, 1))) o)
  GROUP BY conv_id, i, q),
done AS (
  SELECT b.conv_id, min({'cost': b.way.cost + l.cost, 'audit': b.way.audit || l.audit, 'turns_kept': b.way.turns_kept || l.turns_kept}) AS way
  FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN leads l ON l.p = b.q AND l.pos IN (0, 3)
  GROUP BY b.conv_id)
SELECT k.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(d.way.cost, 0) AS BIGINT) AS cost,
       coalesce(d.way.audit, '') AS audit, sha256(coalesce(array_to_string(d.way.turns_kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM k.conv_id
"""
