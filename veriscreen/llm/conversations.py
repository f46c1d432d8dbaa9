"""Conversation structure repair: the cheapest edits that make a conversation's roles read (s?(ua)+)?.

A DuckDB recursive query inside hash-partitioned batches. Conversations are dealt by a hash of their id and read in the order of their
turns. A task cuts them into pieces of up to PIECE rows, puts the pieces of about BATCH rows into one recursive query, and each recursion
advances all pieces by a row: it keeps, for each state of the grammar that a piece is entered by and each that it is left by, the
minimum cost and the ASCII-least audit with it. Pieces of a conversation are chained afterwards: costs add up and audits follow each
other, which is exact, since of two audits of equal cost for the same rows neither begins the other.

States: nothing yet, after a system row, after a user row, after an assistant row. The first and the last accept. Edits of a row and
their letters: K keeps it; R gives it the role that the state asks for (3); D deletes it (4; the only edit of a blank or repeated row);
I puts an empty row of the role that the state asks for before the next row or at the end (3). A truncated row that stays costs 3 more.
Letters and state fix the roles, so an audit stands for one repaired conversation.

A task holds a batch of rows at a time, and for an unfinished conversation the audits of four states and four running hashes: a
conversation of any length passes in bounded memory but for its audit, which is one value by the result's form. Conversations
are spread by hash, and a conversation's rows meet in one task, since its audit and its hash are each one sequential value.

Null roles and texts are one space, null ids make one conversation, null turns come first. Rows of equal turn follow each other by role and text.
An empty role has no initial and fits no state. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crc import crc32_sql
from .words import trim

BATCH = 16_384  # rows of a recursive query, about
BATCH_BYTES = 32 << 20  # of their texts, about
PIECE = 128  # rows of a piece, at most
WHITE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # state after a row of the role that a state asks for
ROLE = {USER: "user", ASSISTANT: "assistant"}
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LARGEST = (1 << 63) - 1


def moves() -> list[tuple[int, str, int, int, str]]:
    """(state, class of the row, next state, cost, letters): classes are the initials s, u, a, other ones (o), and rows that must go (d)."""
    out = []
    for state in NEXT:
        for kind in "suaod":
            out.append((state, kind, state, DELETE, "D"))
            if kind == "d":
                continue
            for before, at in (("", state), ("I", NEXT[state])):
                cost = INSERT * len(before)
                if kind == "s" and at == NOTHING:
                    out.append((state, kind, SYSTEM, cost, before + "K"))
                fits = kind == ROLE[NEXT[at]][0]
                out.append((state, kind, NEXT[at], cost + (0 if fits else RELABEL), before + ("K" if fits else "R")))
    return out


_MOVES = ", ".join(f"({p}, '{c}', {q}, {cost}, '{letters}')" for p, c, q, cost, letters in moves())
RECURSION = f"""WITH RECURSIVE m(p, kind, q, cost, letters) AS (VALUES {_MOVES}),
t AS (SELECT piece, entry, entry AS state, 0::BIGINT AS k, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM entries
UNION ALL
SELECT t.piece, t.entry, m.q, t.k + 1, min({{'cost': t.best.cost + m.cost + CASE WHEN m.letters = 'D' THEN 0 ELSE r.extra END, 'audit': t.best.audit || m.letters}})
FROM t JOIN r ON r.piece = t.piece AND r.k = t.k + 1 JOIN m ON m.p = t.state AND m.kind = r.kind GROUP BY t.piece, t.entry, m.q, t.k)
SELECT t.piece, t.entry, t.state, t.best.cost AS cost, t.best.audit AS audit FROM t JOIN n ON n.piece = t.piece AND n.n = t.k"""

FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of rows(conv_id, turn, role, text), damaged by crc32(`conv_id:turn`) % 20: 0 leaves the row
    out (present is false), 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20).alias("_d"))
    d = F.col("_d")
    copies = F.when(d == 0, F.array(F.lit(False))).when(d == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    text = F.when(d <= 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def in_order(rows: DataFrame, present: Column) -> DataFrame:
    """(conv_id, turn, role, text, fault, kind): rows in the order of conversations, each conversation's in one partition. fault: 0 none, 1 blank, 2 repeated,
    3 truncated, null for rows that are not present. The window needs no shuffle of its own."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.coalesce(present, F.lit(False)).alias("present")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn")) > 1
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(~F.col("present"), None).when(end == "", 1).when(F.col("seen"), 2).when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("fault").isin(1, 2), "d").when(initial.isin("s", "u", "a"), initial).otherwise("o")
    out = own.withColumn("seen", seen).withColumn("fault", fault).withColumn("kind", kind)
    return out.select("conv_id", "turn", "role", "text", "fault", "kind").sortWithinPartitions("conv_id", "turn", "role", "text")


class _Open:
    """A conversation that is being read: its counts, and for each state (cost, audit, hash of the repaired rows, whether there are any)."""

    def __init__(self, conv):
        self.conv, self.counts, self.illegal, self.last = conv, [0, 0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = 0
        self.states = {NOTHING: (0, "", hashlib.sha256(), False)}

    def see(self, turn, role: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
            self.turns += 1
        initial = role[:1]
        self.illegal += self.last is not None and (self.last, initial) not in LEGAL
        self.last = initial

    def advance(self, found: dict, rows: list[tuple], ends: bool) -> None:
        """Chains a piece: found has (state, cost, audit) of each entry."""
        best: dict[int, tuple] = {}
        for entry, (cost, audit, _, _) in self.states.items():
            for state, more, letters in found[entry]:
                option = cost + more, audit + letters, entry, letters
                if state not in best or option[:2] < best[state][:2]:
                    best[state] = option
        if ends:  # only the state that wins needs its rows
            best = {(x := min(best, key=lambda s: self.closed(s, *best[s][:2]))): best[x]}
        self.states = {s: (cost, audit, *_written(self.states[entry][2].copy(), self.states[entry][3], entry, letters, rows)) for s, (cost, audit, entry, letters) in best.items()}

    @staticmethod
    def closed(state: int, cost: int, audit: str) -> tuple[int, str]:
        return cost + INSERT * len(ENDING[state]), audit + ENDING[state]

    def row(self) -> tuple:
        state = min(self.states, key=lambda s: self.closed(s, *self.states[s][:2]))
        cost, audit, digest, some = self.states[state]
        cost, audit = self.closed(state, cost, audit)
        digest, _ = _written(digest.copy(), some, state, ENDING[state], [])
        gaps = 0 if self.low is None else min(LARGEST, self.high - self.low + 1 - self.turns)
        return self.conv, gaps, *self.counts[1:], self.illegal, cost, audit, digest.hexdigest()


def edited(state: int, letters: str, rows: list[tuple]) -> Iterator[tuple[str, str, str, int]]:
    """(letter, role, text, state after it) for each letter of an audit over rows(role, text), entered by a state; deleted rows as they were."""
    at = iter(rows)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "K":
            state = SYSTEM if role[0] == "s" else NEXT[state]
        elif letter != "D":
            state = NEXT[state]
            role = ROLE[state]
        yield letter, role, text, state


def _written(digest, some: bool, state: int, letters: str, rows: list[tuple]):
    for letter, role, text, _ in edited(state, letters, rows):
        if letter != "D":
            digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
    return digest, some


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    now: _Open | None = None
    rows: list[tuple] = []  # (conversation, turn, role, text, fault, kind), of which the first may go on from before
    size = 0

    def solve(last: bool) -> list[tuple]:
        nonlocal now
        done, pieces, ends = [], [], []
        for own in rows:
            conv, fault = own[0], own[4]
            if now is None or now.conv != conv:
                if pieces and pieces[-1][0] is now:
                    ends.append(len(pieces) - 1)
                if now is not None:
                    done.append(now)
                now = _Open(conv)
            if fault is None:
                continue
            now.see(own[1], own[2], fault)
            if not pieces or pieces[-1][0] is not now or len(pieces[-1][1]) == PIECE:
                pieces.append((now, []))
            pieces[-1][1].append(own)
        if last and now is not None:
            if pieces and pieces[-1][0] is now:
                ends.append(len(pieces) - 1)
            done.append(now)
            now = None
        if pieces:
            number = [k for k, (_, own) in enumerate(pieces) for _ in own]
            flat = [x for _, own in pieces for x in own]
            place = [j for _, own in pieces for j in range(1, len(own) + 1)]
            # a conversation's first piece is entered by one state, its others by any
            fresh = {k: k and pieces[k - 1][0] is pieces[k][0] or bool(pieces[k][0].states.keys() - {NOTHING}) for k in range(len(pieces))}
            entries = [(k, e) for k in fresh for e in (range(4) if fresh[k] else [NOTHING])]
            db.register("r", pa.table({"piece": pa.array(number, pa.int64()), "k": pa.array(place, pa.int64()), "kind": [x[5] for x in flat], "extra": pa.array([TRUNCATED if x[4] == 3 else 0 for x in flat], pa.int64())}))
            db.register("n", pa.table({"piece": pa.array(range(len(pieces)), pa.int64()), "n": pa.array([len(own) for _, own in pieces], pa.int64())}))
            db.register("entries", pa.table({"piece": pa.array([k for k, _ in entries], pa.int64()), "entry": pa.array([e for _, e in entries], pa.int32())}))
            found: list[dict] = [{} for _ in pieces]
            for piece, entry, state, cost, audit in db.execute(RECURSION).fetchall():
                found[piece].setdefault(entry, []).append((state, cost, audit))
            closing = set(ends)
            for k, (conv, own) in enumerate(pieces):
                conv.advance(found[k], [(x[2], x[3]) for x in own], k in closing)
        return [x.row() for x in done]

    def table(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [x.split()[0] for x in FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], kind) for j, kind in enumerate(kinds)], names)

    for batch in batches:
        for own in zip(*(x.to_pylist() for x in batch.columns)):
            rows.append(own)
            size += len(own[3])
            if len(rows) >= BATCH or size >= BATCH_BYTES:
                found = solve(False)
                rows, size = [], 0
                if found:
                    yield table(found)
                trim()
    if found := solve(True):
        yield table(found)
    db.close()
    trim()


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """A row for each conversation of rows(conv_id, turn, role, text): gaps in its turns, blank, repeated and truncated rows, illegal neighbours, cost and audit of
    the cheapest repair, SHA-256 of its `role:text` lines. present: rows for which it is not true only name their conversation."""
    return in_order(rows, F.lit(True) if present is None else present).mapInArrow(_repair, FOUND)


ROWS = "conv_id long, place long, edit string, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation behind a row with its audit: a row is written with the inserts before it, the last also with those after it."""
    audit, core, at, state, place = "", 0, 0, NOTHING, 0
    for batch in batches:
        out = []
        for conv, new, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if new is not None:
                audit, core, at, state, place = new, len(new.rstrip("I")), 0, NOTHING, 0
                continue
            end = at
            while audit[end] == "I":
                end += 1
            end = len(audit) if end + 1 == core else end + 1
            for letter, own, words, state in edited(state, audit[at:end], [(role, text)]):
                if letter != "D":
                    out.append((conv, place, letter, own, words))
                    place += 1
            at = end
        if out:
            names = [x.split()[0] for x in ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names)


def repaired_rows(rows: DataFrame, found: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows that the audits of repair() leave, from place 0 on. One pass in the order of conversations."""
    own = in_order(rows, F.lit(True) if present is None else present).where("fault is not null").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = heads.union(own).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_apply, ROWS)


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_ENDS = ", ".join(f"({state}, '{letters}', {INSERT * len(letters)}, [{', '.join(repr(x + ':') for x in ('user', 'assistant')[2 - len(letters):])}]::VARCHAR[])" for state, letters in ENDING.items())
_INSERTED = ", ".join(f"({p}, {q}, '{ROLE[q]}')" for p, q in NEXT.items())
DUCKDB_SQL = f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({crc32_sql(_KEY)}) % 20 AS d FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS fin FROM e),
f AS (SELECT *, CASE WHEN fin = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN right(fin, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
r AS (SELECT *, CASE WHEN fault IN (1, 2) THEN 'd' WHEN i IN ('s', 'u', 'a') THEN i ELSE 'o' END AS kind, CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END AS extra FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
m(p, kind, q, cost, letters) AS (VALUES {_MOVES}),
x(p, q, role) AS (VALUES {_INSERTED}),
z(state, letters, cost, lines) AS (VALUES {_ENDS}),
t AS (SELECT DISTINCT conv_id, {NOTHING} AS state, 0::BIGINT AS k, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM conversations
UNION ALL
SELECT t.conv_id, m.q, t.k + 1, min({{'cost': t.best.cost + m.cost + CASE WHEN m.letters = 'D' THEN 0 ELSE r.extra END, 'audit': t.best.audit || m.letters,
'lines': t.best.lines || CASE WHEN m.letters LIKE 'I%' THEN [x.role || ':'] ELSE []::VARCHAR[] END || CASE WHEN m.letters = 'D' THEN []::VARCHAR[] WHEN right(m.letters, 1) = 'K' THEN [r.role || ':' || r.text] ELSE [CASE m.q WHEN {USER} THEN 'user:' ELSE 'assistant:' END || r.text] END}})
FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.k = t.k + 1 JOIN m ON m.p = t.state AND m.kind = r.kind JOIN x ON x.p = t.state GROUP BY t.conv_id, m.q, t.k),
b AS (SELECT t.conv_id, min({{'cost': t.best.cost + z.cost, 'audit': t.best.audit || z.letters, 'lines': t.best.lines || z.lines}}) AS best FROM t JOIN z USING (state) LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM t.conv_id WHERE t.k = coalesce(c.n, 0) GROUP BY t.conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""
