"""Conversation repair against exhaustive search and a plain dynamic programme."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from veriscreen.llm import conversations

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    """{conversation: rows(turn, role, text) in order}"""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def edits(row, fault):
    """(letter, cost, line or None)"""
    yield "D", 4, None
    if fault not in ("blank", "duplicate"):
        for letter, cost, role in (("K", 0, row[1]), ("R", 3, "user"), ("R", 3, "assistant")):
            yield letter, cost + 3 * (fault == "truncated"), (role, row[2])


INSERTS = [("I", 3, ("user", "")), ("I", 3, ("assistant", ""))]
OPEN, SHUT = re.compile(r"s?(ua)*u?\Z"), re.compile(r"(s?(ua)+)?\Z")


def exhaustive(rows):
    slots = [list(itertools.chain.from_iterable(itertools.product(INSERTS, repeat=k) for k in range(3)))] * (len(rows) + 1)
    found = []
    own = [list(edits(r, f)) for r, f in zip(rows, faults(rows))]
    for before in itertools.product(*slots):
        for chosen in itertools.product(*own):
            steps = [x for k in range(len(rows)) for x in (*before[k], chosen[k])] + list(before[-1])
            lines = [x for _, _, x in steps if x is not None]
            if SHUT.match("".join(role[:1] or "-" for role, _ in lines)):
                found.append((sum(c for _, c, _ in steps), "".join(x for x, _, _ in steps), "\n".join(f"{a}:{b}" for a, b in lines)))
    return min(found)


def programme(rows):
    """Keeps the best (cost, audit, lines) for each sequence of initials, cut to what decides what may follow."""
    def state(initials):
        return initials and ("s" if initials == "s" else initials[-1])

    def step(best, options):
        new = {}
        for (cost, audit, lines), s in ((v, s) for s, v in best.items()):
            for letter, more, line in options:
                to = s if line is None else None
                if line is not None:
                    i = line[0][:1]
                    to = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].get(i)
                    if to is None:
                        continue
                item = cost + more, audit + letter, lines + ([f"{line[0]}:{line[1]}"] if line else [])
                new[to] = min(new.get(to, item), item)
        return new

    def merged(*maps):
        return {s: min(m[s] for m in maps if s in m) for s in {k for m in maps for k in m}}

    def opened(best):
        one = step(best, INSERTS)
        return merged(best, one, step(one, INSERTS))

    best = {"": (0, "", [])}
    for row, fault in zip(rows, faults(rows)):
        best = step(opened(best), list(edits(row, fault)))
    best = opened(best)
    return min((c, a, "\n".join(x)) for s, (c, a, x) in best.items() if s in ("", "a"))


def expected(conv, rows, solve):
    turns = [t for t, _, _ in rows if t is not None]
    kinds = faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = solve(rows)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def made(seed, conversations_, length):
    rng = random.Random(seed)
    for conv in range(conversations_):
        for turn in range(rng.randint(1, length)):
            text = rng.choice(["Yes.", "No!", "Well", " \t", "", "a" * 5, "Wait. ", "Why?\n", None, "été."])
            yield conv, rng.choice([turn, turn, turn, turn + 3, 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "umpire"]), text


SCHEMA = "conv_id long, turn long, role string, text string, present string, `a.b` int, audit int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def repaired(spark, rows):
    return conversations.repair(conversations.damaged(frame(spark, rows)), F.col("present"))


def test_small_conversations_against_all_edits(spark):
    rows = [*made(1, 60, 3), (None, 1, "user", "Hello."), (None, None, "assistant", "Hello."), (70, 0, "user", "One."), (70, 0, "user", "One.")]
    got = sorted(map(tuple, repaired(spark, rows).collect()), key=repr)
    want = [expected(conv, own, exhaustive if len(own) < 4 else programme) for conv, own in damage(rows).items()]
    assert got == sorted(want, key=repr)
    assert {x for r in got for x in r[7]} == set("DIKR")


def test_conversations_of_many_pieces(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "tool"]), f"turn {rng.randrange(300)}{rng.choice(['.', '', '!'])}") for k in range(1000)]
    rows += [(8, None, "user", "The same.")] * 300 + [(9, k, "assistant" if k % 2 else "user", f"Turn {k}.") for k in range(257)]
    rows += list(made(3, 200, 12))
    rows = [(c + 1000 * (c < 7 and len(t or "") < 99 and c not in (7, 8, 9)), k, r, t) for c, k, r, t in rows]
    got = sorted(map(tuple, repaired(spark, rows).collect()))
    assert got == sorted(expected(conv, own, programme) for conv, own in damage(rows).items())


def test_batches_end_within_conversations():
    """The task's own function, over batches that end anywhere: results do not depend on where."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = [(c, k, rng.choice(["user", "assistant"]), f"{k} {'.' * rng.randrange(2)}", rng.choice([0, 0, 2, 3]), "") for c in range(3) for k in range(300)]
    rows = [(c, k, r, t, f, "d" if f == 2 else r[0]) for c, k, r, t, f, _ in rows]
    batches = lambda: [pa.RecordBatch.from_pylist([dict(zip(("conv_id", "turn", "role", "text", "fault", "kind"), r)) for r in rows])]
    found = []
    for size in (conversations.BATCH, 64, 1):
        before, conversations.BATCH = conversations.BATCH, size
        try:
            found.append([tuple(r.values()) for b in conversations._repair(iter(batches())) for r in b.to_pylist()])
        finally:
            conversations.BATCH = before
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


def test_rows_that_the_audit_leaves(spark):
    rows = [*made(9, 80, 6), *((500, k, "user", f"Turn {k}.") for k in range(400))]
    broken = conversations.damaged(frame(spark, rows)).cache()
    found = conversations.repair(broken, F.col("present"))
    left = conversations.repaired_rows(broken, found, F.col("present")).orderBy("conv_id", "place").collect()
    by = {}
    for r in left:
        assert r.place == len(by.setdefault(r.conv_id, []))
        by[r.conv_id].append(f"{r.role}:{r.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(by.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_empty_table(spark):
    assert repaired(spark, []).collect() == []
    alone = conversations.repair(spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id int, turn int, role string, text string"))
    assert [(r.cost, r.audit) for r in alone.collect()] == [(3, "KI")]
