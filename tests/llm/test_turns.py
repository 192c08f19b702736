import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from molgrid.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def fates(rows):
    """The rows after damage, by conversation, written anew from the contract."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def brute(rows):
    """Every sequence of edits that can be the cheapest; at most two inserts in a row."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    known = [t for t, _, _ in rows if t is not None]

    @cache
    def best(i, said, inserts):
        """(cost, audit, kept turns) from row i on, after turns with the initials `said` (its end only)."""
        found = []
        if i == len(rows) and said in ("", "a"):
            found.append((0, "", ()))
        need = "a" if said == "u" else "u"
        name = {"u": "user", "a": "assistant"}[need]
        if inserts < 2:
            c, a, t = best(i, need, inserts + 1)
            found.append((c + 5, "I" + a, (f"{name}:", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, said, 0)
            found.append((c + 2, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                c, a, t = best(i + 1, need, 0)
                found.append((c + 1 + more, "R" + a, (f"{name}:{text}", *t)))
                if initials[i] == need or (initials[i] == "s" and said == ""):
                    c, a, t = best(i + 1, initials[i], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, kept = best(0, "", 0)
    gaps = known and max(known) - min(known) + 1 - len(set(known)) or 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = (faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def invented(rng, conversations, most):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ünder", "usher"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice(["A b.", "c", "Why?", " \t", "", None, "d! ", f"Own {turn}."])))
    rng.shuffle(rows)
    return rows


def digests(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rows = invented(random.Random(seed), 150, 9)
    assert digests(turns.report(spark.createDataFrame(rows, SCHEMA).repartition(3))) == {c: brute(own) for c, own in fates(rows).items()}


def test_edge_rows(spark):
    rows = [(None, None, None, None), (None, 4, "user", "x."), (1, None, "user", None), (2, 1, "user", "a."), (2, 1, "user", "a."), (2, 1, "user", "a."), (3, -(2**62), "user", "A" * 300_000), (3, 2**62, "assistant", "."), (4, 0, "", "?")]
    names = ["lost_", "copy", "fate", "fault", "again", "conv", "no_turn"]
    wide = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], SCHEMA + ", " + ", ".join(f"{n} string" for n in names))
    assert digests(turns.report(wide)) == {c: brute(own) for c, own in fates(rows).items()}
    clashing = spark.createDataFrame([(1, 0, "user", "a.", "x")], SCHEMA + ", lost string")
    assert digests(turns.audits(clashing))[1] == brute([(0, "user", "a.")])
    assert turns.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert turns.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversation_of_lost_rows(spark):
    lost = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert digests(turns.report(spark.createDataFrame([(7, lost, "user", "a.")], SCHEMA))) == {7: EMPTY}


def test_far_turns(spark):
    rows = [(3, -(2**63), "user", "a."), (3, 2**63 - 1, "assistant", "b.")]
    assert digests(turns.audits(spark.createDataFrame(rows, SCHEMA)))[3][0] == turns.LARGEST


def test_giant_conversation_spills(spark):
    """Over many Arrow batches, with backpointers and texts in files: the same as unspilled, and as brute force."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"c{t}.", f"d{t}!", f"e{t}"])) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        small, kept = digests(turns.audits(df, spill_rows=7)), turns.repaired(df, spill_rows=7, spool=50).orderBy("nth").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == digests(turns.audits(df))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == small[1][7]
    assert "".join(r.edit for r in kept) == small[1][6].replace("D", "") and [r.nth for r in kept] == list(range(len(kept)))
    part = [(1, t, r, x) for _, t, r, x in rows[:200]]
    assert digests(turns.audits(spark.createDataFrame(part, SCHEMA)))[1] == brute([(t, r, x) for _, t, r, x in part])


def test_repaired_rows(spark):
    rows = invented(random.Random(9), 60, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    told = digests(turns.audits(df))
    kept = {}
    for r in turns.repaired(df).orderBy("conv_id", "nth").collect():
        kept.setdefault(r.conv_id, []).append(r)
    for conv, digest in told.items():
        own = kept.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest[7]


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = {r[0]: tuple(r)[1:] for r in con.sql(turns.ORACLE_SQL).fetchall()}
    assert digests(turns.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))) == want


def test_one_shuffle(spark, sf_dir):
    plan = turns.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
