"""Conversation repair against exhaustive search on strings, with nulls, ties, repeats, giant conversations and small chunks."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from bayesloom.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest and then least of all edit strings, by trying every edit at every place (rows already in order)."""
    kind = faults(rows)

    @cache
    def rest(i, initials, inserts):
        """(cost, audit, lines) of rows i.. behind kept initials, or None; only what the pattern can still tell apart is kept."""
        options = []
        if i == len(rows) and LEGAL.match(initials):
            options.append((0, "", ()))

        def put(cost, edit, role, text, j, n):
            after = initials + role[:1]
            if not role[:1] or not re.match(r"s?(ua)*u?\Z", after):
                return
            after = after if len(after) < 4 else after[:-2]  # one more (ua) changes nothing
            if got := rest(j, after, n):
                options.append((cost + got[0], edit + got[1], ((role, text), *got[2])))

        if inserts < 3:
            put(3, "I", "user", "", i, inserts + 1)
            put(3, "I", "assistant", "", i, inserts + 1)
        if i < len(rows):
            _, _, role, text = rows[i]
            if got := rest(i + 1, initials, 0):
                options.append((4 + got[0], "D" + got[1], got[2]))
            if kind[i] not in ("blank", "duplicate"):
                late = 3 if kind[i] == "truncated" else 0
                put(late, "K", role, text, i + 1, 0)
                put(3 + late, "R", "user", text, i + 1, 0)
                put(3 + late, "R", "assistant", text, i + 1, 0)
        return min(options) if options else None

    for i in range(len(rows), 0, -5):  # from the end, so that recursion stays shallow
        for initials in ("", "s", "u", "su", "ua", "sua", "uau", "suau"):
            rest(i, initials, 0)
    cost, audit, lines = rest(0, "", 0)
    return cost, audit, lines


def plain(rows, conversations):
    out = {}
    for conv in conversations:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        kind = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = plain_repair(tuple(mine))
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kind.count("blank"), kind.count("duplicate"),
                     kind.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest())
    return out


def table(rng, n):
    rows = []
    for conv in [*range(n), None]:
        turn = 0
        for _ in range(rng.randrange(0, 8)):
            turn += rng.choice((1, 1, 1, 2, 5))
            rows.append((conv, rng.choice((turn, turn, turn, turn, None if not rows or rows[-1][:2] != (conv, None) else turn)),
                         rng.choice(("user", "assistant", "system", "user", "assistant", "tool", "", None)),
                         rng.choice(("Yes.", "No!", "What?", "cut off", " ", "", None, "Done. \n", "Ünïcode …", "a\nb."))))
    seen = set()  # one row without a turn in a conversation: their order isn't the contract's
    return [r for r in rows if not (r[1] is None and (r[0] in seen or seen.add(r[0])))]


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 20), (2, 1), (3, 3)])
def test_equals_exhaustive_search(spark, seed, chunk):
    rows = table(random.Random(seed), 60)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in cr.repair(cr.damage(df), df, chunk=chunk).collect()}
    assert got == plain(plain_damage(rows), {r[0] for r in rows})


def test_batches_and_long_conversations(spark):
    """One conversation over many batches and chunks equals the search over the whole; a copy of a row anywhere is found."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(("user", "assistant", "system")), f"Text {rng.randrange(60)}.") for t in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = [tuple(r) for r in cr.repair(df, chunk=20).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(7, *plain(rows, [7])[7])]


def test_repaired_rows_are_the_audit(spark):
    rows = table(random.Random(9), 40)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS kind", "1 AS edits", "2 AS known")
    lines = {}
    for r in sorted(cr.repair(df, output="rows").collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(r)
    for r in cr.repair(df).collect():
        mine = lines.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == r.repaired_sha256
        assert "".join(x.edit for x in mine) == r.audit.replace("D", "")
        assert LEGAL.match("".join(x.role[:1] for x in mine))


def test_empty_ties_and_types(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair(cr.damage(empty), empty).count() == 0
    # all rows gone: zeros and the digest of nothing
    got = cr.repair(empty, spark.createDataFrame([(3, 1, "user", "x")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    # text ids, int turns, rows of one turn: by role, repeats are duplicates in either order of the input
    rows = [("b", 1, "user", "Hi."), ("b", 1, "assistant", "Yes."), ("b", 1, "user", "Hi.")]
    a = cr.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    b = cr.repair(spark.createDataFrame(rows[::-1], "conv_id string, turn int, role string, text string")).collect()
    assert a == b and a[0].duplicate == 1 and a[0].gaps == 0 and a[0].conv_id == "b"
