import functools
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import dialogue as d
from lectern.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, n long, key string"


def cheapest(turns):
    """(cost, audit, repaired) by trying each edit at each place: what follows is the least of all that can follow."""
    seen, faults = set(), []
    for role, text in turns:
        end = text.rstrip(d.BLANKS)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def rest(i, state, inserts):
        out = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        put = lambda cost, letter, line, *to: [(cost + c, letter + a, (*line, *x)) for c, a, x in [rest(*to)] if c < 1e9]
        if inserts < 2:
            for name in ("user", "assistant"):
                if name[0] in follow[state]:
                    out += put(5, "I", [name + ":"], i, name[0], inserts + 1)
        if i < len(turns):
            role, text = turns[i]
            out += put(2, "D", [], i + 1, state, 0)
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] else 0
                if role[:1] and role[0] in follow[state]:
                    out += put(extra, "K", [f"{role}:{text}"], i + 1, role[0], 0)
                for name in ("user", "assistant"):
                    if name[0] in follow[state]:
                        out += put(1 + extra, "R", [f"{name}:{text}"], i + 1, name[0], 0)
        return min(out, default=(1e9, "", ()))

    for i in range(len(turns), -1, -1):  # from the end, so that no call goes deep
        for state in follow:
            rest(i, state, 0)
    return *rest(0, "", 0), faults


def report_of(rows):
    """The expected row of a conversation's (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    cost, audit, lines, faults = cheapest([(r, x) for _, _, r, x in rows])
    turns = [t for known, t, _, _ in rows if known]
    initials = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made_up(seed, conversations, most=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "open", "", " \n\t", "Why? ", "long " * 30 + ".", "a\nb.", "é。", None]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, most)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]), rng.choice(texts), 7, "x"))
    return rows


@pytest.mark.parametrize("piece", [0, 1, 2, d.PIECE])
def test_against_all_edits(spark, piece):
    rows = made_up(piece, 60)
    got = d.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), piece=piece).collect()
    own = {}
    for c, t, r, x, *_ in rows:
        own.setdefault(c, []).append((t, r, x))
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: report_of(own[c]) for c in own} and len(got) == len(own)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=9), st.integers(0, 9))
def test_pieces_agree_with_the_whole(codes, at):
    """Solved in two parts by matrices, the edits are those of the whole."""
    whole, role = d.walk(codes, d.END, d.NONE, True)
    left, right = codes[:at], codes[at:]
    if left and right:
        matrix = d.costs(right)
        after = [min(matrix[4 * q + r] + d.END[r] for r in range(4)) for q in range(4)]
        assert after == [d.choices(right, d.END)[0][q][0] for q in range(4)]
        first, middle = d.walk(left, after, d.NONE, False)
        second, _ = d.walk(right, d.END, middle, True)
        assert [x[2:] for x in first + second] == [x[2:] for x in whole]


def test_registered_query_against_all_edits(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    own = {r.conv_id: [] for r in table.collect()}
    for r in d.damage(table).collect():
        own[r.conv_id].append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_dialogue"](spark, folder).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: report_of(rows) if rows else empty for c, rows in own.items()}


def test_one_conversation_over_all_tasks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["So.", f"t{t}.", "open"]), 0, "") for t in range(600)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows come together again
    try:
        spread = d.rows_of(table, "conv_id", "turn", "role", "text").selectExpr("shiftright(n, 33) as p").distinct().count()
        (got,) = d.repair(table, piece=4).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1
    assert tuple(got)[1:] == report_of([r[1:4] for r in rows])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert d.repair(none).count() == 0 and d.report(none, d.repair(d.damage(none))).count() == 0
