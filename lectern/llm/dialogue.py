"""Repair of the turn structure of conversations by a retained-subsequence DP.

A conversation should be an optional system turn and then pairs of a user and an
assistant turn, `(s?(ua)+)?` in initials of roles, or empty. Turns may be kept
(cost 0), given the role user or assistant (1), deleted (2; blank turns and
repeats of an earlier role and text must be), and empty turns of user or
assistant inserted (5). A truncated turn that stays costs 5 more.

The DP chooses the turns that stay and their roles. What lies between two of
them is deleted, priced by a difference of prefix sums, and the pair of roles
fixes which turns are inserted between them. So going backwards one running
minimum for each role of the next turn is enough. Among the cheapest repairs
the one of the ASCII-least audit (initials of the edits in order) is taken:
deletions come before the insertion of a gap, a longer gap before a shorter
one, an insertion before none, keeping before a new role. All of that is known
where a minimum is taken.

Rows are sorted over all partitions by conversation and turn, so a conversation
of any length is spread over tasks. Pieces of PIECE rows at most are solved
apart: of a conversation in several pieces each piece has a matrix of costs from
role to role, which are multiplied from the end to give what follows a piece,
and then roles at the edges are passed on from the front. Only these small
summaries of a conversation meet in one row. Its digest is a hash over all its
text, so one task has to read that in order, but it streams.

Defined results: null roles and texts are one space; rows of one turn go by
role, then text; rows without a key are a conversation; a conversation without
rows isn't one; an empty table gives an empty table; other columns aren't looked
at, whatever their names; texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, rejoin

#: Rows of a conversation that are solved at once: 2 ** PIECE.
PIECE = 12
BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Roles before a place: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = (None, None, "user", "assistant")
FAR = 1 << 60
#: Turns to insert between a role and the next one; None where the next can't follow.
_BETWEEN = {
    NONE: {SYSTEM: 0, USER: 0, ASSISTANT: 1},
    SYSTEM: {USER: 0, ASSISTANT: 1},
    USER: {USER: 1, ASSISTANT: 0},
    ASSISTANT: {USER: 0, ASSISTANT: 1},
}
#: Turns to insert at the end, by the last role.
_AT_END = (0, 2, 1, 0)
END = [INSERT * n for n in _AT_END]
#: Bits of a turn's code above its initial (0 to 3).
FORCED, CUT = 4, 8


def _stay(code: int, role: int) -> tuple[int, str] | None:
    """Cost and letter of letting a turn stay in this role."""
    if code & FORCED or (role == SYSTEM and code & 3 != SYSTEM):
        return None
    extra = TRUNCATED if code & CUT else 0
    return (extra, "K") if code & 3 == role else (REROLE + extra, "R")


def choices(codes, after: list[int]) -> list[list[tuple | None]]:
    """By place (and one more, for none): by role before it, (cost from here, next place, its role, turns inserted, letter).

    after: cost of what follows the last turn, by the role before it. A next
    place of len(codes) means that all turns from here on are deleted.
    """
    n = len(codes)
    out: list[list[tuple | None]] = [[] for _ in range(n + 1)]
    prefix = DELETE * n
    out[n] = [(after[q], n, None, 0, "") for q in range(4)]
    best: dict[int, tuple] = {}  # role: (prefix + cost from the turn on, place, letter)
    for i in range(n - 1, -1, -1):
        prefix -= DELETE
        for role in (SYSTEM, USER, ASSISTANT):
            own = _stay(codes[i], role)
            if own:
                value = prefix + own[0] + out[i + 1][role][0]
                if role not in best or value < best[role][0]:
                    best[role] = (value, i, own[1])
        row = []
        for q in range(4):
            top = (DELETE * n + after[q], -n, 0, "", None)
            for role, added in _BETWEEN[q].items():
                if role in best:
                    value, at, letter = best[role]
                    option = (value + INSERT * added, -at, -added, letter, role)
                    if option[:4] < top[:4]:
                        top = option
            row.append((min(top[0] - prefix, FAR), -top[1], top[4], -top[2], top[3]))
        out[i] = row
    return out


def costs(codes) -> list[int]:
    """Matrix, row by row, of the least cost from each role before the turns to each role after them."""
    columns = [choices(codes, [0 if q == end else FAR for q in range(4)])[0] for end in range(4)]
    return [min(columns[end][q][0], FAR) for q in range(4) for end in range(4)]


def walk(codes, after: list[int], before: int, last: bool):
    """Edits in order and the role they end with: (place, order, letter, role, cost), place -1 for none.

    last: whether the conversation ends here, so that its last turns are inserted.
    """
    table, at, role, out = choices(codes, after), 0, before, []
    while at < len(codes):
        _, to, next_role, added, letter = table[at][role]
        out += [(i, 1, "D", None, DELETE) for i in range(at, to)]
        if next_role is None:
            break
        if added:
            out.append((to, 0, "I", USER if role in (NONE, SYSTEM, ASSISTANT) else ASSISTANT, INSERT))
        cost = (REROLE if letter == "R" else 0) + (TRUNCATED if codes[to] & CUT else 0)
        out.append((to, 1, letter, next_role if letter == "R" else None, cost))
        at, role = to + 1, next_role
    if last:
        for k in range(_AT_END[role]):
            role = ASSISTANT if role == USER else USER
            out.append((len(codes) - 1, 2 + k, "I", role, INSERT))
    return out, role


def illegal_pairs(codes, before: int) -> int:
    """Neighbours whose initials don't belong together; before: initial of the turn before the first, -1 for none."""
    initials = np.r_[before, np.asarray(codes, np.int64) & 3] if before >= 0 else np.asarray(codes, np.int64) & 3
    a, b = initials[:-1], initials[1:]
    fine = ((a == SYSTEM) & (b == USER)) | ((a == USER) & (b == ASSISTANT)) | ((a == ASSISTANT) & (b == USER))
    return int((~fine).sum())


# -- on Spark -------------------------------------------------------------------------------------


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def rows_of(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(n, key, id, turn, role, text, initial, blank, truncated), n rising in the order of the turns of each conversation."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    rows = turns.select(F.struct(F.col(key).alias("k")).alias("key"), F.col(key).alias("id"), F.col(turn).alias("turn"), _filled(role).alias("role"), _filled(text).alias("text"))
    rows = rows.select(
        "*",
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(NONE).alias("initial"),
        (end == "").alias("blank"),
        ((end != "") & ~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    # the ranges are drawn without the text, of which a sample would come to the driver
    place = (F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"))
    return cut(rows.repartitionByRange(*place).sortWithinPartitions(*place, "text").withColumn("n", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """(n, key, initial, fault): blank, duplicate or truncated, the first that a turn has, or null."""
    small = rows.select("n", "key", "initial", "blank", "truncated", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    same = ["key", "h1", "h2"]
    first = small.groupBy(*same).agg(F.min("n").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("n") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated")
    return rejoin(small, first, same).select("n", "key", "initial", fault.alias("fault"))


def _map_rows(df: DataFrame, run, schema: str) -> DataFrame:
    """run(row) yields tuples; rows come as dicts."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def each(batches):
        import pandas as pd

        for batch in batches:
            found = [out for row in batch.to_pylist() for out in run(row)]
            for at in range(0, len(found), 20_000):
                yield pa.RecordBatch.from_pandas(pd.DataFrame(found[at : at + 20_000], columns=names), schema=arrow, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = df.schema["key"].dataType
    typed = StructType.fromDDL(schema.replace("key key", f"key {kind.simpleString()}"))
    arrow = to_arrow_schema(typed)
    return df.mapInArrow(each, typed)


def _edges(pieces: DataFrame) -> DataFrame:
    """(key, piece, after, before, initial, last) of the pieces of conversations that have several."""
    several = cut(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    wide = cut(pieces.join(several, "key", "left_semi"))
    code = lambda row: [x["code"] for x in row["turns"]]
    summed = _map_rows(wide, lambda row: [(row["key"], row["piece"], costs(code(row)), code(row)[-1] & 3)], "key key, piece long, costs array<long>, initial int")
    whole = summed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "costs", "initial"))).alias("all"))

    def follow(row):
        after, initials = END, [-1, *(x["initial"] for x in row["all"][:-1])]
        for k in range(len(row["all"]) - 1, -1, -1):
            yield row["key"], row["all"][k]["piece"], after, initials[k], k == len(row["all"]) - 1
            matrix = np.array(row["all"][k]["costs"]).reshape(4, 4)
            after = np.minimum((matrix + np.array(after)).min(1), FAR).tolist()

    after = cut(_map_rows(whole, follow, "key key, piece long, after array<long>, initial int, last boolean"))
    ends = _map_rows(
        wide.join(after, ["key", "piece"]),
        lambda row: [(row["key"], row["piece"], [walk(code(row), row["after"], q, False)[1] for q in range(4)])],
        "key key, piece long, ends array<int>",
    )

    def lead(row):
        role = NONE
        for x in row["all"]:
            yield row["key"], x["piece"], role
            role = x["ends"][role]

    before = _map_rows(ends.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "ends"))).alias("all")), lead, "key key, piece long, before int")
    return cut(after.join(before, ["key", "piece"]))


def edits(faulty: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, n, place, letter, role, cost, illegal): the edits of each conversation in the order of (n, place).

    role is the new or inserted one; illegal: pairs of neighbours before the
    repair that don't belong together, counted at one edit of a piece.
    """
    code = F.col("initial") + F.when(F.col("fault").isin("blank", "duplicate"), FORCED).when(F.col("fault") == "truncated", CUT).otherwise(0)
    turn = F.struct("n", code.cast("int").alias("code"))
    pieces = cut(faulty.groupBy("key", F.shiftright("n", piece).alias("piece")).agg(F.sort_array(F.collect_list(turn)).alias("turns")))
    met = pieces.join(_edges(pieces), ["key", "piece"], "left")

    def run(row):
        codes, at = [x["code"] for x in row["turns"]], [x["n"] for x in row["turns"]]
        lone = row["after"] is None
        found, _ = walk(codes, END if lone else row["after"], NONE if lone else row["before"], lone or row["last"])
        wrong = illegal_pairs(codes, -1 if lone else row["initial"])
        for k, (i, place, letter, role, cost) in enumerate(found):
            yield row["key"], at[i], place, letter, NAMES[role] if role else None, cost, wrong if k == 0 else 0

    return _map_rows(met, run, "key key, n long, place int, letter string, role string, cost long, illegal long")


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """done with the text of each turn that stays or is inserted, and its role; deleted ones have neither."""
    own = rows.select("n", F.col("role").alias("own"), "text")
    met = done.join(own, "n", "left")
    stays = F.col("letter").isin("K", "R")
    role, text = F.when(F.col("letter") != "D", F.coalesce("role", "own")), F.when(stays, F.col("text")).when(F.col("letter") == "I", "")
    return met.select("key", "n", "place", "letter", "cost", "illegal", role.alias("role"), text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """(key, cost, illegal, audit, repaired_sha256) of each conversation, read in order."""

    def run(batches):
        now, empty = None, True

        def opened(key):
            return {"key": key, "cost": 0, "illegal": 0, "audit": bytearray(), "hash": hashlib.sha256(), "first": True}

        def closed(x):
            cells = [[x["key"]], [x["cost"]], [x["illegal"]], [x["audit"].decode()], [x["hash"].hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if empty or row["key"] != now["key"]:
                    if not empty:
                        out.append(closed(now))
                    now, empty = opened(row["key"]), False
                now["cost"] += row["cost"]
                now["illegal"] += row["illegal"]
                now["audit"] += row["letter"].encode()
                if row["role"] is not None:
                    now["hash"].update(("" if now["first"] else "\n").encode() + row["role"].encode() + b":" + row["text"].encode())
                    now["first"] = False
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if not empty:
            yield closed(now)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    typed = StructType.fromDDL(f"key {found.schema['key'].dataType.simpleString()}, cost long, illegal long, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(typed)
    read = found.select("key", "n", "place", "letter", "cost", "illegal", "role", "text")
    return read.repartition("key").sortWithinPartitions("key", "n", "place").mapInArrow(run, typed)


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Per conversation that has rows: key (named as in turns), gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = rows_of(turns, key, turn, role, text)
    faulty = cut(faults(rows))
    done = digests(repaired(rows, cut(edits(faulty, piece))))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    spans = rows.groupBy("key").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
    kinds = ("blank", "duplicate", "truncated")
    counts = faulty.groupBy("key").agg(*(F.count_if(F.col("fault") == k).alias(k) for k in kinds))
    out = done.join(spans, "key").join(counts, "key")
    return out.select(F.col("key.k").alias(key), "gaps", *kinds, "illegal", "cost", "audit", "repaired_sha256")


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The stated damage: by crc32 of `key:turn` modulo 20 a row is dropped (0), emptied (1), left without full stops (2), repeated (3) or given to the user (4)."""
    kind = F.crc32(F.concat(_filled(key), F.lit(":"), _filled(turn)).cast("binary")) % 20
    out = turns.select(F.col(key), F.col(turn), _filled(role).alias(role), _filled(text).alias(text), kind.alias("__kind")).where("__kind != 0")
    what = F.col("__kind")
    out = out.withColumn(text, F.when(what == 1, "").when(what == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)))
    out = out.withColumn(role, F.when(what == 4, "user").otherwise(F.col(role)))
    return out.withColumn("__copy", F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(key, turn, role, text)


def report(turns: DataFrame, found: DataFrame, key: str = "conv_id") -> DataFrame:
    """found for every key of turns; conversations of which no row is left have zeros and an empty repair."""
    all_ = turns.select(F.struct(F.col(key).alias("k")).alias("__key")).distinct()
    own = found.withColumn("__key", F.struct(F.col(key).alias("k"))).drop(key)
    met = all_.join(own, "__key", "left").select(F.col("__key.k").alias(key), *(c for c in found.columns if c != key))
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return met.fillna(zeros | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
