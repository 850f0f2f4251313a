"""SimHash near-duplicates by a binary trie self-join.

Every text has a 64-bit fingerprint: the majority of the bits of its shingles'
hashes. Distinct fingerprints are the leaves of a binary trie. The trie is
joined with itself by walking pairs of nodes together from the root down,
adding up differing bits and leaving a pair once it exceeds the budget.

If two fingerprints differ in at most r bits, one of r + 1 parts of the bits is
equal. So r + 1 tries are walked, each over the bits rotated so that another
part leads, and the budget within the leading part is 0: there the walk keeps
to the diagonal, which is a grouping by the leading bits. Below it the subtries
are joined with the full budget, many in one task. A subtrie too large for a
task is split in Spark into pairs of its children, again within the budget.

A task does not emit all pairs it finds: it keeps a spanning forest of them.
Exact copies are one leaf, whatever their number.

Defined results: a null text is the empty text; texts without words share the
fingerprint zero and are linked like any other; texts of any length are hashed
whole, CHUNK shingles at a time; an empty table gives an empty table; repeated
rows each have their row; a component of rows without an id has a null
component id; columns beside key and text are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, rejoin, tidy
from lectern.llm.graph import components

SEED = 42
#: Shingles whose bits are added up at once; bounds the memory for a long text.
CHUNK = 1 << 15
#: Leaves of a subtrie pair above which it is split, and leaves of a task.
SUBTRIE_ROWS, TASK_ROWS = 20_000, 16_000
#: Bits by which a too large subtrie is split at a time.
SPLIT_BITS = 4
#: Node pairs walked at once.
FRONT = 1 << 20


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit fingerprint; a bit is set if more than half of the shingles' hashes set it."""
    own = (text or "").encode().lower().split()  # of bytes: A-Z, and ASCII white space
    if not own:
        return 0
    if len(own) < words:
        shingles = [b" ".join(own)]
    else:
        shingles = list(map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[at : at + CHUNK]], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), words) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "fp"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def _rotated(fp, by: int):
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _split(pairs: DataFrame, budget: int) -> DataFrame:
    """Each pair of subtries as the pairs of their children, at most `budget` bits apart in all."""
    masks = [(sum(1 << b for b in flips), n) for n in range(min(budget, SPLIT_BITS) + 1) for flips in combinations(range(SPLIT_BITS), n)]
    table = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(n).alias("n")) for m, n in masks))
    own = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64 - SPLIT_BITS) - F.col("depth")).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
    rows = pairs.withColumn("own", own).withColumn("to", F.explode(table)).where(F.col("far") + F.col("to.n") <= budget)
    wide = F.lit(1 << SPLIT_BITS)
    mine = F.col("own")
    other = mine.bitwiseXOR(F.col("to.m"))
    same = F.col("a") == F.col("b")
    first = F.when(same, mine <= other).otherwise(F.col("side") == 0)
    child_a, child_b = F.when(first, mine).otherwise(other), F.when(first, other).otherwise(mine)
    return rows.select(
        "turn",
        (F.col("depth") + SPLIT_BITS).alias("depth"),
        (F.col("a") * wide + child_a).alias("a"),
        (F.col("b") * wide + child_b).alias("b"),
        (F.col("far") + F.col("to.n")).alias("far"),
        F.when(first, 0).otherwise(1).alias("side"),
        "fp",
    )


class _Walk:
    """Joins the subtries of one task; `find` yields the pairs of leaves within the budget."""

    def __init__(self, fps: np.ndarray, budget: int):
        self.fps, self.budget, self.sums = fps, budget, {}

    def _ones(self, depth: int) -> np.ndarray:
        if depth not in self.sums:
            self.sums[depth] = np.concatenate([[0], np.cumsum((self.fps >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return self.sums[depth]

    def find(self, front: np.ndarray, depth: int):
        """front: rows of (a from, a to, b from, b to, bits apart) of nodes at this depth; a node with itself finds its inner pairs."""
        work = [(front, depth)]
        while work:
            front, depth = work.pop()
            if len(front) > FRONT:
                half = len(front) // 2
                work += [(front[:half], depth), (front[half:], depth)]
                continue
            a0, a1, b0, b1, _ = front.T
            lone = (a1 - a0 == 1) & (b1 - b0 == 1)
            if lone.any():
                i, j = a0[lone], b0[lone]
                i, j = i[i != j], j[i != j]
                near = np.bitwise_count(self.fps[i] ^ self.fps[j]) <= self.budget
                yield i[near], j[near]
                front = front[~lone]
            if depth == 64 or not len(front):
                if len(front):  # equal leaves stand once, so only different sides can hold both
                    yield from self._rest(front)
                continue
            a0, a1, b0, b1, far = front.T
            ones = self._ones(depth)
            a_mid, b_mid = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            same = a0 == b0
            parts = [
                np.stack([a0, a_mid, b0, b_mid, far], 1),
                np.stack([a_mid, a1, b_mid, b1, far], 1),
                np.stack([a0, a_mid, b_mid, b1, far + 1], 1),
                np.stack([a_mid, a1, b0, b_mid, far + 1], 1)[~same],
            ]
            front = np.concatenate(parts)
            front = front[(front[:, 1] > front[:, 0]) & (front[:, 3] > front[:, 2]) & (front[:, 4] <= self.budget)]
            work.append((front, depth + 1))

    @staticmethod
    def _rest(front):
        for a0, a1, b0, b1, _ in front:
            if a0 != b0:
                i, j = np.meshgrid(np.arange(a0, a1), np.arange(b0, b1))
                yield i.ravel(), j.ravel()


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the pairs (i, j) into the forest."""
    while len(i):
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        i, j = parent[i], parent[j]
        open_ = i != j
        i, j = i[open_], j[open_]
        parent[np.maximum(i, j)] = np.minimum(i, j)


def _join_task(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Spanning forest of the links within all subtrie pairs of a task."""
    rows = rows.sort_values(["turn", "depth", "a", "b", "far", "side"], kind="stable")
    fps = rows["fp"].to_numpy().view(np.uint64)
    key = rows[["turn", "depth", "a", "b", "far"]].to_numpy()
    side = rows["side"].to_numpy()
    fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1) | (side[1:] != side[:-1])])
    ends = np.r_[fresh[1:], len(fps)]
    order = np.lexsort((fps, np.repeat(np.arange(len(fresh)), ends - fresh)))
    fps = fps[order]
    nodes = [(*key[s], side[s], s, e) for s, e in zip(fresh, ends, strict=True)]
    fronts: dict[int, list] = {}
    before = None
    for turn, depth, a, b, far, own, s, e in nodes:
        if a == b:
            if e - s > 1:
                fronts.setdefault(depth, []).append((s, e, s, e, far))
        elif own == 1 and before is not None and before[:5] == (turn, depth, a, b, far):
            fronts.setdefault(depth, []).append((before[6], before[7], s, e, far))
        before = (turn, depth, a, b, far, own, s, e)
    walk, parent = _Walk(fps, budget), np.arange(len(fps))
    for depth, front in fronts.items():
        for i, j in walk.find(np.array(front, np.int64), int(depth)):
            _hook(parent, i, j)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(fps)))
    turns = rows["turn"].to_numpy()[order]
    back = lambda at: _turned_back(fps[at], turns[at])
    return pd.DataFrame({"a": back(child), "b": back(parent[child])})


def _turned_back(fps: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    out = np.where(by == 0, fps, (fps >> by) | (fps << ((np.uint64(64) - by) % np.uint64(64))))
    return out.view(np.int64)


def links(distinct: DataFrame, budget: int, subtrie_rows: int = SUBTRIE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints at most `budget` bits apart; distinct: (fp), each once."""
    part = 64 // (budget + 1)
    turns = [i * part for i in range(budget + 1)]
    roots = [
        distinct.select(F.lit(t).alias("turn"), _rotated(F.col("fp"), t).alias("fp")).withColumn("a", F.shiftrightunsigned("fp", 64 - part))
        for t in turns
    ]
    columns = ("turn", "depth", "a", "b", "far", "side", "fp")
    pairs = reduce(DataFrame.unionAll, roots)
    pairs = pairs.select("turn", F.lit(part).alias("depth"), "a", F.col("a").alias("b"), F.lit(0).alias("far"), F.lit(0).alias("side"), "fp")
    same = ("turn", "depth", "a", "b")
    found = []
    while True:
        large = cut(pairs.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.first("depth").alias("d")).where(f"n > {subtrie_rows} and depth <= {64 - SPLIT_BITS}").select(*same))
        if large.isEmpty():
            found.append(pairs)
            break
        found.append(pairs.join(large, [*same], "left_anti").select(*columns))
        pairs = cut(_split(pairs.join(large, [*same], "left_semi").select(*columns), budget))
    leaves = cut(reduce(DataFrame.unionAll, found))
    tasks = max(1, -(-leaves.count() // task_rows))
    task = F.pmod(F.xxhash64(*same, "far"), F.lit(tasks))
    return leaves.groupBy(task.alias("task")).applyInPandas(lambda rows: _join_task(rows, budget), "a long, b long")


def near_duplicates(docs: DataFrame, words: int, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fp and the smallest key (component_id) that its fingerprint is linked to, over any number of links."""
    fps = cut(fingerprints(docs, words, key, text))
    distinct = cut(fps.groupBy("fp").agg(F.min(key).alias("low")))
    roots = components(links(distinct.select("fp"), budget)).withColumnRenamed("node", "fp")
    nodes = cut(distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    least = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = rejoin(nodes, least, ["root"]).select("fp", "component_id")
    return rejoin(fps, of_fp, ["fp"]).select(key, "fp", "component_id")


# -- by similarity --------------------------------------------------------------------------------

#: Sampled fingerprints of a document, and shingles in each sample: of two sets of a Jaccard similarity j one sample agrees
#: with a chance of j ** 3, so of those at the threshold (j = 2 / 3 where sizes are equal) all differ with one of 0.0002.
SAMPLES, SAMPLE_SIZE = 24, 3
#: 64-bit words of a sketch, members of a block of a large group, and rows of a task that compares blocks.
SKETCH_WORDS, BLOCK_ROWS, COMPARED_ROWS = 16, 16_000, 32_000
#: Members that are compared with one copy of their head's text.
HEAD_ROWS = 2_000
#: Sketches compared with a whole block at once.
STRIP = 64
_SALTS = np.array([xxhash.xxh64_intdigest(b"sample", i) | 1 for i in range(SAMPLES)], np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes in order; a text of fewer words has one shingle, one without words none."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(own)] if len(own) < words else map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in {*shingles}], np.uint64))


def sampled(h: np.ndarray) -> list[int]:
    """A fingerprint of the few shingles that come first under each salt: bits set in more than half of them.

    Two sets agree in a sample with the chance of their similarity to the power of its size.
    """
    if not len(h):
        return [0] * SAMPLES
    out = []
    for salt in _SALTS:
        mixed = h * salt
        mixed ^= mixed >> np.uint64(29)
        first = np.partition(mixed, SAMPLE_SIZE - 1)[:SAMPLE_SIZE] if len(h) > SAMPLE_SIZE else mixed
        ones = np.unpackbits(first.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(first), bitorder="little").view("<i8")[0]))
    return out


def sketch(h: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in each of 64 * SKETCH_WORDS bins.

    Two sketches differ in no more bits than there are shingles in only one of the sets.
    """
    bins = np.bincount((h >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS)
    return np.packbits(bins & 1).tobytes()


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / (len(x) * len(y)) ** 0.5


def similarity(a: str | None, b: str | None, words: int) -> float:
    """Cosine of the shingle sets, which is what SimHash estimates; 1 for two empty ones. It is never below their Jaccard similarity."""
    return _cosine(shingle_set(a, words), shingle_set(b, words))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """(key, h, whole, fp, bands, size, sketch): a hash of the shingle set, the fingerprint, the sampled ones, the set's size and sketch."""

    def run(batches):
        for batch in batches:
            whole, full, bands, sizes, sketches = [], [], [], [], []
            for t in batch.column(2):
                h = shingle_set(t.as_py(), words)
                whole.append(int.from_bytes(xxhash.xxh64_digest(h.tobytes()), "big", signed=True))
                full.append(fingerprint(t.as_py(), words))
                bands.append(sampled(h))
                sizes.append(len(h))
                sketches.append(sketch(h))
            found = [pa.array(whole, pa.int64()), pa.array(full, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["key", "h", "whole", "fp", "bands", "size", "sketch"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "h", "text").mapInArrow(run, f"key {kind}, h long, whole long, fp long, bands array<long>, size long, sketch binary")


def _texts(sets: DataFrame, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(whole, text): one text for each wanted set, that of its first document."""
    own = sets.join(wanted, "whole", "left_semi").select("whole", F.col("low.key").alias("key"), F.col("low.h").alias("h"))
    return texts.join(own, ["key", "h"]).dropDuplicates(["whole"]).select("whole", "text")


def _plausible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose sizes and sketches allow the similarity, before any text is moved."""
    own = lambda x: sets.select(F.col("whole").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    rows = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS) for i in (4, 5))
            far = np.bitwise_count(sa ^ sb).sum(1, dtype=np.int64)
            near = (far <= na + nb - 2 * least * np.sqrt(na * nb) + 1e-6) & (np.minimum(na, nb) >= least**2 * np.maximum(na, nb) - 1e-6)
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those pairs (a, b) of sets whose texts are similar enough, exactly; b is the head of many.

    A member's text moves to its head, and a head's text once for HEAD_ROWS of
    its members, ahead of them; tasks stream through both.
    """
    blocks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HEAD_ROWS).cast("int").alias("n"))
    placed = rejoin(pairs, blocks, ["b"]).select("a", "b", F.pmod(F.xxhash64("a"), "n").cast("int").alias("block"))
    wanted = pairs.select(F.col("a").alias("whole")).union(blocks.select("b")).distinct()
    own = cut(_texts(sets, wanted, texts))
    members = placed.join(own.withColumnRenamed("whole", "a"), "a").select("b", "block", "a", "text")
    heads = blocks.select("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block")).join(own.withColumnRenamed("whole", "b"), "b")
    rows = members.unionByName(heads.select("b", "block", F.lit(None).cast("long").alias("a"), "text"))

    def run(batches):
        head, at = None, None
        for batch in batches:
            a, b = [], []
            for *own, text in zip(*batch.columns, strict=True):  # texts one by one: a batch of them is large
                y, block, x = (c.as_py() for c in own)
                if x is None:
                    head, at = shingle_set(text.as_py(), words), (y, block)
                elif at == (y, block) and _cosine(shingle_set(text.as_py(), words), head) >= least:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _possible(rows: pd.DataFrame, least: float):
    """(i, js): places of rows that one block pair has to compare, as their roots differ and size and sketch allow the similarity."""
    order = rows.groupby(["g", "class", "p", "q"], sort=False).indices
    size, side = rows["size"].to_numpy(), rows["side"].to_numpy()
    p, q, root = rows["p"].to_numpy(), rows["q"].to_numpy(), pd.factorize(rows["root"])[0]
    bits = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(-1, SKETCH_WORDS)
    for at in order.values():
        inner = p[at[0]] == q[at[0]]
        left, right = (at, at) if inner else (at[side[at] == 0], at[side[at] == 1])
        for s in range(0, len(left), STRIP):
            i = left[s : s + STRIP, None]
            far = np.bitwise_count(bits[i] ^ bits[right]).sum(2, dtype=np.int64)
            # sets share least * sqrt(product) of their shingles, so they differ in what is left of both, and a sketch in no more
            most = size[i] + size[right] - 2 * least * np.sqrt(size[i] * size[right].astype(float))
            near = (root[i] != root[right]) & (far <= most + 1e-6)
            near &= np.minimum(size[i], size[right]) >= least**2 * np.maximum(size[i], size[right]) - 1e-6
            if inner:
                near &= i < right
            for r in np.flatnonzero(near.any(1)):
                yield left[s + r], right[near[r]]


def _compare_task(rows: pd.DataFrame, words: int, least: float) -> pd.DataFrame:
    """Spanning forest, over the roots, of the similar pairs within all block pairs of a task."""
    code, names = pd.factorize(rows["root"])
    parent, texts, own = list(range(len(names))), rows["text"].to_numpy(), {}

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def of(at):
        if at not in own:
            own[at] = shingle_set(texts[at], words)
        return own[at]

    a, b = [], []
    for i, js in _possible(rows, least):
        for j in js:
            x, y = top(code[i]), top(code[j])
            if x != y and _cosine(of(i), of(j)) >= least:
                parent[max(x, y)] = min(x, y)
                a.append(names[code[i]])
                b.append(names[code[j]])
    return pd.DataFrame({"a": a, "b": b}, dtype=rows["root"].dtype)


def _rest(grouped: DataFrame, roots: DataFrame, sets: DataFrame, texts: DataFrame, words: int, least: float, block_rows: int) -> DataFrame:
    """(a, b): roots of sets that share a group, are not linked so far and are similar enough.

    grouped: (whole, k, band, n), the members of groups of several; roots: (whole, root) of the
    linked ones. A group of two has been compared, and one of a single
    root needs no more links. Similar sets meet in many groups, so those with the
    same members count once, and large ones of the same least root and like size
    are joined. Of what is left each block of members meets each block, first by
    sketches; only what those leave open is compared as texts.
    """
    members = rejoin(grouped.where("n > 2"), roots, ["whole"], "left").withColumn("root", F.coalesce("root", "whole")).select("whole", "root", "k", "band")
    own = F.bit_xor(F.xxhash64("whole")).alias("own"), F.min("whole").alias("w0"), F.max("whole").alias("w1")
    mixed = members.groupBy("k", "band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), *own).where("r0 < r1")
    large = F.ceil(F.log2(F.col("n") / block_rows)).cast("int")
    mixed = mixed.select("k", "band", F.greatest(large, F.lit(0)).alias("class"), F.when(large > 0, F.col("r0")).otherwise(F.xxhash64("n", "own", "w0", "w1")).alias("g"))
    joint = cut(rejoin(members, mixed, ["k", "band"]).select("g", "class", "whole", "root").distinct())
    blocks = cut(joint.groupBy("g", "class").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))
    total = blocks.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    placed = rejoin(joint, blocks.drop("n"), ["g", "class"]).withColumn("own", F.pmod(F.xxhash64("whole"), "blocks").cast("int"))
    placed = placed.join(sets.select("whole", "size", "sketch"), "whole").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side")]
    rows = placed.select("whole", "root", "g", "class", *pair, "size", "sketch")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def dealt(df, n):
        return df.groupBy(F.pmod(F.xxhash64("g", "class", "p", "q"), F.lit(max(1, -(-n // COMPARED_ROWS)))).alias("task"))

    def flagged(rows):
        hit = np.zeros(len(rows), bool)
        for i, js in _possible(rows, least):
            hit[i] = True
            hit[js] = True
        return rows[hit]

    open_ = cut(dealt(rows, total).applyInPandas(flagged, kinds))
    tidy(sets.sparkSession)
    wanted = _texts(sets, open_.select("whole").distinct(), texts)
    return dealt(open_.join(wanted, "whole"), open_.count()).applyInPandas(lambda rows: _compare_task(rows, words, least), "a long, b long")


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, budget: int = 3, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row with a key: key, text_hash, the smallest key (component_id) it is linked to by similarities of `least` and more, and that row's text_hash (component_hash).

    Rows of one key and different texts are documents of their own; of those
    of the smallest key the first by its hash is the component's.

    Fingerprints that differ in few bits are found by the trie, but texts of
    this similarity mostly differ in more. So documents also have sampled
    fingerprints, of which similar texts share some. Groups are the documents
    of one sampled fingerprint, and those of fingerprints that the trie
    connects, whether or not the texts between them are similar. Each document
    is first compared with one head, the first document of the most of its
    groups, then with the heads of those groups it isn't linked to yet; at last
    those of a group that are still not linked with each other. All links are checked on the
    whole texts. Equal shingle sets count as one document throughout, and go by
    their hash.
    """
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    signed = cut(_signed(named, words))
    sets = cut(signed.groupBy("whole").agg(F.min(F.struct("key", "h")).alias("low"), *(F.first(c).alias(c) for c in ("fp", "bands", "size", "sketch"))))
    families = components(links(sets.select("fp").distinct(), budget)).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    groups = F.concat("bands", F.array(F.coalesce("family", "fp")))
    sets = cut(rejoin(sets, families, ["fp"], "left").select("whole", "low", "size", "sketch", groups.alias("bands")))
    members = sets.select("whole", F.posexplode("bands").alias("k", "band"))
    heads = members.groupBy("k", "band").agg(F.min("whole").alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = cut(rejoin(members, heads, ["k", "band"]))
    tidy(docs.sparkSession)
    pairs = grouped.where("whole != y").groupBy(F.col("whole").alias("a"), F.col("y").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    pairs = cut(_plausible(pairs, sets, least).join(pairs, ["a", "b"]))
    # most documents are linked by the head they share the most groups with; only what that leaves apart goes on
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    found = cut(_verified(best, sets, named, words, least))
    roots = components(found).withColumnRenamed("node", "whole")
    tidy(docs.sparkSession)
    of = lambda x: roots.select(F.col("whole").alias(x), F.col("root").alias(f"r{x}"))
    apart = pairs.join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = cut(apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    more = cut(_verified(apart, sets, named, words, least))
    if not more.isEmpty():
        roots = components(found.unionByName(more)).withColumnRenamed("node", "whole")
    tidy(docs.sparkSession)
    further = components(_rest(grouped, roots, sets, named, words, least, block_rows)).select(F.col("node").alias("root"), F.col("root").alias("last"))
    linked = sets.select("whole", "low").join(roots, "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    linked = cut(rejoin(linked, further, ["root"], "left").select("whole", "low", F.coalesce("last", "root").alias("root")))
    least_of = linked.groupBy("root").agg(F.min("low").alias("first"))
    of_set = rejoin(linked, least_of, ["root"]).select("whole", "first")
    found = rejoin(signed.select("key", "h", "whole"), of_set, ["whole"])
    return found.select(F.col("key").alias(key), F.col("h").alias("text_hash"), F.col("first.key").alias("component_id"), F.col("first.h").alias("component_hash"))
