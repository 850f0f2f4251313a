"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A code is the signs of a vector after centring and rotations that are learned
to lose little by it (iterative quantisation), fitted on a bounded sample. The
code is cut into substrings, each indexed by itself: postings give the rows of
each substring that occurs. If two codes differ in at most r bits, and the
radii of m substrings add up to r - m + 1, then some substring differs within
its radius, so probing the postings within these small radii retrieves every
code within r; those are checked on the whole code and reranked by their
original vectors. The radius is learned too: it holds the sample's true
neighbours. So are the length of codes and substrings: of a few choices the one
whose probes and reranks cost least on the sample. A query that finds fewer
than k in a shard widens its radius there until it has them.

How many rows the probes touch depends on the vectors. Clustered ones are told
apart by a few bits; for vectors that point anywhere in many dimensions, whose
nearest neighbours are hardly nearer than the others, every index has to touch
a large part of the rows for a high recall (figures in the README).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; distances beyond the largest double are infinite; a
query is compared with rows of its own length and not with rows of its own id;
repeated rows count once; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives an empty table; columns
beside key and vector are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks

#: Vectors that rotations and radius are fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 12_000
#: Lengths of codes and of their substrings to choose from.
LENGTHS = ((32, 8), (32, 16), (64, 16), (64, 32), (128, 64), (256, 64))
ROUNDS = 20
#: Share of the sample's true neighbours that the radius holds, and queries it is learned from.
HELD, ASKED = 0.96, 400
#: Costs of testing a substring and of reranking a row by its vector, in probed rows.
TEST, RERANK = 0.1, 2.0
#: Rows of a shard, each with an index of its own.
SHARD_ROWS = 16_384


@dataclass(frozen=True)
class Codes:
    """Scale, centre and rotations for one vector length, bits of a substring, and the radius."""

    scale: float
    mean: np.ndarray
    rotation: np.ndarray  # length x bits
    width: int
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The substrings of each vector's code, bits / width of them."""
        bits = (x / self.scale - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view(f"<u{self.width // 8}")


def radii(radius: int, parts: int) -> list[int]:
    """Radii of the substrings that together retrieve every code within the radius; -1: not probed."""
    each, over = divmod(radius, parts)
    return [each] * (over + 1) + [each - 1] * (parts - over - 1)


def _rotations(x: np.ndarray, bits: int, rng: np.random.Generator) -> np.ndarray:
    """length x bits: principal directions turned so that signs lose little; several turns if bits exceed the length."""
    directions = np.linalg.svd(x, full_matrices=False)[2][:bits].T
    z, parts = x @ directions, []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(z.T @ np.where(z @ turn > 0, 1.0, -1.0))
            turn = u @ v
        parts.append(directions @ turn)
    return np.concatenate(parts, 1)[:, :bits]


def fit(x: np.ndarray, k: int) -> Codes:
    """The codes of least cost whose radius holds the true neighbours of the sample."""
    rng, scale = np.random.default_rng(7), float(np.abs(x).max()) or 1.0
    x = x / scale
    mean = x.mean(0)
    asked = rng.permutation(len(x))[:ASKED]
    near = []
    for i in asked:
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        near.append(np.argpartition(far, k)[:k] if len(x) > k + 1 else np.flatnonzero(np.isfinite(far)))
    best, least = None, np.inf
    for bits, width in LENGTHS:
        codes = Codes(1.0, mean, _rotations(x - mean, bits, rng), width, bits)
        own = codes.encode(x)
        held = [np.bitwise_count(own[n] ^ own[i]).sum(1, dtype=np.int64) for i, n in zip(asked, near, strict=True)]
        held = np.concatenate(held) if held else np.array([], int)
        radius = int(np.quantile(held, HELD, method="higher")) if held.size else bits
        bounds = np.array(radii(radius, bits // width))
        tested = sum(min(_ball_size(width, b), len(np.unique(column))) for column, b in zip(own.T, bounds.tolist(), strict=True))
        cost = TEST * tested * len(asked)
        for i in asked:
            apart = np.bitwise_count(own ^ own[i])
            cost += (apart <= bounds).any(1).sum() + RERANK * (apart.sum(1, dtype=np.int64) <= radius).sum()
        if cost < least:
            best, least = Codes(scale, mean, codes.rotation, width, radius), cost
    return best


class Index:
    """For each substring its postings: the substrings that occur, and the rows of each, one after the other."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for column in codes.T:
            rows = np.argsort(column, kind="stable")
            keys, starts = np.unique(column[rows], return_index=True)
            self.tables.append((keys, starts, np.diff(np.r_[starts, len(rows)]), rows))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows in the postings within the substrings' radii, in order."""
        seen = np.zeros(len(self.codes), bool)
        for (keys, starts, sizes, rows), own, bound in zip(self.tables, code, radii(radius, len(self.tables)), strict=True):
            if bound < 0:
                continue
            hit = self._ball(keys, own, bound)
            n, at = sizes[hit], starts[hit]
            if len(hit):
                seen[rows[np.arange(n.sum()) + np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n)]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius."""
        rows = self.probe(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius]

    @staticmethod
    def _ball(keys: np.ndarray, own: int, radius: int) -> np.ndarray:
        """Places of the keys in the ball around own, by whichever is shorter: the ball or the keys."""
        width = keys.itemsize * 8
        if _ball_size(width, radius) > len(keys):
            return np.flatnonzero(np.bitwise_count(keys ^ own) <= radius)
        ball = np.array([int(own) ^ flips for flips in _flips(width, radius)], keys.dtype)
        at = np.minimum(np.searchsorted(keys, ball), len(keys) - 1)
        return at[keys[at] == ball]


def _ball_size(width: int, radius: int) -> int:
    return sum(comb(width, i) for i in range(radius + 1))


@lru_cache
def _flips(width: int, radius: int) -> tuple[int, ...]:
    return tuple(sum(1 << b for b in flips) for i in range(radius + 1) for flips in combinations(range(width), i))


def best_near(models: dict[int, Codes], k: int):
    """The search of one block, for blocks.search."""

    def best(query_ids, queries, ids, vectors):
        model = models.get(vectors.shape[1])
        q, q_ids = blocks.collapse(query_ids, queries, len(query_ids))
        x, x_ids = blocks.collapse(ids, vectors, k + 1)
        index, codes = Index(model.encode(x)), model.encode(q)
        for i in range(len(q)):
            radius = model.radius
            rows = index.within(codes[i], radius)
            while len(rows) < min(k + 1, len(x)):
                radius = min(model.bits, radius + max(2, radius // 8))
                rows = index.within(codes[i], radius)
            with np.errstate(over="ignore"):
                far = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
            order = np.argsort(far, kind="stable")
            if len(order) > k + 1:  # equals of the last one stay
                order = order[far[order] <= far[order[k]]]
            for query, near, score in blocks.expand(q_ids[i], rows[order], far[order], x_ids, k):
                ranked = np.lexsort((near, score))[:k]
                yield query, near[ranked], score[ranked]

    return best


def search(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest found for each query, by Euclidean distance; is_query is a condition on `id`."""
    rows = blocks.usable(vectors, key, vector, zero_too=False)
    sample = rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(SAMPLE_ROWS).select("v", "dim").toPandas()
    models = {int(dim): fit(np.stack(part["v"].to_list()), k) for dim, part in sample.groupby("dim")}
    for dim in (r["dim"] for r in rows.select("dim").distinct().collect() if r["dim"] not in models):
        models[dim] = fit(np.random.default_rng(dim).normal(size=(64, dim)), k)  # a length too rare for the sample
    return blocks.search(rows, is_query, k, best_near(models, k), least_first=True, score="double", shard_rows=SHARD_ROWS)
