"""Exact top-k by inner product, pruned with multi-resolution segment statistics.

A vector cut into segments keeps each segment's mean and deviation. For two
vectors, the segment sums n * (mean * mean + deviation * deviation) bound the
inner product from above, which is the same as bounding their distance from
below; more segments bound tighter. Each block is filtered coarse to fine
against the k-th best score known so far, and only survivors get exact scores.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; 256 x beyond the largest double counts as that, and a
score beyond a long as the outermost long; a query is compared with rows of its
own length and not with rows of its own id; repeated rows count once; ties go to the smaller
id; with fewer than k candidates all are returned; an empty table gives an
empty table; columns beside key and vector are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from lectern.llm import blocks

SEGMENTS = (1, 2, 4, 8, 16, 32)
#: Queries searched together in a block; bounds the matrices to STEP x SHARD_ROWS.
STEP = 256


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    parts = np.array_split(x, segments, axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate([np.stack([p.mean(1) for p in parts], 1) * root, np.stack([p.std(1) for p in parts], 1) * root], 1)


def best_products(k: int):
    """The search of one block, for blocks.search."""

    def best(query_ids, queries, ids, vectors):
        q, q_ids = blocks.collapse(query_ids, _scaled(queries), len(query_ids))
        x, x_ids = blocks.collapse(ids, _scaled(vectors), k + 1)
        with np.errstate(over="ignore"):
            largest = np.abs(q).max() * np.abs(x).max() * x.shape[1]
        levels = [s for s in SEGMENTS if s < x.shape[1]] if largest < 2**63 else []
        sums = [_summary(x, s) for s in levels]
        exact = lambda a, b: _exact(a, b, largest)
        slack = 1e-9 * (1 + largest)
        few = min(k + 1, len(x))
        for at in range(0, len(q), STEP):
            part = q[at : at + STEP]
            bounds = [_summary(part, s) for s in levels]
            if not levels:
                alive = np.ones((len(part), len(x)), bool)
            else:
                # the k+1 distinct vectors of the best middle bounds give the first threshold
                middle = len(levels) // 2
                seed = np.argpartition(-(bounds[middle] @ sums[middle].T), few - 1, axis=1)[:, :few]
                known = np.stack([np.sort(exact(part[i : i + 1], x[s])[0])[::-1] for i, s in enumerate(seed)])
                floor = known[:, -1].astype(float) if len(x) > k else np.full(len(part), -np.inf)
                alive = np.ones((len(part), len(x)), bool)
                for b, s in zip(bounds, sums, strict=True):
                    left = np.flatnonzero(alive.any(0))
                    alive[:, left] &= b @ s[left].T >= floor[:, None] - slack
            for i in range(len(part)):
                near = np.flatnonzero(alive[i])
                score = exact(part[i : i + 1], x[near])[0]
                order = np.argsort(-score, kind="stable")
                if len(order) > k + 1:  # equals of the last one stay
                    order = order[score[order] >= score[order[k]]]
                yield from _ranked(q_ids[at + i], near[order], score[order], x_ids, k)

    return best


def _scaled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256 * x))


def _exact(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Integer products, none above `largest`; by floating point where that is exact."""
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    if largest < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64) if a.size and b.size else np.zeros((len(a), len(b)), np.int64)


def _ranked(own, near, score, ids, k):
    for query, best, worth in blocks.expand(own, near, score, ids, k):
        order = np.lexsort((best, -worth))[:k]
        yield query, best[order], worth[order]


def search(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest integer inner products of floor(256 x) for each query; is_query is a condition on `id`."""
    rows = blocks.usable(vectors, key, vector)
    return blocks.search(rows, is_query, k, best_products(k), least_first=False, score="long")
