"""Searching a stated set of queries against all rows, block by block.

Rows are dealt into shards of bounded size by a hash of their id, queries into
blocks of bounded size; each pair of shard and block is searched in one group,
and only the best few of each query leave it. No group grows with the data:
more rows make more shards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_QUERIES = 4096, 4096


def usable(vectors: DataFrame, key: str, vector: str, zero_too: bool = True) -> DataFrame:
    """(id, v, dim) of the rows with an id and a vector of finite components."""
    v = F.col("v")
    ok = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not zero_too:
        ok = ok & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & ok).withColumn("dim", F.size("v"))


def search(rows: DataFrame, is_query: Column, k: int, best: Callable, least_first: bool, score: str, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query among the other rows of its length.

    best(query_ids, queries, ids, vectors) yields (query_id, ids, scores) with
    the k best of a block of either; ties go to the smaller id.
    """
    total, wanted = rows.select(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, math.ceil(total / (shard_rows or SHARD_ROWS))), max(1, math.ceil(wanted / BLOCK_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard, block = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
    data = rows.select("id", "v", "dim", shard.alias("shard"), each(blocks).alias("block"))
    asked = rows.where(is_query).select("id", "v", "dim", each(shards).alias("shard"), block.alias("block"))
    kind = "double" if score == "double" else "long"

    def one(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(own):
            q, x = np.stack(queries["v"].to_list()), np.stack(own["v"].to_list())
            for query, ids, scores in best(queries["id"].to_numpy(), q, own["id"].to_numpy(), x):
                out += [(query, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64" if kind == "double" else "int64"})

    keys = ("dim", "block", "shard")
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(one, f"query_id long, vec_id long, score {kind}")
    order = F.col("score") if least_first else F.desc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def collapse(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, and of each the `keep` smallest distinct ids: copies cost nothing however many."""
    x = np.ascontiguousarray(x) + 0.0  # one zero
    view = x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, first, group = np.unique(view, return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    starts = np.searchsorted(group[order], np.arange(len(first) + 1))
    return x[first], [np.unique(ids[order[a:b]])[:keep] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def expand(own_ids: Iterable[int], near: np.ndarray, scores: np.ndarray, ids: list[np.ndarray], k: int):
    """For each query of equal vectors: the k first ids of the distinct vectors `near`, without its own.

    near and scores are ordered, best first; equal scores are ordered by id here.
    """
    flat = [(s, i) for at, s in zip(near, scores, strict=True) for i in ids[at]]
    if not flat:
        return
    best = np.array([i for _, i in flat], np.int64)
    worth = np.array([s for s, _ in flat])
    for q in own_ids:
        mask = best != q
        yield q, best[mask], worth[mask]
