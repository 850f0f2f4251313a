import random
import re
from collections import defaultdict

import numpy as np

from lectern.llm import mixing
from lectern.llm.common import WORD


def wanted(sizes):
    """Targets by resharing in rounds, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
        free -= over
        left = sum(sizes.values()) - sum(out.values())
    return out


def corpus(seed, sources=("b", "a", "é", "Z", None), n=300):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(int(rng.lognormvariate(3, 1)))), sources[min(int(rng.expovariate(0.8)), len(sources) - 1)]) for i in range(n)]


def test_targets_and_taken(spark):
    for seed in (2,):
        docs = corpus(seed)
        sizes = defaultdict(int)
        for _, t, s in docs:
            sizes[s] += len(re.findall(WORD, t))
        want = wanted(dict(sizes))
        df = spark.createDataFrame(docs, "doc_id long, text string, source string")
        rows = mixing.plan(df).collect()
        assert rows and len(rows) == len(docs)
        source = {i: s for i, _, s in docs}
        taken = defaultdict(int)
        for r in rows:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
            assert r.size == 0 or (r.taken % r.size == 0 and r.taken <= 3 * r.size)
            taken[s] += r.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 20), (s, taken[s], want[s])
        again = mixing.plan(df.repartition(7)).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_rates_are_the_optimum(spark):
    """Against primal conditions and a plain solver: rates meet the targets, and no feasible shift between documents lowers the entropy."""
    rng = np.random.default_rng(3)
    sizes = {s: rng.integers(1, 400, n) for s, n in (("a", 60), ("b", 200), ("c", 1), ("d", 40), ("e", 30), ("f", 50))}
    want = {"a": 0.3, "b": 1.7, "c": 2.0, "d": 2.999, "e": 3.0, "f": 1.0}
    rows = [(s, float(n), int(c)) for s, x in sizes.items() for n, c in zip(*np.unique(x, return_counts=True), strict=True)]
    goals = [(s, int(x.sum()), float(want[s] * x.sum())) for s, x in sizes.items()]
    found, steps = mixing.balance(spark.createDataFrame(rows, "name string, size double, n long"), spark.createDataFrame(goals, "name string, source_size long, target double"))
    got = {r.name: r.multiplier for r in found.collect()}
    assert steps < 60 and got["f"] == 0
    for s, n in sizes.items():
        target = want[s] * n.sum()
        x = np.minimum(3, np.exp(got[s] * n))
        assert abs((x * n).sum() - target) <= 1e-9 * target
        lo, hi = -20.0, np.log(3)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (np.minimum(3, np.exp(mid * n)) * n).sum() < target else (lo, mid)
        assert np.allclose(np.minimum(3, np.exp(lo * n)), x, atol=1e-9)
        entropy = lambda v: (v * np.log(np.maximum(v, 1e-300)) - v + 1).sum()
        for _ in range(200 if len(n) > 1 else 0):
            i, j = rng.choice(len(n), 2, replace=False)
            moved = x.copy()
            step = rng.normal() * 1e-2
            moved[i] += step / n[i]
            moved[j] -= step / n[j]
            if moved.min() >= 0 and moved.max() <= 3:
                assert entropy(moved) >= entropy(x) - 1e-12


def test_many_sources_are_joined_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string, source string")
    before = sorted(map(tuple, mixing.plan(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.plan(docs).collect())) == before


def test_rows_without_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 20)
    docs = [(None, f"{'w ' * (i % 9)}t{i}", "a" if i % 3 else "b") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.plan(df).collect()
    assert len(rows) == 400
    for size in {(r.source_size, r.target) for r in rows}:
        taken = sum(r.taken for r in rows if (r.source_size, r.target) == size)
        assert abs(taken - size[1]) <= 0.03 * size[1]


def test_targets_stop_at_three_times(spark):
    docs = [(1, "w " * 10, "a"), (2, "w " * 10, "b"), (3, "w " * 1000, "c"), (4, "", "d")]
    got = {r.doc_id: r.target for r in mixing.plan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {1: 30.0, 2: 30.0, 3: 960.0, 4: 0.0}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.plan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.size for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.plan(no_docs).count() == 0
    twice = mixing.repeat(odd_docs)
    assert twice.columns == odd_docs.columns
    copies = {r.doc_id: r["count"] for r in twice.groupBy("doc_id").count().collect()}
    assert sum(copies.values()) == sum(r.taken // r.size for r in rows if r.size)
    assert mixing.plan(spark.createDataFrame([(1, "", "a")], "doc_id long, text string, source string")).first().taken == 0
