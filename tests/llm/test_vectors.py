import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import blocks, mih, topk
from lectern.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score double, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], SCHEMA)


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # copies
    rows += [rows[10], (400, None), (401, []), (402, [1.0, None] * 8), (403, [float("nan")] * 16), (404, [float("inf")] * 16), (405, [0.0] * 16), (None, rows[3][1]), (450, [1.0, 2.0]), (451, [2.0, 1.0])]
    return rows


def usable(rows, zero):
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            seen[i] = np.asarray(v, float)
    return seen


@pytest.mark.parametrize("shard", [40, 4096])
def test_topk_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(blocks, "SHARD_ROWS", shard)
    rows = odd_rows()
    got = topk.search(table(spark, rows), F.col("id") % 50 == 0, 5).collect()
    own = {i: np.floor(256 * v).astype(int) for i, v in usable(rows, True).items()}
    want = []
    for q in (i for i in own if i % 50 == 0):
        best = sorted((-int(own[q] @ v), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert len([w for w in want if w[0] == 450]) == 1


def test_nearest_are_found(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD_ROWS", 64)
    rows = odd_rows()
    got = mih.search(table(spark, rows), F.col("id") % 50 == 0, 10).collect()
    own = usable(rows, False)
    hits = total = 0
    for q in (i for i in own if i % 50 == 0):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        near = sorted((float(np.sqrt(((own[q] - v) ** 2).sum())), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:10]
        assert [r.rank for r in mine] == list(range(1, len(near) + 1))
        assert all(abs(r.score - np.sqrt(((own[q] - own[r.vec_id]) ** 2).sum())) < 1e-12 and r.vec_id != q for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & {i for _, i in near}), total + len(near)
    assert hits >= 0.9 * total


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, size=(5, 4), dtype=np.uint16)
    codes = np.concatenate([base ^ (np.uint16(1) << rng.integers(0, 16, size=base.shape, dtype=np.uint16)) for _ in range(40)])
    index = mih.Index(codes)
    for radius in (0, 3, 4, 9, 20, 64):
        true = np.bitwise_count(codes ^ base[0]).sum(1)
        assert index.within(base[0], radius).tolist() == np.flatnonzero(true <= radius).tolist()
    assert sum(x + 1 for x in mih.radii(13, 4)) == 14 and mih.radii(2, 4) == [0, 0, 0, -1]


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    own = {r.vec_id: np.asarray(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids, x = np.array(sorted(own)), np.stack([own[i] for i in sorted(own)])
    got = {}
    for r in QUERIES["op8_multi_index"](spark, folder).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in ids[ids % 100 == 0].tolist():
        far = np.sqrt(((x - own[q]) ** 2).sum(1))
        near = [int(i) for i in ids[np.lexsort((ids, far))] if i != q][:10]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(r.score == far[np.searchsorted(ids, r.vec_id)] for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(near)), total + 10
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.9 * total


def test_probes_of_clustered_vectors_touch_few_rows():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(200, 32)).repeat(20, 0) + 0.2 * rng.normal(size=(4000, 32))).round(6)
    codes = mih.fit(x, 10)
    own = codes.encode(x)
    index = mih.Index(own)
    shares, hits = [], 0
    for i in range(0, 4000, 40):
        shares.append(len(index.probe(own[i], codes.radius)) / len(x))
        far = ((x - x[i]) ** 2).sum(1)
        hits += np.isin(np.argsort(far)[1:11], index.within(own[i], codes.radius)).sum()
    assert np.mean(shares) < 0.2 and hits >= 0.9 * 1000


def test_huge_components(spark):
    rows = [(0, [1e300, -1e300]), (1, [1e300, 1.0]), (2, [1.0, 1.0]), (50, [1.7e308, 1.7e308]), (3, [2.0**40, 2.0**40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.search(df, F.col("id") % 50 == 0, 5).collect()}
    assert got[0, 1] == got[50, 1] == 2**63 - 1 and got[0, 2] == 0 and got[0, 3] == 0 and len(got) == 8
    assert mih.search(df, F.col("id") % 50 == 0, 3).count() == 6


def test_empty_tables(spark):
    none = table(spark, odd_rows()).where("false")
    assert topk.search(none, F.col("id") % 50 == 0, 5).count() == 0
    assert mih.search(none, F.col("id") % 50 == 0, 5).count() == 0
    one = table(spark, [(0, [1.0, 2.0])])
    assert topk.search(one, F.col("id") % 50 == 0, 5).count() == 0
    assert mih.search(one, F.col("id") % 50 == 0, 5).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 64)), rng.normal(size=(20, 64))
    exact, last = x @ y.T, np.inf
    for segments in topk.SEGMENTS:
        bound = topk._summary(x, segments) @ topk._summary(y, segments).T
        assert (bound >= exact - 1e-9).all() and bound.mean() <= last
        last = bound.mean()
