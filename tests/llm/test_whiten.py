import numpy as np
import pytest

from lectern.llm import whiten
from lectern.llm.queries import QUERIES


def check(got, rows, components=16):
    """Against dense algebra on all rows; rows: (id, vector)."""
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + whiten.SHIFT
    one = np.unique(x, axis=0)
    n, sums = len(one), one.sum(0)
    centred = (n * one - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for (i, _), own in zip(rows, x, strict=True):
        d = n * own - sums
        mine = sorted(by[i], key=lambda r: r.component)[:: len(by[i]) // k]
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert all(r.n == n and r.deviation == int((d * d).sum()) and 0 <= r.identity_error <= 1e-9 for r in mine)
        assert np.allclose([r.explained for r in mine], values[:k] / values.sum(), rtol=1e-9)
    table = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)[:: len(by[i]) // k]] for i, _ in rows])
    want = (n * x - sums) / n @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((table * want).sum(0))
    gaps = np.abs(np.diff(values[: k + 1])).min() / values[0] if len(values) > k else np.abs(np.diff(values[:k])).min(initial=values[0]) / values[0]
    assert np.allclose(table * sign, want, atol=1e-10 / gaps)


@pytest.mark.parametrize("dim", [1, 5, 40, 150])
def test_against_dense_algebra(spark, dim):
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(400, dim)) * np.linspace(3, 0.3, dim)).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(1_000 + i, vectors[0]) for i in range(300)]  # copies are fitted once
    table = spark.createDataFrame([(i, v, "x", 0.0) for i, v in rows], "vec_id long, embedding array<float>, x string, n double").repartition(7)
    check(whiten.whiten(table).collect(), rows)


def test_registered_query_against_dense_algebra(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, folder).collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 3))
    flat = np.c_[base, base.sum(1), base[:, 0], np.zeros(30)].tolist()  # of low rank, but for rounding to whole numbers
    rows = [(i, v) for i, v in enumerate(flat)]
    odd = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (53, [float("nan")] * 6), (54, [float("inf")] * 6), (55, [1.0, 2.0]), (None, flat[3]), (5, flat[5])]
    got = whiten.whiten(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {None, *range(30)}
    assert sum(r.vec_id == 5 for r in got) == 2 * sum(r.vec_id == 4 for r in got)
    assert [r.component for r in got if r.vec_id == 4] == list(range(1, 5)) and max(r.identity_error for r in got) < 1e-9
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [0.0, 1e-300])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten.whiten(huge).collect()} <= {(1 << 63) - 1, *range(1 << 20)} and whiten.whiten(huge).count() % 3 == 0
    assert whiten.whiten(huge.where("false")).count() == 0


def test_iteration_certifies_close_eigenvalues():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(300, 300)))
    true = np.r_[1 + 1e-4 * np.arange(16)[::-1], np.linspace(0.9, 0.01, 284)]
    matrix = (q * true) @ q.T
    values, vectors, residuals, rounds = whiten.lobpcg(lambda z: matrix @ z, rng.normal(size=(300, 22)), 16)
    assert residuals.max() <= whiten.CERTIFIED and np.allclose(values, true[:16], rtol=1e-12) and rounds < 200
    assert np.allclose(np.abs((vectors * q[:, :16]).sum(0)), 1, atol=1e-8)
