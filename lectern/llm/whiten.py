"""Whitening of embeddings along their first principal components, by LOBPCG.

The eigenvectors of the covariance come from a block method that needs the
matrix only as a product with a few columns. Each product is a pass over the
centred rows in Spark: every task adds up its rows' share of V Z, a matrix of
dimensions by columns, and shares are summed by a shuffle. On the driver are
only such matrices: Rayleigh-Ritz on the iterate, its residual and the previous
direction gives the next iterate.

Iteration ends when the residuals of all wanted components, computed from a
fresh product, are below TOLERANCE of the first eigenvalue; if rounding holds
them up, they must be below CERTIFIED, else it is an error. Rows are whitened
only after that.

Components are fitted to the distinct vectors, all rows are whitened. Vectors
are rounded to whole numbers first, so their sums and the differences n x - S
are exact, and the centred rows are as exact as doubles are.

Defined results: rows whose vector is null or holds null, NaN or infinite
entries are dropped; vectors of different lengths are spaces of their own;
components whose eigenvalue is null to rounding are not given, so a space of a
single distinct vector, or of no entries, gives no rows; entries beyond 2 ** 52
after scaling are held there, and sums of squares beyond a long at its end;
repeated rows each have theirs; null ids stay; an empty table gives an empty
table; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns of the iterate beyond the wanted ones; they speed up the last of those.
GUARDS = 6
#: Residual, of the first eigenvalue, that ends the iteration, and that certifies a component.
TOLERANCE, CERTIFIED = 1e-13, 1e-9
ROUNDS = 500
#: Of the first eigenvalue; below it an eigenvalue is taken for null.
NULL_VALUE = 1e-12
MOST = float(1 << 52)


@dataclass(frozen=True)
class Fit:
    """n distinct vectors, their sums, unit eigenvectors (columns), falling eigenvalues, trace, residuals."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    rounds: int


def prepared(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x, dim): usable rows, entries as whole numbers."""
    v = F.col("v")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("long") + SHIFT
    return rows.select("id", F.transform(v, whole).alias("x"), F.size("v").alias("dim"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Column x of a batch as rows of longs."""
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 0), np.int64)


def _summed(rows: DataFrame, share, width: int, kind: str) -> np.ndarray:
    """Sum over all tasks of what share gives for a matrix of rows: d by width. Shares are added within a task, then by row."""
    names = [f"c{i}" for i in range(width)]

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                own = share(_matrix(batch))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(c) for c in total.T)], names=["i", *names])

    found = rows.select("x").mapInArrow(run, f"i int, {', '.join(f'{c} {kind}' for c in names)}")
    out = sorted(found.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect())
    return np.array([r[1:] for r in out], dtype=object if kind == "long" else float)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding: n x - S is a whole number."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums)) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / n
    return ((n * x.astype(object) - np.array(sums, object)) / n).astype(float)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the block's columns, without their parts in `against` (orthonormal columns); what depends goes."""
    size = np.linalg.norm(block, axis=0)
    b = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # twice is enough
        b = b - against @ (against.T @ b)
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        b = u[:, s > 1e-8 * max(1.0, s.max(initial=0))]
    return b


def lobpcg(product, start: np.ndarray, wanted: int):
    """(values, vectors, residuals, rounds) of the `wanted` largest eigenpairs; product(Z) is V Z, start the first block.

    Only residuals go through product; the rest of the products are combined
    from earlier ones, until the last one, which certifies the result.
    """
    x, _ = np.linalg.qr(start)
    vx = product(x)
    p, best, held = np.empty((len(x), 0)), np.inf, 0
    for rounds in range(1, ROUNDS + 1):
        values, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = x @ turn, vx @ turn
        rest = vx - x * values
        worst = np.linalg.norm(rest, axis=0)[:wanted].max() / max(values[0], 1e-300)
        held = held + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if worst <= TOLERANCE or (worst <= CERTIFIED and held >= 3):
            fresh = product(x)
            values = (x * fresh).sum(0)
            own = np.linalg.norm(fresh - x * values, axis=0)[:wanted] / max(values[0], 1e-300)
            if own.max() <= CERTIFIED:
                order = np.argsort(-values[:wanted], kind="stable")
                return values[order], x[:, order], own[order], rounds
            vx, best, held = fresh, np.inf, 0
            continue
        r = _orthonormal(rest, x)
        basis = np.concatenate([x, r], 1)
        p = _orthonormal(p, basis)
        new = product(np.concatenate([r, p], 1)) if r.shape[1] + p.shape[1] else np.empty((len(x), 0))
        z, vz = np.concatenate([basis, p], 1), np.concatenate([vx, new], 1)
        small = z.T @ vz
        _, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1][:, : x.shape[1]]
        old, x, vx = x, z @ turn, vz @ turn
        p = x - old @ (old.T @ x)
    raise ArithmeticError(f"residual {best:.2g} of the first eigenvalue after {ROUNDS} rounds")


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """The first components of the covariance of distinct vectors (x), all of length dim."""
    n = distinct.count()
    sums = [int(r[0]) for r in _summed(distinct, lambda x: x.sum(0)[:, None], 1, "long")] if n else [0] * dim
    squares = _summed(distinct, lambda x: (centred(x, n, sums) ** 2).sum(0)[:, None], 1, "double")
    trace = float(squares.sum()) / n

    def product(z: np.ndarray) -> np.ndarray:
        def share(x):
            c = centred(x, n, sums)
            return c.T @ (c @ z)

        return _summed(distinct, share, z.shape[1], "double") / n

    wanted = min(components, dim)
    start = np.random.default_rng(11).standard_normal((dim, min(dim, wanted + GUARDS)))
    if trace == 0:
        return Fit(n, sums, np.zeros((dim, 0)), np.zeros(0), trace, np.zeros(0), 0)
    values, vectors, residuals, rounds = lobpcg(product, start, wanted)
    good = values > NULL_VALUE * values[0]
    vectors = vectors[:, good]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)  # reruns agree in sign
    return Fit(n, sums, vectors, values[good], trace, residuals[good], rounds)


def _whitened(rows: DataFrame, model: Fit) -> DataFrame:
    """(id, component, n, deviation, whitened, explained) of every row."""
    n, sums, k = model.n, model.sums, len(model.values)
    tilt, explained = model.vectors / np.sqrt(model.values), model.values / model.trace
    most = (1 << 63) - 1

    def deviations(x: np.ndarray) -> np.ndarray:
        far = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums))
        if far < 1 << 62:
            d = n * x - np.array(sums, np.int64)
            if len(sums) * int(np.abs(d).max(initial=0)) ** 2 < most:
                return (d * d).sum(1)
            d = d.astype(object)
        else:
            d = n * x.astype(object) - np.array(sums, object)
        return np.array([min(int(s), most) for s in (d * d).sum(1)], np.int64)

    def run(batches):
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                m = len(x)
                cells = {
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, n, np.int64),
                    "deviation": np.repeat(deviations(x), k),
                    "whitened": (centred(x, n, sums) @ tilt).ravel(),
                    "explained": np.tile(explained, m),
                }
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cells.values())], names=["id", *cells])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double")


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    tilt = model.vectors / np.sqrt(model.values)

    def share(x):
        w = centred(x, model.n, model.sums) @ tilt
        return w.T @ w

    k = len(model.values)
    return float(np.abs(_summed(distinct, share, k, "double") / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    rows = prepared(vectors, key, vector)
    out = []
    for dim in sorted(r[0] for r in rows.where("dim > 0").select("dim").distinct().collect()):
        own = rows.where(F.col("dim") == dim)
        distinct = cut(own.select("x").distinct())
        model = fit(distinct, dim, components)
        if len(model.values):
            out.append(_whitened(own, model).withColumn("identity_error", F.lit(identity_error(distinct, model))))
    if not out:
        empty = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty).withColumnRenamed("id", key)
    return reduce(DataFrame.unionAll, out).withColumnRenamed("id", key)
