"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay in Spark. Each step multiplies them from the right and from the left in one scan and keeps
only vectors as long as a row: `v`, the coefficients `w` of the left vector `u = Xw`, and `X'u`. Coefficients of a new
left vector on the earlier ones are `w' X'u`, so left vectors are reorthogonalised without being stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import written

#: What is taken for zero, as a part of the largest singular value.
ZERO = 1e-10
#: Size of the residual at which a component counts as found, as a part of the largest singular value.
SETTLED = 1e-13
#: Steps from a fresh start that look for components the first start has no part in.
PROBES = 8


@dataclass(frozen=True)
class Whitening:
    """What whitens a row x: `(x - sums / n) @ components / sqrt(variances)`."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> tuple[DataFrame, int]:
    """`id, x`: whole numbers `floor(scale * c) + offset` of every usable vector, eight bytes each, and their length.

    Usable are vectors without null, infinite or undefined entries, of the commonest length (the longest of those
    equally common).
    """
    length = F.size(vector_col)
    usual = vectors.where(length > 0).groupBy(length.alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    d = (usual.first() or [0])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            batch = batch.filter(pa.compute.equal(lists.value_lengths(), d))
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            fine = np.isfinite(rows).all(axis=1)
            whole = np.floor(rows[fine] * scale)
            if whole.size and np.abs(whole).max() >= 2**52:
                raise OverflowError("an entry is too large for whole numbers")
            x = whole.astype(np.int64) + offset
            ids = batch.column(0).filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, x binary"
    return written(rows.where(F.size("vector") == d).mapInArrow(run, kind), "scaled"), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def _summed(rows: DataFrame, d: int, size: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double"):
    """The sum over all rows of `of(matrix)`, `size` numbers: summed in each task, then by place in Spark."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            total += of(_matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "value"])

    parts = rows.select("x").mapInArrow(run, f"place long, value {kind}")
    out = np.zeros(size, dtype)
    for place, value in parts.groupBy("place").agg(F.sum("value")).collect():
        out[place] = value
    return out


def bidiagonal(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, wanted: int, seed: int = 7):
    """Singular values and right vectors of X, largest first, from `product(w) = X'Xw, |Xw|^2`.

    Both sides are reorthogonalised fully. Ends after `d` steps, or as soon as the `wanted` largest values have
    settled and a fresh start has found none that was missed (as copies of a repeated value are). Where a step leads
    out of the space reached so far no further, it goes on from a fresh direction.
    """
    pick = np.random.default_rng(seed)
    V, W, Z = (np.zeros((d, 0)) for _ in range(3))
    alphas: list[float] = []
    betas: list[float] = []
    scale = probes = 0.0

    def fresh() -> np.ndarray:
        v = pick.standard_normal(d)
        for _ in range(2):
            v -= V @ (V.T @ v)
        return v / np.linalg.norm(v)

    def triplets():
        b = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)
        left, values, right = np.linalg.svd(b)
        return left, values, V @ right.T

    v, beta = fresh(), 0.0
    while True:
        V = np.column_stack([V, v])
        w = v - beta * W[:, -1] if W.shape[1] else v.copy()
        for _ in range(4):
            z, square = product(w)
            along = W.T @ z
            w, z, before = w - W @ along, z - Z @ along, square
            square -= along @ along
            if square > 0.5 * before:
                break
        alpha = float(np.sqrt(max(square, 0.0)))
        scale = max(scale, alpha, beta)
        if alpha <= ZERO * scale:
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = w / alpha, z / alpha
        W, Z = np.column_stack([W, w]), np.column_stack([Z, z])
        alphas.append(alpha)
        if len(alphas) == d:
            break
        rest = z - alpha * v
        for _ in range(2):
            rest -= V @ (V.T @ rest)
        beta = float(np.linalg.norm(rest))
        if len(alphas) >= wanted and not probes:
            left, values, _ = triplets()
            if (np.abs(beta * left[-1, :wanted]) <= SETTLED * values[0]).all():
                known, probes, beta = values[:wanted], PROBES, 0.0
        elif probes:
            probes -= 1
            if not probes:
                _, values, _ = triplets()
                if np.allclose(values[:wanted], known, rtol=1e-12, atol=0):
                    break
        if beta <= ZERO * scale:
            beta, v = 0.0, fresh()
        else:
            v = rest / beta
        betas.append(beta)
    _, values, right = triplets()
    return values, right


def fit(rows: DataFrame, d: int, components: int) -> Whitening:
    """Sums, components and variances of all `rows(x)`; components without variance are left out."""
    n = rows.count()
    sums = _summed(rows, d, d, lambda x: x.sum(axis=0), "long") if n else np.zeros(d, np.int64)
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n

    def product(w: np.ndarray) -> tuple[np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            u = y @ w
            return np.append(y.T @ u, u @ u)

        out = _summed(rows, d, d + 1, of)
        return out[:-1], out[-1]

    trace = _summed(rows, d, 1, lambda x: np.array([np.square(centred(x)).sum()]))[0] / n
    if not trace:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    values, right = bidiagonal(product, d, min(components, d))
    found = values[:components] > ZERO * values[0]
    chosen = right[:, :components][:, found]
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return Whitening(n, sums, chosen, np.square(values[:components][found]) / n, float(trace))


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    return ((model.n * x - model.sums) / model.n) @ model.components / np.sqrt(model.variances)


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """The largest entry, in size, of the whitened rows' covariance minus the identity."""
    k = len(model.variances)
    mean = _summed(rows, d, k, lambda x: _whitened(model, x).sum(axis=0)) / max(model.n, 1)

    def of(x: np.ndarray) -> np.ndarray:
        y = _whitened(model, x) - mean
        return (y.T @ y).ravel()

    if not k:
        return 0.0
    return float(np.abs(_summed(rows, d, k * k, of).reshape(k, k) / model.n - np.eye(k)).max())


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 32,
    scale: float = 64.0,
    offset: int = 1_000_000,
) -> DataFrame:
    """One row per usable vector and component: whitened value, explained share, deviation, fit size, identity error.

    Vectors that are null or hold a null, infinite or undefined entry are left out, as are empty ones and those of
    another length than the commonest. A null id stays as it is, and repeated rows and ids count as often as they
    occur. Components without variance are left out, so equal vectors only, a single vector or an empty table give no
    rows. Components of equal variance are any orthonormal set of their space, the same for all rows. The sign makes a
    component's largest entry positive. Entries of 2^52 and more after scaling, and deviations beyond a long, are
    errors. Other columns are not read.

    The driver holds vectors as long as a row, and at most as many of them as a row has entries.
    """
    rows, d = scaled(vectors, id_col, vector_col, scale, offset)
    model = fit(rows, d, components)
    k, error = len(model.variances), identity_error(rows, d, model)
    explained = model.variances / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            apart = model.n * x - model.sums
            if np.square(apart.astype(np.float64)).sum(axis=1).max(initial=0) >= 2**63:
                raise OverflowError("a deviation doesn't fit into a long")
            deviation = np.square(apart).sum(axis=1)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n, np.int64)),
                    pa.array(np.repeat(deviation, k)),
                    pa.array(_whitened(model, x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long"
    out = rows.mapInArrow(run, f"{kind}, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
