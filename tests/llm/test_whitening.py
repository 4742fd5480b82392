import math

import numpy as np
import pytest

from usagelens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def plain(rows, scale=64, offset=1_000_000, components=32):
    """Whole numbers, exact deviations and the covariance's own eigenvectors."""
    x = np.array([[math.floor(scale * float(np.float32(c))) + offset for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviations = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums)) for r in x]
    return n, deviations, y @ axes / np.sqrt(values), values / np.trace(y.T @ y / n)


def usual(n=300, d=12, seed=5):
    pick = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(pick.standard_normal((n, d)) @ pick.standard_normal((d, d)))]


def held(got, rows, components):
    n, deviations, whitened, explained = plain(rows, components=components)
    by_place = sorted(got, key=lambda r: (r.component, r.vec_id))
    assert len(got) == n * components
    for k in range(components):
        part = by_place[k * n : (k + 1) * n]
        values = np.array([r.whitened for r in part])
        sign = np.sign(values @ whitened[:, k])
        assert np.abs(sign * values - whitened[:, k]).max() < 1e-8
        assert [r.deviation for r in part] == deviations
        assert {r.n for r in part} == {n} and abs(part[0].explained / explained[k] - 1) < 1e-10
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_against_the_covariance(spark):
    rows = usual()
    held(whitening.whiten(vectors(spark, rows), components=5).collect(), rows, 5)


def test_all_components(spark):
    rows = usual(60, 6)
    held(whitening.whiten(vectors(spark, rows)).collect(), rows, 6)


def test_repeated_values_and_early_end(spark):
    """Repeated values are found although one start sees each value once, and not all steps are taken."""
    axes = np.array([9.0, 9.0, 9.0, 4.0, 4.0, 1.0] + [0.5] * 54)
    x = np.diag(axes)

    def product(w):
        u = x @ w
        return x.T @ u, float(u @ u)

    values, right = whitening.bidiagonal(product, 60, 6)
    assert np.allclose(values[:6], axes[:6]) and np.allclose(right.T @ right, np.eye(right.shape[1]))
    assert np.allclose(np.abs(right[:3, :3]) ** 2 @ np.ones(3), 1)
    assert right.shape[1] < 40


def test_ill_conditioned(spark):
    pick = np.random.default_rng(1)
    q = np.linalg.qr(pick.standard_normal((200, 16)))[0] * np.logspace(4, -2, 16)
    x = q @ np.linalg.qr(pick.standard_normal((16, 16)))[0]
    values, right = whitening.bidiagonal(lambda w: (x.T @ (x @ w), float(np.square(x @ w).sum())), 16, 16)
    assert np.allclose(values, np.logspace(4, -2, 16), rtol=1e-7)
    assert np.allclose(right.T @ right, np.eye(16), atol=1e-12)


def test_awkward_rows(spark):
    rows = usual(80, 4)
    bad = [(901, None), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0])]
    odd = [(905, []), (906, [1.0, 2.0])]
    repeated = rows + rows[:7]
    got = whitening.whiten(vectors(spark, repeated + bad + odd)).collect()
    n, deviations, _, _ = plain(repeated)
    assert len(got) == n * 4 and got[0].n == n and not {r.vec_id for r in got} & set(range(901, 907))
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    nulls = whitening.whiten(vectors(spark, [(None, v) for _, v in rows])).collect()
    assert len(nulls) == 320 and {r.vec_id for r in nulls} == {None}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_flat_axes_and_clashing_names(spark):
    """A constant entry and a doubled one have no variance of their own; extra columns are not read."""
    rows = [(i, [*v, 3.0, v[0]]) for i, v in usual(50, 3)]
    table = vectors(spark, rows).selectExpr("*", "1 AS id", "2 AS x", "3 AS component", "4 AS n", "5 AS whitened")
    got = whitening.whiten(table).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 150 and got[0].identity_error < 1e-9


def test_query_against_the_covariance(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows.sort()
    held(queries.op13_embedding_whitening(spark, folder).collect(), rows, 32)
