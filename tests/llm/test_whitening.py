import math

import numpy as np
import pytest

from punctual.llm import queries, whitening
from llm.data import SF

F = whitening.F


def brute(vectors):
    """Eigenpairs of the covariance, falling, with exact sums."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])
    n = len(x)
    off = (n * x - x.sum(axis=0)) / n
    values, components = np.linalg.eigh(off.T @ off / n)
    return x, off, values[::-1], components[:, ::-1]


def test_whole_table(spark):
    rows = queries.op11_embedding_whitening(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, off, values, components = brute(table["embedding"])
    n = len(x)
    assert len(rows) == 32 * n and set(rows["n"]) == {n} and rows["identity_error"].iloc[0] < 1e-10
    got = rows.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    for k in range(32):
        want = off @ components[:, k] / math.sqrt(values[k])
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-8
    shares = rows.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, values[:32] / values.sum(), rtol=1e-10)
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for i, row in zip(table["vec_id"], x)}
    assert dict(zip(rows["vec_id"], rows["deviation"])) == exact


def dense_product(x):
    return lambda q, p: ((x @ p).T @ (x @ q), float((x @ q) @ (x @ q)), x.T @ (x @ q))


@pytest.mark.parametrize(
    "values", [[9, 9, 9, 9, 5, 5, 3, 1], [7] * 8, [8, 4, 2, 1, 0, 0, 0, 0], [5, 1e-3, 1e-4], [3], list(range(60, 0, -1)), [50] * 3 + [1] * 57]
)
@pytest.mark.parametrize("wanted", [1, 3, 32])
def test_bidiagonalisation_finds_repeated_and_missing_directions(values, wanted):
    rng = np.random.default_rng(1)
    d = len(values)
    left, right = np.linalg.qr(rng.standard_normal((90, d)))[0], np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = left @ np.diag(np.array(values, float)) @ right.T
    got, components = whitening.bidiagonal_components(d, wanted, dense_product(x))
    want = [v for v in sorted(values, reverse=True) if v > 0][:wanted]
    assert np.allclose(got, want, rtol=1e-8)
    assert np.allclose(components.T @ components, np.eye(len(want)), atol=1e-10)
    assert np.allclose(x.T @ (x @ components), components * got**2, atol=1e-8 * max(values) ** 2)


def test_few_steps_suffice_where_the_spectrum_falls():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 200)) * 0.5 ** np.arange(200)
    calls = []
    product = dense_product(x)
    got, _ = whitening.bidiagonal_components(200, 4, lambda q, p: (calls.append(1), product(q, p))[1])
    assert np.allclose(got, np.linalg.svd(x)[1][:4], rtol=1e-10) and len(calls) < 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [1.0]), (7, [2.0**50, 0.0, 0.0])]
    rng = np.random.default_rng(3)
    good = [(10 + k, [float(v) for v in rng.normal(size=3)]) for k in range(20)]
    good += [good[0], (None, good[1][1]), (99, [-0.0, 1e-300, -1e-300])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows + good], "row long, deviation array<double>, whitened string, n long").repartition(3)
    vector = F.col("deviation")
    model = whitening.fit(df, vector)
    x, off, values, components = brute([v for _, v in good])
    assert model.n == len(good) and np.allclose(model.eigenvalues, values)
    out = whitening.whiten(df, vector, model).collect()
    assert sorted(str(r["row"]["row"]) for r in out) == sorted(str(k) for k, _ in good) and out[0]["row"]["whitened"] == "x"
    assert all(len(r["whitened"]) == 3 for r in out)


def test_no_variance_and_no_vectors(spark):
    same = spark.createDataFrame([(k, [0.5, 2.0]) for k in range(4)], "vec_id long, embedding array<float>")
    model = whitening.fit(same, F.col("embedding"))
    out = whitening.whiten(same, F.col("embedding"), model).collect()
    assert model.n == 4 and len(out) == 4 and all(r["whitened"] == [] and r["deviation"] == 0 for r in out)
    none = same.where("vec_id < 0")
    assert whitening.fit(none, F.col("embedding")) is None and whitening.whiten(none, F.col("embedding"), None).count() == 0


def test_deviation_is_exact_and_null_beyond_64_bits():
    model = whitening.Whitening(10**9, np.array([0, 0]), np.array([1, 999_999_999]), np.zeros((2, 0)), np.zeros(0), 1.0, 0.0)
    small, large = np.array([[1, 1]]), np.array([[10**6, 1]])
    assert model.deviations(small) == [(10**9 - 1) ** 2 + 1]
    assert model.deviations(large) == [None]
