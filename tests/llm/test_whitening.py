import math

import numpy as np
import pytest

from folioscope.llm import queries, whitening


def laid_out(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2**30 for c in v)]
    sizes = [len(v) for _, v in good]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    good = [(i, v) for i, v in good if len(v) == d]
    return [i for i, _ in good], [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]


def decomposed(x):
    """Eigenpairs by falling value of the whole covariance."""
    c = np.array(x, float) - np.array([math.fsum(col) / len(x) for col in zip(*x)])
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return c, values[::-1], vectors[:, ::-1]


def spectrum(seed, n, d, falling):
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    return (rng.standard_normal((n, d)) * falling(np.arange(d))) @ turn + rng.standard_normal(d) * 3


SHAPES = {
    "steep": (900, 40, lambda k: 0.5 * 0.8**k),
    "flat": (700, 90, lambda k: np.full(len(k), 0.2)),  # eigenvalues close together; the space is cut back
    "few dimensions": (300, 3, lambda k: 0.1 + k),
    "one leads": (500, 64, lambda k: np.where(k == 0, 3.0, 0.05)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_whole_decomposition(spark, shape):
    x = spectrum(5, *SHAPES[shape])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<double>, n int, data string").repartition(5)
    got, model = whitening.whiten(df)
    ids, laid = laid_out(rows)
    c, values, vectors = decomposed(laid)
    k = min(8, len(values))
    assert model.n == len(ids) and model.residual < 1e-12 and model.identity_error < 1e-9
    assert np.allclose(model.values, values[:k], rtol=1e-11)
    assert np.allclose(model.explained, values[:k] / values.sum(), rtol=1e-11)
    gaps = -np.diff(values[: k + 1]) if len(values) > k else np.append(-np.diff(values), values[-1])
    gap = min(gaps.min() / values[0], 1)
    assert np.abs(np.abs(np.sum(model.components * vectors[:, :k], 0)) - 1).max() < 1e-11 / gap**2
    found = {r.vec_id: r for r in got.collect()}
    assert sorted(found) == ids
    signs = np.sign(np.sum(model.components * vectors[:, :k], 0))
    want = c @ vectors[:, :k] * signs / np.sqrt(values[:k])
    assert np.abs(np.array([found[i].whitened for i in ids]) - want).max() < 1e-9 / gap
    sums = [sum(col) for col in zip(*laid)]
    n = len(laid)
    assert [int(found[i].deviation) for i in ids] == [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in laid]


def test_bad_vectors_repeats_and_ranks(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5, 1.0]), (6, [0.5, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]),
            (8, [-3.25, 0.001]), (9, [2.0**31, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, model = whitening.whiten(df)
    ids, laid = laid_out(rows)
    assert sorted(ids, key=str) == sorted((r.vec_id for r in got.collect()), key=str) == [6, 6, 8, None] and model.n == 4
    _, values, _ = decomposed(laid)
    assert np.allclose(model.values, values, rtol=1e-11)
    # two vectors have one direction, equal ones none
    got, model = whitening.whiten(df.filter("vec_id in (6, 8)").dropDuplicates())
    assert len(model.values) == 1 and {round(r.whitened[0], 9) for r in got.collect()} == {1.0, -1.0}
    got, model = whitening.whiten(df.filter("vec_id = 6"))
    assert len(model.values) == 0 and [r.whitened for r in got.collect()] == [[], []]
    for none in (df.filter("false"), df.filter("vec_id < 6")):
        got, model = whitening.whiten(none)
        assert model is None and got.collect() == []


def test_exact_deviations_of_large_entries():
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**40), 2**40, (30, 7))
    sums, n = [int(s) for s in x.sum(0)], 30
    assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal(12)
    solver, answer = whitening.minres(b, 40, 1e-13), None
    try:
        while True:
            answer = a @ solver.send(answer)
    except StopIteration as end:
        assert np.allclose(a @ end.value, b, atol=1e-9)


def test_query_columns(spark, tmp_path):
    x = spectrum(9, 60, 10, lambda k: 0.5 * 0.7**k)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path)).toPandas()
    assert len(got) == 480 and set(got.component) == set(range(1, 9)) and set(got.n) == {60}
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / 60 - np.eye(8)).max() < 1e-9 and got.identity_error.max() < 1e-9
    assert got.drop_duplicates("component").sort_values("component").explained.is_monotonic_decreasing
