"""Hidden Markov models: batched, segmented and chunked forms against the textbook recursions on one series and one model."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from latentia.operators import regimes
from latentia.operators.regimes import log_density


def blocky(n: int = 150, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, s, n) for s in (0.3, 2.0, 0.3, 2.0)])


def plain_em(x: np.ndarray, k: int, seed: int, steps: int, tol: float) -> tuple[float, int, np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Forward-backward EM, one step of time after the other."""
    rng = np.random.default_rng(seed)
    means = np.quantile(x, (np.arange(k) + 0.5) / k) + rng.normal(0, 0.05 * x.std() + 1e-12, k)
    variances = np.maximum(x.var() * rng.uniform(0.2, 2.0, k), 1e-6)
    a = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(a, 0.9)
    start, history, n = np.full(k, 1 / k), [], len(x)
    for step in range(1, steps + 1):
        b = np.exp(log_density(x[:, None], means, variances))
        alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        for t in range(n):
            row = (start if t == 0 else alpha[t - 1] @ a) * b[t]
            scale[t] = row.sum()
            alpha[t] = row / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = a @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        history.append(float(np.log(scale).sum()))
        if step > 1 and history[-1] - history[-2] < tol or step == steps:
            break
        gamma = alpha * beta
        xi = a * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        start, a, mass = gamma[0], xi / xi.sum(1, keepdims=True), gamma.sum(0)
        means = gamma.T @ x / mass
        variances = np.maximum((gamma * (x[:, None] - means) ** 2).sum(0) / mass, 1e-6)
    return history[-1], step, means, variances, a, history


def plain_viterbi(x: np.ndarray, means: np.ndarray, variances: np.ndarray, a: np.ndarray) -> np.ndarray:
    logb, loga = log_density(x[:, None], means, variances), np.log(np.maximum(a, 1e-300))
    back, row = np.zeros(logb.shape, int), logb[0] - np.log(logb.shape[1])
    for t in range(1, len(x)):
        step = row[:, None] + loga
        back[t], row = step.argmax(0), step.max(0) + logb[t]
    path = [int(row.argmax())]
    for t in range(len(x) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def test_batched_fit_is_the_plain_fit():
    """Two to four states, three restarts, in one batch and in segments, after a number of steps that divides nothing."""
    x, states = blocky(37), [2, 3, 4]
    m, progress = regimes.fitted(x, states, 3, 11, 23, 1e-6)
    for i, (k, restart) in enumerate((k, r) for k in states for r in range(3)):
        ll, n, means, variances, a, history = plain_em(x, k, 11 + restart, 23, 1e-6)
        assert (np.diff(history) > -1e-6).all()
        assert progress.ll[i] == pytest.approx(ll, rel=1e-9) and progress.iterations[i] == n
        assert np.allclose(m.means[i, :k], means, atol=1e-8) and np.allclose(m.variances[i, :k], variances, rtol=1e-7) and np.allclose(m.a[i, :k, :k], a, atol=1e-8)


def test_a_model_that_has_converged_stays():
    x = blocky(60)
    _, progress = regimes.fitted(x, [2, 3], 2, 0, 400, 1e-4)
    for i, (k, restart) in enumerate((k, r) for k in (2, 3) for r in range(2)):
        ll, n, *_ = plain_em(x, k, restart, 400, 1e-4)
        assert progress.iterations[i] == n and progress.ll[i] == pytest.approx(ll, rel=1e-9)
    assert len(set(progress.iterations.tolist())) > 1


@pytest.fixture(scope="module")
def series(spark):
    x = blocky(50)
    pdf = pd.concat([pd.DataFrame({"symbol": s, "bin": at + np.arange(len(v)), "z": v}) for s, at, v in (("a", -30, x), ("b", 7, blocky(9, 1)))])
    return pdf, spark.createDataFrame(pdf).repartition(3).persist()


def test_long_series_fit_in_chunks(series):
    """A symbol beyond the limit of a task: chunks of 60 bars give the fit of one task."""
    pdf, df = series
    one = regimes.fit_hmm(df, "z", [2, 3], restarts=2, steps=6).toPandas().sort_values(["symbol", "k", "restart"])
    many = regimes.fit_hmm(df, "z", [2, 3], restarts=2, steps=6, most=60).toPandas().sort_values(["symbol", "k", "restart"])
    assert len(one) == 8 and one["n"].tolist() == many["n"].tolist() and one["iterations"].tolist() == many["iterations"].tolist()
    assert np.allclose(one["ll"], many["ll"], rtol=1e-9)
    for c in ("means", "variances"):
        assert all(np.allclose(x, y, rtol=1e-6, atol=1e-8) for x, y in zip(one[c], many[c], strict=True))
    best = regimes.best_models(regimes.fit_hmm(df, "z", [2, 3], restarts=2, steps=40)).where("chosen AND symbol = 'a'").first()
    assert best["variances"][0] == pytest.approx(0.09, rel=0.5) and best["variances"][-1] == pytest.approx(4.0, rel=0.5)
    n, k = best["n"], best["k"]
    assert best["bic"] == pytest.approx(-2 * best["ll"] + (2 * k + k * (k - 1) + k - 1) * np.log(n))


@pytest.mark.parametrize("width", [1000, 33, 2, 1])
def test_decoding_in_chunks(spark, series, width):
    pdf, df = series
    rows = [("a", [0.0, 0.1, 0.0], [0.05, 0.5, 3.0], [[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.0, 0.1, 0.9]]), ("b", [0.0, 0.5], [0.1, 4.0], [[0.95, 0.05], [0.2, 0.8]])]
    models = spark.createDataFrame(rows, "symbol string, means array<double>, variances array<double>, transition array<array<double>>")
    got = regimes.decode(df, models, "z", width).toPandas().sort_values(["symbol", "bin"])
    for s, means, variances, a in rows:
        want = plain_viterbi(pdf[pdf.symbol == s]["z"].to_numpy(), np.array(means), np.array(variances), np.array(a))
        assert got[got.symbol == s]["state"].tolist() == want.tolist()
