"""Regimes to filter parameters: horizon, noise, the fitted chain against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latentia.functions.expr import horizon, horizon_of
from latentia.operators import filters, parameters, regimes
from latentia.plans import catalogue
from tests.conftest import SMALL


def test_horizon_of_the_given_modes(spark):
    """Two elevated modes of the four: H = 53.987 bars, sojourns 70.12 and 45.12, weights .3546 and .6454."""
    above = regimes.above_median(F.array(*map(F.lit, catalogue.FOUR_Q)))
    pi = F.array(*[F.array(*map(F.lit, row)) for row in catalogue.FOUR_PI])
    got = spark.range(1).select(above.alias("s"), horizon_of(pi, above).alias("x")).first()
    assert got["s"] == [2, 3]
    assert got["x"]["h"] == pytest.approx(53.987, abs=5e-4)
    assert got["x"]["sojourn"] == pytest.approx([70.12, 45.12], abs=5e-3) and got["x"]["weights"] == pytest.approx([0.3546, 0.6454], abs=5e-5)


def test_horizon_expressions_are_the_matrix_form(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        pi = rng.dirichlet(np.ones(4), 4)
        if i % 5 == 0:
            pi[2, 3] = 0.0
        if i % 7 == 0:
            pi[3, 2] = 0.0
        rows.append((i, pi.tolist(), sorted(rng.choice(4, int(rng.integers(1, 4)), replace=False).tolist())))
    df = spark.createDataFrame(rows, "i int, pi array<array<double>>, states array<int>")
    for r in df.select("i", "pi", "states", horizon_of(F.col("pi"), F.col("states")).alias("x")).collect():
        if len(r["states"]) > 2:
            assert r["x"] is None
            continue
        h, sojourn, weights = horizon(np.array(r["pi"])[np.ix_(r["states"], r["states"])].tolist())
        assert r["x"]["sojourn"] == pytest.approx(sojourn)
        if len(r["states"]) < 2 or np.array(r["pi"])[np.ix_(r["states"], r["states"])][[0, 1], [1, 0]].all():
            assert r["x"]["h"] == pytest.approx(h) and r["x"]["weights"] == pytest.approx(weights)


def test_parameters_of_states_with_and_without_noise(spark):
    models = spark.createDataFrame([("a", [1.0, 4.0, 9.0], [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.01, 0.02, 0.97]])], "symbol string, variances array<double>, transition array<array<double>>")
    noise = spark.createDataFrame([("a", 0, 500, 0.7), ("a", 1, 50, None), ("a", 2, 300, -0.3)], "symbol string, state int, n_pairs long, r_noise double")
    got = parameters.parameter_table(models, noise).first()
    assert (got["q"], got["r"], got["n_pairs"], got["elevated"]) == ([1e-15, 4.0, 9.0], [0.7, 0.0, 0.0], [500, 50, 300], [2])
    assert got["horizon"] == pytest.approx(1 / 0.03)
    assert [r["sticky"] for r in parameters.by_state(parameters.parameter_table(models, noise)).orderBy("state").collect()] == [False, False, True]
    alone = parameters.parameter_table(models, noise.limit(0)).first()
    assert (alone["q"], alone["r"], alone["n_pairs"]) == ([1.0, 4.0, 9.0], [0.0] * 3, [0] * 3)


def test_observed_models_count_moves(spark):
    r = [None, 0.1, 0.1, 3.0, 0.6, 0.1]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(r)], "symbol string, bin long, r double")
    states, models = parameters.observed_models(df, [0.5, 2.0])
    assert [s["state"] for s in states.orderBy("bin").collect()] == [0, 0, 2, 1, 0]
    got = models.first()
    assert np.allclose(got["transition"], [[2 / 5, 1 / 5, 2 / 5], [2 / 4, 1 / 4, 1 / 4], [1 / 4, 2 / 4, 1 / 4]]) and got["variances"] == pytest.approx([0, 0, 0], abs=1e-12)


def test_fitted_regimes_feed_the_filter(spark, monkeypatch):
    """Fit, decode, rescale, noise by decoded state, process noise, filter, horizon: the queries against numpy on their own models."""
    full = regimes.fit_hmm
    monkeypatch.setattr(regimes, "fit_hmm", lambda series, value, states: full(series, value, states, restarts=1, steps=4))
    monkeypatch.setattr(catalogue, "FITS", {})
    monkeypatch.setattr(catalogue, "LEAST_PAIRS", 10)
    chosen = {r["symbol"]: r for r in catalogue.hmm_fit(spark, SMALL).where("chosen").collect()}
    series = catalogue.standardized_series(spark, SMALL).select("symbol", "scale").distinct().collect()
    rows = catalogue.fitted_regimes(spark, SMALL).toPandas().sort_values(["symbol", "state"])
    prices = catalogue.log_prices(spark, SMALL).toPandas().sort_values(["symbol", "bin"])
    got = catalogue.fitted_imm(spark, SMALL).toPandas().sort_values(["symbol", "bin"])
    assert set(rows["symbol"]) == set(chosen) == {r["symbol"] for r in series} and len(got) == len(prices)
    for r in series:
        model, own, z = chosen[r["symbol"]], rows[rows.symbol == r["symbol"]], prices[prices.symbol == r["symbol"]]["z"].to_numpy()
        variances = np.array(model["variances"]) * r["scale"] ** 2
        assert np.allclose(own["variance"], variances) and np.allclose(own["q"], np.maximum(variances - 2 * own["r_noise"], 1e-15)) and (own["r_noise"] >= 0).all()
        elevated = np.flatnonzero(variances > np.median(variances))
        assert own["elevated"].tolist() == [i in elevated for i in range(len(variances))]
        assert own["horizon"].iloc[0] == pytest.approx(horizon(np.array(model["transition"])[np.ix_(elevated, elevated)].tolist())[0])
        x, _, mu, _ = filters.imm_steps(z, own["q"].to_numpy(), own["r_noise"].to_numpy(), np.array([list(p) for p in model["transition"]]))
        mine = got[got.symbol == r["symbol"]]
        assert np.allclose(mine["x_filt"], x, equal_nan=True) and np.allclose(mine["elevated_prob"], mu[:, elevated].sum(1), equal_nan=True)
    assert pd.notna(got["x_filt"]).all()
    assert catalogue.fitted_persistence(spark, SMALL).where("persistence BETWEEN 0 AND 1").count() == 15
