"""Synthetic series with known answers, and kernels against plain restatements."""

from __future__ import annotations

import hashlib
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latentia.operators import calibrate, filters, metrics, models, noise, order, realized
from latentia.plans import catalogue
from latentia.sources import sinks, ticks
from latentia.streaming import filters as streaming
from tests.conftest import SMALL


def test_roll_recovers_the_bounce(spark):
    rng = np.random.default_rng(1)
    n, s = 4000, 0.02
    z = np.cumsum(rng.normal(0, 1e-3, n)) + s / 2 * rng.choice([-1, 1], n)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "us": np.arange(n) * 10_000_000, "seq": np.arange(n), "price": np.exp(z)}))
    got = noise.roll(noise.return_pairs(df), ["symbol"]).first()
    assert got["status"] == "ok" and got["r_noise"] == pytest.approx(s * s / 4, rel=0.2)


def test_neighbours_cross_chunks_and_ties(spark):
    df = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 0, 2, 2.0), ("a", 5, 3, 4.0), ("b", 1, 4, 9.0)], "symbol string, us long, seq long, price double")
    got = {r["seq"]: r["prev_price"] for r in order.with_neighbour(df, ["price"], ["us", "seq"], F.floor(F.col("us") / 3)).collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0, 4: None}


def test_quantiles_are_exact(spark):
    x = np.random.default_rng(3).integers(0, 50, 333) / 7
    got = order.quantiles(spark.createDataFrame(pd.DataFrame({"x": x})), "x", [0.0, 0.13, 0.5, 0.99, 1.0]).toPandas().sort_values("share")
    assert np.allclose(got["q"], np.quantile(x, got["share"]))


def test_two_modes_are_told_apart():
    rng = np.random.default_rng(2)
    z = np.concatenate([rng.normal(0, 0.01, 200).cumsum(), rng.normal(0, 1.0, 200).cumsum()])
    _, p, mu, _ = filters.imm_steps(z, np.array([1e-4, 1.0]), np.array([1e-3, 1e-3]), np.array([[0.97, 0.03], [0.03, 0.97]]))
    assert np.allclose(mu.sum(1), 1) and (p > 0).all()
    assert mu[20:200, 1].mean() < 0.3 < 0.8 < mu[220:, 1].mean()


def test_kalman_state_carries_over():
    z, q = np.random.default_rng(0).normal(size=50), np.full(50, 0.3)
    whole, _ = filters.kalman_steps(z, q, 0.5)
    first, state = filters.kalman_steps(z[:20], q[:20], 0.5)
    rest, _ = filters.kalman_steps(z[20:], q[20:], 0.5, state)
    assert np.array_equal(whole, np.vstack([first, rest]))


def dataset(spark, n=600, days=10, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    pdf = pd.DataFrame({"pos": np.arange(n), "day": np.arange(n) * days // n, "a": x[:, 0], "b": x[:, 1] * 5 + 3, "y": y})
    return pdf, models.prepared(spark.createDataFrame(pdf), ["a", "b"], ["y"], 10, F.floor(F.col("pos") / 100))


def test_walk_forward_logistic_equals_separate_fits(spark):
    pdf, rows = dataset(spark)
    folds = models.day_folds(rows, 7)
    got = models.logistic_oof(rows, folds, 1, 2).toPandas()
    assert set(got["fold"]) == set(range(1, 10))
    days = pdf.groupby("day")["pos"].agg(["min", "max"])
    fold = 6
    use = pdf["pos"] < days.loc[fold, "min"] - 7
    for p in range(1, fold):
        use &= ~pdf["pos"].between(days.loc[p, "max"] + 1, days.loc[p, "max"] + 10)
    train, test = pdf[use], pdf[pdf["day"] == fold]
    mean, scale = train[["a", "b"]].mean().to_numpy(), train[["a", "b"]].std(ddof=0).to_numpy()
    z = np.column_stack([np.ones(len(train)), (train[["a", "b"]] - mean) / scale])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([0, 1, 1]), z.T @ (p - train["y"]) + np.array([0, 1, 1]) * w)
    want = 1 / (1 + np.exp(-(np.column_stack([np.ones(len(test)), (test[["a", "b"]] - mean) / scale]) @ w)))
    assert np.allclose(got[got["fold"] == fold].sort_values("pos")["y_pred"], want, atol=1e-7)


def test_network_learns_what_the_prior_cannot(spark):
    _, rows = dataset(spark)
    folds = models.k_folds(600, 3)
    auc = metrics.auc(models.mlp_oof(rows, folds, 2, [8], epochs=12, rate=0.05)[8]).first()["auc"]
    assert auc > 0.7
    prior = models.prior_oof(rows, folds, 1, 2).toPandas()
    assert prior.groupby("fold")["y_pred"].nunique().max() == 1


def test_pooling_in_chunks_equals_pooling_at_once(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 200, 800) / 200, (rng.random(800) < 0.5).astype(float)
    got = calibrate.isotonic_blocks(spark.createDataFrame(pd.DataFrame({"fold": 1, "x": x, "y": y})), 8).toPandas().sort_values("lo")
    g = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["mean", "size"]).reset_index()
    want = calibrate.pooled(*(g[c].to_numpy(float) for c in ("x", "mean", "size", "x")))
    assert np.allclose(got[["lo", "hi", "y", "w"]], np.array(want))
    assert (np.diff(got["y"]) > 0).all()


def test_auc_mirrors_and_permutations_centre(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"y_true": (rng.random(400) < 0.3).astype(float), "y_pred": rng.integers(0, 40, 400) / 40})
    df = spark.createDataFrame(pdf)
    a = metrics.auc(df).first()["auc"]
    assert a + metrics.auc(df.withColumn("y_pred", 1 - F.col("y_pred"))).first()["auc"] == pytest.approx(1)
    null = metrics.permutation_aucs(df, 300).toPandas()["auc"]
    assert abs(null.mean() - 0.5) < 0.01 and 0.02 < null.std() < 0.06
    assert metrics.auc(df.where("y_true = 1")).first()["auc"] is None


def test_bootstrap_null_draws_every_symbol(spark):
    rows = [(s, d, float(d + 1)) for s, n in (("a", 9), ("b", 8), ("c", 3)) for d in range(n)]
    got = realized.bootstrap_by_symbol(spark.createDataFrame(rows, "symbol string, day int, rv double"), draws=40).toPandas()
    assert got.groupby("symbol")["draw"].nunique().to_dict() == {"a": 40, "b": 40, "c": 40}
    assert got[got.symbol == "c"]["share"].isna().all() and got[got.symbol != "c"]["share"].between(1 / 7, 1).all()
    null = catalogue.bootstrap_null(spark, SMALL)
    assert null.columns == ["symbol", "draw", "share"]
    by = null.groupBy("symbol").count().collect()
    assert len(by) == 5 and {r["count"] for r in by} == {5000}


def test_bootstrap_needs_enough_days(spark):
    with pytest.raises(ValueError):
        realized.bootstrap_shares(spark, [1.0], 7)
    d = realized.bootstrap_shares(spark, [1.0] * 9, 7, draws=20).toPandas()
    assert np.allclose(d["share"], 1 / 7)


def test_zipped_ticks_and_checksums(spark, tmp_path):
    lines = "1,10.5,1,1,1,1650000000000,True,True\n2,11.5,1,1,1,1650000000000123,False,True\n"
    with zipfile.ZipFile(tmp_path / "X.zip", "w") as z:
        z.writestr("X.csv", lines)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = ticks.zip_ticks(spark, str(tmp_path / "X.zip"), strict=True).orderBy("seq").collect()
    assert [(r["symbol"], r["us"], r["price"]) for r in got] == [("X", 1650000000000000, 10.5), ("X", 1650000000000123, 11.5)]
    status = {r["file"]: (r["status"], r["rows"]) for r in ticks.archive_report(spark, str(tmp_path / "*.zip")).collect()}
    assert status == {"X.zip": ("ok", 2), "bad.zip": ("invalid", None)}
    sha = hashlib.sha256((tmp_path / "X.zip").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("X.zip", f"{sha.upper()}  X.zip"), ("gone.zip", "00  gone.zip")], "file string, line string")
    assert {r["file"]: r["ok"] for r in ticks.checksums(spark, str(tmp_path / "X.zip"), manifest).collect()} == {"X.zip": True, "gone.zip": False}
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "X.csv").write_text(lines)
    assert ticks.csv_ticks(spark, str(tmp_path / "plain")).count() == 2
    sinks.write_parquet(spark.createDataFrame([("a", 1)], "window_id string, v int"), str(tmp_path / "out"), ["window_id"])
    assert "window_id=a" in {p.name for p in (tmp_path / "out").iterdir()}
    sinks.write_parquet(spark.createDataFrame([(1,)], "v int"), str(tmp_path / "w" / "first.parquet"))
    assert ticks.windows(spark, str(tmp_path / "w" / "*.parquet"), r"/([^/]+)\.parquet/").first()["window_id"] == "first"


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 60
    pdf = pd.DataFrame({"symbol": ["a", "b"] * (n // 2), "at": np.arange(n), "z": rng.normal(size=n)})
    for i in range(3):
        spark.createDataFrame(pdf[i * 20 : i * 20 + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("symbol string, at long, z double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.stream_kalman(source, 0.3, 0.5).writeStream.format("memory").queryName("level").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("level").toPandas().sort_values("at")
    want = pd.concat(pd.DataFrame({"at": g["at"], "x": filters.kalman_steps(g["z"].to_numpy(), np.full(len(g), 0.3), 0.5)[0][:, 0]}) for _, g in pdf.groupby("symbol")).sort_values("at")
    assert np.allclose(got["x_filt"], want["x"])
    base = pd.DataFrame({"symbol": "a", "ts": pd.to_datetime(np.arange(0, 600, 7), unit="s"), "seq": np.arange(86), "price": 1.0 + np.arange(86)})
    spark.createDataFrame(base).coalesce(1).write.parquet(str(tmp_path / "t"))
    live = spark.readStream.schema("symbol string, ts timestamp, seq long, price double").parquet(str(tmp_path / "t"))
    q = streaming.stream_bars(live).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    bars = spark.table("bars").orderBy("bar_ts").toPandas()
    want = base.groupby(base["ts"].dt.floor("60s"))["price"].last()
    assert len(bars) >= 7 and bars["price"].tolist() == want.tolist()[: len(bars)]


def test_stream_of_modes_equals_the_batch_and_counts_late_rows(spark, tmp_path):
    """Three files; the second repeats a time and brings two rows from before, which are left out and counted."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"symbol": ["a", "b"] * 45, "at": np.arange(90), "z": rng.normal(size=90).cumsum()})
    late = pd.DataFrame({"symbol": ["a", "a", "b"], "at": [2, 28, 7], "z": 99.0})
    parts = [pdf[:30], pd.concat([pdf[30:60], late]), pdf[60:]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    q, r, pi = catalogue.FOUR_Q, [0.1, 0.2, 0.3, 0.4], catalogue.FOUR_PI
    source = spark.readStream.schema("symbol string, at long, z double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = streaming.stream_imm(source, q, r, pi).writeStream.format("memory").queryName("modes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    got = spark.table("modes").toPandas().sort_values("at").reset_index(drop=True)
    assert len(got) == 90
    for s in ("a", "b"):
        own, z = got[got.symbol == s], pdf[pdf.symbol == s]["z"].to_numpy()
        x, p, mu, _ = filters.imm_steps(z, np.array(q), np.array(r), np.array(pi))
        assert np.allclose(own["x_filt"], x) and np.allclose(own["p_filt"], p) and np.allclose(np.array(own["mode_probs"].tolist()), mu)
    assert got.groupby("symbol")["n_late"].max().to_dict() == {"a": 2, "b": 1}


def test_calm_window_is_the_least_that_passes(spark):
    rng = np.random.default_rng(3)
    frames = [pd.DataFrame({"symbol": s, "day": range(n), "rv": rng.gamma(2.0, 1.0, n), "intraday_range": 0.1}) for s, n in (("a", 25), ("b", 12), ("c", 4))]
    daily = pd.concat(frames)
    daily.loc[(daily.symbol == "a") & (daily.day == 5), "rv"] = 60.0  # an outlier is no part of the null population
    df = spark.createDataFrame(daily)
    windows = realized.calm_windows(df, k=3, percentile=60.0, draws=400).toPandas()
    shares = realized.bootstrap_by_symbol(realized.calm_days(df), k=3, draws=400).toPandas()
    assert set(windows["symbol"]) == {"a", "b", "c"} and len(windows) == 23 + 10 + 2
    for s, own in windows.groupby("symbol"):
        cutoff = np.percentile(shares[shares.symbol == s]["share"].astype(float), 60)
        assert np.allclose(own["cutoff"], cutoff) and (own["passes_null"] == (own["largest_share"] <= cutoff)).all()
        passing = own[own.passes_null].sort_values("total_rv")
        assert own[own.selected]["start_day"].tolist() == passing["start_day"].head(1).tolist()
    assert 0 < windows["passes_null"].sum() < len(windows)
    days = realized.days_of_selected(realized.calm_windows(df, k=3, percentile=60.0, draws=400), df).toPandas()
    assert np.allclose(days.groupby("symbol")["rv_share"].sum(), 1) and (days.groupby("symbol").size() == 3).all()


def test_horizon_solves_its_equations():
    """Sojourns solve (I - Q) s = 1, weights are Q's left eigenvector with sum 1, H is their product."""
    from latentia.functions.expr import horizon

    q = np.array([[0.95, 0.03], [0.02, 0.96]])
    h, sojourn, weights = horizon(q.tolist())
    assert np.allclose((np.eye(2) - q) @ sojourn, 1)
    moved = np.array(weights) @ q
    assert np.isclose(sum(weights), 1) and np.allclose(moved / moved.sum(), weights)
    assert np.isclose(h, np.dot(weights, sojourn))


def test_chi2_gate_meets_its_alarm_rate():
    """The threshold is passed by squares of standard normal values at the rate asked for."""
    from math import erfc, sqrt

    from latentia.functions.expr import chi2_gate

    alpha, threshold = chi2_gate(2.0, 1440)
    assert np.isclose(alpha, 2 / 1440) and np.isclose(erfc(sqrt(threshold / 2)), alpha)
