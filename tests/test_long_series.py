"""Series in chunks give what they give at once, whatever the chunks' size."""

from __future__ import annotations

import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latentia.operators import chunks, filters, labels, medians, realized


def series(n: int = 130, seed: int = 3) -> pd.DataFrame:
    """Two symbols, one of them with most of the bars; the other begins elsewhere and has one bar alone in its chunk."""
    rng = np.random.default_rng(seed)
    frames = [pd.DataFrame({"symbol": s, "bin": at + np.arange(m), "z": rng.normal(0, 1, m).cumsum(), "q": rng.uniform(0.01, 1, m), "r_noise": r}) for s, at, m, r in (("a", -17, n, 0.5), ("b", 1000, 9, 0.01))]
    return pd.concat(frames, ignore_index=True)


def test_products_of_kalman_steps_are_the_filter():
    pdf = series()[lambda d: d.symbol == "a"]
    z, q, r = pdf["z"].to_numpy(), pdf["q"].to_numpy(), pdf["r_noise"].to_numpy()
    steps, _ = filters.kalman_steps(z, q, 0.5)
    elements = filters.kalman_elements(z, q, r)
    start = np.array([[0, z[0], 0.5, 0, 0]])
    for n in (1, 2, 3, 64, 130):
        whole = filters.kalman_product(start, chunks.product(elements[:n], filters.kalman_product)[None])[0]
        assert whole[[1, 2]] == pytest.approx(steps[n - 1, :2], rel=1e-12)
    e = [elements[i : i + 1] for i in range(3)]
    p = filters.kalman_product
    assert np.allclose(p(p(e[0], e[1]), e[2]), p(e[0], p(e[1], e[2])))


@pytest.mark.parametrize("width", [1000, 40, 2])
def test_kalman_in_chunks(spark, width):
    """One, about four and about 65 chunks."""
    pdf = series()
    got = filters.kalman(spark.createDataFrame(pdf), width=width).toPandas().sort_values(["symbol", "bin"])
    want = np.vstack([filters.kalman_steps(d["z"].to_numpy(), d["q"].to_numpy(), float(d["r_noise"].iloc[0]))[0] for _, d in pdf.groupby("symbol")])
    assert np.allclose(got[["x_filt", "p_filt", "innovation", "innovation_var"]], want, rtol=1e-10, atol=1e-12)
    assert np.allclose(got["gate_stat"], want[:, 2] ** 2 / want[:, 3], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("fan", [100, 3, 2])
def test_prefixes_of_runs(spark, fan):
    """Strings under concatenation: order matters; with a small fan, runs of runs are scanned first."""
    digits = [(s, c, [float(c % 7), 1.0]) for s, n in (("a", 23), ("b", 1)) for c in range(5, 5 + n)]
    join = lambda x, y: np.column_stack([x[:, 0] * 10 ** y[:, 1] % 1e9 + y[:, 0], np.minimum(x[:, 1] + y[:, 1], 12)])
    got = {(r["symbol"], r["__chunk"]): r["before"] for r in chunks.prefixes(spark.createDataFrame(digits, "symbol string, __chunk long, e array<double>"), join, fan).collect()}
    for s, n in (("a", 23), ("b", 1)):
        held = None
        for c in range(5, 5 + n):
            assert (got[s, c] is None) == (held is None) and (held is None or got[s, c] == pytest.approx(held))
            e = np.array([[float(c % 7), 1.0]])
            held = (e if held is None else join(np.array([held]), e))[0].tolist()


@pytest.mark.parametrize("width", [500, 8, 1])
def test_windows_with_halos(spark, width):
    """Chunks wider and much shorter than the reach, with missing bins: range frames see the same rows."""
    pdf = series().drop(index=[3, 4, 50])
    columns = {"s": lambda w: F.sum("z").over(w.rangeBetween(-5, 0)), "m": lambda w: F.avg("z").over(w.rangeBetween(1, 3)), "n": lambda w: F.count("z").over(w.rangeBetween(-5, 3))}
    got = chunks.over_halo(spark.createDataFrame(pdf), columns, back=5, ahead=3, width=width).toPandas().sort_values(["symbol", "bin"])
    assert len(got) == len(pdf)
    for r in got.itertuples():
        near = pdf[(pdf.symbol == r.symbol) & (pdf.bin >= r.bin - 5) & (pdf.bin <= r.bin + 3)]
        after = near[near.bin > r.bin]["z"]
        assert r.s == pytest.approx(near[near.bin <= r.bin]["z"].sum()) and r.n == len(near)
        assert (np.isnan(r.m) and not len(after)) or r.m == pytest.approx(after.mean())


def test_rolling_operators_over_several_chunks(spark, monkeypatch):
    """Chunks of 8 times the reach: 130 bars are several; pandas' rolling forms agree."""
    monkeypatch.setattr(chunks, "CHUNK", 1)
    pdf = series().rename(columns={"z": "r"})
    df = spark.createDataFrame(pdf)
    order = lambda d: d.toPandas().sort_values(["symbol", "bin"]).reset_index(drop=True)
    by = pdf.sort_values(["symbol", "bin"]).groupby("symbol")["r"]
    flat = lambda x: x.reset_index(level=0, drop=True).to_numpy()
    assert np.allclose(order(realized.rolling_rv_rate(df.drop("q"), 60_000_000, 240_000_000))["rv_rate"], flat(by.apply(lambda x: (x * x).rolling(4, min_periods=1).sum())) / 240)
    assert np.allclose(order(realized.rolling_volatility(df, 60_000_000, 240_000_000))["rolling_vol"], flat(by.apply(lambda x: x.rolling(4, min_periods=1).std())), equal_nan=True)
    label = order(labels.forward_label(df, "r", 3))["forward_mean"]
    assert np.allclose(label, flat(by.apply(lambda x: x.shift(-1).rolling(3).mean().shift(-2))), equal_nan=True)


@pytest.mark.parametrize("width", [None, 7])
def test_autocorrelation_at_reference_range(spark, width):
    """2,880 lags of 6,000 bars in one chunk and more; 40 lags in chunks shorter than the lags; a symbol shorter than the range."""
    n, far = (6000, 2880) if width is None else (120, 40)
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=n).cumsum(), np.array([1.0, 3.0, 2.0])
    pdf = pd.DataFrame({"symbol": ["a"] * n + ["b"] * 3 + ["c"] * 2, "bin": [*range(n), *range(3), 5, 6], "v": [*x, *y, 4.0, 4.0]})
    got = realized.acf(spark.createDataFrame(pdf), "v", far, width).toPandas().sort_values(["symbol", "lag"])
    for s, v in (("a", x), ("b", y)):
        d = v - v.mean()
        want = [d[: len(d) - k] @ d[k:] / (d @ d) for k in range(min(far + 1, len(d)))]
        assert np.allclose(got[got.symbol == s]["acf"], want, atol=1e-10)
    assert got[got.symbol == "c"]["acf"].isna().all() and len(got[got.symbol == "c"]) == 2


def test_running_medians_with_uncounted_ends():
    rng = np.random.default_rng(0)
    for _ in range(200):
        past, new = rng.integers(0, 12, int(rng.integers(0, 40))).astype(float), rng.integers(-3, 15, 6).astype(float)
        past.sort()
        lo, hi = medians.wanted_ranks(len(past), len(new)) if len(past) else (0, -1)
        got = medians.running_medians(new.tolist(), past[lo : hi + 1], lo, len(past) - 1 - hi)
        assert got == [statistics.median([*past, *new[:i]]) if len(past) + i else None for i in range(len(new))]


@pytest.mark.parametrize(("rows", "ranges", "together"), [(1000, 10, 64), (16, 10, 2), (5, 3, 1), (1, 50, 4)])
def test_expanding_median_in_chunks(spark, monkeypatch, rows, ranges, together):
    monkeypatch.setattr(medians, "RANGES", ranges)
    monkeypatch.setattr(medians, "TOGETHER", together)
    rng = np.random.default_rng(7)
    pdf = series()
    pdf["v"] = np.where(rng.random(len(pdf)) < 0.5, 2.0, rng.integers(0, 9, len(pdf)) / 3)  # many ties
    pdf.loc[pdf.symbol == "b", "v"] = pdf["z"]
    got = medians.expanding_median(spark.createDataFrame(pdf[["symbol", "bin", "v"]]), "v", rows=rows).toPandas().sort_values(["symbol", "bin"])
    want = pdf.sort_values(["symbol", "bin"]).groupby("symbol")["v"].apply(lambda x: x.shift(1).expanding().median())
    assert np.allclose(got["past_median"].astype(float), want, equal_nan=True)
