"""Calibration in steps of days against fits from scratch, and the stored chain of forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from latentia.operators import calibrate
from latentia.plans import catalogue, forecasts
from tests.conftest import SMALL


def plain_isotonic(x: np.ndarray, y: np.ndarray) -> dict[float, float]:
    """max over starts at or before, min over ends at or after, of the mean between."""
    points = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["sum", "size"]).reset_index()
    s, w = np.concatenate([[0], points["sum"].cumsum()]), np.concatenate([[0], points["size"].cumsum()])
    mean = lambda a, b: (s[b + 1] - s[a]) / (w[b + 1] - w[a])
    n = len(points)
    return {points["x"][i]: max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)}


@pytest.mark.parametrize(("window", "chunks"), [(None, 64), (2, 3), (None, 1)])
def test_blocks_of_each_day_are_fits_from_scratch(spark, window, chunks):
    rng = np.random.default_rng(2)
    n = 240
    pdf = pd.DataFrame({"pos": np.arange(n), "ordinal": np.arange(n) // 40, "y_pred": rng.integers(0, 31, n) / 30})
    pdf["y_true"] = (rng.random(n) < pdf["y_pred"]).astype(float)
    pdf.loc[pdf.ordinal == 0, "y_true"] = 1.0
    blocks = calibrate.cumulative_blocks(spark.createDataFrame(pdf), 1, window, chunks).toPandas()
    assert set(blocks["fold"]) == {2, 3, 4, 5}  # day 1 has a past of one class
    for fold in (2, 3, 4, 5):
        past = pdf[(pdf.ordinal < fold) & (pdf.ordinal >= fold - (window or 99))]
        own = blocks[blocks.fold == fold].sort_values("lo")
        assert (np.diff(own["y"]) > 0).all() and own["w"].sum() == len(past)
        for x, want in plain_isotonic(past["y_pred"].to_numpy(), past["y_true"].to_numpy()).items():
            inside = own[(own.lo <= x) & (own.hi >= x)]
            assert len(inside) == 1 and inside["y"].iloc[0] == pytest.approx(want)


def test_recalibration_reads_the_stored_predictions(spark):
    oof = forecasts.oof_rows(spark, SMALL).toPandas().sort_values("pos")
    assert oof["pos"].tolist() == list(range(len(oof))) and oof["ordinal"].is_monotonic_increasing and oof["y_pred"].between(0, 1).all()
    got = forecasts.oof_recalibrated(spark, SMALL).toPandas().set_index("method")
    n = len(oof)
    assert got.loc["isotonic_half", "n"] == n - n // 2 and set(got.index) == {"isotonic_half", "isotonic_regime", "isotonic_expanding", "isotonic_rolling", "platt_rolling"}
    later, y = oof[oof.pos >= n // 2], "y_true"
    assert got.loc["isotonic_half", "brier_raw"] == pytest.approx(((later["y_pred"] - later[y]) ** 2).mean(), abs=1e-4)
    assert got[["log_raw", "log_calibrated", "brier_raw", "brier_calibrated"]].notna().all().all()
    assert forecasts.oof_rows(spark, SMALL) is forecasts.oof_rows(spark, SMALL)


def test_ticks_are_read_once_for_bars_and_datasets(spark):
    """Neighbours, labels, nulls and positions each use their rows again; none of that may read the ticks again."""
    for df in (catalogue.hourly(spark, SMALL), catalogue.dataset(spark, SMALL, nulls=True)):
        assert not df.inputFiles()
