"""Checks that stop a query."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from latentia.operators import filters, noise

TICKS = "symbol string, us long, seq long, price double"


def ticks(spark, prices):
    return spark.createDataFrame([("a", i * 10, i, p) for i, p in enumerate(prices)], TICKS)


def test_prices_must_be_positive(spark):
    assert noise.checked(ticks(spark, [1.0, 2.0])).count() == 2
    for bad in (0.0, -1.0, None):
        with pytest.raises(Exception, match="prices must be positive"):
            noise.checked(ticks(spark, [1.0, bad, 2.0])).collect()


def test_strict_estimates_need_a_bounce(spark):
    bouncing, rising, short = [1.0, 1.1, 1.0, 1.1, 1.0], [1.0, 1.1, 1.3, 1.6, 2.2], [1.0, 1.1]
    assert noise.roll(noise.return_pairs(ticks(spark, bouncing)), ["symbol"], strict=True).first()["status"] == "ok"
    for prices, status in ((rising, "not_positive"), ([1.0, 1.1, 1.0], "too_few")):
        pairs = noise.return_pairs(ticks(spark, prices))
        assert noise.roll(pairs, ["symbol"]).first()["status"] == status
        with pytest.raises(Exception, match="too few pairs"):
            noise.roll(pairs, ["symbol"], strict=True).collect()
    assert noise.roll(noise.return_pairs(ticks(spark, short)), ["symbol"]).count() == 0


def test_modes_batch_by_batch(spark):
    """Batches of seven rows cut symbols anywhere; a symbol without parameters has no rows, parameters without a series no harm."""
    rng = np.random.default_rng(0)
    pdf = pd.concat([pd.DataFrame({"symbol": s, "bin": np.arange(n) * 2 - 9, "z": rng.normal(size=n).cumsum()}) for s, n in (("a", 40), ("b", 1), ("c", 23), ("d", 5))])
    q, pi = [0.1, 2.0], [[0.9, 0.1], [0.2, 0.8]]
    given = spark.createDataFrame([(s, q, [0.5, r], pi) for s, r in (("a", 0.0), ("b", 1.0), ("c", 2.0), ("e", 3.0))], "symbol string, q array<double>, r array<double>, pi array<array<double>>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = filters.imm(spark.createDataFrame(pdf).repartition(3), given).toPandas().sort_values(["symbol", "bin"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.groupby("symbol").size().to_dict() == {"a": 40, "b": 1, "c": 23}
    for s, r in (("a", 0.0), ("b", 1.0), ("c", 2.0)):
        x, p, mu, _ = filters.imm_steps(pdf[pdf.symbol == s]["z"].to_numpy(), np.array(q), np.array([0.5, r]), np.array(pi))
        own = got[got.symbol == s]
        assert np.allclose(own["x_filt"], x) and np.allclose(own["p_filt"], p) and np.allclose(np.array(own["mode_probs"].tolist()), mu)
