"""Networks against plain restatements at one seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latentia.operators import metrics, models
from latentia.operators.models import MiniBatch, Net, glorot, held_back, mixed
from latentia.plans import catalogue
from tests.conftest import SMALL

N = 360


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, 2)) * [1, 4] + [0, 7]
    y = (rng.random(N) < 1 / (1 + np.exp(-3 * np.abs(x[:, 0]) + 2))).astype(float)  # not linear
    pdf = pd.DataFrame({"pos": np.arange(N), "day": np.arange(N) // 60, "a": x[:, 0], "b": x[:, 1], "y": y})
    rows = models.prepared(spark.createDataFrame(pdf), ["a", "b"], ["y"], 10, F.floor(F.col("pos") / 100))
    return x, y, rows.persist()


def sigmoid(o: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-o))


def plain_gradient(w1, b1, w2, b2, z, y, alpha):
    """Mean log-loss plus alpha / 2 of the squared weights over the rows, by hand."""
    a = np.maximum(z @ w1 + b1, 0)
    d = (sigmoid(a @ w2 + b2) - y) / len(y)
    back = np.outer(d, w2) * (a > 0)
    return z.T @ back + alpha * w1 / len(y), back.sum(0), a.T @ d + alpha * w2 / len(y), d.sum()


def plain_minibatch(x, y, train, hidden, o):
    """Probabilities for all rows of one network trained on ``train``, and the epochs that it took."""
    mean, scale = x[train].mean(0), x[train].std(0)
    z, pos = (x - mean) / scale, np.arange(len(x))
    back = held_back(pos, o)
    fit, test = np.flatnonzero(train & ~back), np.flatnonzero(train & back)
    v = glorot(Net(2, hidden), o.seed)
    parts = [v[: 2 * hidden].reshape(2, hidden), v[2 * hidden : 3 * hidden], v[3 * hidden : 4 * hidden], v[-1]]
    m1, m2, t, best, kept, waited = [0.0] * 4, [0.0] * 4, 0, -np.inf, parts, 0
    for epoch in range(1, o.epochs + 1):
        order = fit[np.argsort(mixed(pos[fit], o.seed + epoch), kind="stable")]
        parts = [np.copy(p) for p in parts]
        for i in range(0, len(order), o.batch):
            use = order[i : i + o.batch]
            t += 1
            for k, g in enumerate(plain_gradient(*parts, z[use], y[use], o.alpha)):
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                step = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                m = m1[k] / (np.sqrt(m2[k]) + 1e-8)
                parts[k] = parts[k] - o.rate * step * m
        w1, b1, w2, b2 = parts
        score = ((np.maximum(z[test] @ w1 + b1, 0) @ w2 + b2 > 0) == (y[test] > 0.5)).mean()
        waited = waited + 1 if score < best + o.tol else 0
        if score > best:
            best, kept = score, parts
        if waited > o.patience:
            break
    w1, b1, w2, b2 = kept
    return sigmoid(np.maximum(z @ w1 + b1, 0) @ w2 + b2), epoch


def test_one_shard_is_plain_minibatch_training(data):
    x, y, rows = data
    folds, o = models.k_folds(N, 3), MiniBatch(batch=32, rate=0.02, patience=3, epochs=12, alpha=0.3)
    got = models.minibatch_oof(rows.repartition(5), folds, 2, [4, 7], o)
    epochs = set()
    for hidden in (4, 7):
        oof = got[hidden].toPandas().sort_values("pos")
        for f in range(3):
            train = ~((np.arange(N) >= folds.lo[f]) & (np.arange(N) <= folds.hi[f]))
            want, n = plain_minibatch(x, y, train, hidden, o)
            epochs.add(n)
            assert np.allclose(oof[oof.fold == f]["y_pred"], want[~train], atol=1e-9)
    assert len(epochs) > 1  # some stopped early


def test_shards_do_not_depend_on_partitions_and_learn(data):
    _, y, rows = data
    folds, o = models.k_folds(N, 2), MiniBatch(batch=16, rate=0.02, epochs=25, shard=120)
    runs = [models.minibatch_oof(rows.repartition(n), folds, 2, [8], o)[8].toPandas().sort_values("pos")["y_pred"] for n in (1, 6)]
    assert np.allclose(*runs, atol=1e-9)
    linear = metrics.auc(models.logistic_oof(rows, folds, 1, 2)).first()["auc"]
    learned = metrics.auc(models.minibatch_oof(rows, folds, 2, [8], o)[8]).first()["auc"]
    assert learned > linear + 0.1


def test_widths_trained_together_are_those_trained_alone(data):
    _, _, rows = data
    folds = models.k_folds(N, 2)
    both = models.mlp_oof(rows, folds, 2, [3, 5], epochs=6, rate=0.05)
    for h in (3, 5):
        alone = models.mlp_oof(rows, folds, 2, [h], epochs=6, rate=0.05)[h]
        assert np.allclose(*[d.toPandas().sort_values("pos")["y_pred"] for d in (both[h], alone)], atol=1e-12)


def test_comparison_names_folds_and_differences(spark, monkeypatch):
    monkeypatch.setattr(models, "minibatch_oof", lambda rows, folds, width, hiddens, f=models.minibatch_oof: f(rows, folds, width, hiddens, MiniBatch(epochs=2)))
    monkeypatch.setattr(models, "mlp_oof", lambda rows, folds, width, hiddens, f=models.mlp_oof: f(rows, folds, width, hiddens, epochs=2))
    got = catalogue.mlp_compare(spark, SMALL).toPandas().set_index("model")
    assert set(got.index) == {"lr", *[f"{k}_{h}" for k in ("mlp", "net") for h in (16, 32, 64)]}
    assert got.loc["lr", "auc_diff"] == 0 and (got["seconds"] > 0).all() and got["n_folds"].nunique() == 1 and got["n"].nunique() == 1
    assert np.allclose(got["auc"] - got.loc["lr", "auc"], got["auc_diff"])
