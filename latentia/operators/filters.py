"""Sequential filters: local-level Kalman and interacting multiple models.

The Kalman filter is a scan over chunks of a series; the interacting filter takes a series through one task, batch by batch.
``kalman_steps`` and ``imm_steps`` take and give back their
state, which is what the streaming form keeps between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.operators.chunks import CHUNK, chunked, prefixes, product
from latentia.session import stored


class Level(NamedTuple):
    x: float
    p: float


def kalman_steps(z: np.ndarray, q: np.ndarray, r: float, state: Level | None = None) -> tuple[np.ndarray, Level]:
    """Rows (x, P, innovation, its variance) after each update; the first value starts the state and is updated too."""
    x, p = state or Level(float(z[0]), r)
    out = np.empty((len(z), 4))
    for t, (zt, qt) in enumerate(zip(z.tolist(), q.tolist(), strict=True)):
        p = p + qt
        y = zt - x
        s = p + r
        k = p / s
        x, p = x + k * y, (1 - k) * p
        out[t] = x, p, y, s
    return out, Level(x, p)


def kalman_elements(z: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """One row (a, b, c, h, j) for each step: what it makes of any state before it.

    From a level with mean m and variance p, the step leads to mean a (m + p h) / (1 + p j) + b and variance
    a^2 p / (1 + p j) + c.  q + r must be positive.
    """
    s = q + r
    k = q / s
    return np.column_stack([1 - k, k * z, k * r, z / s, 1 / s])


def kalman_product(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rows of elements: the first step, then the second, as one.  Associative, and all terms are sums of like signs in p."""
    a, b, c, h, j = first.T
    a2, b2, c2, h2, j2 = second.T
    d = 1 + c * j2
    return np.column_stack([a2 * a / d, a2 * (b + c * h2) / d + b2, a2 * a2 * c / d + c2, a * (h2 - j2 * b) / d + h, a * a * j2 / d + j])


def kalman(series: DataFrame, value: str = "z", noise: str = "q", r: str = "r_noise", order: str = "bin", width: int = CHUNK) -> DataFrame:
    """symbol, order, x_filt, p_filt, innovation, innovation_var, gate_stat; r is one value per symbol.

    An associative scan: every chunk of ``width`` bins becomes one element, a scan over chunks gives each the state that it
    starts from, then each is filtered by itself.  No task holds a symbol's rows.
    """
    rows = chunked(series.select("symbol", F.col(order).alias("at"), F.col(value).alias("z"), F.col(noise).alias("q"), F.col(r).alias("r")), "at", width)

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        z, q, r = (part[c].to_numpy(float) for c in "zqr")
        e = product(kalman_elements(z, q, r), kalman_product)
        first = kalman_product(np.array([[0.0, z[0], r[0], 0.0, 0.0]]), e[None])[0]  # as a symbol's first chunk: a level at z with variance r
        return pd.DataFrame({"symbol": part["symbol"].iloc[:1], "__chunk": part["__chunk"].iloc[:1], "e": [e.tolist()], "first": [first.tolist()]})

    found = stored(rows.groupBy("symbol", "__chunk").applyInPandas(summary, "symbol string, __chunk long, e array<double>, first array<double>"))
    least = found.groupBy("symbol").agg(F.min("__chunk").alias("__least"))
    started = found.join(least, "symbol").select("symbol", "__chunk", F.when(F.col("__chunk") == F.col("__least"), F.col("first")).otherwise(F.col("e")).alias("e"))
    starts = prefixes(stored(started), kalman_product)

    def run(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        before = start["before"].iloc[0]
        state = None if before is None else Level(float(before[1]), float(before[2]))
        out, _ = kalman_steps(part["z"].to_numpy(float), part["q"].to_numpy(float), float(part["r"].iloc[0]), state)
        return pd.DataFrame({"symbol": part["symbol"], order: part["at"], "x_filt": out[:, 0], "p_filt": out[:, 1], "innovation": out[:, 2], "innovation_var": out[:, 3], "gate_stat": out[:, 2] ** 2 / out[:, 3]})

    schema = f"symbol string, {order} long, x_filt double, p_filt double, innovation double, innovation_var double, gate_stat double"
    return rows.groupBy("symbol", "__chunk").cogroup(starts.groupBy("symbol", "__chunk")).applyInPandas(run, schema)


class Modes(NamedTuple):
    x: np.ndarray
    p: np.ndarray
    mu: np.ndarray


def first_modes(z0: float, r: np.ndarray) -> Modes:
    """Equal mode probabilities; the variance is the mean of the positive R, or 1e-8."""
    positive = r[r > 0]
    return Modes(np.full(len(r), z0), np.full(len(r), positive.mean() if len(positive) else 1e-8), np.full(len(r), 1 / len(r)))


def imm_steps(z: np.ndarray, q: np.ndarray, r: np.ndarray, pi: np.ndarray, state: Modes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Modes]:
    """x, P and mode probabilities after each step, and the state at the end."""
    x, p, mu = state or first_modes(float(z[0]), r)
    xs, ps, mus = np.empty(len(z)), np.empty(len(z)), np.empty((len(z), len(r)))
    for t, zt in enumerate(z.tolist()):
        c = np.maximum(pi.T @ mu, 1e-300)
        w = pi * mu[:, None] / c
        x0 = w.T @ x
        p0 = (w * (p[:, None] + (x[:, None] - x0) ** 2)).sum(0)
        p1 = p0 + q
        y, s = zt - x0, p1 + r
        k = p1 / s
        x, p = x0 + k * y, (1 - k) * p1
        mass = c * np.exp(-y * y / (2 * s)) / np.sqrt(2 * np.pi * s)
        total = mass.sum()
        mu = mass / total if np.isfinite(total) and total > 0 else c
        xs[t] = mu @ x
        ps[t] = mu @ (p + (x - xs[t]) ** 2)
        mus[t] = mu
    return xs, ps, mus, Modes(x, p, mu)


def imm(series: DataFrame, parameters: DataFrame, value: str = "z", order: str = "bin") -> DataFrame:
    """symbol, order, x_filt, p_filt, mode_probs; parameters: symbol, q and r (array<double>), pi (array<array<double>>).

    The recursion is not associative, so a symbol's bars pass through one task, in order and batch by batch: it holds a
    batch and the state of the modes, however long the series is.  A symbol's parameters come once, as a row before its first bar.
    Symbols without parameters have no result; symbols are not null.
    """
    out = pa.schema([("symbol", pa.string()), (order, pa.int64()), ("x_filt", pa.float64()), ("p_filt", pa.float64()), ("mode_probs", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, given, state = None, None, None
        for batch in batches:
            names, first = batch.column("symbol").to_pylist(), batch.column("first").to_pylist()
            at, z = batch.column("at").to_numpy(zero_copy_only=False), batch.column("z").to_numpy(zero_copy_only=False)
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1] or first[i] != first[i - 1]]
            for i, end in zip(cuts, [*cuts[1:], len(names)], strict=True):
                if names[i] != symbol:
                    symbol, given, state = names[i], None, None
                if first[i] == 0:
                    given = [np.array(batch.column(c)[i].as_py(), float) for c in ("q", "r", "pi")]
                elif given is not None:
                    x, p, mu, state = imm_steps(z[i:end], *given, state)
                    yield pa.RecordBatch.from_arrays([pa.array([symbol] * (end - i)), pa.array(at[i:end].astype(np.int64)), pa.array(x), pa.array(p), pa.array(list(mu), pa.list_(pa.float64()))], schema=out)

    none = [F.lit(None).cast("array<double>").alias(c) for c in ("q", "r")]
    rows = series.select("symbol", F.lit(1).alias("first"), F.col(order).alias("at"), F.col(value).cast("double").alias("z"), *none, F.lit(None).cast("array<array<double>>").alias("pi"))
    heads = parameters.select("symbol", F.lit(0).alias("first"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("z"), "q", "r", "pi")
    dealt = rows.unionByName(heads).repartition("symbol").sortWithinPartitions("symbol", "first", "at")
    return dealt.mapInArrow(run, f"symbol string, {order} long, x_filt double, p_filt double, mode_probs array<double>")


def elevated(probabilities: Column, states: Column) -> Column:
    """Sum of the mode probabilities over a set of states (array of 0-based numbers)."""
    return F.aggregate(states, F.lit(0.0), lambda s, i: s + F.get(probabilities, i.cast("int")))
