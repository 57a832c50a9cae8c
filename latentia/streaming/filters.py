"""Structured Streaming forms of the causal operators: bars with a watermark, then a stateful Kalman filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from latentia.operators.filters import Level, Modes, imm_steps, kalman_steps


def stream_bars(ticks: DataFrame, width: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """symbol, bar_ts, price, n: the last price of each window once the watermark has passed it.

    ticks: symbol, ts (TIMESTAMP), seq, price.  Ticks later than the watermark are dropped.
    """
    kept = ticks.withWatermark("ts", late)
    bars = kept.groupBy("symbol", F.window("ts", width)).agg(F.max_by("price", F.struct("ts", "seq")).alias("price"), F.count(F.lit(1)).alias("n"))
    return bars.select("symbol", F.col("window.start").alias("bar_ts"), "price", "n")


def stream_rolling_variance(ticks: DataFrame, span: str = "1 hour", step: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """symbol, start, end, n, mean and deviation of log prices over sliding windows."""
    kept = ticks.withWatermark("ts", late).withColumn("z", F.ln("price"))
    out = kept.groupBy("symbol", F.window("ts", span, step)).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.stddev_samp("z").alias("deviation"))
    return out.select("symbol", "window.start", "window.end", "n", "mean", "deviation")


def stream_kalman(series: DataFrame, q: float, r: float) -> DataFrame:
    """symbol, at, x_filt, p_filt, gate_stat; series: symbol, at (long), z.  The level and its variance are the state."""

    def run(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values("at")
        before = Level(*state.get) if state.exists else None
        out, after = kalman_steps(rows["z"].to_numpy(float), np.full(len(rows), q), r, before)
        state.update(tuple(after))
        yield pd.DataFrame({"symbol": key[0], "at": rows["at"].to_numpy(), "x_filt": out[:, 0], "p_filt": out[:, 1], "gate_stat": out[:, 2] ** 2 / out[:, 3]})

    return series.select("symbol", "at", "z").groupBy("symbol").applyInPandasWithState(run, "symbol string, at long, x_filt double, p_filt double, gate_stat double", "x double, p double", "append", GroupStateTimeout.NoTimeout)


def stream_imm(series: DataFrame, q: list[float], r: list[float], pi: list[list[float]]) -> DataFrame:
    """symbol, at, x_filt, p_filt, mode_probs, n_late; series: symbol, at (long), z.

    Each mode's level and variance, the mode probabilities, the last time and the number of late rows are the state.  Within a batch rows are put in
    order; a row that is not after the last one filtered is late: it is left out and counted, so the result is the batch
    filter over the rows that were in time.
    """
    given = np.array(q, float), np.array(r, float), np.array(pi, float)

    def run(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values("at", kind="stable")
        x, p, mu, last, late = state.get if state.exists else ([], [], [], None, 0)
        fresh = rows.drop_duplicates("at") if last is None else rows[rows["at"] > last].drop_duplicates("at")
        late += len(rows) - len(fresh)
        if not len(fresh):
            state.update((x, p, mu, last, late))
            return
        before = Modes(*(np.array(a, float) for a in (x, p, mu))) if last is not None else None
        xs, ps, mus, after = imm_steps(fresh["z"].to_numpy(float), *given, before)
        state.update((after.x.tolist(), after.p.tolist(), after.mu.tolist(), int(fresh["at"].iloc[-1]), late))
        yield pd.DataFrame({"symbol": key[0], "at": fresh["at"].to_numpy(), "x_filt": xs, "p_filt": ps, "mode_probs": list(mus), "n_late": late})

    out, kept = "symbol string, at long, x_filt double, p_filt double, mode_probs array<double>, n_late long", "x array<double>, p array<double>, mu array<double>, last long, late long"
    return series.select("symbol", "at", "z").groupBy("symbol").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)
