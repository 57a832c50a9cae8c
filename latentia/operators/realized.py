"""Realized variance, jumps, calm windows, autocorrelation."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentia.functions.expr import DAY, MU1, day_of
from latentia.operators.bars import bar_returns
from latentia.operators.chunks import CHUNK, chunk_of, halo, over_halo
from latentia.operators.order import positions


def daily_metrics(ticks: DataFrame, width: int) -> DataFrame:
    """symbol, day, rv (a day's first return belongs to it), intraday range of ticks."""
    r = bar_returns(ticks, width)
    per_day = r.groupBy("symbol", F.floor(F.col("bin") / (DAY // width)).cast("long").alias("day")).agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("rv"))
    extent = ticks.groupBy("symbol", day_of(F.col("us")).alias("day")).agg(F.ln(F.max("price") / F.min("price")).alias("intraday_range"))
    return per_day.join(extent, ["symbol", "day"], "left")


def signature(ticks: DataFrame, widths: list[int], offsets: int = 10) -> DataFrame:
    """symbol, width, rv_mean, rv_std (n), stale over phase-shifted bars of several widths.

    Ticks are repeated once per (width, offset) and aggregated at once, before any window.
    """
    grid = F.array(*[F.struct(F.lit(w).cast("long").alias("width"), F.lit(i * w // offsets).cast("long").alias("offset")) for w in widths for i in range(offsets)])
    at = ticks.withColumn("g", F.explode(grid)).select("*", "g.width", "g.offset")
    bars = at.groupBy("symbol", "width", "offset", F.floor((F.col("us") - F.col("offset")) / F.col("width")).cast("long").alias("bin")).agg(F.max_by("price", F.struct("us", "seq")).alias("price"))
    prev = F.lag("price").over(Window.partitionBy("symbol", "width", "offset").orderBy("bin"))
    r = bars.withColumn("r", F.ln("price") - F.ln(prev)).withColumn("same", F.when(prev.isNotNull(), (F.col("price") == prev).cast("int")))
    one = r.groupBy("symbol", "width", "offset").agg(F.sum(F.col("r") * F.col("r")).alias("rv"), F.avg("same").alias("stale"))
    return one.groupBy("symbol", "width").agg(F.avg("rv").alias("rv_mean"), F.stddev_pop("rv").alias("rv_std"), F.avg("stale").alias("stale"))


def rolling_rv_rate(returns: DataFrame, width: int, span: int) -> DataFrame:
    """Sum of squared returns over (t - span, t] per second, and q = rate * bar width.  Defined from the first return on."""
    back = span // width - 1
    rate = lambda w: F.sum(F.col("r") * F.col("r")).over(w.rangeBetween(-back, 0)) / (span / 1e6)
    return over_halo(returns.where("r IS NOT NULL"), {"rv_rate": rate}, back).withColumn("q", F.col("rv_rate") * (width / 1e6))


def rolling_volatility(returns: DataFrame, width: int, span: int) -> DataFrame:
    """Sample deviation of returns over (t - span, t]; null with fewer than two."""
    back = span // width - 1
    return over_halo(returns.where("r IS NOT NULL"), {"rolling_vol": lambda w: F.stddev_samp("r").over(w.rangeBetween(-back, 0))}, back)


def standardized(returns: DataFrame) -> DataFrame:
    """Returns over their population deviation, not centred."""
    scale = returns.groupBy("symbol").agg(F.stddev_pop("r").alias("scale"))
    return returns.join(scale, "symbol").withColumn("z", F.col("r") / F.col("scale"))


def bipower_daily(returns: DataFrame, width: int, least: int = 10, literature_constant: bool = False) -> DataFrame:
    """Per symbol and day: n, rv, bv, jump part, ratio z statistic.

    The quarticity uses MU1 ** -3; ``literature_constant`` takes E|Z|^(4/3) ** -3 instead.
    """
    r = returns.where("r IS NOT NULL").withColumn("day", F.floor(F.col("bin") / (DAY // width)).cast("long"))
    w = Window.partitionBy("symbol", "day").orderBy("bin")
    a = F.abs("r")
    r = r.withColumn("two", a * F.lag(a, 1).over(w)).withColumn("three", F.pow(a * F.lag(a, 1).over(w) * F.lag(a, 2).over(w), F.lit(4 / 3)))
    constant = (2 ** (2 / 3) * math.gamma(7 / 6) / math.gamma(1 / 2)) ** -3 if literature_constant else MU1**-3
    d = r.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("r")).alias("rv"), (F.sum("two") * (math.pi / 2)).alias("bv"), F.sum("three").alias("three")).where(F.col("n") >= least)
    d = d.withColumn("jump", F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)))
    tq = F.col("n") * constant * F.col("three")
    theta = (math.pi / 2) ** 2 + math.pi - 5
    below = F.sqrt(F.lit(theta) * F.greatest(F.lit(1.0), tq / (F.col("bv") * F.col("bv"))) / F.col("n"))
    z = F.when((F.col("bv") > 0) & (tq > 0) & (F.col("rv") > 0), (F.col("rv") - F.col("bv")) / F.col("rv") / below)
    return d.withColumn("z_stat", z).withColumn("jump_share", F.when(F.col("rv") > 0, F.col("jump") / F.col("rv"))).drop("three")


def window_summary(daily: DataFrame, k: int = 7) -> DataFrame:
    """Each complete run of k days: totals, largest day and its share, largest range; by total, least first."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(0, k - 1)
    out = daily.select("symbol", F.col("day").alias("start_day"), F.max("day").over(w).alias("end_day"), F.count(F.lit(1)).over(w).alias("n"), F.sum("rv").over(w).alias("total_rv"), F.max("rv").over(w).alias("max_daily_rv"), F.max("intraday_range").over(w).alias("max_range"))
    return out.where(F.col("n") == k).drop("n").withColumn("largest_share", F.col("max_daily_rv") / F.col("total_rv"))


def calm_days(daily: DataFrame, most: float = 3.5) -> DataFrame:
    """Days whose modified z score 0.6745 (x - median) / MAD is within ``most``; all of them where MAD is 0."""
    middle = daily.groupBy("symbol").agg(F.percentile("rv", F.lit(0.5)).alias("med"))
    far = daily.join(middle, "symbol")
    mad = far.groupBy("symbol").agg(F.percentile(F.abs(F.col("rv") - F.col("med")), F.lit(0.5)).alias("mad"))
    return far.join(mad, "symbol").where((F.col("mad") == 0) | (F.abs(0.6745 * (F.col("rv") - F.col("med")) / F.col("mad")) <= most)).drop("med", "mad")


def bootstrap_shares(spark: SparkSession, pool: list[float], k: int = 7, draws: int = 5000, seed: int = 0) -> DataFrame:
    """draw, share: largest value over the sum of k values drawn without replacement, draws spread over tasks.

    The pool is a list of days (bounded by the calendar, not by ticks).
    """
    if len(pool) < k:
        raise ValueError(f"the pool has {len(pool)} days, fewer than {k}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.array(pool)
        for part in batches:
            take = [x[np.random.default_rng([seed, i]).choice(len(x), k, replace=False)] for i in part["id"]]
            yield pd.DataFrame({"draw": part["id"], "share": [v.max() / v.sum() for v in take]})

    return spark.range(draws).mapInPandas(run, "draw long, share double")


def bootstrap_by_symbol(days: DataFrame, column: str = "rv", k: int = 7, draws: int = 5000, seed: int = 0) -> DataFrame:
    """symbol, draw, share: bootstrap_shares of every symbol's days; a null share where a symbol has fewer than k days.

    A symbol's days are one array (bounded by the calendar, not by ticks).
    """
    pools = days.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", F.col(column).alias("x")))), lambda d: d["x"]).alias("pool"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            shares = []
            for i, symbol, x in zip(part["id"], part["symbol"], part["pool"], strict=True):
                v = np.random.default_rng([seed, i, zlib.crc32((symbol or "").encode())]).choice(np.asarray(x, float), k, replace=False) if len(x) >= k else None
                shares.append(None if v is None else v.max() / v.sum())
            yield pd.DataFrame({"symbol": part["symbol"], "draw": part["id"], "share": pd.array(shares, "Float64")})

    return days.sparkSession.range(draws).crossJoin(F.broadcast(pools)).mapInPandas(run, "symbol string, draw long, share double")


def calm_windows(daily: DataFrame, k: int = 7, percentile: float = 90.0, draws: int = 5000, seed: int = 0) -> DataFrame:
    """Windows of k days with cutoff, passes_null and selected: the calmest window that passes is the symbol's selected one.

    The cutoff is a percentile of the largest day's share in random groups of k calm days; a window passes whose own share is
    not above it.  Symbols with fewer than k calm days have no cutoff, so none passes.
    """
    null = bootstrap_by_symbol(calm_days(daily), k=k, draws=draws, seed=seed)
    cutoff = null.groupBy("symbol").agg(F.percentile("share", F.lit(percentile / 100)).alias("cutoff"))
    out = window_summary(daily, k).join(cutoff, "symbol", "left").withColumn("passes_null", F.coalesce(F.col("largest_share") <= F.col("cutoff"), F.lit(False)))
    first = out.where("passes_null").groupBy("symbol").agg(F.min_by("start_day", F.struct("total_rv", "start_day")).alias("__first"))
    return out.join(first, "symbol", "left").withColumn("selected", F.coalesce(F.col("start_day") == F.col("__first"), F.lit(False))).drop("__first")


def days_of_selected(windows: DataFrame, daily: DataFrame) -> DataFrame:
    """symbol, day, rv, rv_share of the days in each symbol's selected window."""
    w = windows.where("selected").select("symbol", F.explode(F.sequence("start_day", "end_day")).alias("day"), "total_rv")
    return daily.join(w, ["symbol", "day"]).select("symbol", "day", "rv", (F.col("rv") / F.col("total_rv")).alias("rv_share"))


def centred(values: DataFrame, column: str) -> DataFrame:
    """symbol, pos (row number by bin), x: the column less its symbol's mean."""
    mean = values.groupBy("symbol").agg(F.avg(column).alias("mean"))
    x = values.join(mean, "symbol").select("symbol", "bin", (F.col(column) - F.col("mean")).alias("x"))
    return positions(x, ["bin"], chunk_of("bin", CHUNK), "symbol").select("symbol", "pos", "x")


def acf_at(values: DataFrame, column: str, lags: list[int]) -> DataFrame:
    """symbol, lag, acf at a few lags (rows), centred by the whole mean."""
    far = max(lags)
    products = {f"p{k}": lambda w, k=k: F.col("x") * F.lead("x", k).over(w) for k in lags}
    found = over_halo(centred(values, column), products, ahead=far, order="pos")
    sums = found.groupBy("symbol").agg(F.sum(F.col("x") * F.col("x")).alias("ss"), *[F.sum(f"p{k}").alias(f"p{k}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"p{k}") / F.col("ss")).alias("acf")) for k in lags])
    return sums.select("symbol", F.explode(pairs).alias("a")).select("symbol", "a.lag", "a.acf")


def lagged_sums(x: np.ndarray, longer: np.ndarray, max_lag: int) -> np.ndarray:
    """Sums over i of x[i] * longer[i + k] for k = 0..max_lag, as far as there are pairs; longer begins with x and is taken as 0 beyond its end."""
    size = 1 << int(len(x) + len(longer)).bit_length()
    c = np.fft.irfft(np.fft.rfft(longer, size) * np.conj(np.fft.rfft(x, size)), size)
    return c[: min(max_lag + 1, len(longer))]


def acf(values: DataFrame, column: str, max_lag: int, width: int | None = None) -> DataFrame:
    """symbol, lag, acf for all lags 0..max_lag (rows; as many as the symbol has), centred by the whole mean.

    Overlap-add: each chunk multiplies its own rows with themselves and the max_lag rows after them by FFT, and the chunks'
    sums are added up by lag.  No task holds more than a chunk and its halo.
    """
    width = width or max(4 * max_lag, 4096)
    rows = halo(centred(values, column), "pos", width, ahead=max_lag)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        own = part["__own"].to_numpy(bool)
        x = part["x"].to_numpy(float)
        sums = lagged_sums(x[own], x, max_lag) if own.any() else np.empty(0)
        return pd.DataFrame({"symbol": part["symbol"].iloc[0], "lag": np.arange(len(sums), dtype=np.int32), "s": sums})

    parts = rows.groupBy("symbol", "__chunk").applyInPandas(run, "symbol string, lag int, s double")
    sums = parts.groupBy("symbol", "lag").agg(F.sum("s").alias("s"))
    whole = sums.where("lag = 0").select("symbol", F.col("s").alias("ss"))
    return sums.join(whole, "symbol").select("symbol", "lag", F.when(F.col("ss") > 0, F.col("s") / F.col("ss")).alias("acf"))


def flagged(x: Column, limit: float) -> Column:
    """Strictly above the limit."""
    return x > F.lit(limit)


