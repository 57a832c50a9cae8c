"""Bars from ticks: last price, gap filling, offsets, staleness, arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.functions.expr import DAY, SECOND, bin_of, day_of
from latentia.operators.order import quantiles, with_neighbour
from latentia.session import stored


def last_bars(ticks: DataFrame, width: int, offset: int = 0) -> DataFrame:
    """symbol, bin, price, n: the last price of each bin that has ticks, ties by sequence."""
    at = bin_of(F.col("us"), width, offset)
    return ticks.groupBy("symbol", at.alias("bin")).agg(F.max_by("price", F.struct("us", "seq")).alias("price"), F.count(F.lit(1)).alias("n"))


def day_chunk(width: int) -> Column:
    """About a day of bins."""
    return F.floor(F.col("bin") / max(DAY // width, 1))


def gap_filled(bars: DataFrame, width: int) -> DataFrame:
    """Every bin between a symbol's first and last, the price carried forward.

    Each bar is repeated up to the next one, so neither a grid nor a join is needed.
    """
    ahead = with_neighbour(bars.select("symbol", "bin", "price"), ["bin"], ["bin"], day_chunk(width), ahead=True, prefix="next_")
    until = F.coalesce(F.col("next_bin") - 1, F.col("bin"))
    return ahead.select("symbol", F.explode(F.sequence("bin", until)).alias("bin"), "price")


def log_returns(bars: DataFrame, width: int) -> DataFrame:
    """symbol, bin, price, r: log return from the bin before; null in a symbol's first."""
    prev = with_neighbour(bars, ["price"], ["bin"], day_chunk(width))
    return prev.select("symbol", "bin", "price", (F.ln("price") - F.ln("prev_price")).alias("r"))


def bar_returns(ticks: DataFrame, width: int) -> DataFrame:
    """Returns of gap-filled bars.  Bars are stored: each neighbour's lookup uses its rows twice, which would read the ticks once for each use."""
    return log_returns(gap_filled(stored(last_bars(ticks, width)), width), width)


def stale_fraction(ticks: DataFrame, width: int) -> DataFrame:
    """Share of non-empty bins whose price did not move; null under two bins.  Empty bins don't count."""
    prev = with_neighbour(last_bars(ticks, width), ["price"], ["bin"], day_chunk(width))
    same = F.when(F.col("prev_price").isNotNull(), (F.col("price") == F.col("prev_price")).cast("int"))
    return prev.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bins"), F.avg(same).alias("stale"))


def gaps(ticks: DataFrame) -> DataFrame:
    prev = with_neighbour(ticks, ["us"], ["us", "seq"], day_of(F.col("us")))
    return prev.withColumn("gap", (F.col("us") - F.col("prev_us")) / SECOND)


def arrival_stats(ticks: DataFrame, sparse: float = 0.1) -> DataFrame:
    """Median and mean gap in seconds, share of gaps over a second, and whether that share is a warning."""
    long = F.avg((F.col("gap") > 1).cast("int"))
    g = gaps(ticks).select("symbol", "gap")
    middle = quantiles(g, "gap", [0.5], ["symbol"]).select("symbol", F.col("q").alias("median_gap"))
    means = g.groupBy("symbol").agg(F.avg("gap").alias("mean_gap"), long.alias("share_over_1s"), (long > sparse).alias("sparse"))
    return means.join(middle, "symbol", "left").select("symbol", "median_gap", "mean_gap", "share_over_1s", "sparse")


def same_time_share(ticks: DataFrame) -> DataFrame:
    """Share of all ticks at the time of the tick before; the first counts as no."""
    return gaps(ticks).groupBy("symbol").agg(F.avg(F.coalesce((F.col("gap") == 0).cast("int"), F.lit(0))).alias("same_ts_share"))
