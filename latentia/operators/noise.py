"""Microstructure noise: Roll's estimator and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.functions.expr import bin_of, day_of, not_negative, require
from latentia.operators.order import with_neighbour


def return_pairs(ticks: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Ticks with r, the return before it (prev_r), and times (and other columns) one and two ticks back."""
    order, chunk = ["us", "seq"], day_of(F.col("us"))
    one = with_neighbour(ticks, ["price", "us", *carried], order, chunk)
    one = one.withColumn("r", F.ln("price") - F.ln("prev_price")).drop("prev_price")
    return with_neighbour(one, ["r", "prev_us", *[f"prev_{c}" for c in carried]], order, chunk)


def checked(ticks: DataFrame) -> DataFrame:
    """ticks; a price that is null or not positive stops the query with an error."""
    ok = F.coalesce(F.col("price") > 0, F.lit(False))
    return ticks.withColumn("price", require(ok, "prices must be positive", F.col("price")))


def roll(pairs: DataFrame, by: list[str], where: Column | None = None, least: int = 2, strict: bool = False) -> DataFrame:
    """-cov(r_t, r_t-1) with n - 1, each side centred by itself; r_noise is null under ``least`` pairs.

    status: too_few, not_positive (the covariance is not negative) or ok; with ``strict`` any but ok stops the query with an error.
    """
    used = pairs.where(F.col("r").isNotNull() & F.col("prev_r").isNotNull())
    used = used.where(where) if where is not None else used
    cov = -F.covar_samp("r", "prev_r")
    out = used.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), cov.alias("cov"))
    value = F.when(F.col("n_pairs") >= least, F.col("cov"))
    status = F.when(F.col("n_pairs") < least, "too_few").when(F.col("cov") <= 0, "not_positive").otherwise("ok")
    value = require(status == "ok", "too few pairs, or a covariance that is not negative", value) if strict else value
    return out.select(*by, "n_pairs", value.alias("r_noise"), status.alias("status"))


def distinct_times() -> Column:
    """Pairs whose two returns each join different times; applied after the returns exist, so nothing is re-joined."""
    return (F.col("us") != F.col("prev_us")) & (F.col("prev_us") != F.col("prev_prev_us"))


def one_state() -> Column:
    return (F.col("state") == F.col("prev_state")) & (F.col("state") == F.col("prev_prev_state"))


def tick_states(ticks: DataFrame, states: DataFrame, width: int) -> DataFrame:
    """Ticks with the state of their bar, -1 outside; states: symbol, bin, state.  An equi-join on the bar number."""
    at = ticks.withColumn("bin", bin_of(F.col("us"), width))
    return at.join(states, ["symbol", "bin"], "left").withColumn("state", F.coalesce("state", F.lit(-1)))


def roll_by_state(ticks: DataFrame, states: DataFrame, width: int, least: int = 100) -> DataFrame:
    """Roll's estimator per state from ticks whose two predecessors share it; all states in one pass."""
    pairs = return_pairs(tick_states(ticks, states, width).drop("bin"), ("state",))
    return roll(pairs, ["symbol", "state"], one_state() & (F.col("state") >= 0), least)


def process_noise(variance: Column, r: Column, floor: float = 1e-15) -> Column:
    """Q = max(var - 2 R, floor), with R clipped at 0."""
    return F.greatest(variance - 2 * not_negative(r), F.lit(floor))


def implied_spread(r: Column) -> Column:
    """2 sqrt(R) in basis points; null unless R is positive."""
    return F.when(r > 0, 2 * F.sqrt(r) * 1e4)
