"""Labels and datasets: forward labels, causal features, circular nulls, unions of windows, data checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from latentia.functions.expr import DAY
from latentia.operators.chunks import CHUNK, chunk_of, over_halo
from latentia.operators.order import positions, with_neighbour


def forward_label(series: DataFrame, value: str, h: int) -> DataFrame:
    """real_label: whether the mean of the next h values exceeds 0.5; null unless all h exist."""

    def mean(w: WindowSpec) -> Column:
        ahead = w.rangeBetween(1, h)
        return F.when(F.count(value).over(ahead) == h, F.avg(value).over(ahead))

    label = F.when(F.col("forward_mean").isNotNull(), (F.col("forward_mean") > 0.5).cast("double"))
    return over_halo(series, {"forward_mean": mean}, ahead=h).withColumn("real_label", label)


def causal_features(series: DataFrame, value: str = "elevated_prob", vol: str = "rolling_vol") -> DataFrame:
    """The value, its predecessor, and rolling volatility: nothing from after the row."""
    before = with_neighbour(series.select("symbol", "bin", value, vol), [value], ["bin"], chunk_of("bin", CHUNK), prefix="__")
    return before.select("symbol", "bin", value, F.col(f"__{value}").alias(f"{value}_lag1"), vol)


def draw_shifts(n: int, count: int = 20, seed: int = 0, margin: int = 1440, near: int = 30, periods: tuple[int, ...] = (480, 1440), tries: int = 400) -> list[int]:
    """Shifts from [margin, n - margin) that stay ``near`` rows away from multiples of the periods; they may repeat."""
    if n <= 2 * margin:
        return []
    rng, out = np.random.default_rng(seed), []
    for _ in range(tries):
        s = int(rng.integers(margin, n - margin))
        if all(near <= s % p <= p - near for p in periods):
            out.append(s)
            if len(out) == count:
                break
    return out


def circular_nulls(labels: DataFrame, shifts: list[int], width: int) -> DataFrame:
    """symbol, bin, shift_id, null_label: the labels rolled by each shift; an equi-join on positions modulo the length."""
    at = positions(labels.where("real_label IS NOT NULL").select("symbol", "bin", "real_label"), ["bin"], F.floor(F.col("bin") / max(DAY // width, 1)), "symbol")
    n = at.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    ids = F.array(*[F.struct(F.lit(i).alias("shift_id"), F.lit(s).cast("long").alias("s")) for i, s in enumerate(shifts)])
    moved = at.join(n, "symbol").select("symbol", "real_label", F.explode(ids).alias("g"), "pos", "n").select("symbol", F.col("g.shift_id").alias("shift_id"), F.pmod(F.col("pos") + F.col("g.s"), F.col("n")).alias("pos"), F.col("real_label").alias("null_label"))
    return at.select("symbol", "bin", "pos").join(moved, ["symbol", "pos"]).select("symbol", "bin", "shift_id", "null_label")


def union_windows(frames: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Rows of several windows with their window_id."""
    parts = [df.select(F.lit(name).alias("window_id"), *columns) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how many rows are too many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("n_extra", F.col("n") - 1)


def calendar_gaps(df: DataFrame, day: str, most: int = 5) -> DataFrame:
    """Distinct days (numbers) that come more than ``most`` days after the one before."""
    days = df.select("symbol", F.col(day).alias("day")).distinct()
    step = F.col("day") - F.lag("day").over(Window.partitionBy("symbol").orderBy("day"))
    return days.withColumn("gap_days", step).where(F.col("gap_days") > most)
