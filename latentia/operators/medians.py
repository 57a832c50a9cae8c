"""Expanding medians of long series from mergeable order statistics.

The median of all values before a row moves by less than a chunk's length while the chunk is passed.  So a chunk needs
no more of the past than the values whose ranks lie within its length of the past's median.  Values are dealt into ranges; counts by
chunk and range, summed over the chunks before, tell which ranges hold those ranks and how many values lie below them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.operators.chunks import CHUNK, chunk_of
from latentia.operators.order import positions
from latentia.session import stored

#: Rows of a chunk; a task holds about three times as many values.
ROWS = 1 << 16
#: Most ranges of values of one symbol.
RANGES = 10_000
#: Chunks that meet one copy of a range's values in a task.
TOGETHER = 64


def wanted_ranks(n: int, rows: int) -> tuple[int, int]:
    """First and last rank (from 0) of n sorted values that can matter while ``rows`` more values come in."""
    return max(0, (n - 1) // 2 - rows), min(n - 1, n // 2 + rows)


def running_medians(values: list[float], past: np.ndarray, below: int, above: int) -> list[float | None]:
    """The median of everything before each value: ``below`` smaller ones, the sorted ``past``, ``above`` larger ones, and the values so far.

    Two heaps hold the lower and the upper half; the uncounted ones only add to the halves' sizes.
    """
    n = below + len(past) + above
    split = min(max((n + 1) // 2 - below, 0), len(past))
    low, high, out = (-past[:split][::-1]).tolist(), past[split:].tolist(), []  # both are heaps as they are sorted
    for v in values:
        lower, upper = below + len(low), above + len(high)
        out.append(None if not lower + upper else -low[0] if lower > upper else (high[0] - low[0]) / 2)
        if low and v > -low[0] or not low and high and v > high[0]:
            heapq.heappush(high, v)
            upper += 1
        else:
            heapq.heappush(low, -v)
            lower += 1
        if lower > upper + 1:
            heapq.heappush(high, -heapq.heappop(low))
        elif upper > lower:
            heapq.heappush(low, -heapq.heappop(high))
    return out


def expanding_median(series: DataFrame, value: str, order: str = "bin", rows: int = ROWS) -> DataFrame:
    """Adds past_median: the median of all earlier values of the symbol, null in its first row.  Values are not null.

    Tasks hold a chunk of ``rows`` rows and a part of the past of about twice that; where a symbol has more than ``RANGES``
    chunks, that part grows in proportion.
    """
    at = positions(series.select("symbol", F.col(order).alias("at"), F.col(value).cast("double").alias("v")), ["at"], chunk_of("at", CHUNK), "symbol")
    own = stored(at.withColumn("__chunk", chunk_of("pos", rows)).repartition("symbol", "__chunk"))
    sizes = own.groupBy("symbol").agg(F.max("__chunk").alias("last"))
    most = (sizes.agg(F.max("last")).first()[0] or 0) + 1
    n = min(most, RANGES)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    edges = own.groupBy("symbol").agg(F.percentile_approx("v", shares, F.lit(max(10 * n, 10_000))).alias("edges"))
    per_chunk = edges.join(sizes, "symbol").select(F.col("symbol").alias("of"), "edges", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("at"))

    def counted(part: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        v, count = np.unique(part["v"].to_numpy(float), return_counts=True)
        return pd.DataFrame({"symbol": part["symbol"].iloc[0], "__chunk": part["__chunk"].iloc[0], "range": np.searchsorted(np.unique(edge["edges"].iloc[0]), v, "right"), "v": v, "n": count})

    values = stored(own.groupBy("symbol", "__chunk").cogroup(per_chunk.groupBy("of", "at")).applyInPandas(counted, "symbol string, __chunk long, range long, v double, n long"))

    def ranges(part: pd.DataFrame) -> pd.DataFrame:
        """For each chunk of a symbol: values before it, and the ranges that hold the wanted ranks; reads counts, not values."""
        out, seen = [], np.zeros(int(part["range"].max()) + 1, np.int64)
        for chunk, own in part.sort_values("__chunk").groupby("__chunk"):
            total = int(seen.sum())
            if total:
                lo, hi = wanted_ranks(total, rows)
                ends = np.cumsum(seen)
                first, last = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "right"))
                out.append((part["symbol"].iloc[0], chunk, total, first, last, int(ends[first] - seen[first])))
            seen[own["range"].to_numpy()] += own["n"].to_numpy()
        return pd.DataFrame(out, columns=["symbol", "__chunk", "total", "first", "last", "base"])

    counts = values.groupBy("symbol", "__chunk", "range").agg(F.sum("n").alias("n"))
    wants = stored(counts.groupBy("symbol").applyInPandas(ranges, "symbol string, __chunk long, total long, first long, last long, base long"))

    asked = wants.select("symbol", "__chunk", F.floor(F.col("__chunk") / TOGETHER).alias("together"), F.explode(F.sequence("first", "last")).alias("range"))
    some = asked.groupBy("symbol", "range").agg(F.collect_set("together").alias("groups"))
    copies = values.join(some, ["symbol", "range"]).select("symbol", "range", F.col("__chunk").alias("from"), "v", "n", F.explode("groups").alias("together"))
    past = copies.join(asked, ["symbol", "range", "together"]).where(F.col("from") < F.col("__chunk")).groupBy("symbol", "__chunk", "v").agg(F.sum("n").alias("n"))
    none = [F.lit(None).cast("long").alias(c) for c in ("total", "base")]
    marks = wants.select("symbol", "__chunk", F.lit(None).cast("double").alias("v"), F.lit(None).cast("long").alias("n"), "total", "base")
    past = past.select("symbol", "__chunk", "v", "n", *none).unionByName(marks)

    def run(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=["symbol", order, "past_median"])
        part, sorted_past, below, above = part.sort_values("pos"), np.empty(0), 0, 0
        if len(before):
            mark = before[before["total"].notna()].iloc[0]
            held = before[before["v"].notna()].sort_values("v")
            lo, hi = wanted_ranks(int(mark["total"]), rows)
            ends = np.cumsum(held["n"].to_numpy(np.int64)) + int(mark["base"])
            starts = ends - held["n"].to_numpy(np.int64)
            inside = np.clip(np.minimum(ends, hi + 1) - np.maximum(starts, lo), 0, None)
            sorted_past, below, above = np.repeat(held["v"].to_numpy(float), inside), lo, int(mark["total"]) - 1 - hi
        found = running_medians(part["v"].tolist(), sorted_past, below, above)
        return pd.DataFrame({"symbol": part["symbol"], order: part["at"], "past_median": pd.array(found, dtype="Float64")})

    medians = own.groupBy("symbol", "__chunk").cogroup(past.groupBy("symbol", "__chunk")).applyInPandas(run, f"symbol string, {order} long, past_median double")
    return series.join(medians, ["symbol", order])
