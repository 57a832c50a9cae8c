"""Neighbours in time order without one task per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentia.session import stored


def with_neighbour(df: DataFrame, columns: list[str], order: list[str], chunk: Column, key: str = "symbol", ahead: bool = False, prefix: str = "prev_") -> DataFrame:
    """Adds prefix + column: the value in the row before (or after) within the symbol.

    Windows run over (symbol, chunk), so a symbol with most of the rows is spread over its chunks (say, days).  The
    row next to a chunk's edge comes from a table with one row per symbol and chunk.
    """
    rows = df.withColumn("__chunk", chunk)
    within = Window.partitionBy(key, "__chunk").orderBy(*order)
    near = (F.lead if ahead else F.lag)(F.struct(*columns)).over(within)
    at = F.struct(*order)
    edge = (F.min_by if ahead else F.max_by)(F.struct(*columns), at)
    edges = rows.groupBy(key, "__chunk").agg(edge.alias("__edge"))
    chunks = Window.partitionBy(key).orderBy("__chunk")
    carried = edges.select(key, "__chunk", (F.lead if ahead else F.lag)("__edge").over(chunks).alias("__carried"))
    out = rows.withColumn("__near", near).join(carried, [key, "__chunk"])
    near = F.coalesce("__near", "__carried")
    return out.select(*df.columns, *[near[c].alias(f"{prefix}{c}") for c in columns])


def positions(df: DataFrame, order: list[str], chunk: Column, key: str | None = None, name: str = "pos") -> DataFrame:
    """0-based row number in order (within key): numbers within chunks plus the sizes of the chunks before."""
    keys = [key] if key else []
    rows = df.withColumn("__chunk", chunk)
    sizes = rows.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__chunk")
    before = sizes.select(*keys, "__chunk", (F.sum("__n").over(over) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)) - 1
    return rows.withColumn("__row", within).join(before, [*keys, "__chunk"]).select(*df.columns, (F.col("__row") + F.col("__before")).cast("long").alias(name))


def running(groups: DataFrame, value: str, sums: list[str], keys: list[str] | None = None, chunks: int = 64) -> DataFrame:
    """Adds before_<sum>: the sums over smaller values (within keys); groups has one row per (keys, value).

    Chunks of the value range come from approximate quantiles and only balance the work; the result is exact.
    """
    keys = keys or []
    groups = stored(groups)
    bounds = groups.approxQuantile(value, [i / chunks for i in range(1, chunks)], 0.02) if chunks > 1 else []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    rows = groups.withColumn("__chunk", F.size(F.filter(edges, lambda b: b <= F.col(value))))
    per = rows.groupBy(*keys, "__chunk").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    over = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__chunk", *[F.coalesce(F.sum(f"__{s}").over(over), F.lit(0)).alias(f"__{s}") for s in sums])
    within = Window.partitionBy(*keys, "__chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"__own_{s}") for s in sums])
    return own.join(per, [*keys, "__chunk"]).select(*groups.columns, *[(F.col(f"__own_{s}") + F.col(f"__{s}")).alias(f"before_{s}") for s in sums])


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, share, q: exact quantiles with linear interpolation, without holding a group's values in one place.

    Equal values are counted first; ranks are prefix sums of the counts.
    """
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, "__v", ["__n"], keys)
    n = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    sized = ranked.join(n, keys) if keys else ranked.crossJoin(F.broadcast(n))
    at = sized.withColumn("share", asked).withColumn("__h", (F.col("__all") - 1) * F.col("share"))
    first, last = F.col("before___n"), F.col("before___n") + F.col("__n")
    inside = lambda r: (r >= first) & (r < last)
    low, high = F.floor("__h"), F.least(F.floor("__h") + 1, F.col("__all") - 1)
    hit = at.where(inside(low) | inside(high))
    ends = hit.groupBy(*keys, "share").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.first("__h").alias("__h"))
    return ends.select(*keys, "share", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__h") - F.floor("__h"))).alias("q"))
