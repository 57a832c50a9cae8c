"""Long series cut into chunks of time: halos for windows, scans for states.

A chunk is a range of bins, so a symbol with most of the rows is spread over its chunks.  ``over_halo`` gives windows the
rows that they need from the chunks beside theirs; ``prefixes`` gives every chunk the product of all chunks before it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from latentia.session import stored

#: Bins of a chunk, at least.
CHUNK = 256
#: Chunks that one task scans.
FAN = 4096

Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def chunk_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def halo(df: DataFrame, order: str, width: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """df with __chunk and __own: each row once in its own chunk, and once in each chunk with a row that looks back or ahead to it."""
    at = F.col(order)
    around = F.sequence(F.floor((at - ahead) / width).cast("long"), F.floor((at + back) / width).cast("long"))
    return df.select("*", F.explode(around).alias("__chunk")).withColumn("__own", F.col("__chunk") == chunk_of(order, width))


def over_halo(df: DataFrame, columns: dict[str, Callable[[WindowSpec], Column]], back: int = 0, ahead: int = 0, order: str = "bin", key: str = "symbol", width: int | None = None) -> DataFrame:
    """df with columns over windows that reach ``back`` and ``ahead`` in units of the order (an integer).

    Each column is made from a window of (key, chunk) by the order; its frame should be a range frame within that reach.
    A chunk is at least eight times as wide as the reach, so few rows are held twice.
    """
    rows = halo(df, order, width or max(CHUNK, 8 * (back + ahead)), back, ahead)
    w = Window.partitionBy(key, "__chunk").orderBy(order)
    made = rows.select(*df.columns, "__own", *[f(w).alias(name) for name, f in columns.items()])
    return made.where("__own").drop("__own")


def chunked(df: DataFrame, order: str, width: int) -> DataFrame:
    """df with __chunk, stored by (symbol, chunk): grouping by both needs no further shuffle."""
    return stored(df.withColumn("__chunk", chunk_of(order, width)).repartition("symbol", "__chunk"))


def product(elements: np.ndarray, combine: Combine) -> np.ndarray:
    """The product of the rows in order, in pairs, then pairs of pairs (each level is one call of combine)."""
    while len(elements) > 1:
        even = len(elements) // 2 * 2
        merged = combine(elements[0:even:2], elements[1:even:2])
        elements = np.concatenate([merged, elements[even:]])
    return elements[0]


def prefixes(summaries: DataFrame, combine: Combine, fan: int = FAN) -> DataFrame:
    """symbol, __chunk, before: the product of the elements of all earlier chunks, null in a symbol's first.

    summaries: symbol, __chunk, e (array of double), one row for each chunk.  Where a symbol has more than ``fan`` chunks, runs of
    them are multiplied first and scanned in the same way, so no task sees more than ``fan`` rows.
    """
    schema = "symbol string, __chunk long, before array<double>"

    def scanned(part: pd.DataFrame, held: np.ndarray | None) -> pd.DataFrame:
        part, out = part.sort_values("__chunk"), []
        for e in part["e"]:
            out.append(None if held is None else held.tolist())
            e = np.asarray(e, float)[None]
            held = (e if held is None else combine(np.asarray(held)[None], e))[0]
        return pd.DataFrame({"symbol": part["symbol"], "__chunk": part["__chunk"], "before": out})

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        return scanned(part, None)

    most = summaries.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= fan:
        return summaries.groupBy("symbol").applyInPandas(scan, schema)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__chunk")
        e = product(np.array(part["e"].tolist(), float), combine)
        return pd.DataFrame({"symbol": part["symbol"].iloc[:1], "__chunk": part["__run"].iloc[:1], "e": [e.tolist()]})

    def within(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        before = start["before"].iloc[0]
        return scanned(part, None if before is None else np.asarray(before, float))

    runs = stored(summaries.withColumn("__run", F.floor(F.col("__chunk") / fan)))
    above = prefixes(stored(runs.groupBy("symbol", "__run").applyInPandas(merge, "symbol string, __chunk long, e array<double>")), combine, fan)
    starts = above.withColumnRenamed("__chunk", "__run")
    return runs.groupBy("symbol", "__run").cogroup(starts.groupBy("symbol", "__run")).applyInPandas(within, schema)
