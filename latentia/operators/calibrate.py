"""Recalibration of probabilities: isotonic and Platt, static, by regime, and walking forward by day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentia.functions.expr import logit, sigmoid
from latentia.operators.models import Folds, fit_logistic
from latentia.session import stored

OUT = ["pos", "y_true", "y_pred_raw", "y_pred_calibrated"]


def half_split(oof: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows with pos in the first half, and the others."""
    return oof.where(F.col("pos") < n // 2), oof.where(F.col("pos") >= n // 2)


def isotonic_static(oof: DataFrame) -> DataFrame:
    """Fit on the earlier half (by pos, 0-based), predict the later one; predictions outside the fitted range take its ends."""
    first, second = half_split(oof, oof.count())
    wide = VectorAssembler(inputCols=["y_pred"], outputCol="__x")
    model = IsotonicRegression(featuresCol="__x", labelCol="y_true", predictionCol="y_pred_calibrated").fit(wide.transform(first))
    return model.transform(wide.transform(second)).select("pos", "y_true", F.col("y_pred").alias("y_pred_raw"), "y_pred_calibrated")


def isotonic_by_regime(oof: DataFrame, regime: str, middle: float, reposition) -> DataFrame:
    """The same within rows at or below the middle of a column (calm) and above it (elevated); reposition numbers a part anew."""
    parts = {"calm": oof.where(F.col(regime) <= middle), "elevated": oof.where(F.col(regime) > middle)}
    done = [isotonic_static(reposition(part)).withColumn("regime", F.lit(name)) for name, part in parts.items()]
    return done[0].unionByName(done[1])


def pooled_sums(x: np.ndarray, s: np.ndarray, w: np.ndarray, last: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Pool adjacent violators over blocks in order of x: (first x, last x, sum, weight)."""
    out: list[list[float]] = []
    for a, m, n, b in zip(x.tolist(), s.tolist(), w.tolist(), last.tolist(), strict=True):
        out.append([a, b, m, n])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            _, b2, s2, n2 = out.pop()
            p = out[-1]
            p[1], p[2], p[3] = b2, p[2] + s2, p[3] + n2
    return [tuple(r) for r in out]


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray, last: np.ndarray) -> list[tuple[float, float, float, float]]:
    """The same of means: (first x, last x, mean, weight)."""
    return [(a, b, s / n, n) for a, b, s, n in pooled_sums(x, y * w, w, last)]


BLOCKS = "fold long, lo double, hi double, y double, w double"


def isotonic_blocks(rows: DataFrame, chunks: int = 32) -> DataFrame:
    """fold, lo, hi, y, w: isotonic regression per fold of rows (fold, x, y).

    Equal x are averaged first and violators are pooled within chunks of x; pooling the blocks that are left gives
    the same result as pooling all rows, so a fold's last task sees blocks only.
    """
    points = rows.groupBy("fold", "x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    chunk = F.least(F.floor(F.col("x") * chunks), F.lit(chunks - 1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lo")
        found = pooled(part["lo"].to_numpy(), part["y"].to_numpy(), part["w"].to_numpy(), part["hi"].to_numpy())
        return pd.DataFrame([(part["fold"].iloc[0], *r) for r in found], columns=["fold", "lo", "hi", "y", "w"])

    first = points.select("fold", chunk.alias("chunk"), F.col("x").alias("lo"), F.col("x").alias("hi"), "y", "w").groupBy("fold", "chunk").applyInPandas(run, BLOCKS)
    return first.groupBy("fold").applyInPandas(run, BLOCKS)


def cumulative_blocks(oof: DataFrame, warm_up: int = 3, window: int | None = None, chunks: int = 64) -> DataFrame:
    """fold, lo, hi, y, w: isotonic regression for each day ordinal from warm_up on, over all earlier days or the last ``window`` ones.

    Rows (ordinal, y_pred, y_true) are added up by day and prediction and dealt by prediction once, not once for each later day: a chunk's
    task pools its own points for one day after the other, and a day's last task sees the blocks that are left.  Days
    whose past has one class are left out.
    """
    folds = sorted(r[0] for r in oof.select("ordinal").distinct().where(F.col("ordinal") >= warm_up).collect())
    chunk = F.least(F.floor(F.col("y_pred") * chunks), F.lit(chunks - 1))
    points = oof.groupBy(chunk.alias("chunk"), F.col("ordinal"), F.col("y_pred").alias("x")).agg(F.sum(F.col("y_true").cast("double")).alias("s"), F.count(F.lit(1)).alias("w"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, place = np.unique(part["x"].to_numpy(), return_inverse=True)
        ordinal, s, w = part["ordinal"].to_numpy(), part["s"].to_numpy(), part["w"].to_numpy(float)
        out = []
        for fold in folds:
            use = (ordinal < fold) & (ordinal >= fold - window) if window else ordinal < fold
            weight = np.bincount(place[use], w[use], len(x))
            some = weight > 0
            total = np.bincount(place[use], s[use], len(x))
            out += [(fold, *r) for r in pooled_sums(x[some], total[some], weight[some], x[some])]
        return pd.DataFrame(out, columns=["fold", "lo", "hi", "s", "w"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lo")
        found = pooled_sums(part["lo"].to_numpy(), part["s"].to_numpy(), part["w"].to_numpy(), part["hi"].to_numpy())
        return pd.DataFrame([(part["fold"].iloc[0], *r) for r in found], columns=["fold", "lo", "hi", "s", "w"])

    sums = "fold long, lo double, hi double, s double, w double"
    blocks = points.groupBy("chunk").applyInPandas(run, sums).groupBy("fold").applyInPandas(merge, sums).withColumn("y", F.col("s") / F.col("w"))
    both = blocks.withColumn("__p", F.sum("s").over(Window.partitionBy("fold"))).withColumn("__w", F.sum("w").over(Window.partitionBy("fold")))
    return both.where((F.col("__p") > 0.5) & (F.col("__p") < F.col("__w") - 0.5)).select("fold", "lo", "hi", "y", "w")


def between_knots(knots: Column, x: Column) -> Column:
    """The fitted value at x: of its block, between two blocks on the line from one to the other, beyond the ends the ends'."""
    below = F.filter(knots, lambda k: k["lo"] <= x)
    above = F.filter(knots, lambda k: k["hi"] >= x)
    a, b = F.element_at(below, -1), F.get(above, F.lit(0))
    line = a["y"] + (b["y"] - a["y"]) * (x - a["hi"]) / (b["lo"] - a["hi"])
    return F.when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).when(a["lo"] == b["lo"], a["y"]).otherwise(line)


def isotonic_walk_forward(oof: DataFrame, warm_up: int = 3, window: int | None = None) -> DataFrame:
    """Each day calibrated by isotonic regression on all days before it or on the last ``window`` ones."""
    blocks = cumulative_blocks(oof, warm_up, window)
    knots = blocks.groupBy(F.col("fold").alias("__fold")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "y"))).alias("knots"))
    rows = oof.select("pos", "y_true", "y_pred", "ordinal").join(knots, F.col("ordinal") == F.col("__fold"))
    return rows.select("pos", "y_true", F.col("y_pred").alias("y_pred_raw"), between_knots(F.col("knots"), F.col("y_pred")).alias("y_pred_calibrated"))


def platt_walk_forward(oof: DataFrame, warm_up: int = 3, window: int | None = 5, c: float = 1.0) -> DataFrame:
    """Each day calibrated by logistic regression on the logit of days before it, all days fitted together."""
    spans = {r["ordinal"]: (r["lo"], r["hi"]) for r in oof.groupBy("ordinal").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()}
    days = [d for d in sorted(spans) if d >= warm_up]
    starts = {d: min((spans[e][0] for e in spans if e < d and (not window or e >= d - window)), default=spans[d][0]) for d in days}

    class Before(Folds):
        def training(self, f: int, pos: np.ndarray, embargoed: np.ndarray) -> np.ndarray:
            return (pos >= first[f]) & (pos < self.lo[f])

    first = np.array([starts[d] for d in days], np.int64)
    folds = Before(np.array(days, np.int64), np.array([spans[d][0] for d in days], np.int64), np.array([spans[d][1] for d in days], np.int64), 0)
    rows = oof.select("pos", F.array(logit(F.col("y_pred"))).alias("x"), F.array(F.col("y_true").cast("double")).alias("ys"), F.lit(False).alias("embargoed"), F.lit(None).cast("long").alias("rank"))
    w, s = fit_logistic(stored(rows), folds, 1, 1, c=c, standardize=False)
    fitted = [(int(d), float(w[i, 0, 0]), float(w[i, 0, 1])) for i, d in enumerate(days) if s.usable[i, 0]]
    table = oof.sparkSession.createDataFrame(fitted, "ordinal long, a double, b double")
    joined = oof.join(F.broadcast(table), "ordinal")
    return joined.select("pos", "y_true", F.col("y_pred").alias("y_pred_raw"), sigmoid(F.col("a") + F.col("b") * logit(F.col("y_pred"))).alias("y_pred_calibrated"))
