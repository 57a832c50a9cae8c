"""Cross-validation splits as relations: naive k-fold and purged, embargoed walk-forward.

Input: one series with pos (0-based row) and day (number).  Membership is a predicate on positions, so no
index lists exist; the embargo is one running maximum over days instead of a loop over folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kfold(rows: DataFrame, n: int, k: int) -> DataFrame:
    """fold: number of inner bounds i * n / k, cut to whole numbers, that are at or below pos."""
    bounds = F.array(*[F.lit(int(i * n / k)).cast("long") for i in range(1, k)])
    return rows.withColumn("fold", F.size(F.filter(bounds, lambda b: b <= F.col("pos"))))


def day_table(rows: DataFrame) -> DataFrame:
    """day, first, last position, ordinal: a row for each calendar day."""
    days = rows.groupBy("day").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return days.withColumn("ordinal", F.row_number().over(Window.orderBy("day")) - 1)


def walk_forward_folds(rows: DataFrame) -> DataFrame:
    """fold, test_lo, test_hi: each day from the second on is one test fold."""
    return day_table(rows).where("ordinal >= 1").select(F.col("ordinal").alias("fold"), F.col("lo").alias("test_lo"), F.col("hi").alias("test_hi"))


def embargoed_rows(rows: DataFrame, embargo: int) -> DataFrame:
    """rows with ordinal and embargoed: within ``embargo`` rows after the end of an earlier test day (not day 0).

    Rows after a zone's end are of later days, so the running maximum of zone ends over earlier days decides for
    every fold alike.
    """
    days = day_table(rows)
    until = F.max(F.when(F.col("ordinal") >= 1, F.col("hi") + embargo)).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    zone = days.select("day", "ordinal", until.alias("until"))
    return rows.join(zone, "day").withColumn("embargoed", F.coalesce(F.col("pos") <= F.col("until"), F.lit(False))).drop("until")


def training_sizes(rows: DataFrame, h: int, embargo: int, label: str | None = None) -> DataFrame:
    """fold, test_lo, test_hi, n_train (and the label's training sum) by prefix sums over days, not by row x fold.

    A fold's training rows end h rows before its day: whole earlier days count through a running sum, and the rows
    the purge cuts off are a short stretch before test_lo.
    """
    e = embargoed_rows(rows, embargo)
    y = F.col(label) if label else F.lit(0.0)
    ok = ~F.col("embargoed")
    per_day = e.groupBy("day", "ordinal").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum(F.when(ok, 1).otherwise(0)).alias("m"), F.coalesce(F.sum(F.when(ok, y)), F.lit(0.0)).alias("s"))
    w = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    folds = per_day.select(F.col("ordinal").alias("fold"), F.col("lo").alias("test_lo"), F.col("hi").alias("test_hi"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("m"), F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("s")).where("fold >= 1")
    near = folds.select("fold", F.explode(F.sequence(F.greatest(F.col("test_lo") - h, F.lit(0)), F.col("test_lo") - 1)).alias("pos"))
    cut = near.join(e.where(ok).select("pos", y.alias("y")), "pos").groupBy("fold").agg(F.count(F.lit(1)).alias("cm"), F.sum("y").alias("cs"))
    out = folds.join(cut, "fold", "left")
    return out.select("fold", "test_lo", "test_hi", (F.col("m") - F.coalesce("cm", F.lit(0))).alias("n_train"), (F.col("s") - F.coalesce("cs", F.lit(0.0))).alias("y_train"))


def dummy_oof(rows: DataFrame, label: str, h: int, embargo: int) -> DataFrame:
    """Out-of-fold predictions of the training mean; folds without training rows are left out."""
    folds = training_sizes(rows, h, embargo, label).where("n_train > 0").select(F.col("fold").alias("ordinal"), (F.col("y_train") / F.col("n_train")).alias("prior"))
    ordinal = day_table(rows).select("day", "ordinal")
    return rows.join(ordinal, "day").join(folds, "ordinal").select("pos", F.col("ordinal").alias("fold"), F.col(label).alias("y_true"), F.col("prior").alias("y_pred"))
