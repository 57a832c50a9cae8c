"""Queries on real forecasts: features from the regime filter, out-of-fold predictions, their calibration, regimes and costs.

Each step reads the stored result of the one before: parameters of regimes -> filter -> labelled features -> out-of-fold
predictions -> calibrators and decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.operators import calibrate, cv, labels, metrics, models, realized
from latentia.operators.order import quantiles
from latentia.plans.catalogue import C_FN, C_FP, CALIBRATED, FEATURES, HOUR, PURGE, SCORES, dataset_of, filtered, hourly, log_prices, observed_parameters, prepared_rows, query, renumbered, rounded, settled
from latentia.session import stored

#: Bars whose mean elevated probability is the label.
AHEAD = 6
#: Digits of stored predictions: equal forecasts stay equal whatever batch they were made in.
DIGITS = 9
STORED: dict[tuple[str, str, str], DataFrame] = {}


def once(name: str):
    """Keep a step's stored result for the session: later queries read it."""

    def wrap(f):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            at = (spark.sparkContext.applicationId, sf_dir, name)
            if at not in STORED:
                STORED[at] = stored(f(spark, sf_dir))
            return STORED[at]

        return get

    return wrap


@once("scored")
def regime_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, bin, elevated_prob of the regime filter, rolling_vol."""
    vol = realized.rolling_volatility(hourly(spark, sf_dir), HOUR, 6 * HOUR).select("symbol", "bin", "rolling_vol")
    prob = filtered(log_prices(spark, sf_dir), stored(observed_parameters(spark, sf_dir))).select("symbol", "bin", "elevated_prob")
    return prob.join(vol, ["symbol", "bin"])


@query
def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forecast may know at each bar, and the label: whether the mean elevated probability of the next bars exceeds one half."""
    base = regime_scored(spark, sf_dir)
    label = labels.forward_label(base, "elevated_prob", AHEAD).select("symbol", "bin", "forward_mean", "real_label")
    return rounded(labels.causal_features(base).join(label, ["symbol", "bin"]), *FEATURES, "forward_mean", digits=5)


@once("oof")
def oof_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos (from 0 over the predicted rows), fold, day, ordinal, y_true, y_pred, elevated_prob."""
    data = stored(dataset_of(regime_scored(spark, sf_dir)))
    rows = prepared_rows(data, ["real_label"])
    oof = models.logistic_oof(rows, models.day_folds(rows, PURGE), 1, len(FEATURES)).select("pos", "fold", "y_true", F.round("y_pred", DIGITS).alias("y_pred"))
    named = stored(renumbered(oof.join(data.select("pos", "day", "elevated_prob"), "pos")))
    return named.join(F.broadcast(cv.day_table(named).select("day", "ordinal")), "day").select("pos", F.col("fold").cast("long").alias("fold"), "day", "ordinal", "y_true", "y_pred", "elevated_prob")


@query
def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of purged, embargoed walk-forward logistic regression."""
    return rounded(oof_rows(spark, sf_dir).select("pos", "fold", "y_true", "y_pred", "elevated_prob"), "y_pred", "elevated_prob", digits=5)


@query
def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, log and Brier score and skill of the predictions."""
    rows = oof_rows(spark, sf_dir)
    return rounded(metrics.proper_scores(rows).crossJoin(F.broadcast(metrics.auc(rows))), *SCORES, "auc", digits=5)


@query
def oof_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.reliability(oof_rows(spark, sf_dir)).withColumn("bin", F.col("bin").cast("long"))
    return rounded(out, "mean_pred", "obs_freq", "se", "z", digits=4)


@query
def oof_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic regression on the earlier half of the predictions, applied to the later one."""
    return settled(calibrate.isotonic_static(oof_rows(spark, sf_dir).select("pos", "y_true", "y_pred")), 5)


def calibrated_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oof_rows(spark, sf_dir).select("pos", "y_true", "y_pred", "elevated_prob")
    middle = quantiles(rows, "elevated_prob", [0.5]).first()["q"]
    return calibrate.isotonic_by_regime(rows, "elevated_prob", middle, renumbered)


@query
def oof_isotonic_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the calmer and the more elevated half of the rows; pos counts within each."""
    return settled(calibrated_by_regime(spark, sf_dir), 5)


@query
def oof_isotonic_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(calibrate.isotonic_walk_forward(oof_rows(spark, sf_dir)), 5)


@query
def oof_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt scaling of each day on the five days before it."""
    return settled(calibrate.platt_walk_forward(oof_rows(spark, sf_dir)), 5)


@query
def oof_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean costs of the predictions at the Bayes threshold and at one half."""
    out = metrics.bayes_decision(oof_rows(spark, sf_dir), C_FP, C_FN)
    return rounded(out, "p_star", "cost_star", "flagged_star", "cost_half", "flagged_half", "reduction", digits=5)


@query
def oof_recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, n, log and Brier score before and after each calibrator, over the rows it calibrates."""
    rows = oof_rows(spark, sf_dir)
    plain = rows.select("pos", "y_true", "y_pred")
    made = {
        "isotonic_half": calibrate.isotonic_static(plain), "isotonic_regime": calibrated_by_regime(spark, sf_dir).drop("regime"), "isotonic_expanding": calibrate.isotonic_walk_forward(rows),
        "isotonic_rolling": calibrate.isotonic_walk_forward(rows, window=5), "platt_rolling": calibrate.platt_walk_forward(rows),
    }
    out = None
    for name, df in made.items():
        one = df.select(F.lit(name).alias("method"), "y_true", *CALIBRATED)
        out = one if out is None else out.unionByName(one)
    y = F.col("y_true")
    pairs = [(f(y, F.col(p)), f"{label}_{when}") for p, when in zip(CALIBRATED, ("raw", "calibrated"), strict=True) for f, label in ((metrics.log_loss, "log"), (metrics.brier, "brier"))]
    return rounded(out.groupBy("method").agg(F.count(F.lit(1)).alias("n"), *[x.alias(n) for x, n in pairs]), *[n for _, n in pairs], digits=4)
