"""Scores of probability forecasts, reliability, ranking and costs.

Input: rows with y_true (0 or 1) and y_pred.  Everything is a bounded number of aggregations; where an order is needed,
equal predictions are counted first and prefix sums run over chunks of the value range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.functions.expr import clip
from latentia.operators.order import quantiles, running

EPS = 1e-12


def log_loss(y: Column, p: Column) -> Column:
    q = clip(p, EPS, 1 - EPS)
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def proper_scores(oof: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, base rate, log and Brier score, and their skill against always forecasting the base rate."""
    y, p = F.col("y_true").cast("double"), F.col("y_pred")
    s = oof.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("base_rate"), log_loss(y, p).alias("log_score"), brier(y, p).alias("brier"))
    b = clip(F.col("base_rate"), EPS, 1 - EPS)
    own_log = -(F.col("base_rate") * F.ln(b) + (1 - F.col("base_rate")) * F.ln(1 - b))
    own_brier = F.col("base_rate") * (1 - F.col("base_rate"))
    return s.withColumn("log_skill", 1 - F.col("log_score") / own_log).withColumn("brier_skill", F.when(own_brier > 0, 1 - F.col("brier") / own_brier))


def reliability(oof: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_pred, obs_freq, se, z over quantile bins; a prediction at an inner edge belongs above it, empty bins are left out."""
    inner = [r["q"] for r in quantiles(oof, "y_pred", [i / bins for i in range(1, bins)]).orderBy("share").collect()]
    edges = F.array(*[F.lit(x) for x in inner]) if inner else F.array().cast("array<double>")
    at = F.size(F.filter(edges, lambda e: e <= F.col("y_pred")))
    f = F.avg(F.col("y_true").cast("double"))
    out = oof.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred"), f.alias("obs_freq"))
    out = out.withColumn("se", F.sqrt(F.col("obs_freq") * (1 - F.col("obs_freq")) / F.col("n")))
    return out.withColumn("z", F.when(F.col("se") > 0, (F.col("obs_freq") - F.col("mean_pred")) / F.col("se")))


def score_groups(oof: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per distinct prediction: positives, negatives, and how many of each are below."""
    y = F.col("y_true").cast("long")
    g = oof.groupBy(*(by or []), "y_pred").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return running(g, "y_pred", ["pos", "neg"], by)


def auc(oof: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with one class only."""
    g = score_groups(oof, by)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return g.groupBy(*(by or [])).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins")).select(*(by or []), "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def permutation_aucs(oof: DataFrame, permutations: int = 1000, seed: int = 0, chunks: int = 64) -> DataFrame:
    """perm, auc under label shuffles; ranks are computed once and no row is shuffled.

    A shuffle puts P positives on a uniformly chosen set of rows, so the positives of each chunk of scores, and of each
    distinct score within it, are multivariate hypergeometric draws.  Chunks (a bounded number) are drawn together, and
    a chunk's task draws within it.  numpy's sampler takes up to 1e9 rows.
    """
    g = score_groups(oof).withColumn("n", F.col("pos") + F.col("neg")).withColumn("mid", F.col("before_pos") + F.col("before_neg") + (F.col("n") + 1) / 2)
    bounds = sorted(set(g.approxQuantile("y_pred", [i / chunks for i in range(1, chunks)], 0.01)))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    g = g.withColumn("chunk", F.size(F.filter(edges, lambda b: b <= F.col("y_pred"))))
    sizes = {r["chunk"]: (r["n"], r["pos"]) for r in g.groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}
    ids = sorted(sizes)
    pos, total = sum(sizes[c][1] for c in ids), sum(sizes[c][0] for c in ids)
    if not 0 < pos < total:
        return oof.sparkSession.createDataFrame([], "perm int, auc double")
    draws = np.random.default_rng([seed, chunks]).multivariate_hypergeometric([sizes[c][0] for c in ids], pos, permutations)
    given = dict(zip(ids, draws.T, strict=True))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        c = int(part["chunk"].iloc[0])
        part = part.sort_values("mid")
        rng = np.random.default_rng([seed, chunks, c])
        colors, mid = part["n"].to_numpy(), part["mid"].to_numpy()
        sums = [float(rng.multivariate_hypergeometric(colors, int(k)) @ mid) if k else 0.0 for k in given[c]]
        return pd.DataFrame({"perm": np.arange(len(sums), dtype=np.int32), "s": sums})

    rank_sums = g.select("chunk", "n", "mid").groupBy("chunk").applyInPandas(run, "perm int, s double").groupBy("perm").agg(F.sum("s").alias("s"))
    return rank_sums.select("perm", ((F.col("s") - pos * (pos + 1) / 2) / (pos * (total - pos))).alias("auc"))


def permutation_summary(observed: float, null: DataFrame) -> DataFrame:
    """Share of the null below the observed AUC, z (population deviation), and the null's 95th percentile."""
    return null.agg(F.lit(observed).alias("auc"), F.avg((F.col("auc") < observed).cast("int")).alias("percentile"), ((F.lit(observed) - F.avg("auc")) / F.stddev_pop("auc")).alias("z"), F.percentile("auc", F.lit(0.95)).alias("null_p95"), F.count(F.lit(1)).alias("permutations"))


def confusion(flag: Column, c_fp: float, c_fn: float) -> list[Column]:
    y = F.col("y_true") == 1
    fp, fn = F.count_if(flag & ~y), F.count_if(~flag & y)
    total = fp * c_fp + fn * c_fn
    n = F.count(F.lit(1))
    return [F.count_if(flag & y).alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~flag & ~y).alias("tn"), total.alias("total_cost"), (total / n).alias("mean_cost"), (F.count_if(flag) / n).alias("flagged_rate")]


def cost_matrix(oof: DataFrame, threshold: float, c_fp: float = 1.0, c_fn: float = 1.0) -> DataFrame:
    """Outcomes and costs of flagging strictly above the threshold."""
    return oof.agg(*confusion(F.col("y_pred") > threshold, c_fp, c_fn)).select(F.lit(threshold).alias("threshold"), "*")


def cost_curve(oof: DataFrame, thresholds: list[float], c_fp: float = 1.0, c_fn: float = 1.0) -> DataFrame:
    """threshold, fp, fn, mean_cost for each threshold from one pass: predictions are counted between thresholds."""
    at = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t < F.col("y_pred")))
    y = F.col("y_true").cast("long")
    cells = oof.groupBy(at.alias("above")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    asked = F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("i", "threshold")
    wide = cells.select("above", "pos", "neg", asked)
    out = wide.groupBy("threshold").agg(F.sum(F.when(F.col("above") > F.col("i"), F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("above") <= F.col("i"), F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    return out.select("threshold", "fp", "fn", ((F.col("fp") * c_fp + F.col("fn") * c_fn) / F.col("n")).alias("mean_cost"))


def best_threshold(curve: DataFrame) -> DataFrame:
    return curve.agg(F.min_by("threshold", F.struct("mean_cost", "threshold")).alias("threshold"), F.min("mean_cost").alias("mean_cost"))


def bayes_threshold(c_fp: float, c_fn: float) -> float:
    """The probability above which flagging costs less."""
    return c_fp / (c_fp + c_fn)


def bayes_decision(oof: DataFrame, c_fp: float, c_fn: float, doubtful: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Mean cost at the Bayes threshold and at 0.5, the reduction, and whether the threshold lies in a doubtful range."""
    p = bayes_threshold(c_fp, c_fn)
    named = lambda t, s: [c.alias(f"{n}_{s}") for c, n in zip(confusion(F.col("y_pred") > t, c_fp, c_fn)[5:], ("cost", "flagged"), strict=True)]
    both = oof.agg(*named(p, "star"), *named(0.5, "half"))
    return both.select(F.lit(p).alias("p_star"), "*", (1 - F.col("cost_star") / F.col("cost_half")).alias("reduction"), F.lit(doubtful[0] <= p < doubtful[1]).alias("warn"))


def paired_differences(scores: DataFrame, by: list[str], value: str, base: str) -> DataFrame:
    """Mean, sample deviation and number of positive differences value - base."""
    d = F.col(value) - F.col(base)
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"), F.count_if(d > 0).alias("n_positive"))
