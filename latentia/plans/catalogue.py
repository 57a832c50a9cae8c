"""The named queries: each builds one operator's answer over the whole tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions.expr import DAY, SECOND, closed, day_between, day_of, half_open, moment, normal_gate, period, phase
from latentia.operators import bars, calibrate, cv, filters, labels, medians, metrics, models, noise, parameters, realized, regimes
from latentia.operators.chunks import over_halo
from latentia.operators.order import positions, quantiles
from latentia.session import stored
from latentia.sources.ticks import event_ticks, order_ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MINUTES_10, HOUR = 600 * SECOND, 3600 * SECOND
EVENT = "2024-01-10"
#: First and last day of a slice, and a return that counts as large.
SLICE, LARGE = ("2024-01-08", "2024-01-12"), 0.5
#: For the 30 days of hourly bars that events have at every scale factor.
SHIFTS = labels.draw_shifts(700, 20, margin=100, near=5, periods=(24,))
R_NOISE, GATE = 0.05, 4.0
#: Two modes of the interacting filter: process noise, measurement noise, transitions.
MODES_Q, MODES_R, MODES_PI = [0.01, 1.0], [0.05, 0.2], [[0.95, 0.05], [0.1, 0.9]]
#: Four modes fitted to a month of minute bars (process noise, measurement noise, transitions).
FOUR_Q, FOUR_R = [4.668482e-07, 1.229825e-07, 9.774018e-06, 1.648590e-06], [4.247151e-11, 0.0, 4.367791e-09, 2.826219e-10]
FOUR_PI = [[0.9670, 0.0170, 0.0003, 0.0156], [0.0247, 0.9745, 0.0004, 0.0004], [0.0, 0.0, 0.9600, 0.0400], [0.0287, 0.0, 0.0118, 0.9595]]
#: Sizes of hourly returns that part observed states; pairs of ticks that a state's noise needs.
EDGES, LEAST_PAIRS = [0.5, 1.0, 2.0], 100
PURGE, EMBARGO = 60, 60
C_FP, C_FN = 1.0, 4.0
THRESHOLDS = [round(0.01 * i, 2) for i in range(1, 100)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits; negative zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bar_returns(event_ticks(spark, sf_dir), HOUR)


def ten_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bar_returns(event_ticks(spark, sf_dir), MINUTES_10)


@query
def daily_realized_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.daily_metrics(event_ticks(spark, sf_dir), MINUTES_10), "rv", "intraday_range")


@query
def bars_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.last_bars(event_ticks(spark, sf_dir), MINUTES_10)


@query
def bars_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.gap_filled(bars.last_bars(event_ticks(spark, sf_dir), MINUTES_10), MINUTES_10)


@query
def bars_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.last_bars(event_ticks(spark, sf_dir), HOUR, 90 * SECOND)


@query
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly(spark, sf_dir), "r")


@query
def stale_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.stale_fraction(order_ticks(spark, sf_dir), 7 * DAY), "stale")


@query
def arrival_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.arrival_stats(event_ticks(spark, sf_dir)), "median_gap", "mean_gap", "share_over_1s", digits=4)


@query
def same_ts_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.same_time_share(order_ticks(spark, sf_dir)), "same_ts_share")


@query
def roll_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(noise.roll(noise.return_pairs(event_ticks(spark, sf_dir)), ["symbol"]), "r_noise")


@query
def roll_noise_distinct_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(noise.roll(noise.return_pairs(order_ticks(spark, sf_dir)), ["symbol"], noise.distinct_times()), "r_noise")


@query
def roll_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = noise.return_pairs(event_ticks(spark, sf_dir)).withColumn("period", period(F.col("us"), EVENT))
    return rounded(noise.roll(pairs, ["symbol", "period"]), "r_noise")


def bar_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a return: 1 where it moved by more than 1, else 0."""
    return hourly(spark, sf_dir).where("r IS NOT NULL").select("symbol", "bin", (F.abs("r") > 1).cast("int").alias("state"))


@query
def tick_state_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.tick_states(event_ticks(spark, sf_dir), bar_states(spark, sf_dir), HOUR).groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"))


@query
def roll_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(noise.roll_by_state(event_ticks(spark, sf_dir), bar_states(spark, sf_dir), HOUR), "r_noise")


@query
def implied_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = noise.roll(noise.return_pairs(event_ticks(spark, sf_dir)), ["symbol"])
    return rounded(r.select("symbol", noise.implied_spread(F.col("r_noise")).alias("spread_bp")), "spread_bp", digits=4)


@query
def regime_invariance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll's estimate during the event over that before it."""
    by = roll_by_period(spark, sf_dir).groupBy("symbol").agg(*[F.max(F.when(F.col("period") == p, F.col("r_noise"))).alias(p) for p in ("pre", "during")])
    return rounded(by.select("symbol", (F.col("during") / F.col("pre")).alias("ratio")), "ratio", digits=4)


@query
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.signature(event_ticks(spark, sf_dir), [HOUR, 2 * HOUR], 4), "rv_mean", "rv_std", "stale")


@query
def rolling_rv_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.rolling_rv_rate(hourly(spark, sf_dir), HOUR, 6 * HOUR).select("symbol", "bin", "rv_rate", "q"), "rv_rate", "q")


@query
def rolling_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.rolling_volatility(hourly(spark, sf_dir), HOUR, 6 * HOUR).select("symbol", "bin", "rolling_vol"), "rolling_vol")


@query
def standardized_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.standardized(hourly(spark, sf_dir)).where("r IS NOT NULL").select("symbol", "bin", "z"), "z")


BIPOWER = ("rv", "bv", "jump", "z_stat", "jump_share")


@query
def bipower_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.bipower_daily(ten_minutes(spark, sf_dir), MINUTES_10), *BIPOWER)


@query
def jump_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = realized.bipower_daily(ten_minutes(spark, sf_dir), MINUTES_10)
    flag = F.coalesce(realized.flagged(F.col("z_stat"), normal_gate(30)), F.lit(False))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"), F.count_if(flag).alias("n_flagged"))


@query
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.window_summary(realized.daily_metrics(event_ticks(spark, sf_dir), MINUTES_10)), "total_rv", "max_daily_rv", "max_range", "largest_share")


@query
def calmest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 windows of least total variance."""
    return window_summary(spark, sf_dir).orderBy("total_rv", "symbol", "start_day").limit(10).select("symbol", "start_day", "end_day", "total_rv")


@query
def mad_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.calm_days(realized.daily_metrics(event_ticks(spark, sf_dir), MINUTES_10)).select("symbol", "day", "rv"), "rv")


@query
def bootstrap_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of 7 calm days of each symbol: the share of the largest day (a pool is one number for each calendar day)."""
    return realized.bootstrap_by_symbol(realized.calm_days(realized.daily_metrics(event_ticks(spark, sf_dir), MINUTES_10)))


@query
def calm_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of 7 days with the cutoff of random groupings, whether it passes, and the one selected for each symbol."""
    return realized.calm_windows(stored(realized.daily_metrics(event_ticks(spark, sf_dir), MINUTES_10)))


@query
def calm_window_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of each symbol's selected window and their shares of its variance."""
    daily = stored(realized.daily_metrics(event_ticks(spark, sf_dir), MINUTES_10))
    return realized.days_of_selected(realized.calm_windows(daily), daily)


@query
def acf_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(realized.acf_at(hourly(spark, sf_dir).where("r IS NOT NULL"), "r", [1, 2, 12, 24]), "acf")


@query
def acf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lags to two days, as the reference's range of 48 hours of bars."""
    return rounded(realized.acf(hourly(spark, sf_dir).where("r IS NOT NULL"), "r", 48), "acf")


@query
def naive_vol_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags bars whose rolling variance rate exceeds the median of all earlier ones."""
    rate = realized.rolling_rv_rate(hourly(spark, sf_dir), HOUR, 6 * HOUR).select("symbol", "bin", "rv_rate")
    out = medians.expanding_median(rate, "rv_rate").select("symbol", "bin", "past_median", F.coalesce(F.col("rv_rate") > F.col("past_median"), F.lit(False)).alias("flag"))
    return rounded(out, "past_median")


def kalman_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = realized.rolling_rv_rate(hourly(spark, sf_dir), HOUR, 6 * HOUR)
    return rate.select("symbol", "bin", F.ln("price").alias("z"), "q", F.lit(R_NOISE).alias("r_noise"))


@query
def kalman_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.kalman(kalman_input(spark, sf_dir)), "x_filt", "p_filt", "innovation", "innovation_var", "gate_stat")


@query
def kalman_gate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of bars above the chi-squared gate by period."""
    out = filters.kalman(kalman_input(spark, sf_dir)).withColumn("period", period(F.col("bin") * HOUR, EVENT))
    return rounded(out.groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gate_stat") > GATE).cast("int")).alias("flagged")), "flagged")


def log_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("symbol", "bin", F.ln("price").alias("z"))


def filtered(series: DataFrame, params: DataFrame) -> DataFrame:
    """symbol, bin, x_filt, p_filt, mode_probs, elevated_prob of the interacting filter under a table of parameters."""
    out = filters.imm(series, params).join(params.select("symbol", "elevated"), "symbol")
    return out.withColumn("elevated_prob", filters.elevated(F.col("mode_probs"), F.col("elevated"))).drop("elevated")


def given_modes(series: DataFrame, q: list[float], r: list[float], pi: list[list[float]]) -> DataFrame:
    """The same parameters for every symbol of a series."""
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    fixed = series.select("symbol").distinct().select("symbol", array(q).alias("q"), array(r).alias("r"), F.array(*map(array, pi)).alias("pi"))
    return fixed.withColumn("elevated", regimes.above_median(F.col("q")))


def imm_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = log_prices(spark, sf_dir)
    return filtered(series, given_modes(series, MODES_Q, MODES_R, MODES_PI))


@query
def imm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imm_output(spark, sf_dir).select("symbol", "bin", "x_filt", "p_filt", "elevated_prob"), "x_filt", "p_filt", "elevated_prob")


@query
def elevated_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imm_output(spark, sf_dir).withColumn("phase", phase(F.col("bin") * HOUR, EVENT)).where("phase IS NOT NULL")
    return rounded(out.groupBy("symbol", "phase").agg(F.avg("elevated_prob").alias("persistence")), "persistence")


@query
def imm_four_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interacting filter with four given modes, one of them without measurement noise."""
    series = log_prices(spark, sf_dir)
    out = filtered(series, given_modes(series, FOUR_Q, FOUR_R, FOUR_PI))
    return rounded(out.select("symbol", "bin", "x_filt", "p_filt", "elevated_prob"), "x_filt", "p_filt", "elevated_prob")


def observed_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter parameters of four states by the size of hourly returns: variances, noise of ticks in a state, transitions, horizon."""
    states, models = parameters.observed_models(hourly(spark, sf_dir), EDGES)
    return parameters.parameter_table(models, noise.roll_by_state(event_ticks(spark, sf_dir), states, HOUR, LEAST_PAIRS))


@query
def regime_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance, measurement and process noise, and persistence of each observed state."""
    rows = parameters.by_state(observed_parameters(spark, sf_dir)).withColumn("state", F.col("state").cast("long"))
    return rounded(rows, "variance", "r_noise", "q", "stays")


@query
def regime_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected bars until a symbol leaves its elevated states, from its transitions."""
    return rounded(observed_parameters(spark, sf_dir).select("symbol", F.size("elevated").cast("long").alias("n_elevated"), "horizon"), "horizon", digits=4)


@query
def imm_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interacting filter with each symbol's own observed regimes."""
    out = filtered(log_prices(spark, sf_dir), stored(observed_parameters(spark, sf_dir)))
    return rounded(out.select("symbol", "bin", "x_filt", "p_filt", "elevated_prob"), "x_filt", "p_filt", "elevated_prob", digits=5)


def scored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, bin, elevated_prob (a plain transform of the price), rolling_vol."""
    vol = realized.rolling_volatility(hourly(spark, sf_dir), HOUR, 6 * HOUR)
    return vol.select("symbol", "bin", (F.col("price") / (F.col("price") + 25)).alias("elevated_prob"), "rolling_vol")


@query
def forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.forward_label(scored_bars(spark, sf_dir), "elevated_prob", 6).select("symbol", "bin", "forward_mean", "real_label"), "forward_mean")


@query
def causal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.causal_features(scored_bars(spark, sf_dir)), "elevated_prob", "elevated_prob_lag1", "rolling_vol")


@query
def circular_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.circular_nulls(labels.forward_label(scored_bars(spark, sf_dir), "elevated_prob", 6), SHIFTS, HOUR)


@query
def window_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = realized.daily_metrics(event_ticks(spark, sf_dir), MINUTES_10)
    cut = (moment("2024-01-16") / DAY).cast("long")
    frames = {"first": daily.where(F.col("day") < cut), "second": daily.where(F.col("day") >= cut)}
    return rounded(labels.union_windows(frames, ["symbol", "day", "rv"]), "rv")


@query
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.calendar_gaps(order_ticks(spark, sf_dir).withColumn("d", day_of(F.col("us"))), "d", most=2)


@query
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.duplicates(order_ticks(spark, sf_dir), ["symbol", "us"])


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, day, y_true (a purchase), y_pred of all events in time order."""
    t = event_ticks(spark, sf_dir)
    at = positions(t, ["us", "seq"], day_of(F.col("us")))
    p = F.col("price") / (F.col("price") + 25)
    return at.select("pos", day_of(F.col("us")).alias("day"), (F.col("symbol") == "purchase").cast("double").alias("y_true"), p.alias("y_pred"))


@query
def kfold_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir).select("pos")
    return cv.kfold(rows, rows.count(), 7).select("pos", F.col("fold").cast("long").alias("fold"))


@query
def walkforward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cv.training_sizes(scored_events(spark, sf_dir), PURGE, EMBARGO, "y_true")
    return out.select(F.col("fold").cast("long").alias("fold"), "test_lo", "test_hi", F.col("n_train").cast("long").alias("n_train"), "y_train")


@query
def dummy_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cv.dummy_oof(scored_events(spark, sf_dir), "y_true", PURGE, EMBARGO)
    return rounded(out.withColumn("fold", F.col("fold").cast("long")), "y_pred")


@query
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(scored_events(spark, sf_dir)), "auc", digits=8)


@query
def auc_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(scored_events(spark, sf_dir), ["day"]), "auc", digits=8)


SCORES = ("base_rate", "log_score", "brier", "log_skill", "brier_skill")


@query
def log_brier_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.proper_scores(scored_events(spark, sf_dir)), *SCORES)


@query
def half_split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir)
    half = F.when(F.col("pos") < rows.count() // 2, "first").otherwise("second")
    return rounded(metrics.proper_scores(rows.withColumn("half", half), ["half"]), *SCORES)


@query
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.reliability(scored_events(spark, sf_dir)).withColumn("bin", F.col("bin").cast("long"))
    return rounded(out, "mean_pred", "obs_freq", "se", "z")


@query
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantiles(scored_events(spark, sf_dir), "y_pred", [0.05, 0.5, 0.9]), "q")


@query
def cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cost_matrix(scored_events(spark, sf_dir), 0.5, C_FP, C_FN), "mean_cost", "flagged_rate")


@query
def cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cost_curve(scored_events(spark, sf_dir), THRESHOLDS, C_FP, C_FN), "mean_cost")


@query
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_threshold(metrics.cost_curve(scored_events(spark, sf_dir), THRESHOLDS, C_FP, C_FN)), "mean_cost")


@query
def bayes_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.bayes_decision(scored_events(spark, sf_dir), C_FP, C_FN)
    return rounded(out, "p_star", "cost_star", "flagged_star", "cost_half", "flagged_half", "reduction")


@query
def bic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIC of given log-likelihoods for 2 to 5 states, and the least."""
    n = event_ticks(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln(F.col("price") + 1)).alias("s"))
    k = n.withColumn("k", F.explode(F.array(*[F.lit(i) for i in (2, 3, 4, 5)]))).withColumn("ll", -F.col("s") * (1 + 1 / F.col("k")))
    out = k.groupBy("symbol").agg(F.min_by("k", regimes.bic(F.col("ll"), F.col("k"), F.col("n"))).alias("k"), F.min(regimes.bic(F.col("ll"), F.col("k"), F.col("n"))).alias("bic"))
    return rounded(out.withColumn("k", F.col("k").cast("long")), "bic", digits=3)


FEATURES = ["elevated_prob", "elevated_prob_lag1", "rolling_vol"]


def dataset(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """pos, day, symbol, features, real_label (and null labels), all defined, in time order over all symbols."""
    return dataset_of(scored_bars(spark, sf_dir), nulls)


def dataset_of(base: DataFrame, nulls: bool = False) -> DataFrame:
    """The same from symbol, bin, elevated_prob, rolling_vol; what is used more than once is stored."""
    base = stored(base)
    label = stored(labels.forward_label(base, "elevated_prob", 6))
    rows = labels.causal_features(base).join(label.select("symbol", "bin", "real_label"), ["symbol", "bin"])
    if nulls:
        wide = labels.circular_nulls(label, SHIFTS, HOUR).groupBy("symbol", "bin").pivot("shift_id", list(range(len(SHIFTS)))).agg(F.first("null_label"))
        rows = rows.join(wide.toDF("symbol", "bin", *[f"null_label_{i}" for i in range(len(SHIFTS))]), ["symbol", "bin"])
    whole = stored(rows.dropna().withColumn("day", F.floor(F.col("bin") / 24).cast("long")))
    return positions(whole, ["bin", "symbol"], F.col("day"))


def model_rows(spark: SparkSession, sf_dir: str, targets: list[str], nulls: bool = False) -> DataFrame:
    return prepared_rows(stored(dataset(spark, sf_dir, nulls)), targets)


def prepared_rows(rows: DataFrame, targets: list[str]) -> DataFrame:
    return stored(models.prepared(rows, FEATURES, targets, EMBARGO, F.floor(F.col("pos") / 100_000)))


@query
def lr_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir, ["real_label"])
    oof = models.logistic_oof(rows, models.day_folds(rows, PURGE), 1, len(FEATURES)).drop("label")
    return rounded(oof.withColumn("fold", F.col("fold").cast("long")), "y_pred")


def compared(rows: DataFrame, folds: models.Folds, n_labels: int, scheme: str) -> DataFrame:
    """label, scheme, auc_real, auc_dummy."""
    real, dummy = (f(rows, folds, n_labels, len(FEATURES)).withColumn("model", F.lit(name)) for name, f in (("real", models.logistic_oof), ("dummy", models.prior_oof)))
    equal = real.unionByName(dummy).withColumn("y_pred", F.round("y_pred", 9))  # equal forecasts tie whatever batch they were made in
    scored = metrics.auc(equal, ["label", "model"])
    return scored.groupBy("label").agg(F.lit(scheme).alias("scheme"), *[F.max(F.when(F.col("model") == m, F.col("auc"))).alias(f"auc_{m}") for m in ("real", "dummy")])


LEAKS: dict[tuple[str, str], DataFrame] = {}


def leakage_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of model and class prior for the real label (0) and the circular nulls, under naive and purged splits; stored for the session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in LEAKS:
        targets = ["real_label", *[f"null_label_{i}" for i in range(len(SHIFTS))]]
        rows = model_rows(spark, sf_dir, targets, nulls=True)
        walk = models.day_folds(rows, PURGE)
        naive = models.k_folds(rows.count(), len(walk.ids))
        LEAKS[at] = stored(compared(rows, naive, len(targets), "naive").unionByName(compared(rows, walk, len(targets), "purged")))
    return LEAKS[at]


@query
def leakage_real_vs_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leakage_aucs(spark, sf_dir), "auc_real", "auc_dummy", digits=4)


@query
def leakage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.paired_differences(leakage_aucs(spark, sf_dir).where("label > 0"), ["scheme"], "auc_real", "auc_dummy")
    return rounded(out, "mean_diff", "std_diff", digits=4)


@query
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir)
    return metrics.permutation_summary(metrics.auc(rows).first()["auc"], metrics.permutation_aucs(rows))


def scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir)
    return rows.join(F.broadcast(cv.day_table(rows).select("day", "ordinal")), "day")


#: Predictions before and after calibration.
CALIBRATED = ("y_pred_raw", "y_pred_calibrated")


def settled(df: DataFrame, digits: int = 6) -> DataFrame:
    """rounded predictions before and after calibration; shares that lie just between two roundings go up."""
    return rounded(df.withColumn(CALIBRATED[1], F.col(CALIBRATED[1]) + 1e-11), *CALIBRATED, digits=digits)


def renumbered(part: DataFrame) -> DataFrame:
    """Rows with pos counted anew from 0 in the order they have."""
    return positions(part.withColumnRenamed("pos", "at"), ["at"], F.floor(F.col("at") / 100_000))


@query
def isotonic_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(calibrate.isotonic_static(scored_events(spark, sf_dir)))


@query
def isotonic_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir).withColumn("elevated_prob", F.pmod(F.col("pos") * 7919, F.lit(1000)) / 1000)
    middle = quantiles(rows, "elevated_prob", [0.5]).first()["q"]
    return settled(calibrate.isotonic_by_regime(rows, "elevated_prob", middle, renumbered))


@query
def isotonic_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(calibrate.isotonic_walk_forward(scored_days(spark, sf_dir), window=5))


@query
def isotonic_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day calibrated on all days before it."""
    return settled(calibrate.isotonic_walk_forward(scored_days(spark, sf_dir)))


@query
def platt_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(calibrate.platt_walk_forward(scored_days(spark, sf_dir)))


def standardized_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realized.standardized(hourly(spark, sf_dir)).where("z IS NOT NULL")


FITS: dict[tuple[str, str], DataFrame] = {}


def fitted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of two to five states with five restarts, the best of each number marked; fitted once in a session and stored."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in FITS:
        FITS[at] = stored(regimes.best_models(regimes.fit_hmm(standardized_series(spark, sf_dir), "z", [2, 3, 4, 5])))
    return FITS[at]


@query
def hmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted_models(spark, sf_dir)


@query
def hmm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.decode(standardized_series(spark, sf_dir), fitted_models(spark, sf_dir).where("chosen"), "z")


def fitted_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter parameters of the chosen model: variances in the returns' units, noise of the ticks in each decoded state."""
    series, chosen = standardized_series(spark, sf_dir), fitted_models(spark, sf_dir).where("chosen")
    states = regimes.decode(series, chosen, "z").withColumn("state", F.col("state").cast("int"))
    scale = series.groupBy("symbol").agg(F.first("scale").alias("scale"))
    models = regimes.rescaled(chosen.join(scale, "symbol"), F.col("scale"))
    return parameters.parameter_table(models, noise.roll_by_state(event_ticks(spark, sf_dir), stored(states), HOUR, LEAST_PAIRS))


@query
def fitted_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen model of each symbol as filter parameters, with the horizon of its elevated states."""
    found = stored(fitted_parameters(spark, sf_dir))
    return parameters.by_state(found).join(found.select("symbol", "horizon"), "symbol")


@query
def fitted_imm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interacting filter with each symbol's fitted regimes: elevated probability of every bar."""
    out = filtered(log_prices(spark, sf_dir), stored(fitted_parameters(spark, sf_dir)))
    return out.select("symbol", "bin", "x_filt", "p_filt", "elevated_prob")


@query
def fitted_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean elevated probability before, early in and late in the event, under the fitted regimes."""
    out = fitted_imm(spark, sf_dir).withColumn("phase", phase(F.col("bin") * HOUR, EVENT)).where("phase IS NOT NULL")
    return out.groupBy("symbol", "phase").agg(F.avg("elevated_prob").alias("persistence"))


HIDDEN = [16, 32, 64]


@query
def mlp_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, log score, folds and seconds of logistic regression and networks of three widths, with AUC differences from the former.

    mlp: mini-batches with L2, early stopping on a random tenth; net: full batches, early stopping on the last rows in time.
    Networks of a kind are trained together, so each has the kind's seconds.
    """
    rows = model_rows(spark, sf_dir, ["real_label"])
    folds, width = models.day_folds(rows, PURGE), len(FEATURES)
    makers = {
        "lr": lambda: {"lr": models.logistic_oof(rows, folds, 1, width)},
        "mlp": lambda: {f"mlp_{h}": oof for h, oof in models.minibatch_oof(rows, folds, width, HIDDEN).items()},
        "net": lambda: {f"net_{h}": oof for h, oof in models.mlp_oof(rows, folds, width, HIDDEN).items()},
    }
    found = None
    for make in makers.values():
        began = time.time()
        oofs = make()
        took = time.time() - began
        for name, oof in oofs.items():
            one = oof.withColumn("model", F.lit(name)).withColumn("seconds", F.lit(took))
            found = one if found is None else found.unionByName(one)
    found = stored(found)
    scores = metrics.auc(found, ["model"]).join(metrics.proper_scores(found, ["model"]).select("model", "n", "log_score"), "model")
    each = scores.join(found.groupBy("model").agg(F.countDistinct("fold").alias("n_folds"), F.first("seconds").alias("seconds")), "model")
    base = each.where("model = 'lr'").select(F.col("auc").alias("lr_auc"))
    return each.crossJoin(F.broadcast(base)).select("model", "n", "auc", "log_score", "n_folds", "seconds", (F.col("auc") - F.col("lr_auc")).alias("auc_diff"))


@query
def slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of each symbol in three kinds of date slice: up to the last day's end, that end included, and whole days."""
    us = F.col("us")
    kinds = {"half_open": half_open, "closed": closed, "whole_days": day_between}
    found = [F.count_if(f(us, *SLICE)).alias(name) for name, f in kinds.items()]
    return event_ticks(spark, sf_dir).groupBy("symbol").agg(*found)


@query
def day_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which each symbol has ticks, apart from the days of SLICE (difference) and of those only (intersection)."""
    ticks = event_ticks(spark, sf_dir)
    days = ticks.groupBy("symbol", day_of(F.col("us")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    excluded = ticks.where(day_between(F.col("us"), *SLICE)).select(day_of(F.col("us")).alias("day")).distinct()
    apart = days.join(excluded, "day", "left_anti").withColumn("kind", F.lit("difference"))
    return apart.unionByName(days.join(excluded, "day", "left_semi").withColumn("kind", F.lit("intersection")))


@query
def flagged_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the bars of the last six hours whose return is beyond LARGE."""
    flagged = hourly(spark, sf_dir).where("r IS NOT NULL").select("symbol", "bin", (F.abs("r") > LARGE).cast("double").alias("flag"))
    return rounded(over_halo(flagged, {"share": lambda w: F.avg("flag").over(w.rangeBetween(-5, 0))}, back=5), "share")
