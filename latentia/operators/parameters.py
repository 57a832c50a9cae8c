"""From regimes to filter parameters: states, transitions, noise of each state, process noise, horizon.

A parameter table has one row per symbol: variances, q, r (arrays by state), pi (array of rows), elevated (the states
above the median variance), horizon.  It joins back to series by symbol; its size is the number of symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.functions.expr import horizon_of, not_negative
from latentia.operators.chunks import CHUNK, chunk_of
from latentia.operators.noise import process_noise
from latentia.operators.order import with_neighbour
from latentia.operators.regimes import above_median


def level(r: Column, edges: list[float]) -> Column:
    """How many edges the size of a return reaches."""
    reached = [(F.abs(r) >= e).cast("int") for e in edges]
    return sum(reached[1:], reached[0])


def observed_models(returns: DataFrame, edges: list[float]) -> tuple[DataFrame, DataFrame]:
    """States by the size of returns, and their models as if fitted.

    First symbol, bin, state; then symbol, k, variances (0 where a state has no bar), transition (counts plus one, over their sums).
    """
    k = len(edges) + 1
    states = returns.where("r IS NOT NULL").select("symbol", "bin", "r", level(F.col("r"), edges).alias("state"))
    moves = with_neighbour(states, ["state"], ["bin"], chunk_of("bin", CHUNK)).where("prev_state IS NOT NULL")
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))  # noqa: E731 - k or k * k entries
    counts = moves.groupBy("symbol", (F.col("prev_state") * k + F.col("state")).alias("move")).agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(entries("move", "n").alias("moves"))
    spread = states.groupBy("symbol", "state").agg(F.var_pop("r").alias("v")).groupBy("symbol").agg(entries("state", "v").alias("spread"))
    numbers = F.sequence(F.lit(0), F.lit(k - 1))
    seen = F.transform(numbers, lambda i: F.transform(numbers, lambda j: F.coalesce(F.try_element_at("moves", i * k + j), F.lit(0)) + 1))
    shares = F.transform(seen, lambda row: F.transform(row, lambda n: n / F.aggregate(row, F.lit(0).cast("long"), lambda t, x: t + x)))
    models = spread.join(counts, "symbol", "left").withColumn("moves", F.coalesce("moves", F.create_map().cast("map<int,bigint>")))
    variances = F.transform(numbers, lambda i: F.coalesce(F.try_element_at("spread", i), F.lit(0.0)))
    return states.drop("r"), models.select("symbol", F.lit(k).alias("k"), variances.alias("variances"), shares.alias("transition"))


def parameter_table(models: DataFrame, noise: DataFrame) -> DataFrame:
    """symbol, variances, q, r, n_pairs, pi, elevated, horizon.

    models: symbol, variances (of returns, in their units), transition; noise: symbol, state, n_pairs, r_noise.  A missing, null or
    negative noise counts as 0; q is the variance less twice the noise, 1e-15 at least.
    """
    each = models.select("symbol", F.posexplode("variances").alias("state", "variance")).join(noise.select("symbol", "state", "n_pairs", "r_noise"), ["symbol", "state"], "left")
    one = F.struct("state", "variance", process_noise(F.col("variance"), F.col("r_noise")).alias("q"), not_negative(F.col("r_noise")).alias("r"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))
    packed = each.groupBy("symbol").agg(F.array_sort(F.collect_list(one)).alias("s")).join(models.select("symbol", F.col("transition").alias("pi")), "symbol")
    arrays = packed.select("symbol", *[F.col(f"s.{c}").alias(out) for c, out in (("variance", "variances"), ("q", "q"), ("r", "r"), ("n_pairs", "n_pairs"))], "pi")
    named = arrays.withColumn("elevated", above_median(F.col("variances")))
    return named.withColumn("horizon", horizon_of(F.col("pi"), F.col("elevated"))["h"])


def by_state(parameters: DataFrame) -> DataFrame:
    """symbol, state, variance, n_pairs, r_noise, q, elevated, stays (probability of staying), sticky (above 0.9): a row per state."""
    zipped = F.posexplode(F.arrays_zip("variances", "q", "r", "n_pairs", "pi"))
    rows = parameters.select("symbol", "elevated", zipped.alias("state", "s"))
    stays = F.get(F.col("s.pi"), F.col("state"))
    return rows.select("symbol", "state", F.col("s.variances").alias("variance"), F.col("s.n_pairs").alias("n_pairs"), F.col("s.r").alias("r_noise"), F.col("s.q").alias("q"), F.array_contains("elevated", F.col("state")).alias("elevated"), stays.alias("stays"), (stays > 0.9).alias("sticky"))
