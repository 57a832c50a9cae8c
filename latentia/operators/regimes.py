"""Gaussian hidden Markov models per series: all models of a symbol fitted at once, decoding in chunks, selection by BIC.

Models of 2 to 5 states and their restarts are one array axis (states padded to the most), and a series is cut into
segments, a second axis.  The forward operator of a segment is the product of its steps' matrices; a scan over these
products gives each segment the state it starts from, so the steps inside segments run for all segments and models together.
Series of up to ``ROWS`` bars are fitted in a task each.  Of a longer one, each chunk is a task: a pass over the chunks
makes their operators, one over chunks and scan adds up the expected counts, and only these sums meet.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.operators.chunks import chunked, prefixes, product
from latentia.session import stored

FIT = "symbol string, k int, restart int, n long, ll double, iterations int, means array<double>, variances array<double>, transition array<array<double>>"
#: Bars of a series that one task fits.
ROWS = 1 << 17
#: Bars of a chunk of a longer series, and of a chunk that is decoded.
CHUNK_ROWS, DECODE = 1 << 15, 4096
FLOOR = 1e-6
TINY = 1e-300


class Models(NamedTuple):
    """M models padded to K states: means, variances (M, K), transitions (M, K, K), start (M, K), which states are real."""

    means: np.ndarray
    variances: np.ndarray
    a: np.ndarray
    start: np.ndarray
    real: np.ndarray


def log_density(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * variances) + (x - means) ** 2 / variances)


def first_guess(mean: float, variance: float, quantiles: dict[int, np.ndarray], states: list[int], restarts: int, seed: int) -> Models:
    """Means near the quantiles at (i + 1/2) / k, variances between 0.2 and 2 times the series'; drawn from seed + restart."""
    most = max(states)
    shape = (len(states) * restarts, most)
    means, variances, start, real = np.zeros(shape), np.ones(shape), np.zeros(shape), np.zeros(shape, bool)
    a = np.tile(np.eye(most), (shape[0], 1, 1))
    for m, (k, restart) in enumerate((k, r) for k in states for r in range(restarts)):
        rng = np.random.default_rng(seed + restart)
        means[m, :k] = quantiles[k] + rng.normal(0, 0.05 * np.sqrt(variance) + 1e-12, k)
        variances[m, :k] = np.maximum(variance * rng.uniform(0.2, 2.0, k), FLOOR)
        a[m, :k, :k] = 0.1 / max(k - 1, 1)
        a[m, range(k), range(k)] = 0.9 if k > 1 else 1.0
        start[m, :k], real[m, :k] = 1 / k, True
    return Models(means, variances, a, start, real)


def quantile_points(k: int) -> np.ndarray:
    return (np.arange(k) + 0.5) / k


class Blocks(NamedTuple):
    """A run of bars as (steps, segments), the last segment filled up; first says whether the series begins here."""

    x: np.ndarray
    used: np.ndarray
    first: bool


def blocks(x: np.ndarray, first: bool) -> Blocks:
    length = max(int(np.sqrt(len(x))), 1)
    segments = -(-len(x) // length)
    padded = np.concatenate([x, np.zeros(segments * length - len(x))]).reshape(segments, length).T
    used = (np.arange(segments * length) < len(x)).reshape(segments, length).T
    return Blocks(padded, used, first)


def likelihoods(b: Blocks, m: Models) -> tuple[np.ndarray, np.ndarray]:
    """Densities (steps, M, segments, K) over the largest of each step's, and the sums (M) of the logarithms of those."""
    logs = log_density(b.x[:, None, :, None], m.means[:, None], m.variances[:, None])
    logs += np.where(m.real, 0.0, -np.inf)[:, None]
    top = logs.max(-1)
    return np.exp(logs - top[..., None]), (top * b.used[:, None]).sum((0, 2))


def operators(b: Blocks, m: Models, dense: np.ndarray) -> np.ndarray:
    """(segments, M, K, K): each segment's product of transitions and densities, scaled so that its largest entry is 1.

    No transition leads into a series' first bar; steps beyond the end, which only the last segment has, change nothing.
    """
    (models, k), segments = m.means.shape, b.x.shape[1]
    out = m.a[:, None] * dense[0][:, :, None, :]
    if b.first:
        out[:, 0] = np.eye(k) * dense[0][:, 0, None, :]
    for step in range(1, len(b.x)):
        new = (out.reshape(models, -1, k) @ m.a).reshape(models, segments, k, k) * dense[step][:, :, None, :]
        new /= np.maximum(new.max((-2, -1), keepdims=True), TINY)
        if not b.used[step, -1]:
            new[:, -1] = out[:, -1]
        out = new
    return out.swapaxes(0, 1)


def scan_forward(row: np.ndarray, ops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State rows (M, K) before each segment, summing to 1, and after the last."""
    out = np.empty((len(ops), *row.shape))
    for s, op in enumerate(ops):
        out[s] = row
        row = (row[:, None, :] @ op)[:, 0]
        row = row / np.maximum(row.sum(-1, keepdims=True), TINY)
    return out, row


def scan_backward(column: np.ndarray, ops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns (M, K) after each segment, and before the first."""
    out = np.empty((len(ops), *column.shape))
    for s in range(len(ops) - 1, -1, -1):
        out[s] = column
        column = (ops[s] @ column[..., None])[..., 0]
        column = column / np.maximum(column.max(-1, keepdims=True), TINY)
    return out, column


class Counts(NamedTuple):
    """Expected counts: log-likelihood (M), weights of the first state, transitions, states, states times x, times x^2."""

    ll: np.ndarray
    first: np.ndarray
    moves: np.ndarray
    mass: np.ndarray
    sx: np.ndarray
    sxx: np.ndarray

    def __add__(self, other: Counts) -> Counts:
        return Counts(*(x + y for x, y in zip(self, other, strict=True)))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])


def unflat(v: np.ndarray, m: int, k: int) -> Counts:
    shapes = [(m,), (m, k), (m, k, k), (m, k), (m, k), (m, k)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return Counts(*(p.reshape(s) for p, s in zip(np.split(v, ends[:-1]), shapes, strict=True)))


def expected(b: Blocks, m: Models, dense: np.ndarray, top: np.ndarray, before: np.ndarray, after: np.ndarray) -> Counts:
    """Counts of a run of bars whose segments start from ``before`` and end before ``after``."""
    steps, (before, after) = len(b.x), (x.swapaxes(0, 1) for x in (before, after))
    alpha, row, ll = np.empty_like(dense), before, top.copy()
    for step in range(steps):
        new = row @ m.a
        if step == 0 and b.first:
            new[:, 0] = row[:, 0]
        new *= dense[step]
        total = np.maximum(new.sum(-1), TINY)
        new /= total[..., None]
        if not b.used[step, -1]:
            new[:, -1], total[:, -1] = row[:, -1], 1.0
        ll += np.log(total).sum(1)
        alpha[step] = row = new
    mass, sx, sxx, first = (np.zeros_like(m.means) for _ in range(4))
    moves, beta, back = np.zeros_like(m.a), after, m.a.swapaxes(1, 2)
    for step in range(steps - 1, -1, -1):
        gamma = alpha[step] * beta
        gamma *= (b.used[step] / np.maximum(gamma.sum(-1), TINY))[..., None]
        x = b.x[step][:, None]
        mass, sx, sxx = mass + gamma.sum(1), sx + (gamma * x).sum(1), sxx + (gamma * x * x).sum(1)
        u = dense[step] * beta
        new = u @ back
        previous = alpha[step - 1] if step else before
        weight = previous * (b.used[step] / np.maximum((previous * new).sum(-1), TINY))[..., None]
        if step == 0 and b.first:
            first = gamma[:, 0]
            weight[:, 0] = 0
        moves += weight.swapaxes(1, 2) @ u
        new /= np.maximum(new.max(-1, keepdims=True), TINY)
        if not b.used[step, -1]:
            new[:, -1] = beta[:, -1]
        beta = new
    return Counts(ll, first, moves * m.a, mass, sx, sxx)


def maximised(m: Models, c: Counts, moving: np.ndarray) -> Models:
    """The next parameters of the models that are still moving."""
    mass = np.maximum(c.mass, 1e-12)
    means = c.sx / mass
    variances = np.maximum(c.sxx / mass - means * means, FLOOR)
    a = c.moves / np.maximum(c.moves.sum(-1, keepdims=True), TINY)
    a = np.where(m.real[:, :, None], a, np.eye(a.shape[-1]))
    keep = moving[:, None]
    return Models(np.where(keep & m.real, means, m.means), np.where(keep & m.real, variances, m.variances), np.where(keep[..., None], a, m.a), np.where(keep, c.first, m.start), m.real)


class Progress:
    """Likelihoods of the models: who still rises by more than tol, and after how many steps each stopped."""

    def __init__(self, m: int, tol: float):
        self.ll, self.iterations, self.moving, self.tol = np.full(m, -np.inf), np.zeros(m, int), np.ones(m, bool), tol

    def seen(self, ll: np.ndarray) -> None:
        self.iterations += self.moving
        still = self.moving & (ll - self.ll >= self.tol)
        self.ll = np.where(self.moving, ll, self.ll)
        self.moving = still


def fitted(x: np.ndarray, states: list[int], restarts: int, seed: int, steps: int, tol: float) -> tuple[Models, Progress]:
    """EM of all models of one series in one task.  Likelihoods never fall (up to the variance floor)."""
    m = first_guess(x.mean(), x.var(), {k: np.quantile(x, quantile_points(k)) for k in states}, states, restarts, seed)
    b, progress = blocks(x, True), Progress(len(m.means), tol)
    while True:
        dense, top = likelihoods(b, m)
        ops = operators(b, m, dense)
        before, _ = scan_forward(m.start, ops)
        after, _ = scan_backward(np.ones_like(m.start), ops)
        counts = expected(b, m, dense, top, before, after)
        progress.seen(counts.ll)
        if not progress.moving.any() or progress.iterations.max() >= steps:
            return m, progress
        m = maximised(m, counts, progress.moving)


def result_rows(symbol: object, n: int, m: Models, progress: Progress, states: list[int], restarts: int) -> pd.DataFrame:
    """A row for each model, its states ordered by variance."""
    rows = []
    for i, (k, restart) in enumerate((k, r) for k in states for r in range(restarts)):
        order = np.argsort(m.variances[i, :k], kind="stable")
        rows.append((symbol, k, restart, n, float(progress.ll[i]), int(progress.iterations[i]), m.means[i, order].tolist(), m.variances[i, order].tolist(), m.a[i][np.ix_(order, order)].tolist()))
    return pd.DataFrame(rows, columns=["symbol", "k", "restart", "n", "ll", "iterations", "means", "variances", "transition"])


def fitted_in_chunks(rows: DataFrame, x: dict, states: list[int], restarts: int, seed: int, steps: int, tol: float) -> tuple[Models, Progress]:
    """EM of one long series: rows (symbol, at, x, __chunk) of it alone, x: its count, mean, variance and quantiles.

    Two jobs an iteration; what reaches the driver is an operator for each chunk and model, and one sum.
    """
    m = first_guess(x["mean"], x["variance"], x["quantiles"], states, restarts, seed)
    progress, (models, most) = Progress(len(m.means), tol), m.means.shape
    chunks = sorted(r[0] for r in rows.select("__chunk").distinct().collect())
    place = {c: i for i, c in enumerate(chunks)}
    shape = (len(chunks), models, most, most)

    def chunk_blocks(part: pd.DataFrame) -> Blocks:
        return blocks(part.sort_values("at")["x"].to_numpy(float), int(part["__chunk"].iloc[0]) == chunks[0])

    while True:
        held = rows.groupBy("__chunk").applyInPandas(chunk_operator(m, chunk_blocks), "__chunk long, v array<double>").collect()
        ops = np.empty(shape)
        for chunk, v in held:
            ops[place[chunk]] = np.reshape(v, shape[1:])
        before, _ = scan_forward(m.start, ops)
        after, _ = scan_backward(np.ones_like(m.start), ops)
        edges = {c: (before[i], after[i]) for c, i in place.items()}
        sums = rows.groupBy("__chunk").applyInPandas(chunk_counts(m, chunk_blocks, edges), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
        counts = unflat(sums["v"].to_numpy(), models, most)
        progress.seen(counts.ll)
        if not progress.moving.any() or progress.iterations.max() >= steps:
            return m, progress
        m = maximised(m, counts, progress.moving)


def chunk_operator(m: Models, chunk_blocks: Callable[[pd.DataFrame], Blocks]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        b = chunk_blocks(part)
        ops = operators(b, m, likelihoods(b, m)[0])
        whole = product(ops.reshape(len(ops), -1), lambda p, q: scaled_product(p, q, *m.means.shape))
        return pd.DataFrame({"__chunk": part["__chunk"].iloc[:1], "v": [whole.tolist()]})

    return run


def chunk_counts(m: Models, chunk_blocks: Callable[[pd.DataFrame], Blocks], edges: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        b = chunk_blocks(part)
        dense, top = likelihoods(b, m)
        inner = operators(b, m, dense)
        row, column = edges[int(part["__chunk"].iloc[0])]
        v = expected(b, m, dense, top, scan_forward(row, inner)[0], scan_backward(column, inner)[0]).flat()
        return pd.DataFrame({"i": np.arange(len(v)), "v": v})

    return run


def scaled_product(p: np.ndarray, q: np.ndarray, models: int, most: int) -> np.ndarray:
    """Rows of operators, multiplied pair by pair and scaled."""
    shape = (len(p), models, most, most)
    out = p.reshape(shape) @ q.reshape(shape)
    return (out / np.maximum(out.max((-2, -1), keepdims=True), TINY)).reshape(len(p), -1)


def fit_hmm(series: DataFrame, value: str, states: list[int], restarts: int = 5, seed: int = 0, steps: int = 500, tol: float = 1e-6, most: int = ROWS) -> DataFrame:
    """One row per (symbol, k, restart); states are ordered by variance.

    Symbols with more than ``most`` bars are fitted one after the other, each over all its chunks.
    """
    rows = stored(series.where(F.col(value).isNotNull()).select("symbol", F.col("bin").alias("at"), F.col(value).cast("double").alias("x")))
    long = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        m, progress = fitted(part["x"].to_numpy(float), states, restarts, seed, steps, tol)
        return result_rows(part["symbol"].iloc[0], len(part), m, progress, states, restarts)

    short = rows if not long else rows.where(~F.col("symbol").isin([r["symbol"] for r in long]))
    spread = short.repartition(2 * series.sparkSession.sparkContext.defaultParallelism, "symbol")  # a number keeps few small symbols apart
    out = spread.groupBy("symbol").applyInPandas(run, FIT)
    for r in long:
        own = rows.where(F.col("symbol") == r["symbol"])
        shares = sorted({float(s) for k in states for s in quantile_points(k)})
        about = own.agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).first()
        known = dict(zip(shares, about["q"], strict=True))
        x = {"mean": about["mean"], "variance": about["variance"], "quantiles": {k: np.array([known[float(s)] for s in quantile_points(k)]) for k in states}}
        m, progress = fitted_in_chunks(chunked(own, "at", min(CHUNK_ROWS, most)), x, states, restarts, seed, steps, tol)
        out = out.unionByName(series.sparkSession.createDataFrame(list(result_rows(r["symbol"], r["n"], m, progress, states, restarts).itertuples(index=False, name=None)), FIT))
    return stored(out)


def bic(ll: Column, k: Column, n: Column) -> Column:
    """-2 ll + p ln n with p = 2k + k(k-1) + (k-1)."""
    return -2 * ll + (2 * k + k * (k - 1) + (k - 1)) * F.ln(n)


def best_models(fits: DataFrame) -> DataFrame:
    """The restart of highest likelihood for each (symbol, k), with its BIC, and whether it has the symbol's least."""
    best = fits.groupBy("symbol", "k").agg(F.max_by(F.struct(*[c for c in fits.columns if c not in ("symbol", "k")]), F.struct("ll", -F.col("restart"))).alias("m")).select("symbol", "k", "m.*")
    scored = best.withColumn("bic", bic(F.col("ll"), F.col("k"), F.col("n")))
    least = scored.groupBy("symbol").agg(F.min_by("k", F.struct("bic", "k")).alias("chosen_k"))
    return scored.join(least, "symbol").withColumn("chosen", F.col("k") == F.col("chosen_k")).drop("chosen_k")


def above_median(variances: Column) -> Column:
    """0-based states whose variance exceeds the median variance: a set for each model, never fixed numbers."""
    s = F.array_sort(variances)
    n = F.size(s)
    lower, upper = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    numbers = F.sequence(F.lit(0), n - 1)
    return F.filter(numbers, lambda i: F.get(variances, i) > (lower + upper) / 2)


def best_sums(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rows of K x K matrices under (max, +): the best score from state i to state j over both."""
    k = int(np.sqrt(first.shape[1]))
    p, q = first.reshape(-1, k, k), second.reshape(-1, k, k)
    return (p[:, :, :, None] + q[:, None]).max(2).reshape(len(p), -1)


def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rows of maps from states to states: the first, then the second."""
    return np.take_along_axis(second, first.astype(int), 1)


def decode(series: DataFrame, models: DataFrame, value: str, width: int = DECODE) -> DataFrame:
    """symbol, bin, state by Viterbi; models: symbol, means, variances, transition (one row per symbol).

    Best scores of chunks are matrices under (max, +), whose scan gives each chunk the scores it starts from; each chunk then
    knows from which state it came into each of its last states, and a scan of these maps from the end gives its last
    state.  Three passes over the bars, none with a symbol in one task.
    """
    used = series.where(F.col(value).isNotNull()).select("symbol", F.col("bin").alias("at"), F.col(value).cast("double").alias("x"))
    rows = chunked(used.join(models.select("symbol", "means", "variances", "transition"), "symbol"), "at", width)
    least = rows.groupBy("symbol").agg(F.min("__chunk").alias("__least"))

    def scores(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        m = part.iloc[0]
        logb = log_density(part["x"].to_numpy(float)[:, None], np.array(m["means"]), np.array(m["variances"]))
        return logb, np.log(np.maximum(np.array([list(r) for r in m["transition"]]), TINY))

    def walked(row: np.ndarray, logb: np.ndarray, loga: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back pointers of all steps but those of a start, and the last scores."""
        back = np.zeros(logb.shape, np.int64)
        for t, b in enumerate(logb):
            step = row[:, None] + loga
            back[t] = step.argmax(0)
            row = step.max(0) + b
        return back, row

    def entered(part: pd.DataFrame, start: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Back pointers from a chunk's rows to the state before each, and the scores at its end."""
        logb, loga = scores(part)
        before = start["before"].iloc[0]
        if before is not None:
            return walked(np.asarray(before), logb, loga)
        back, row = walked(logb[0] - np.log(logb.shape[1]), logb[1:], loga)
        return np.concatenate([np.zeros((1, logb.shape[1]), np.int64), back]), row

    def matrix(part: pd.DataFrame) -> pd.DataFrame:
        """A chunk's best scores from the state before it, and, for a series' first chunk, from any: all rows alike."""
        part = part.sort_values("at")
        logb, loga = scores(part)
        k = logb.shape[1]
        e = product((loga[None] + logb[:, None, :]).reshape(len(part), -1), best_sums)
        first = logb[0] - np.log(k)
        if len(part) > 1:
            rest = product((loga[None] + logb[1:, None, :]).reshape(len(part) - 1, -1), best_sums).reshape(k, k)
            first = (first[:, None] + rest).max(0)
        return pd.DataFrame({"symbol": part["symbol"].iloc[:1], "__chunk": part["__chunk"].iloc[:1], "e": [e.tolist()], "first": [np.tile(first, k).tolist()]})

    made = stored(rows.groupBy("symbol", "__chunk").applyInPandas(matrix, "symbol string, __chunk long, e array<double>, first array<double>"))
    started = made.join(least, "symbol").select("symbol", "__chunk", F.when(F.col("__chunk") == F.col("__least"), F.col("first")).otherwise(F.col("e")).alias("e"))
    scored = prefixes(stored(started), best_sums).withColumn("before", F.slice("before", F.lit(1), F.sqrt(F.size("before")).cast("int")))
    scored = stored(scored)

    def maps(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        """The state before the chunk for each state at its end, and the best state at its end."""
        part = part.sort_values("at")
        back, row = entered(part, start)
        at = np.arange(back.shape[1])
        for step in back[::-1]:
            at = step[at]
        return pd.DataFrame({"symbol": part["symbol"].iloc[:1], "__chunk": -part["__chunk"].iloc[:1], "e": [at.astype(float).tolist()], "last": [np.full(len(at), row.argmax(), float).tolist()]})

    ends = stored(rows.groupBy("symbol", "__chunk").cogroup(scored.groupBy("symbol", "__chunk")).applyInPandas(maps, "symbol string, __chunk long, e array<double>, last array<double>"))
    final = ends.groupBy("symbol").agg(F.min("__chunk").alias("__first"), F.min_by("last", "__chunk").alias("__state"))
    # from the end of the series: the best last state, taken back through the chunks
    chosen = prefixes(stored(ends.join(final, "symbol").select("symbol", "__chunk", F.when(F.col("__chunk") == F.col("__first"), F.transform("__state", lambda s: F.get("e", s.cast("int")))).otherwise(F.col("e")).alias("e"))), then)
    last = chosen.join(final, "symbol").select("symbol", (-F.col("__chunk")).alias("__chunk"), F.coalesce(F.col("before"), F.col("__state"))[0].cast("int").alias("last"))
    given = stored(scored.join(last, ["symbol", "__chunk"]))

    def path(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        back, _ = entered(part, start)
        out = np.empty(len(part), np.int64)
        out[-1] = start["last"].iloc[0]
        for t in range(len(part) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return pd.DataFrame({"symbol": part["symbol"], "bin": part["at"], "state": out})

    return rows.groupBy("symbol", "__chunk").cogroup(given.groupBy("symbol", "__chunk")).applyInPandas(path, "symbol string, bin long, state long")


def rescaled(models: DataFrame, scale: Column) -> DataFrame:
    """Means and variances back in the units of the returns."""
    return models.withColumn("means", F.transform("means", lambda m: m * scale)).withColumn("variances", F.transform("variances", lambda v: v * scale * scale))
