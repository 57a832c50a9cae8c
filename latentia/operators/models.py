"""Classifiers under cross-validation, all folds fitted together.

A fold's training rows are never gathered: each pass over the rows adds up gradients for every (fold, label) where the
rows are, and only those sums (folds x labels x parameters) reach the driver, which takes the step.  The number of
folds is bounded by the calendar or by k.

Rows: pos (0-based), x (array of double), ys (array of double, one entry per label column, null where undefined), and
embargoed; ``rank`` numbers the rows outside the embargo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.operators.cv import embargoed_rows, walk_forward_folds
from latentia.operators.order import positions
from latentia.session import stored

Sums = Callable[[np.ndarray, np.ndarray, np.ndarray, int, int], np.ndarray]


class Folds(NamedTuple):
    """Test ranges lo..hi; training rows lie before lo - purge (walk forward) or anywhere outside the range."""

    ids: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    purge: int | None

    def training(self, f: int, pos: np.ndarray, embargoed: np.ndarray) -> np.ndarray:
        if self.purge is None:
            return (pos < self.lo[f]) | (pos > self.hi[f])
        return (pos < self.lo[f] - self.purge) & ~embargoed

    def testing(self, f: int, pos: np.ndarray) -> np.ndarray:
        return (pos >= self.lo[f]) & (pos <= self.hi[f])


def k_folds(n: int, k: int) -> Folds:
    bounds = np.array([int(i * n / k) for i in range(k + 1)])
    return Folds(np.arange(k), bounds[:-1], bounds[1:] - 1, None)


def day_folds(rows: DataFrame, purge: int) -> Folds:
    t = walk_forward_folds(rows).orderBy("fold").collect()
    return Folds(*(np.array([r[c] for r in t], np.int64) for c in ("fold", "test_lo", "test_hi")), purge)


def prepared(dataset: DataFrame, features: list[str], labels: list[str], embargo: int, chunk: Column) -> DataFrame:
    """pos, day, x, ys, embargoed, rank from a dataset with pos and day."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    ys = F.array(*[F.col(c).cast("double") for c in labels])
    rows = embargoed_rows(dataset.select("pos", "day", x.alias("x"), ys.alias("ys")), embargo)
    ranks = positions(rows.where(~F.col("embargoed")).select("pos"), ["pos"], chunk, name="rank")
    return rows.join(ranks, "pos", "left").select("pos", "day", "x", "ys", "embargoed", "rank")


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    wide = lambda c: np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)
    rank = batch.column("rank").fill_null(-1).to_numpy()
    return batch.column("pos").to_numpy(), wide("x"), wide("ys"), batch.column("embargoed").to_numpy(zero_copy_only=False), rank


def fold_sums(rows: DataFrame, folds: Folds, n_labels: int, sums: Sums) -> np.ndarray:
    """sums(x, y, rank, f, label) added up over the training rows of every fold and label: (folds, labels, width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, x, ys, embargoed, rank = unpacked(batch)
            for f in range(len(folds.ids)):
                own = folds.training(f, pos, embargoed)
                for j in range(n_labels):
                    use = own & ~np.isnan(ys[:, j])
                    if use.any():
                        held[f, j] = held.get((f, j), 0) + sums(x[use], ys[use, j], rank[use], f, j)
        for (f, j), v in held.items():
            n = len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v.astype(float))], names=["f", "j", "i", "v"])

    got = rows.select("pos", "x", "ys", "embargoed", "rank").mapInArrow(run, "f int, j int, i int, v double").groupBy("f", "j", "i").agg(F.sum("v").alias("v")).toArrow()
    f, j, i, v = (got.column(c).to_numpy() for c in "fjiv")
    out = np.zeros((len(folds.ids), n_labels, int(i.max()) + 1 if len(i) else 0))
    out[f, j, i] = v
    return out


class Scaled(NamedTuple):
    """Per fold and label: rows, positives, population mean and deviation of the features (1 where it is 0)."""

    n: np.ndarray
    positive: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Both classes occur; other folds are not fitted."""
        return (self.positive > 0) & (self.positive < self.n)


def scaling(rows: DataFrame, folds: Folds, n_labels: int, width: int) -> Scaled:
    s = fold_sums(rows, folds, n_labels, lambda x, y, rank, f, j: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))
    if not s.shape[2]:
        s = np.zeros((len(folds.ids), n_labels, 2 + 2 * width))
    n = np.maximum(s[:, :, :1], 1)
    mean = s[:, :, 2 : 2 + width] / n
    var = np.maximum(s[:, :, 2 + width :] / n - mean * mean, 0)
    return Scaled(s[:, :, 0], s[:, :, 1], mean, np.where(var > 1e-24 * (1 + mean * mean), np.sqrt(var), 1.0))


def fit_logistic(rows: DataFrame, folds: Folds, n_labels: int, width: int, c: float = 1.0, standardize: bool = True, steps: int = 12, tol: float = 1e-8) -> tuple[np.ndarray, Scaled]:
    """Weights (folds, labels, 1 + width; intercept first) of L2-penalised logistic regression by Newton steps."""
    s = scaling(rows, folds, n_labels, width)
    if not standardize:
        s = s._replace(mean=np.zeros_like(s.mean), scale=np.ones_like(s.scale))
    w = np.zeros((len(folds.ids), n_labels, 1 + width))
    ridge = np.diag([0.0] + [1 / c] * width)
    for _ in range(steps):

        def sums(x: np.ndarray, y: np.ndarray, rank: np.ndarray, f: int, j: int) -> np.ndarray:
            z = np.column_stack([np.ones(len(x)), (x - s.mean[f, j]) / s.scale[f, j]])
            p = 1 / (1 + np.exp(-np.clip(z @ w[f, j], -40, 40)))
            return np.concatenate([z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        got = fold_sums(rows, folds, n_labels, sums)
        largest = 0.0
        for f, j in zip(*np.nonzero(s.usable), strict=True):
            g, h = got[f, j, : 1 + width], got[f, j, 1 + width :].reshape(1 + width, -1)
            step = np.linalg.solve(h + ridge + 1e-12 * np.eye(1 + width), g + ridge @ w[f, j])
            w[f, j] = w[f, j] - step
            largest = max(largest, float(np.abs(step).max()))
        if largest < tol:
            break
    return w, s


Predict = Callable[[np.ndarray, int, int], np.ndarray]


def out_of_fold(rows: DataFrame, folds: Folds, n_labels: int, usable: np.ndarray, predict: Predict) -> DataFrame:
    """pos, label, fold, y_true, y_pred for the test rows of every fitted fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, x, ys, _, _ = unpacked(batch)
            for f in range(len(folds.ids)):
                own = folds.testing(f, pos)
                for j in range(n_labels):
                    use = own & ~np.isnan(ys[:, j])
                    if use.any() and usable[f, j]:
                        m = int(use.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(pos[use]), pa.array(np.full(m, j, np.int32)), pa.array(np.full(m, folds.ids[f], np.int32)), pa.array(ys[use, j]), pa.array(predict(x[use], f, j).astype(float))], names=["pos", "label", "fold", "y_true", "y_pred"])

    return rows.select("pos", "x", "ys", "embargoed", "rank").mapInArrow(run, "pos long, label int, fold int, y_true double, y_pred double")


def logistic_oof(rows: DataFrame, folds: Folds, n_labels: int, width: int, **options: object) -> DataFrame:
    """Out-of-fold probabilities of scaled logistic regression; folds with one class are skipped."""
    w, s = fit_logistic(rows, folds, n_labels, width, **options)

    def predict(x: np.ndarray, f: int, j: int) -> np.ndarray:
        z = (x - s.mean[f, j]) / s.scale[f, j] @ w[f, j, 1:] + w[f, j, 0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    return out_of_fold(rows, folds, n_labels, s.usable, predict)


def prior_oof(rows: DataFrame, folds: Folds, n_labels: int, width: int) -> DataFrame:
    """Out-of-fold predictions of the training mean."""
    s = scaling(rows, folds, n_labels, width)
    rate = s.positive / np.maximum(s.n, 1)
    return out_of_fold(rows, folds, n_labels, s.n > 0, lambda x, f, j: np.full(len(x), rate[f, j]))


class Net(NamedTuple):
    """One hidden ReLU layer for each fold: parameters in one row."""

    width: int
    hidden: int

    @property
    def size(self) -> int:
        return self.hidden * (self.width + 2) + 1

    def parts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        a, h = self.width * self.hidden, self.hidden
        return v[:a].reshape(self.width, h), v[a : a + h], v[a + h : a + 2 * h], float(v[-1])

    def start(self, rng: np.random.Generator) -> np.ndarray:
        a, b = 1 / np.sqrt(self.width), 1 / np.sqrt(self.hidden)
        return np.concatenate([rng.uniform(-a, a, self.hidden * (self.width + 1)), rng.uniform(-b, b, self.hidden + 1)])

    def logits(self, v: np.ndarray, z: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(v)
        return np.maximum(z @ w1 + b1, 0) @ w2 + b2

    def gradient(self, v: np.ndarray, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(v)
        a = np.maximum(z @ w1 + b1, 0)
        d = 1 / (1 + np.exp(-np.clip(a @ w2 + b2, -40, 40))) - y
        back = (d[:, None] * w2) * (a > 0)
        return np.concatenate([(z.T @ back).ravel(), back.sum(0), a.T @ d, [d.sum()]])


def mlp_oof(rows: DataFrame, folds: Folds, width: int, hiddens: list[int], epochs: int = 100, patience: int = 10, min_delta: float = 1e-4, rate: float = 1e-3, seed: int = 0) -> dict[int, DataFrame]:
    """Out-of-fold probabilities of ReLU networks by their hidden units: full-batch Adam, early stopping on the last training rows in time.

    The validation tail starts at max(int(0.85 n), n - 2000); where the head has one class, all rows train.  An epoch is one
    pass over the rows for all folds and widths.
    """
    s, nets = scaling(rows, folds, 1, width), {h: Net(width, h) for h in hiddens}
    n = s.n[:, 0].astype(int)
    tail = np.maximum((0.85 * n).astype(int), n - 2000)
    head = fold_sums(rows, folds, 1, lambda x, y, rank, f, j: np.array([(rank < tail[f]).sum(), y[rank < tail[f]].sum()]))
    head = head[:, 0] if head.shape[2] else np.zeros((len(n), 2))
    tail = np.where((head[:, 1] > 0) & (head[:, 1] < head[:, 0]), tail, n)
    v = {h: np.tile(net.start(np.random.default_rng(seed)), (len(n), 1)) for h, net in nets.items()}
    best, m1, m2 = {h: x.copy() for h, x in v.items()}, {h: np.zeros_like(x) for h, x in v.items()}, {h: np.zeros_like(x) for h, x in v.items()}
    least, waited, alive = {h: np.full(len(n), np.inf) for h in hiddens}, {h: np.zeros(len(n), int) for h in hiddens}, {h: s.usable[:, 0].copy() for h in hiddens}
    for t in range(1, epochs + 1):
        if not any(alive[h].any() for h in hiddens):
            break

        def sums(x: np.ndarray, y: np.ndarray, rank: np.ndarray, f: int, j: int) -> np.ndarray:
            z = (x - s.mean[f, 0]) / (s.scale[f, 0] + 1e-8)
            fit = rank < tail[f]
            test = ~fit if tail[f] < n[f] else fit
            out = []
            for h, net in nets.items():
                if not alive[h][f]:
                    out.append(np.zeros(net.size + 3))
                    continue
                o = net.logits(v[h][f], z[test])
                loss = (np.maximum(o, 0) - o * y[test] + np.log1p(np.exp(-np.abs(o)))).sum()
                out += [net.gradient(v[h][f], z[fit], y[fit]), [fit.sum(), loss, test.sum()]]
            return np.concatenate(out)

        got, at = fold_sums(rows, folds, 1, sums)[:, 0], 0
        for h, net in nets.items():
            own = got[:, at : at + net.size + 3]
            at += net.size + 3
            for f in np.flatnonzero(alive[h]):
                loss = own[f, -2] / max(own[f, -1], 1)
                if loss < least[h][f] - min_delta:
                    least[h][f], waited[h][f], best[h][f] = loss, 0, v[h][f]
                else:
                    waited[h][f] += 1
                    alive[h][f] = waited[h][f] < patience
                g = own[f, : net.size] / max(own[f, -3], 1)
                m1[h][f], m2[h][f] = 0.9 * m1[h][f] + 0.1 * g, 0.999 * m2[h][f] + 0.001 * g * g
                v[h][f] = v[h][f] - rate * (m1[h][f] / (1 - 0.9**t)) / (np.sqrt(m2[h][f] / (1 - 0.999**t)) + 1e-8)

    def predictor(h: int) -> Predict:
        def predict(x: np.ndarray, f: int, j: int) -> np.ndarray:
            o = nets[h].logits(best[h][f], (x - s.mean[f, 0]) / (s.scale[f, 0] + 1e-8))
            return 1 / (1 + np.exp(-np.clip(o, -40, 40)))

        return predict

    return {h: out_of_fold(rows, folds, 1, s.usable, predictor(h)) for h in hiddens}


class MiniBatch(NamedTuple):
    """Settings of mini-batch training: rows a step, penalty, Adam's rate, patience and least gain in validation accuracy, most epochs."""

    batch: int = 200
    alpha: float = 1e-4
    rate: float = 1e-3
    tenth: float = 0.1
    patience: int = 10
    tol: float = 1e-4
    epochs: int = 500
    seed: int = 0
    shard: int = 100_000


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of row numbers, anew for each salt (a Weyl step and the finaliser of splitmix64)."""
    h = x.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def held_back(pos: np.ndarray, o: MiniBatch) -> np.ndarray:
    """A random tenth of the rows, the same in every fold."""
    return mixed(pos, o.seed) < np.uint64(int(o.tenth * 2**64))


def glorot(net: Net, seed: int) -> np.ndarray:
    """First weights and biases, uniform within sqrt(6 / (in + out)) of a ReLU layer and sqrt(2 / (in + out)) of a sigmoid output."""
    rng = np.random.default_rng(seed)
    a, b = np.sqrt(6 / (net.width + net.hidden)), np.sqrt(2 / (net.hidden + 1))
    return np.concatenate([rng.uniform(-a, a, net.hidden * (net.width + 1)), rng.uniform(-b, b, net.hidden + 1)])


def penalised(net: Net) -> np.ndarray:
    """1 for weights, 0 for biases."""
    a, h = net.width * net.hidden, net.hidden
    return np.concatenate([np.ones(a), np.zeros(h), np.ones(h), [0.0]])


def adam_epoch(net: Net, state: np.ndarray, z: np.ndarray, y: np.ndarray, pos: np.ndarray, epoch: int, o: MiniBatch) -> np.ndarray:
    """One epoch over rows in the order of their hashes for this epoch, ``batch`` rows a step; state: v, m1, m2, number of steps."""
    n, order = net.size, np.argsort(mixed(pos, o.seed + epoch), kind="stable")
    v, m1, m2, t = state[:n].copy(), state[n : 2 * n].copy(), state[2 * n : 3 * n].copy(), state[-1]
    shrink = o.alpha * penalised(net)
    for i in range(0, len(order), o.batch):
        use = order[i : i + o.batch]
        t += 1
        g = (net.gradient(v, z[use], y[use]) + shrink * v) / len(use)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v -= o.rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m1 / (np.sqrt(m2) + 1e-8)
    return np.concatenate([v, m1, m2, [t]])


def minibatch_oof(rows: DataFrame, folds: Folds, width: int, hiddens: list[int], options: MiniBatch = MiniBatch()) -> dict[int, DataFrame]:
    """Out-of-fold probabilities of ReLU networks by their hidden units: mini-batch Adam, L2, early stopping on a tenth.

    Rows are dealt by hash into shards of about ``shard`` rows, whatever their partitions.  A job is an epoch of all networks and folds: each
    shard takes its mini-batch steps from the same parameters (several steps without talking), then parameters and
    moments are averaged over the shards by their rows.  Up to ``shard`` rows there is one shard, and this is plain mini-batch training.
    Parameters (folds times networks) are what the driver keeps; a fold's rows are never gathered.
    """
    o, s, nets = options, scaling(rows, folds, 1, width), {h: Net(width, h) for h in hiddens}
    count = -(-max(int(rows.count()), 1) // o.shard)
    shard = F.pmod(F.xxhash64("pos"), F.lit(count))
    dealt = stored(rows.select("pos", "x", "ys", "embargoed", "rank", shard.alias("shard")).repartition(count, "shard"))
    state = {h: np.tile(np.concatenate([glorot(net, o.seed), np.zeros(2 * net.size + 1)]), (len(folds.ids), 1)) for h, net in nets.items()}
    best = {h: state[h][:, : net.size].copy() for h, net in nets.items()}
    top, waited, alive = ({h: np.full(len(folds.ids), x) for h in hiddens} for x in (-np.inf, 0, True))
    for h in hiddens:
        alive[h] &= s.usable[:, 0]
    for epoch in range(1, o.epochs + 2):
        if not any(alive[h].any() for h in hiddens):
            break

        def run(table: pa.Table) -> pa.Table:
            pos, x, ys, embargoed, _ = unpacked(table.combine_chunks().to_batches()[0])
            back, out = held_back(pos, o), []
            for f in range(len(folds.ids)):
                if not any(alive[h][f] for h in hiddens):
                    continue
                own = folds.training(f, pos, embargoed) & ~np.isnan(ys[:, 0])
                z, y = (x - s.mean[f, 0]) / s.scale[f, 0], ys[:, 0]
                fit, test = own & ~back, own & back
                for h, net in nets.items():
                    if alive[h][f]:
                        right = ((net.logits(state[h][f][: net.size], z[test]) > 0) == (y[test] > 0.5)).sum()
                        after = adam_epoch(net, state[h][f], z[fit], y[fit], pos[fit], epoch, o) if epoch <= o.epochs else state[h][f]
                        out.append((h, f, np.concatenate([after * fit.sum(), [fit.sum(), right, test.sum()]])))
            sizes = [len(v) for *_, v in out]
            wide = lambda k: np.repeat([r[k] for r in out], sizes).astype(np.int32)
            values = np.concatenate([v for *_, v in out]) if out else np.empty(0)
            return pa.table({"h": wide(0), "f": wide(1), "i": np.concatenate([np.arange(n) for n in sizes]).astype(np.int32) if out else np.empty(0, np.int32), "v": values})

        got = dealt.groupBy("shard").applyInArrow(run, "h int, f int, i int, v double").groupBy("h", "f", "i").agg(F.sum("v").alias("v")).toArrow()
        hs, fs, places, values = (got.column(c).to_numpy() for c in "hfiv")
        for h, net in nets.items():
            sums = np.zeros((len(folds.ids), 3 * net.size + 4))
            sums[fs[hs == h], places[hs == h]] = values[hs == h]
            for f in np.flatnonzero(alive[h]):
                n, right, tested = sums[f, -3:]
                if epoch > 1:
                    score = right / tested if tested else -np.inf
                    waited[h][f] = waited[h][f] + 1 if score < top[h][f] + o.tol else 0
                    if score > top[h][f] or not tested:
                        top[h][f], best[h][f] = score, state[h][f][: net.size]
                    alive[h][f] = waited[h][f] <= o.patience
                if n:
                    state[h][f] = sums[f, :-3] / n

    def predictor(h: int) -> Predict:
        def predict(x: np.ndarray, f: int, j: int) -> np.ndarray:
            o = nets[h].logits(best[h][f], (x - s.mean[f, 0]) / s.scale[f, 0])
            return 1 / (1 + np.exp(-np.clip(o, -40, 40)))

        return predict

    return {h: out_of_fold(rows, folds, 1, s.usable, predictor(h)) for h in hiddens}
