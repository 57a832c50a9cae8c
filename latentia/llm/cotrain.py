"""Operator 5: quality classifier by co-training.

Two views of a document, each with its own logistic regression in numpy: the text (trigrams of character
classes, hashed words, a few shares) and the page's metadata (source, language, length).  In each round every
classifier is calibrated on held-out labels, and the unlabelled documents it is confident about become
pseudo-labels for the other one.  In the end the calibrated views are combined by a third regression on the
held-out labels, and every document is scored where it is.

Only the labelled documents are a bounded sample: at most LABELLED, the first by a hash of the id.  Every other document
takes part as unlabelled: texts become features once, in a stored table; in PASSES passes a round over it the tasks give it its pseudo-label (by the first round in which the
other view is sure of it) and add up each view's gradient; only sums reach the driver.  A step divides the sums by
the curvature of the labelled rows, raised to that of the pseudo-labelled ones on the diagonal.  The pseudo-labelled documents together
weigh at most as much as the labelled ones.

Defined cases: a text that is null or without words scores 0 and is rejected; null source, language and length are
values of their own; labels that are null are ignored, repeated ones averaged; without labels of both
classes every document with words scores 1 and is kept; equal rows score alike; an empty table
gives an empty result; extra columns are kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.llm.common import Scratch, cut, slices
from latentia.llm.shingles import IS_SPACE, hashed_words

LABELLED, ROUNDS, PASSES = 6000, 3, 2
CONFIDENT = 0.98
HELD_OUT = 4  # every 4th labelled document calibrates
KEEP = 0.5
CLASSES, WORDS, SOURCES, LANGS = 8, 512, 64, 16
#: Texts that get features at once: bytes and rows (a row has about 1,100 features).
BYTES, BATCH = 1 << 19, 400
STEPS = 150

#: Character classes of bytes: blank, lower, upper, digit, mark within prose, other mark, beyond ASCII, line end.
BYTE_CLASS = np.full(256, 5, np.int32)
BYTE_CLASS[128:] = 6
BYTE_CLASS[IS_SPACE] = 0
BYTE_CLASS[10] = 7
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 1, 2, 3
BYTE_CLASS[[ord(c) for c in ".,;:'\"-?!()"]] = 4


def text_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: root shares of trigrams and words in steps of 1 / 255 (uint8 rows), a few other shares (float32 rows), words."""
    w = hashed_words(texts)
    rows = len(texts)
    sizes = np.array([len(t) + 1 for t in texts])
    doc = np.repeat(np.arange(rows, dtype=np.int32), sizes)
    c = BYTE_CLASS[w.data[: len(doc)]]
    code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:] if len(c) > 2 else c[:0]
    within = doc[:-2] == doc[2:] if len(c) > 2 else np.empty(0, bool)
    tri = np.bincount(doc[: len(code)][within] * CLASSES**3 + code[within], minlength=rows * CLASSES**3).reshape(rows, -1)
    of = np.repeat(np.arange(rows, dtype=np.int32), w.counts)
    bag = np.bincount(of * WORDS + (w.hashes % np.uint64(WORDS)).astype(np.int32), minlength=rows * WORDS).reshape(rows, -1)
    kinds = np.bincount(doc * CLASSES + c, minlength=rows * CLASSES).reshape(rows, -1) / sizes[:, None]
    order = np.lexsort((w.hashes, of))
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[order][1:] != of[order][:-1]) | (w.hashes[order][1:] != w.hashes[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=rows) / np.maximum(w.counts, 1)
    length = np.bincount(of, w.stops - w.starts, rows) / np.maximum(w.counts, 1)
    stats = np.column_stack([kinds, distinct, length / 10, np.log1p(w.counts) / 10])
    share = lambda x: np.rint(255 * np.sqrt(x.astype(np.float32) / np.maximum(x.sum(1, keepdims=True), 1).astype(np.float32))).astype(np.uint8)
    return np.hstack([share(tri), share(bag)]), stats.astype(np.float32), w.counts


def text_view(codes: np.ndarray, stats: np.ndarray) -> np.ndarray:
    return np.hstack([codes.astype(np.float32) / np.float32(255), stats])


def meta_view(sources: list[str | None], langs: list[str | None], lengths: list[int | None]) -> np.ndarray:
    rows = len(sources)
    out = np.zeros((rows, SOURCES + LANGS + 3), np.float32)
    at = np.arange(rows)
    for values, size, base in ((sources, SOURCES, 0), (langs, LANGS, SOURCES)):
        out[at, base + np.array([zlib.crc32((v or "\0").encode()) % size for v in values], np.int64)] = 1
    n = np.log1p(np.array([max(x or 0, 0) for x in lengths], float)) / 10
    out[:, -3:] = np.column_stack([n, n * n, [x is None for x in lengths]])
    return out


class Regression(NamedTuple):
    """Logistic regression on standardized features."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = STEPS) -> Regression:
    """Accelerated gradient descent with a step from the largest singular value."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    z = ((x - mean) / scale).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(12):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * (float(np.linalg.norm(z @ v)) ** 2 / len(z) + 1) + l2)
    w = prev = np.zeros(z.shape[1], np.float32)
    b = last = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for t in range(steps):
        m = t / (t + 3)
        u, c = w + m * (w - prev), b + m * (b - last)
        g = sigmoid(z @ u + c) - y
        prev, last = w, b
        w, b = u - rate * (z.T @ g.astype(np.float32) / len(z) + l2 * u), c - rate * float(g.mean())
    return Regression(mean, scale, w, b)


class Model(NamedTuple):
    text: Regression
    meta: Regression
    text_scale: tuple[float, float]  # calibration of each view: logit -> slope * logit + offset
    meta_scale: tuple[float, float]
    mix: Regression

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text.logit(xt) * self.text_scale[0] + self.text_scale[1]
        m = self.meta.logit(xm) * self.meta_scale[0] + self.meta_scale[1]
        return sigmoid(a), sigmoid(m), sigmoid(self.mix.logit(np.column_stack([a, m])))


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate logits on held-out labels, with Platt's smoothed targets and Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, beta = np.column_stack([logit, np.ones(len(logit))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ beta)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-4
        beta = beta - np.linalg.solve(h, x.T @ (p - target) + 1e-4 * (beta - np.array([1.0, 0.0])))
    return float(max(beta[0], 0.0)), float(beta[1])


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))


def meta_of(batch: pa.RecordBatch) -> np.ndarray:
    return meta_view(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, n_chars, words, codes, stats: what the views are made of, so texts are read once for all passes."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", BYTES, BATCH):
                codes, stats, counts = text_codes([t or b"" for t in batch.column("text").to_pylist()])
                same = [batch.column(c) for c in ("doc_id", "source", "lang", "n_chars")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(counts.astype(np.int64)), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary())], names=["doc_id", "source", "lang", "n_chars", "words", "codes", "stats"])

    return plain(docs).mapInArrow(run, "doc_id long, source string, lang string, n_chars long, words long, codes binary, stats binary")


def views(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of features() with their text view and metadata view."""
    for at in range(0, whole.num_rows, BATCH):
        batch = whole.slice(at, BATCH)
        rows = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)  # noqa: B023, E731
        yield batch, text_view(rows("codes", np.uint8), rows("stats", np.float32)), meta_of(batch)


PAIRS = (("text", "meta"), ("meta", "text"))
L2, FARTHEST = 1e-3, 2.0


class View(NamedTuple):
    """A view's regression and the calibration of its logits."""

    model: Regression
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.model.logit(x) * self.slope + self.offset)


def pseudo_labels(givers: list[View], x: np.ndarray) -> np.ndarray:
    """Labels by the first giver that is sure, NaN where none is."""
    y = np.full(len(x), np.nan)
    for g in givers:
        p = g.probability(x)
        sure = np.isnan(y) & (np.maximum(p, 1 - p) >= CONFIDENT)
        y[sure] = p[sure] > 0.5
    return y


def gradient(model: Regression, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over rows: gradient by weight and offset, curvature on the diagonal, number of rows."""
    z = np.column_stack([((x - model.mean) / model.scale).astype(np.float32), np.ones(len(x), np.float32)])
    p = sigmoid(z[:, :-1] @ model.w + model.b)
    return np.concatenate([z.T @ (p - y), (z * z).T @ np.maximum(p * (1 - p), 0.05), [len(x)]]).astype(np.float64)


def pool_sums(feats: DataFrame, sample: np.ndarray, givers: dict[str, list[View]], now: dict[str, Regression]) -> dict[str, np.ndarray]:
    """gradient() of both views over the pseudo-labelled documents outside the labelled sample."""
    shared = feats.sparkSession.sparkContext.broadcast((sample, givers, now))

    def run(batches):
        sample, givers, now = shared.value
        sums = {k: np.zeros(2 * len(now[k].w) + 3) for k in now}
        for whole in batches:
            for batch, xt, xm in views(whole):
                out = np.isin(np.array([-1 if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64), sample) & np.asarray(batch.column("doc_id").is_valid())
                x = {"text": xt[~out], "meta": xm[~out]}
                for giver, taker in PAIRS:
                    y = pseudo_labels(givers[giver], x[giver])
                    sure = ~np.isnan(y)
                    if sure.any():
                        sums[taker] += gradient(now[taker], x[taker][sure], y[sure])
        yield pa.RecordBatch.from_arrays([pa.array([sums[k].tobytes()], pa.binary()) for k in ("text", "meta")], names=["text", "meta"])

    out = {k: np.zeros(2 * len(now[k].w) + 3) for k in now}
    for row in feats.mapInArrow(run, "text binary, meta binary").toLocalIterator():
        for k in out:
            out[k] += np.frombuffer(row[k], np.float64)
    return out


def stepped(model: Regression, x: np.ndarray, y: np.ndarray, pool: np.ndarray) -> Regression:
    """One step on labelled rows and the sums of the pseudo-labelled ones."""
    n, d = pool[-1], len(model.w) + 1
    z = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    p = sigmoid(z[:, :-1] @ model.w + model.b)
    weight = min(1.0, len(x) / max(n, 1.0))
    ridge = np.append(np.full(d - 1, L2), 1e-6)
    slope = (z.T @ (p - y) + weight * pool[:d]) / (len(x) + weight * n) + ridge * np.append(model.w, 0.0)
    curve = (z * np.maximum(p * (1 - p), 0.05)[:, None]).T @ z / len(x)
    curve += np.diag(ridge + np.maximum(pool[d : 2 * d] / max(n, 1.0) - np.diag(curve), 0))
    move = np.linalg.solve(curve, slope)
    move *= min(1.0, FARTHEST / (np.sqrt(np.mean((z @ move) ** 2)) + 1e-12))
    return model._replace(w=(model.w - move[:-1]).astype(np.float32), b=float(model.b - move[-1]))


def co_train(feats: DataFrame, ids: np.ndarray, xt: np.ndarray, xm: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model from the labelled sample (ids, views, labels) and all other documents of feats."""
    held = np.arange(len(y)) % HELD_OUT == 0
    x = {"text": xt, "meta": xm}
    now = {k: fit(x[k][~held], y[~held]) for k in x}
    calibrated = lambda: {k: View(now[k], *platt(now[k].logit(x[k][held]), y[held])) for k in x}
    views_now = calibrated()
    givers: dict[str, list[View]] = {k: [] for k in x}
    for _ in range(rounds):
        for k in x:
            givers[k].append(views_now[k])
        for _ in range(PASSES):
            sums = pool_sums(feats, ids, givers, now)
            now = {k: stepped(now[k], x[k][~held], y[~held], sums[k]) if sums[k][-1] else now[k] for k in x}
        if not any(v[-1] for v in sums.values()):
            break
        views_now = calibrated()
    z = np.column_stack([v.model.logit(x[k][held]) * v.slope + v.offset for k, v in views_now.items()])
    scale = {k: (v.slope, v.offset) for k, v in views_now.items()}
    return Model(now["text"], now["meta"], scale["text"], scale["meta"], fit(z, y[held], steps=400))


def sample_features(feats: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, text view, metadata view) of the documents with the given ids: a bounded set, in id order."""
    got = feats.join(F.broadcast(ids), "doc_id", "left_semi").toArrow().combine_chunks()
    i, first = np.unique(np.asarray(got.column("doc_id"), np.int64), return_index=True)
    parts = [(xt, xm) for batch in got.take(pa.array(first)).to_batches() for _, xt, xm in views(batch)]
    return i, *(np.concatenate(x) for x in zip(*parts, strict=True))


def fit_model(feats: DataFrame, labels: DataFrame, target: str = "quality") -> Model | None:
    """None where the sample lacks one of the classes."""
    mark = F.xxhash64(F.lit(17), "doc_id")
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(target).alias("y"))
    chosen = known.join(feats.select("doc_id"), "doc_id", "left_semi").orderBy(mark, "doc_id").limit(LABELLED).toArrow()
    if not chosen.num_rows:
        return None
    spark = feats.sparkSession
    of = dict(zip(chosen.column("doc_id").to_pylist(), (np.asarray(chosen.column("y")) >= 0.5).astype(float).tolist(), strict=True))
    if len(set(of.values())) < 2:
        return None
    i, xt, xm = sample_features(feats, spark.createDataFrame(pa.table({"doc_id": pa.array([*of], pa.int64())})))
    y = np.array([of[int(k)] for k in i])
    if len(set(y.tolist())) < 2 or len(set(y[::HELD_OUT].tolist())) < 2:
        return None
    return co_train(feats, i, xt, xm, y)


SCORES = "text_score double, meta_score double, score double, keep boolean"


def score(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """doc_id, text_score, meta_score, score, keep of every document."""
    with Scratch(docs.sparkSession, "quality") as scratch:
        feats = scratch.cut(features(docs))
        shared = docs.sparkSession.sparkContext.broadcast(fit_model(feats, labels, target))

        def run(batches):
            model = shared.value
            for whole in batches:
                for batch, xt, xm in views(whole):
                    full = np.asarray(batch.column("words")) > 0
                    got = model.scores(xt, xm) if model else [np.ones(len(full))] * 3
                    cols = [np.where(full, s, 0.0) for s in got]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c.astype(np.float64)) for c in cols], pa.array(cols[2] >= KEEP)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

        return cut(feats.mapInArrow(run, f"doc_id long, {SCORES}"))


def keep_good(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """docs without those that the classifier rejects, columns unchanged; decided row by row, nothing is joined."""
    with Scratch(docs.sparkSession, "quality") as scratch:
        shared = docs.sparkSession.sparkContext.broadcast(fit_model(scratch.cut(features(docs)), labels, target))
    names = docs.columns

    def run(batches):
        model = shared.value
        for whole in batches:
            own = pa.RecordBatch.from_arrays([whole.column(names.index("text")).cast(pa.binary()), *[whole.column(names.index(c)) for c in ("source", "lang", "n_chars")], pa.array(range(whole.num_rows))], names=["text", "source", "lang", "n_chars", "row"])
            for batch in slices(own, "text", BYTES, BATCH):
                codes, stats, counts = text_codes([t or b"" for t in batch.column("text").to_pylist()])
                keep = (counts > 0) & (model.scores(text_view(codes, stats), meta_of(batch))[2] >= KEEP if model else True)
                if keep.any():
                    yield whole.take(batch.column("row").filter(pa.array(keep)))

    return docs.mapInArrow(run, docs.schema)
