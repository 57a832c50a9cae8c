"""Operator 3: a log-bilinear language model trained with noise-contrastive estimation.

Vocabulary.  Tokens are 64-bit word hashes (two words of a corpus of V types collide with probability
about V^2 / 2^65).  Every training type is an outcome of the model, in three levels: P(class | context), where the
classes are the FREQUENT most frequent words, the end of a text and groups of all other words; P(cell | group, context);
P(word | cell, context).  There is a cell for about LEAF types, and about as many groups as cells in a group, so groups,
cells and words grow with the corpus.  One unknown type takes a Good-Turing share of the groups' mass; so probabilities
over all training types plus the unknown one sum to 1.

Model.  Each level is P(x | two words before) ~ exp((c1 * q[h1] + c2 * q[h2]) . r[x] + b[x]) within its parent.  A frequent
word has its own q; another word's q is the sum of two rows picked by its hash out of two tables of BUCKETS rows (pairs of rows:
BUCKETS^2).  Training texts are dealt by a hash of id and text to shards of about SHARD tokens, in the order of that hash; a task trains a
copy of the shared parameters by noise-contrastive estimation on its shard, and the copies are averaged, weighted by tokens.  So
scores do not depend on how the input is partitioned (up to the order of sums).

Words within cells stay distributed: every token outside the frequent words goes, packed with its context, to the task of its cell,
which counts the cell's types, trains their vectors with noise from their counts, and scores the tokens.  A cell of more than PACK
training tokens is dealt by document to parts of about PACK; each part gets the whole cell's types and counts, trains vectors of its own
and scores its documents by them, so no task holds a hot word's tokens and each document's probabilities sum to 1.  The driver
holds classes and cells (a 256th of the types), never the types.

Defined cases: a null or empty text is its end token; a null id counts as training; an empty table gives an empty
result; with no training text every token is unknown, and base and score stay finite.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.llm.common import cut, slices
from latentia.llm.shingles import word_hashes

FREQUENT, WIDTH, CONTEXT, NOISE, BATCH, RATE = 254, 16, 2, 32, 4096, 0.05
END = 0
LEAF = 256  # types in a cell
BUCKETS_LOG = 10
NEAR = 2  # noise samples of a token within its group or cell
SHARD = 4_000_000  # training tokens of a shard
PACK = 400_000  # tokens of a task of cells
HOLD = 500_000  # tokens a task holds before it packs them
BYTES = 1 << 20
#: Parameters averaged together, and the tasks that average them.
BLOCK, MEAN_TASKS = 4096, 16
#: Tokens of a step in a cell, and its shared noise samples.
CELL_BATCH, CELL_NOISE = 128, 12
TOGETHER = 8  # cells of like size that train side by side, so that a step is worth its calls
SEED = 3


def parts_of_cells(cell_counts: np.ndarray, pack: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of each cell, and the number of its first part."""
    parts = np.maximum(1, -(-cell_counts // pack))
    return parts, np.cumsum(parts) - parts


def hot_types(counts: DataFrame, corpus: Corpus, pack: int, tasks: int) -> DataFrame:
    """task, uid, held (both null), pack (hashes, then counts) and doc (null): the types of cells of several parts, for each part."""
    shared = counts.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = shared.value
        parts, first = parts_of_cells(corpus.cell_counts, pack)
        for batch in batches:
            h, c = batch.column("h").to_numpy().view(np.uint64), batch.column("c").to_numpy()
            cell = corpus.cells(h)
            hot = np.flatnonzero((parts[cell] > 1) & (corpus.classes(h) > len(corpus.words)))
            for at in np.unique(cell[hot]).tolist():
                own = hot[cell[hot] == at]
                data = h[own].tobytes() + c[own].tobytes()
                for s in range(0, int(parts[at]), 1000):
                    task = (first[at] + np.arange(s, min(s + 1000, parts[at]))) % tasks
                    yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array([data] * len(task), pa.binary())], names=["task", "pack"])

    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("uid", "long"), ("held", "boolean"))]
    return counts.select("h", "c").mapInArrow(run, "task int, pack binary").select("task", *nothing, "pack", F.lit(None).cast(f"struct<{DOC}>").alias("doc"))


def with_flags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (binary), held_out: crc32 of the id as text leaves remainder 1 by 5."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), (crc % 5 == 1).alias("held_out"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def token_counts(training: DataFrame, hold: int = 1_000_000) -> DataFrame:
    """(h, c): occurrences of each type in all training texts, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                hashes, _ = word_hashes([t or b"" for t in batch.column("text").to_pylist()])
                keys, counts = np.unique(hashes, return_counts=True)
                if not len(keys):
                    continue
                parts.append((keys, counts))
                held += len(keys)
                if held > 2 * hold:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > hold:
                        yield rows(*parts[0])
                        parts, held = [], 0
        if parts:
            keys, counts = merged(parts)
            for at in range(0, len(keys), 100_000):
                yield rows(keys[at : at + 100_000], counts[at : at + 100_000])

    return training.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Corpus(NamedTuple):
    """Statistics of the training tokens: the frequent words and the cells of all other types."""

    tokens: int  # N, ends included
    types: int  # V, the end included
    texts: int
    once: int  # types seen once
    words: np.ndarray  # hashes of the frequent words, sorted
    word_counts: np.ndarray
    groups: int
    cell_counts: np.ndarray  # tokens by cell; cells of a group are neighbours

    @property
    def rare_tokens(self) -> int:
        return int(self.cell_counts.sum())

    @property
    def unknown(self) -> float:
        """Share of the groups' mass that the unknown type gets."""
        return (self.once + 0.5) / (self.rare_tokens + self.once + 1)

    @property
    def class_counts(self) -> np.ndarray:
        return np.concatenate([[self.texts], self.word_counts, self.cell_counts.reshape(self.groups, -1).sum(1)])

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(33)) % np.uint64(len(self.cell_counts))).astype(np.int64)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        group = 1 + len(self.words) + self.cells(hashes) // (len(self.cell_counts) // self.groups)
        if not len(self.words):
            return group
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, group)


def corpus_statistics(counts: DataFrame, texts: int, frequent: int = FREQUENT) -> Corpus:
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    top = counts.orderBy(F.desc("c"), F.col("h") < 0, "h").limit(frequent).toArrow()  # a task keeps that many; ties by the unsigned hash
    hashes, c = np.asarray(top.column("h"), np.int64).view(np.uint64), np.asarray(top.column("c"), np.int64)
    best = np.argsort(hashes)
    words, word_counts = hashes[best], c[best]
    n = max(1, -(-row["v"] // LEAF))
    groups = 1 << round(np.log2(n) / 2)
    n = -(-n // groups) * groups
    cell_counts = np.zeros(n, np.int64)
    found = counts.groupBy((F.shiftrightunsigned("h", 33) % n).cast("int").alias("cell")).agg(F.sum("c").alias("c")).toArrow()
    cell_counts[np.asarray(found.column("cell"), np.int64)] = np.asarray(found.column("c"), np.int64)
    np.subtract.at(cell_counts, ((words >> np.uint64(33)) % np.uint64(n)).astype(np.int64), word_counts)
    return Corpus(row["n"] + texts, row["v"] + bool(texts), texts, row["once"], words, word_counts, groups, cell_counts)


def accumulated(at: np.ndarray, columns: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ``at`` (below size) and the sums of their values in each column."""
    seen, place = np.zeros(size, bool), np.empty(size, np.int64)
    seen[at] = True
    touched = np.flatnonzero(seen)
    place[touched] = np.arange(len(touched))
    at, sums = place.take(at), np.empty((len(touched), len(columns)), np.float32)
    for j, column in enumerate(columns):
        sums[:, j] = np.bincount(at, column, len(touched))
    return touched, sums


def with_ones(x: np.ndarray) -> np.ndarray:
    """x and a column of ones, for the bias."""
    out = np.ones((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1] = x
    return out


def bounded(full: np.ndarray, weights: np.ndarray, most: float = 60.0) -> bool:
    """No product of a row of full and a row of weights leaves [-most, most] (by their lengths), so exp needs no shift."""
    if not full.size or not weights.size:
        return True
    return float(np.einsum("ij,ij->i", full, full).max()) * float(np.einsum("ij,ij->i", weights, weights).max()) < most * most


def log_sums(full: np.ndarray, weights: np.ndarray, block: int = 512) -> np.ndarray:
    """log of the sum over the rows w of weights of exp(f . w), for each row f of full; blocks stay in the processor's cache."""
    out, easy, ones = np.empty(len(full)), bounded(full, weights), np.ones(len(weights), np.float32)
    turned = np.ascontiguousarray(weights.T)
    room = np.empty((min(block, len(full)), len(weights)), np.float32)
    for s in range(0, len(full), block):
        logits = np.matmul(full[s : s + block], turned, out=room[: len(full) - s])
        shift = np.float32(0) if easy else logits.max(1, keepdims=True)
        if not easy:
            logits -= shift
        np.exp(logits, out=logits)
        out[s : s + block] = np.log(logits @ ones) + np.ravel(shift)
    return out


class LogBilinear:
    """Parameters r (a row for each class), q (for each class and bucket), c (for each context position) and b."""

    def __init__(self, class_counts: np.ndarray, width: int = WIDTH, buckets_log: int = BUCKETS_LOG):
        rng = np.random.default_rng(SEED)
        n = len(class_counts)
        self.log = buckets_log
        self.noise = (class_counts + 0.5) / (class_counts + 0.5).sum()
        self.r = rng.normal(0, 0.1, (n, width)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (n + (2 << buckets_log), width)).astype(np.float32)
        self.c = np.ones((CONTEXT, width), np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.products: Products | None = None

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c, self.b)])

    def load(self, vector: np.ndarray) -> None:
        at, self.products = 0, None
        for name in "rqcb":
            old = getattr(self, name)
            setattr(self, name, vector[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q of context codes (a class, or the number of classes plus a word's low hash bits), which codes have a second row, and that."""
        n = len(self.b)
        other = np.flatnonzero(codes >= n)
        first, bits = codes.copy(), codes[other] - n
        first[other] = n + (bits & ((1 << self.log) - 1))
        return first, other, n + (1 << self.log) + (bits >> self.log)

    def both_rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second rows of q of context codes; a class has the row after the last one as its second."""
        n = len(self.b)
        other, bits = codes >= n, codes - n
        return np.where(other, n + (bits & ((1 << self.log) - 1)), codes), np.where(other, n + (1 << self.log) + (bits >> self.log), len(self.q))

    def embedded(self, codes: np.ndarray) -> np.ndarray:
        first, second = self.both_rows(codes)
        padded = np.concatenate([self.q, np.zeros((1, self.q.shape[1]), np.float32)])
        out = self.q.take(first, 0)
        out += padded.take(second, 0)
        return out

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        out = self.embedded(contexts[:, 0])
        out *= self.c[0]
        for i in range(1, CONTEXT):
            out += self.embedded(contexts[:, i]) * self.c[i]
        return out

    def train(self, classes: np.ndarray, contexts: np.ndarray, squares: dict, rng: np.random.Generator) -> None:
        """One pass over tokens and their contexts; a batch shares its noise samples; AdaGrad steps."""
        n, self.products = len(self.r), None
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        cdf = np.cumsum(self.noise)

        def step(name: str, grad: np.ndarray, tokens: int) -> None:
            """All rows move, untouched ones by 0."""
            own = getattr(self, name)
            if name not in squares:
                squares[name] = np.full(own.shape, 1e-8, np.float32)
            grad = np.ascontiguousarray(grad) / np.float32(tokens)
            squares[name] += grad * grad
            grad *= np.float32(RATE)
            grad /= np.sqrt(squares[name])
            own += grad

        width, none = self.r.shape[1], len(self.q)  # none: the empty second row of a class
        to_r, to_q = np.empty((width + 1, n), np.float32), np.empty((width, none), np.float32)
        for start in range(0, len(classes), BATCH):
            w, h = classes[start : start + BATCH], contexts[start : start + BATCH]
            size = len(w)
            z = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), n - 1)
            padded = np.concatenate([self.q, np.zeros((1, width), np.float32)])
            places = [self.both_rows(h[:, i]) for i in range(CONTEXT)]
            q = [padded.take(first, 0) for first, _ in places]
            for x, (_, second) in zip(q, places, strict=True):
                x += padded.take(second, 0)
            hidden = q[0] * self.c[0]
            for i in range(1, CONTEXT):
                hidden += q[i] * self.c[i]
            rw, rz, offset = self.r.take(w, 0), self.r[z], self.b - log_noise
            right = 1 / (1 + np.exp(np.einsum("ij,ij->i", hidden, rw) + offset.take(w)))
            wrong = hidden @ -rz.T
            wrong -= offset[z]
            np.exp(wrong, out=wrong)
            wrong += 1
            np.divide(-1, wrong, out=wrong)
            back = right[:, None] * rw
            back += wrong @ rz
            for j, column in enumerate([*np.multiply(hidden.T, right, order="C"), right]):
                to_r[j] = np.bincount(w, column, n)
            np.add.at(to_r.T, z, np.column_stack([wrong.T @ hidden, np.ones(size, np.float32) @ wrong]))
            at = np.concatenate([place + i * (none + 1) for i, both in enumerate(places) for place in both])
            four = np.empty((len(at) // size, size))
            for j, column in enumerate(np.ascontiguousarray(back.T)):
                four[:] = column
                sums = np.bincount(at, four.ravel(), CONTEXT * (none + 1)).reshape(CONTEXT, -1)
                to_q[j] = self.c[:, j].astype(np.float64) @ sums[:, :none]
            to_c = np.stack([np.einsum("ij,ij->j", back, q[i]) for i in range(CONTEXT)])
            step("r", to_r[:-1].T, size)
            step("b", to_r[-1], size)
            step("q", to_q.T, size)
            step("c", to_c, size)

    def log10(self, classes: np.ndarray, contexts: np.ndarray, block: int = 512) -> np.ndarray:
        """Normalised log10 P(class | context)."""
        return self.log10_and_tail(classes, contexts, len(self.b), block)[0]

    def log10_and_tail(self, classes: np.ndarray, contexts: np.ndarray, tail: int, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, log10 of the mass of the classes from ``tail`` on (both over distinct contexts), and each token's hidden row."""
        codes, at = np.unique((contexts[:, 0] << 32) | contexts[:, 1], return_inverse=True)
        pairs = np.stack([codes >> 32, codes & 0xFFFFFFFF], 1)
        hidden = self.hidden(pairs)
        if self.products is None or self.products.tail != tail:
            self.products = Products(self, tail)
        sums = self.products.log_sums(pairs) if self.products.fits else self.log_sums(hidden, tail, block)
        norm = np.logaddexp(sums[:, 0], sums[:, 1])
        hidden = hidden.take(at, 0)
        own = np.einsum("ij,ij->i", hidden, self.r.take(classes, 0)) + self.b.take(classes)
        return (own - norm.take(at)) / np.log(10), (sums[:, 1] - norm).take(at) / np.log(10), hidden

    def log_sums(self, hidden: np.ndarray, tail: int, block: int) -> np.ndarray:
        """log of the sums of exp(hidden . r + b) over the classes before ``tail`` and from there on, as matrix products."""
        full, weights = with_ones(hidden), np.column_stack([self.r, self.b]).T.astype(np.float32)
        easy = bounded(full, weights.T)
        parts = np.zeros((len(self.b), 2), np.float32)
        parts[:tail, 0], parts[tail:, 1] = 1, 1
        sums = np.empty((len(full), 2), np.float64)
        room = np.empty((min(block, len(full)), len(self.b)), np.float32)
        for s in range(0, len(full), block):
            logits = np.matmul(full[s : s + block], weights, out=room[: len(full) - s])
            shift = np.float32(0) if easy else logits.max(1, keepdims=True)
            if not easy:
                logits -= shift
            np.exp(logits, out=logits)
            sums[s : s + block] = np.log(np.maximum(logits @ parts, 1e-30)) + shift
        return sums


class Products:
    """Sums over the classes of exp(hidden . r + b) without an exponential for each context and class.

    A hidden row is a sum of up to four rows (one or two of q by context position, times c), so exp(hidden . r) is a product of
    up to four numbers that depend on one row of q and the class alone: they are taken once for each row of q.
    """

    def __init__(self, model: LogBilinear, tail: int, most: float = 80.0):
        self.model, self.tail, self.n = model, tail, len(model.b)
        logits = [(model.q * c) @ model.r.T for c in model.c]
        low, high = (sum(2 * f(x, initial=0) for x in logits) + f(model.b, initial=0) for f in (np.min, np.max))
        self.fits = bool(-most < low and high < most)  # of products of some or all factors, so none leaves the floats
        if not self.fits:
            return
        self.tables = [np.exp(x, out=x) for x in logits]
        self.tables[0][: self.n + (1 << model.log)] *= np.exp(model.b)  # a context has one first row at its first position
        heads, tails = ([x[: self.n, part] for x in self.tables] for part in (slice(tail), slice(tail, None)))
        self.pairs = np.stack([heads[0] @ heads[1].T, tails[0] @ tails[1].T], 2)  # two classes: all pairs at once

    def log_sums(self, pairs: np.ndarray, block: int = 256) -> np.ndarray:
        """log of the sums over the classes before ``tail`` and from there on, for contexts sorted by their first code."""
        out = np.empty((len(pairs), 2), np.float32)
        one, two = np.ascontiguousarray(pairs.T)
        kinds = (one >= self.n) + 2 * (two >= self.n)
        rows = np.flatnonzero(kinds == 0)
        out[rows] = self.pairs[one[rows], two[rows]]
        rows = np.flatnonzero(kinds == 1)
        rows = rows[np.argsort(two[rows], kind="stable")]
        out[rows] = self.class_sums(1, two[rows], one[rows], block)
        rows = np.flatnonzero(kinds == 2)
        out[rows] = self.class_sums(0, one[rows], two[rows], block)
        rows = np.flatnonzero(kinds == 3)
        out[rows] = self.rare_sums(one[rows], two[rows], block)
        return np.log(np.maximum(out, 1e-30)).astype(np.float64)

    def factors(self, i: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = self.tables[i].take(first, 0)
        out *= self.tables[i].take(second, 0)
        return out

    def class_sums(self, i: int, classes: np.ndarray, words: np.ndarray, block: int) -> np.ndarray:
        """Sums for contexts of a class (sorted) at position i and a rare word at the other one: matrix-vector products class by class."""
        out = np.empty((len(classes), 2), np.float32)
        first, _, second = self.model.rows(words)
        cuts = np.flatnonzero(np.diff(classes, prepend=-1, append=-1)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = self.tables[i][classes[lo]]
            for s in range(lo, hi, block):
                e = min(s + block, hi)
                x = self.factors(1 - i, first[s:e], second[s:e])
                np.matmul(x[:, : self.tail], own[: self.tail], out=out[s:e, 0])
                np.matmul(x[:, self.tail :], own[self.tail :], out=out[s:e, 1])
        return out

    def rare_sums(self, one: np.ndarray, two: np.ndarray, block: int) -> np.ndarray:
        """Sums for contexts of two rare words."""
        out = np.empty((len(one), 2), np.float32)
        (first, _, second), (third, _, fourth) = self.model.rows(one), self.model.rows(two)
        for s in range(0, len(out), block):
            e = s + block
            x, y = self.factors(0, first[s:e], second[s:e]), self.factors(1, third[s:e], fourth[s:e])
            np.vecdot(x[:, : self.tail], y[:, : self.tail], out=out[s:e, 0])
            np.vecdot(x[:, self.tail :], y[:, self.tail :], out=out[s:e, 1])
        return out


class Members:
    """P(member | parent, context) for members that are neighbours by parent: parent g has starts[g] to starts[g + 1]."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, width: int = WIDTH):
        self.starts = starts
        self.parent = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        mass = counts + 0.5
        self.cdf = np.cumsum(mass)
        self.edge = np.concatenate([[0.0], self.cdf])[starts]
        noise = mass / np.diff(self.edge)[self.parent]
        self.log_noise = np.log(NEAR * noise).astype(np.float32)
        self.r = np.zeros((len(counts), width), np.float32)
        self.b = np.log(noise).astype(np.float32)
        self.guide = np.searchsorted(self.cdf, np.arange(4 * len(counts)) * (self.cdf[-1] / (4 * len(counts))), "right")
        self.squares = np.full((len(counts), width + 1), 1e-8, np.float32)

    def drawn(self, mass: np.ndarray) -> np.ndarray:
        """np.searchsorted(cdf, mass, "right"): a table of equal steps of mass says where to begin, few draws go on from there."""
        out = self.guide.take(np.maximum((mass * (len(self.guide) / self.cdf[-1])).astype(np.int64) - 1, 0), mode="clip")
        left = np.flatnonzero(self.cdf.take(out) <= mass)
        while len(left):
            out[left] += 1
            left = left[out[left] < len(self.cdf)]
            left = left[self.cdf.take(out[left]) <= mass[left]]
        return out

    def train(self, members: np.ndarray, hidden: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation with noise from the parent's counts; only touched rows move."""
        for start in range(0, len(members), BATCH):
            w, h = members[start : start + BATCH], hidden[start : start + BATCH]
            g = self.parent[w]
            low, high = self.edge[g][:, None], self.edge[g + 1][:, None]
            z = self.drawn((low + rng.random((len(w), NEAR)) * (high - low)).ravel()).reshape(-1, NEAR)
            z = np.clip(z, self.starts[g][:, None], self.starts[g + 1][:, None] - 1)
            at, turned = np.concatenate([w, *z.T]), np.ascontiguousarray(with_ones(h).T)
            parts = np.empty((len(turned), 1 + NEAR, len(w)))
            for i, x in enumerate([w, *z.T]):
                s = np.einsum("ij,ij->i", h, self.r.take(x, 0)) + self.b.take(x) - self.log_noise.take(x)
                np.multiply((i == 0) - 1 / (1 + np.exp(-s)), turned, out=parts[:, i])
            rows, sums = accumulated(at, parts.reshape(len(turned), -1), len(self.b))
            grad = sums / np.float32(len(w))
            held = self.squares.take(rows, 0)
            held += grad * grad
            self.squares[rows] = held
            grad *= np.float32(RATE)
            grad /= np.sqrt(held)
            self.r[rows] = self.r.take(rows, 0) + grad[:, :-1]
            self.b[rows] += grad[:, -1]

    def log10(self, members: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """Normalised log10 P(member | its parent, context)."""
        out = np.einsum("ij,ij->i", hidden, self.r.take(members, 0)).astype(np.float64) + self.b.take(members)
        parent = self.parent.take(members).astype(np.uint16 if len(self.starts) < 1 << 16 else np.int64)
        order = np.argsort(parent, kind="stable")
        cuts = np.searchsorted(parent[order], np.arange(len(self.starts)))
        full, weights = with_ones(hidden), np.column_stack([self.r, self.b])
        for g in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[g] : cuts[g + 1]]
            out[rows] -= log_sums(full.take(rows, 0), weights[self.starts[g] : self.starts[g + 1]])
        return out / np.log(10)


class Cell(NamedTuple):
    """Tokens of one cell, or of a part of a hot one, that training knows."""

    number: int
    members: np.ndarray
    at: np.ndarray  # each token's row of full
    full: np.ndarray  # hidden rows of the cell's distinct contexts, and a one
    counts: np.ndarray  # training tokens of each member, all parts together
    held: np.ndarray


def cell_weights(cells: list[Cell]) -> list[np.ndarray]:
    """Vectors and biases of the cells' members after one pass of noise-contrastive estimation over their tokens not held out.

    A step takes the next CELL_BATCH tokens of each cell that has some left, which share the cell's noise samples. Cells come
    longest first, so those still training are the first ones and so are their members' rows.
    """
    begins = np.cumsum([0] + [len(c.counts) for c in cells])
    rows_before = np.cumsum([0] + [len(c.full) for c in cells])
    noise = np.concatenate([c.counts / c.counts.sum() for c in cells])
    log_noise = np.log(CELL_NOISE * noise).astype(np.float32)
    full = np.concatenate([c.full for c in cells])
    w = np.zeros((len(noise), full.shape[1]), np.float32)
    w[:, -1] = np.log(noise)
    squares = np.full(w.shape, 1e-8, np.float32)
    trained = np.array([np.count_nonzero(~c.held) for c in cells])
    steps = -(-trained // CELL_BATCH)
    rows = np.zeros((len(cells), int(steps.max()) * CELL_BATCH), np.int32)
    members, drawn = np.zeros_like(rows), np.zeros((len(cells), int(steps.max()), CELL_NOISE), np.int64)
    for i, c in enumerate(cells):
        rng = np.random.default_rng([SEED, c.number])
        use = rng.permutation(np.flatnonzero(~c.held))
        rows[i, : len(use)], members[i, : len(use)] = c.at[use] + rows_before[i], c.members[use] + begins[i]
        members[i, len(use) :] = begins[i]
        cdf = np.cumsum(c.counts / c.counts.sum())
        drawn[i, : steps[i]] = np.minimum(np.searchsorted(cdf, rng.random((steps[i], CELL_NOISE))), len(c.counts) - 1) + begins[i]
    columns = np.arange(w.shape[1])
    for step in range(int(steps.max())):
        active = int(np.searchsorted(-steps, -step))  # cells with more than step steps
        top, part = begins[active], slice(step * CELL_BATCH, (step + 1) * CELL_BATCH)
        m, z, h = members[:active, part].ravel(), drawn[:active, step], full.take(rows[:active, part], 0)
        wz, flat = w.take(z, 0), h.reshape(-1, h.shape[2])
        right = np.exp(np.einsum("ij,ij->i", flat, w.take(m, 0)) - log_noise.take(m))
        right += 1
        np.divide(1, right, out=right)
        wrong = h @ wz.transpose(0, 2, 1)
        np.subtract(log_noise.take(z)[:, None], wrong, out=wrong)
        np.exp(wrong, out=wrong)
        wrong += 1
        np.divide(-1, wrong, out=wrong)
        sizes = np.minimum(trained[:active] - step * CELL_BATCH, CELL_BATCH)
        if sizes[-1] < CELL_BATCH or sizes.min() < CELL_BATCH:
            live = np.arange(CELL_BATCH) < sizes[:, None]
            right *= live.ravel()
            wrong *= live[:, :, None]
        moves = np.concatenate([right[:, None] * flat, (wrong.transpose(0, 2, 1) @ h).reshape(-1, h.shape[2])])
        places = np.concatenate([m, z.ravel()])[:, None] * len(columns) + columns
        sums = np.bincount(places.ravel(), moves.ravel(), top * len(columns)).reshape(-1, len(columns))
        sums /= np.repeat(sizes, np.diff(begins[: active + 1]))[:, None]
        grad = sums.astype(np.float32)  # a cell has few types: all rows move, untouched ones by 0
        held = squares[:top]
        held += grad * grad
        grad *= np.float32(RATE)
        grad /= np.sqrt(held)
        w[:top] += grad
    return np.split(w, begins[1:-1])


def cell_scores(cells: list[Cell]) -> list[np.ndarray]:
    """log10 P(member | cell, context) of each cell's tokens; cells come longest first."""
    out = []
    for c, w in zip(cells, cell_weights(cells), strict=True):
        own = np.einsum("ij,ij->i", c.full.take(c.at, 0), w.take(c.members, 0)).astype(np.float64)
        out.append((own - log_sums(c.full, w).take(c.at)) / np.log(10))
    return out


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in place, where each text's end token stands, and tokens of each text."""
    hashes, counts = word_hashes(texts)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    slot = np.ones(int(sizes.sum()), bool)
    slot[ends] = False
    tokens = np.zeros(len(slot), np.uint64)
    tokens[slot] = hashes
    return tokens, ends, sizes


def class_sequence(corpus: Corpus, tokens: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and codes of the two words before each token (the end class before a text begins)."""
    classes = corpus.classes(tokens)
    classes[ends] = END
    low = np.uint64((1 << 2 * BUCKETS_LOG) - 1)
    codes = np.where(classes > len(corpus.words), 1 + len(corpus.words) + corpus.groups + (tokens & low).astype(np.int64), classes)
    place = np.arange(len(classes)) - np.repeat(ends - sizes + 1, sizes)
    before = [np.where(place >= i, np.roll(codes, i), END) for i in (1, 2)]
    return classes, np.stack(before, 1)


def cell_members(corpus: Corpus) -> Members:
    return Members(corpus.cell_counts, np.arange(corpus.groups + 1) * (len(corpus.cell_counts) // corpus.groups))


def train(training: DataFrame, corpus: Corpus) -> tuple[LogBilinear, Members]:
    """Classes and cells trained on every training text (doc_id, text); copies are averaged position by position on the cluster."""
    model, cells = LogBilinear(corpus.class_counts), cell_members(corpus)
    shared = training.sparkSession.sparkContext.broadcast(corpus)
    n = len(model.vector())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        model, cells, squares, seen = LogBilinear(own.class_counts), cell_members(own), {}, 0
        rng = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                tokens, ends, sizes = sequences([t or b"" for t in batch.column("text").to_pylist()])
                classes, contexts = class_sequence(own, tokens, ends, sizes)
                order = rng.permutation(len(classes))
                classes, contexts, tokens = classes.take(order), contexts.take(order, 0), tokens.take(order)
                model.train(classes, contexts, squares, rng)
                rare = np.flatnonzero(classes > len(own.words))
                cells.train(own.cells(tokens.take(rare)), model.hidden(contexts.take(rare, 0)), rng)
                seen += len(classes)
        if seen:
            v = np.concatenate([model.vector(), cells.r.ravel(), cells.b]).astype(np.float32)
            blocks = [v[s : s + BLOCK].tobytes() for s in range(0, len(v), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(blocks, pa.binary()), pa.array(np.full(len(blocks), seen, np.int64))], names=["block", "x", "w"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighted means of this task's blocks."""
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, int] = {}
        for batch in batches:
            for block, x, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(x, np.float32).astype(np.float64) * w
                sums[block] = sums[block] + x if block in sums else x
                weights[block] = weights.get(block, 0) + w
        if sums:
            means = [(sums[k] / weights[k]).astype(np.float32).tobytes() for k in sums]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(means, pa.binary())], names=["block", "x"])

    mark = F.xxhash64("doc_id", "text")
    dealt = training.select("doc_id", "text").repartition(1 + corpus.tokens // SHARD, mark).sortWithinPartitions(mark, "doc_id", "text")
    copies = dealt.select("text").mapInArrow(run, "block int, x binary, w long")
    found = sorted((r["block"], bytes(r["x"])) for r in copies.repartition(MEAN_TASKS, "block").mapInArrow(mean, "block int, x binary").collect())
    if found:
        v = np.frombuffer(b"".join(x for _, x in found), np.float32)
        model.load(v)
        cells.r = v[n : n + cells.r.size].reshape(cells.r.shape).copy()
        cells.b = v[n + cells.r.size :].copy()
    return model, cells


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as their lowest bytes, then their second ones and so on; high bytes are mostly zeros, which the shuffle's codec shortens."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4")[:, 0]


def packed(h: np.ndarray, doc: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> bytes:
    """Tokens sorted by h: each type once with its number of tokens, then the columns; ``more`` is empty for training texts, whose types are all known."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    head = np.array([len(first), len(h)], "<u4").tobytes()
    plain = b"".join([head, h[first].tobytes(), planes(np.diff(first, append=len(h))), planes(doc), planes(one), planes(two), more.astype("<f4").tobytes()])
    return len(plain).to_bytes(4, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpacked(data: bytes, uid: int, held: bool) -> tuple[np.ndarray, ...]:
    """Types and tokens of each, then uid, one, two, more and held of the tokens of packed(), documents numbered from uid."""
    data = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    types, n = np.frombuffer(data, "<u4", 2).tolist()
    at = 8 + 12 * types
    more = np.frombuffer(data, "<f4", n, at + 12 * n) if held else np.zeros(n, np.float32)
    doc, one, two = (from_planes(data, at + 4 * i * n, n) for i in range(3))
    return np.frombuffer(data, "<u8", types, 8), from_planes(data, 8 + 8 * types, types), uid + doc.astype(np.int64), one, two, more, np.full(n, held)


def by_type(t: np.ndarray, types: int, one: np.ndarray, two: np.ndarray, held: np.ndarray) -> np.ndarray:
    """An order by type, context and side; as one number for each token where that has room."""
    bits = int(max(one.max(), two.max())).bit_length()
    if types.bit_length() + 2 * bits + 1 > 63:
        return np.lexsort((held, two, one, t))
    key = t << bits
    for x, room in ((one, bits), (two, 1), (held, 0)):
        key |= x
        key <<= room
    return np.argsort(key)


def hot_counts(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Types, sorted, and counts that hot_types() sent; parts of a cell that share a task have them twice."""
    both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in packs]
    h, c = np.concatenate(both, 1) if both else np.empty((2, 0), np.int64)
    types, at = np.unique(h.view(np.uint64), return_index=True)
    return types, c[at]


DOC = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def document_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, each with its own figures and all sums that cells found for it; this task has both by base."""
    own, sums = [], []
    for batch in batches:
        own.append(batch.column("doc").drop_null())
        found = batch.filter(batch.column("sums").is_valid())
        sums += zip(found.column("base").to_pylist(), found.column("sums").to_pylist(), strict=True)
    own = pa.concat_arrays(own) if own else []
    if not len(own):
        return
    own = pa.Table.from_arrays(own.flatten(), names=[f.name for f in own.type]).sort_by("uid")
    uid = own.column("uid").to_numpy()
    known, base, score = (own.column(c).to_numpy().copy() for c in ("n_known", "base_score", "score"))
    for first, data in sums:
        n = int.from_bytes(data[:4], "little")
        at = np.searchsorted(uid, first + from_planes(data, 4, n).astype(np.int64))
        known[at] += from_planes(data, 4 + 4 * n, n)
        base[at] += np.frombuffer(data, "<f8", n, 4 + 8 * n)
        score[at] += np.frombuffer(data, "<f4", n, 4 + 16 * n)
    whole = [own.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens")] + [pa.array(x) for x in (known, base, score)]
    yield from pa.Table.from_arrays(whole, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]).to_batches(10_000)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pack: int = PACK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; pack: about the tokens of a task of cells."""
    flagged = with_flags(docs, id_col, text_col)
    training = flagged.where(~F.col("held_out"))
    counts = cut(token_counts(training))
    corpus = corpus_statistics(counts, training.count())
    model, cells = train(training, corpus)
    shared = docs.sparkSession.sparkContext.broadcast((corpus, model.vector(), cells.r, cells.b))
    total = corpus.tokens + 0.5 * (corpus.types + 1)
    tasks = 1 + corpus.rare_tokens // pack
    doc_type = pa.struct([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    names = ["task", "uid", "held", "pack", "doc"]

    def flushed(parts: list[tuple[np.ndarray, ...]], uid: int) -> Iterator[pa.RecordBatch]:
        """One pack for each task and side (held out or not) of the tokens held."""
        if not parts:
            return
        side, tokens, doc, one, two, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(side):
            return
        order = np.argsort(tokens)
        order = order[np.argsort(side[order].astype(np.uint16 if 2 * tasks < 1 << 16 else np.uint32), kind="stable")]
        keys, first = np.unique(side[order], return_index=True)
        packs = []
        for key, rows in zip(keys.tolist(), np.split(order, first[1:]), strict=True):
            packs.append(packed(tokens[rows], doc[rows], one[rows], two[rows], more[rows] if key % 2 else more[:0]))
        for at in range(0, len(packs), 256):
            k = keys[at : at + 256]
            columns = [pa.array(k >> 1, pa.int32()), pa.array(np.full(len(k), uid)), pa.array(k % 2 == 1), pa.array(packs[at : at + 256], pa.binary()), pa.nulls(len(k), doc_type)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents with what classes and cells say, and packs of the tokens outside the frequent words by task of cells."""
        corpus, vector, r, b = shared.value
        model, cells = LogBilinear(corpus.class_counts), cell_members(corpus)
        model.load(vector)
        cells.r, cells.b = r, b
        own_counts = np.concatenate([[corpus.texts], corpus.word_counts])
        parts, first_part = parts_of_cells(corpus.cell_counts, pack)
        uid = base_uid = TaskContext.get().partitionId() << 33
        held, rows = [], 0
        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                tokens, ends, sizes = sequences([t or b"" for t in batch.column("text").to_pylist()])
                classes, contexts = class_sequence(corpus, tokens, ends, sizes)
                rare = np.flatnonzero(classes > len(corpus.words))
                count = own_counts[np.minimum(classes, len(corpus.words))]
                base = np.log10((count + 0.5) / total)
                base[rare] = count[rare] = 0
                neural, tail, hidden = model.log10_and_tail(classes, contexts, 1 + len(corpus.words))
                at = corpus.cells(tokens[rare])
                neural[rare] += cells.log10(at, hidden.take(rare, 0))
                doc = np.repeat(np.arange(len(ends)), sizes)
                part = first_part[at] + batch.column("mark").to_numpy()[doc[rare]] % parts[at]
                of_held = np.asarray(batch.column("held_out").to_pylist(), bool)[doc[rare]]
                held.append((2 * (part % tasks) + of_held, tokens[rare], doc[rare] + (uid - base_uid), contexts[rare, 0], contexts[rare, 1], (tail - neural)[rare]))
                rows += len(rare)
                starts = ends - sizes + 1
                columns = [uid + np.arange(len(ends)), batch.column("doc_id"), batch.column("held_out"), sizes.astype(np.int64), np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(neural, starts)]
                own = pa.StructArray.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, doc_type, strict=True)], fields=list(doc_type))
                columns = [pa.array(np.arange(len(ends)) % tasks, pa.int32()), pa.array(np.full(len(ends), base_uid)), pa.nulls(len(ends), pa.bool_()), pa.nulls(len(ends), pa.binary()), own]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                uid += len(ends)
                if rows > HOLD:
                    yield from flushed(held, base_uid)
                    held, rows, base_uid = [], 0, uid
        yield from flushed(held, base_uid)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as they came, and for each base the sums over its documents' tokens in this task's cells."""
        corpus, vector, _, _ = shared.value
        packs, bases, hot = [], [], []
        for batch in batches:
            hot += batch.filter(pc.and_(batch.column("pack").is_valid(), batch.column("held").is_null())).column("pack").to_pylist()
            found = batch.filter(batch.column("held").is_valid())
            packs += [unpacked(*row) for row in zip(*(found.column(c).to_pylist() for c in ("pack", "uid", "held")), strict=True)]
            bases += found.column("uid").to_pylist()
            own = batch.filter(batch.column("doc").is_valid())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("uid"), pa.nulls(own.num_rows, pa.binary()), own.column("doc")], names=["base", "sums", "doc"])
        if not packs:
            return
        own_types, sizes, uid, one, two, more, held = (np.concatenate(x) for x in zip(*packs, strict=True))
        packs.clear()
        whole, whole_counts = hot_counts(hot)
        types, at = np.unique(own_types, return_inverse=True)
        if len(whole):
            every = np.union1d(types, whole)
            types, at = every, np.searchsorted(every, types)[at]
        at = np.repeat(at, sizes)
        order = by_type(at, len(types), one, two, held)
        uid, at, one, two, more, held = (x.take(order) for x in (uid, at, one, two, more, held))
        c = np.bincount(at[~held], minlength=len(types))
        c[np.searchsorted(types, whole)] = whole_counts
        of = corpus.cells(types)
        order = np.lexsort((types, of))
        order = order[c[order] > 0]
        place = np.full(len(types), -1)
        place[order] = np.arange(len(order))
        member, count = place[at], c[at]
        score = more + np.log10(corpus.unknown)
        if len(order):
            model = LogBilinear(corpus.class_counts)
            model.load(vector)
            known = np.flatnonzero(member >= 0)
            known = known[np.argsort(of[at[known]], kind="stable")]
            cells_of, counts_of = of[at[known]], c[order]
            first = np.flatnonzero(np.concatenate([[True], cells_of[1:] != cells_of[:-1], [True]]))
            starts = np.searchsorted(of[order], cells_of[first[:-1]])
            stops = np.searchsorted(of[order], cells_of[first[:-1]], "right")

            def cell(i: int) -> Cell:
                own, lo, hi = known[first[i] : first[i + 1]], starts[i], stops[i]
                codes, row = np.unique(one[own].astype(np.int64) << 32 | two[own], return_inverse=True)
                hidden = model.hidden(np.stack([codes >> 32, codes & 0xFFFFFFFF], 1))
                return Cell(int(cells_of[first[i]]), member[own] - lo, row, with_ones(hidden), counts_of[lo:hi], held[own])

            longest = np.argsort(-np.add.reduceat(~held[known], first[:-1], dtype=np.int64), kind="stable").tolist()
            for s in range(0, len(longest), TOGETHER):
                some = longest[s : s + TOGETHER]
                for i, found in zip(some, cell_scores([cell(i) for i in some]), strict=True):
                    score[known[first[i] : first[i + 1]]] = found + np.log10(1 - corpus.unknown)
        uid, at = np.unique(uid, return_inverse=True)
        known, base, total_score = (np.bincount(at, x, len(uid)) for x in (count > 0, np.log10((count + 0.5) / total), score))
        bases = np.unique(np.array(bases, np.int64))
        cuts = np.append(np.searchsorted(uid, bases), len(uid)).tolist()
        rows = []
        for first, lo, hi in zip(bases.tolist(), cuts[:-1], cuts[1:], strict=True):
            rows.append(b"".join([(hi - lo).to_bytes(4, "little"), planes(uid[lo:hi] - first), planes(known[lo:hi]), base[lo:hi].astype("<f8").tobytes(), total_score[lo:hi].astype("<f4").tobytes()]))
        for s in range(0, len(rows), 256):
            e = min(s + 256, len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(bases[s:e]), pa.array(rows[s:e], pa.binary()), pa.nulls(e - s, doc_type)], names=["base", "sums", "doc"])

    marked = flagged.withColumn("mark", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)))
    found = marked.mapInArrow(run, f"task int, uid long, held boolean, pack binary, doc struct<{DOC}>")
    if corpus.cell_counts.max(initial=0) > pack:
        found = found.unionByName(hot_types(counts, corpus, pack, tasks))
    summed = found.repartition(tasks, "task").mapInArrow(within, f"base long, sums binary, doc struct<{DOC}>").repartition(tasks, "base").mapInArrow(document_totals, ROW)
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")
