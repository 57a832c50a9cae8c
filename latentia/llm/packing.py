"""Operator 10: packing by cutting-stock column generation.

Documents are tokenized and cut into whole sequences of 2048, one piece that is a multiple of 16, and a
tail under 16.  So there are at most 143 piece lengths whatever the corpus, and the histogram over them is
the demand of a cutting-stock problem: a linear program over patterns (how many pieces of each length fill
one sequence), where a knapsack dynamic program over the dual prices brings in new patterns.  Solutions
are rounded down and what is left is packed greedily (a bounded number of sequences).  Pieces of each length are
ranked; a pattern used x times with a pieces of that length takes the next x * a ranks.

Ranks come from counts within the tasks of the tokenizing stage plus prefix sums of those counts, so no
task ever sees all pieces of a length.

Defined cases: a null or empty text is the end id alone (one piece of length 1); repeated rows are packed
as often as they occur; an empty table gives no pieces; long documents give many pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentia.llm.common import cut, slices
from latentia.llm.shingles import hashed_words

LENGTH = 2048
UNIT = 16
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Column generation ends where no pattern is worth more than 1 + GAP sequences.
GAP, REFACTOR, MOST_STEPS = 1e-7, 20, 200_000
CACHE_WORDS = 1_500_000
#: Words whose runs are plain to see: ASCII but no blanks or apostrophe, and Latin letters with one lower case.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-įı-ſ]+")
RUNS = re.compile(r"[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, local long"


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordTokenizer:
    """Token ids of whole texts, each distinct word tokenized once.

    White space separates words in this vocabulary (it is dropped before the merges, and no
    normalization crosses it), and case does not matter, so the ids of a text are those of its lower-cased words.
    Words are kept by 64-bit hash.  A plain word (Latin letters, digits, punctuation, no apostrophe) is
    the chain of its runs, which are encoded many at a time: a run ends where a token ends a word.  Other
    words are encoded one by one, and texts that hold special tokens as wholes.
    """

    def __init__(self, name: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)

    def encoded(self, runs: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs in one array, and the number of each; plain runs go in one call."""
        if plain and runs:
            ids = np.array(self.tokenizer.encode(" ".join(runs), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(runs):
                return ids, np.diff(ends, prepend=0)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), sizes

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Keep the ids of new words: each is a chain of runs, or one run of its own if it isn't plain."""
        runs: dict[str, int] = {}
        odd: list[str] = []
        chain, counts = [], []
        for w in words:
            if PLAIN.fullmatch(w):
                parts = RUNS.findall(w.lower())
                chain += [runs.setdefault(r, len(runs)) for r in parts]
                counts.append(len(parts))
            else:
                odd.append(w)
                chain.append(-len(odd))
                counts.append(1)
        a, na = self.encoded(list(runs), True)
        b, nb = self.encoded(odd, False)
        ids, sizes = np.concatenate([a, b]), np.concatenate([na, nb])
        rows = np.array(chain)
        rows = np.where(rows < 0, len(runs) - rows - 1, rows)
        own = np.add.reduceat(sizes[rows], np.cumsum(counts) - counts).astype(np.int32)
        starts = len(self.flat) + np.cumsum(own, dtype=np.int64) - own
        self.flat = np.concatenate([self.flat, ids[spread((np.cumsum(sizes) - sizes)[rows], sizes[rows])]])
        order = np.argsort(keys := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes, self.starts, self.sizes = keys[order], np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, own])[order]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words = hashed_words(texts)
        types, first, at = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self.forget()
        place = np.searchsorted(self.hashes, types)
        new = np.flatnonzero((place == len(self.hashes)) | (self.hashes[np.minimum(place, len(self.hashes) - 1)] != types)) if len(self.hashes) else np.arange(len(types))
        if len(new):
            data = words.data.tobytes()
            spans = zip(words.starts[first[new]].tolist(), words.stops[first[new]].tolist(), strict=True)
            self.learn(types[new], [data[a:b].decode("utf-8", "replace") for a, b in spans])
            place = np.searchsorted(self.hashes, types)
        row = place[at]
        sizes = self.sizes[row]
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = self.flat[spread(self.starts[row], sizes)]
        last = np.concatenate([[0], ends])[np.cumsum(words.counts)]
        out = np.split(ids, last[:-1]) if len(texts) else []
        for i, t in enumerate(texts):
            if b"<|" in t:
                out[i] = np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def piece_lengths(tokens: int, length: int = LENGTH, unit: int = UNIT) -> list[int]:
    whole, rest = divmod(tokens, length)
    tail = rest % unit
    return [length] * whole + [x for x in (rest - tail, tail) if x]


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, unit: int = UNIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece; part and local number the pieces of a length within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers.setdefault(vocabulary, None) or WordTokenizer(vocabulary)
        _tokenizers[vocabulary] = tok
        part, seen = TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [b or b"" for b in batch.column("text").to_pylist()]
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, ids in zip(batch.column("doc_id").to_pylist(), tok.encode(texts), strict=True):
                    raw = np.append(ids, END_ID).astype("<u4")
                    view, at = memoryview(raw).cast("B"), 0
                    for n in piece_lengths(len(raw), length, unit):
                        local = seen.get(n, 0)
                        seen[n] = local + 1
                        for col, x in zip(out, (doc, at, n, zlib.crc32(view[4 * at : 4 * (at + n)]), len(raw), local), strict=True):
                            col.append(x)
                        at += n
                doc, start, n, crc, tokens, local = out
                yield pa.record_batch(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(crc, pa.int64()), pa.array(tokens, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(local, pa.int64())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, PIECES)


class Pattern(NamedTuple):
    counts: dict[int, int]  # pieces of each length
    times: int


def price_columns(lengths: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern's value, and patterns worth over a sequence, a column each:
    for each length the most valuable pattern that holds it.

    A length is offered in lots of 1, 2, 4 ... pieces, so each lot is one vector step over all capacities.
    """
    best, lots, took = np.zeros(capacity + 1), [], []
    for j, (n, p) in enumerate(zip(lengths, prices.tolist(), strict=True)):
        lot = 1
        while p > 0 and lot * n <= capacity:
            more = best[: capacity + 1 - lot * n] + lot * p
            gain = more > best[lot * n :]
            if gain.any():
                best[lot * n :][gain] = more[gain]
                lots.append((j, lot))
                took.append(gain)
            lot *= 2
    rooms = capacity - np.array(lengths)
    found = {}
    for j in np.flatnonzero(prices + best[rooms] > 1 + GAP).tolist():
        column, w = np.zeros(len(lengths)), int(rooms[j])
        column[j] = 1
        for (i, lot), gain in zip(reversed(lots), reversed(took), strict=True):
            at = w - lot * lengths[i]
            if at >= 0 and gain[at]:
                column[i] += lot
                w = at
        found[column.tobytes()] = column
    return float(best[capacity]), np.array(list(found.values())).reshape(-1, len(lengths)).T


def solve(demand: dict[int, int], capacity: int = LENGTH) -> list[Pattern]:
    """Patterns that together hold exactly the demand; few sequences are left unfilled.

    Revised simplex with column generation until no pattern is worth more than a sequence.  The work depends on the number of
    different lengths and the capacity only.  The linear program's demand is raised by up to a millionth, each length by
    another part, so no step is idle and none comes back; the basis is factored anew every few steps.
    """
    lengths = sorted((n for n, d in demand.items() if d and n < capacity), reverse=True)
    full = [Pattern({capacity: 1}, demand[capacity])] if demand.get(capacity) else []
    if not lengths:
        return full
    exact = np.array([demand[n] for n in lengths], np.int64)
    d = exact * (1 + 1e-6 * np.random.default_rng(len(lengths)).uniform(0.1, 1, len(lengths)))
    basis = np.diag([float(capacity // n) for n in lengths])
    inverse, pool = np.linalg.inv(basis), np.zeros((len(lengths), 0))
    x = inverse @ d
    for step in range(MOST_STEPS):
        prices = inverse.sum(0)
        worth = prices @ pool
        if not len(worth) or worth.max() <= 1 + GAP:
            value, more = price_columns(lengths, prices, capacity)
            if value <= 1 + GAP:
                break
            pool = np.hstack([pool[:, worth > 0.9], more])
            worth = prices @ pool
        column = pool[:, int(worth.argmax())]
        way = inverse @ column
        able = way > 1e-7
        ratio = np.where(able, np.maximum(x, 0) / np.where(able, way, 1), np.inf)
        near = np.flatnonzero(ratio <= ratio.min() * (1 + 1e-9))
        out = int(near[way[near].argmax()])
        basis[:, out] = column
        if step % REFACTOR == REFACTOR - 1:
            inverse = np.linalg.inv(basis)
            x = inverse @ d
        else:
            row, move = inverse[out] / way[out], ratio[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
            x = x - move * way
            x[out] = move
    else:
        raise RuntimeError(f"column generation has not converged in {MOST_STEPS} steps")
    times = np.floor(np.maximum(np.linalg.solve(basis, exact.astype(float)), 0) + 1e-9).astype(np.int64)
    whole = np.rint(basis).astype(np.int64)
    left = exact - whole @ times
    while (left < 0).any():  # rounding noise only
        used = int(np.flatnonzero((times > 0) & (whole[int(left.argmin())] > 0))[0])
        times[used] -= 1
        left = exact - whole @ times
    rounded = [Pattern({n: int(a) for n, a in zip(lengths, whole[:, j].tolist(), strict=True) if a}, int(t)) for j, t in enumerate(times) if t]
    return full + rounded + greedy(dict(zip(lengths, left.tolist(), strict=True)), capacity)


def greedy(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Longest pieces first into each sequence; equal sequences are one pattern."""
    out: list[Pattern] = []
    left = {n: c for n, c in sorted(left.items(), reverse=True) if c}
    while left:
        room, counts = capacity, {}
        for n, c in left.items():
            if a := min(c, room // n):
                counts[n], room = a, room - a * n
        times = min(left[n] // a for n, a in counts.items())
        out.append(Pattern(counts, times))
        left = {n: m for n, c in left.items() if (m := c - times * counts.get(n, 0))}
    return out


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces in a sequence, offset of the first), in rank order."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for n, a in sorted(p.counts.items(), reverse=True):
            rows.setdefault(n, []).append((ranks.get(n, 0), sequence, a, offset))
            ranks[n] = ranks.get(n, 0) + a * p.times
            offset += a * n
        sequence += p.times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, unit: int = UNIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    pieces = cut(tokenized_pieces(docs, id_col, text_col, length, unit, vocabulary))
    held = cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    demand = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(solve(demand, length))
    before = Window.partitionBy("length").orderBy("part")
    bases = held.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for one in np.unique(n):
                rows, at = table[int(one)], np.flatnonzero(n == one)
                first, seq, a, off = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
                sequence[at] = seq + (rank[at] - first) // a
                offset[at] = off + (rank[at] - first) % a * one
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start")] + [pa.array(n.astype(np.int64))] + [batch.column(c) for c in ("ids_crc32", "doc_tokens")] + [pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, schema)
