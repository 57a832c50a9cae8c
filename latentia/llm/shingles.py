"""Word shingles as 64-bit hashes, computed over whole batches of texts with numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_rng = np.random.default_rng(20240607)
#: Hash parameters: random 64-bit numbers from a fixed seed, so every worker agrees.
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
FINAL_A, FINAL_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
POWERS = np.cumprod(np.full(256, 0xD6E8FEB86659FD93, np.uint64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Codes of bytes in words, A-Z as a-z and blanks as 0, and the inverse of the powers' base.
WORD_CODES = np.where(IS_SPACE, np.uint64(0), BYTE_CODES[LOWER])
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
RUN = 1 << 14  # bytes hashed at once, words that begin there
LONG_POWERS = np.cumprod(np.full(RUN + 256, POWERS[0], np.uint64))
SHIFTS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(RUN - 1, INVERSE, np.uint64)]))


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * FINAL_A
    h = (h ^ (h >> np.uint64(27))) * FINAL_B
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, a blank between
    starts: np.ndarray  # of words in data
    stops: np.ndarray
    hashes: np.ndarray  # of the words, A-Z lower-cased
    counts: np.ndarray  # words of each text


def short_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sum of each word's byte codes times POWERS of their places, for words of up to 256 bytes.

    Powers count from the run's beginning, so that no byte's place in its word is needed; a word's sum is then
    divided by its own first power (odd numbers have inverses modulo 2^64).
    """
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + RUN, RUN)).tolist()
    for run, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a == b:
            continue
        codes = WORD_CODES.take(data[run * RUN : stops[b - 1]])
        codes *= LONG_POWERS[: len(codes)]
        at = starts[a:b] - run * RUN
        np.multiply(np.add.reduceat(codes, at), SHIFTS.take(at), out=out[a:b])
    return out


def hashed_words(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    none = np.empty(0, np.int64)
    gap = np.ones(len(data) + 2, bool)
    IS_SPACE.take(data, out=gap[1:-1], mode="clip")
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return Words(data, none, none, np.empty(0, np.uint64), np.zeros(len(texts), np.int64))
    sizes = stops - starts
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
    if sizes.max() <= 256:
        return Words(data, starts, stops, scramble(short_codes(data, starts, stops)), counts)
    inside = np.flatnonzero(~gap[1:-1])
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(begins, sizes)
    codes = BYTE_CODES[LOWER[data[inside]]] * POWERS[place & 255]
    if sizes.max() > 256:  # bytes beyond 256 in a word get their block mixed in
        codes = codes * np.where(place > 255, scramble((place >> 8).astype(np.uint64)) | np.uint64(1), np.uint64(1))
    return Words(data, starts, stops, scramble(np.add.reduceat(codes, begins)), counts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and each text's number of words."""
    words = hashed_words(texts)
    return words.hashes, words.counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k words; the whole text if it has fewer; none without words."""
    h, counts = word_hashes(texts)
    joined = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        joined = scramble(joined * STEP + h[i : i + len(joined)] + np.uint64(i))
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(joined[at : at + n - k + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for i in range(at, at + n):
                one = scramble(one * STEP + h[i : i + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


class OnePermutation:
    """One-permutation hashing: each set is hashed once, its hashes fall into bins by their top bits,
    a bin keeps its least hash, and empty bins borrow by optimal densification (each empty bin follows its
    own fixed random sequence of donors until it meets a filled one)."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        tries = rng.integers(0, self.bins, (self.bins, 4 * self.bins))
        every = np.array([rng.permutation(self.bins) for _ in range(self.bins)])
        self.donors = np.hstack([tries, every])
        edges = (np.arange(self.bins + 1, dtype=object) * (1 << 64)) // self.bins
        self.edges = np.array([min(int(e), (1 << 64) - 1) for e in edges], np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of every bin after densification; hashes are sorted, distinct and not empty."""
        at = np.searchsorted(hashes, self.edges)
        filled = at[1:] > at[:-1]
        values = hashes[np.minimum(at[:-1], len(hashes) - 1)]
        empty = np.flatnonzero(~filled)
        if len(empty):
            near = self.donors[empty, :8]
            ok = filled[near]
            hit = ok.argmax(1)
            donor = near[np.arange(len(empty)), hit]
            far = np.flatnonzero(~ok[np.arange(len(empty)), hit])
            if len(far):
                rows = self.donors[empty[far]]
                donor[far] = rows[np.arange(len(far)), filled[rows].argmax(1)]
            values[empty] = values[donor]
        return values

    def lanes(self, hashes: np.ndarray) -> np.ndarray:
        """16 bits of each bin's value; the lanes of a band, side by side, are the band's bucket."""
        return (self.signature(hashes) & np.uint64(0xFFFF)).astype(np.uint16)


def same_share(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
