"""Operator 7: secret scans.

Three base patterns give spans that always stay.  The method adds strings that look random.  A candidate is a run of 20 or more
characters of encoded strings (padding only at its end; a run with many slashes is a path, whose parts are candidates).  Its
encoding is inferred: the smallest of ALPHABETS that holds it.  A battery tests it as a random string of that alphabet:
chi-squared uniformity, runs above and below the alphabet's middle, serial correlation of neighbours.  A string that the
battery rejects is not taken.  The others get a p-value as ordinary text: how even their characters are and how unusual
their neighbours, against counts of neighbouring characters within the words of all documents (first pass), the smaller
of both times two.  False discoveries are controlled by Benjamini-Hochberg within length classes, over all candidates of all
documents that lie outside base spans: a bounded histogram of p-values by length class goes to the driver, thresholds come back.

Decimal strings can hardly be told from ordinary numbers, whose digits are nearly even too: only long ones pass.

Defined cases: a null text is empty and has no spans; offsets are code points, ends exclusive; repeated rows repeat their
results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.llm.common import cut, slices

#: The base patterns and the least characters of a finding.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encodings by size; letters and digits in the order of their codes.
ALPHABETS = (
    ("decimal", DIGITS), ("hex", DIGITS + LOWER[:6]), ("hex_upper", DIGITS + UPPER[:6]), ("letters", LOWER), ("letters_upper", UPPER), ("base32", UPPER + DIGITS[2:8]),
    ("base32_lower", LOWER + DIGITS[2:8]), ("base36", DIGITS + LOWER), ("base36_upper", DIGITS + UPPER), ("letters_both", UPPER + LOWER), ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64_url", UPPER + LOWER + DIGITS + "-_"), ("any", UPPER + LOWER + DIGITS + "+/-_"),
)
CODES = [{c: i for i, c in enumerate(chars)} for _, chars in ALPHABETS]
MEMBERS = [frozenset(chars) for _, chars in ALPHABETS]
RANDOM_LEVEL = 1e-3
FALSE_SHARE = 0.01
LENGTHS = (24, 32, 40, 64, 128)
STEPS = 60
#: Characters that are counted in words, case-folded: letters, then digits; the surprise of a pair goes up to FARTHEST.
FOLDED = {c: i for i, c in enumerate(LOWER)} | {c: i for i, c in enumerate(UPPER)} | {c: 26 + i for i, c in enumerate(DIGITS)}
COUNTED = UPPER + LOWER + DIGITS + "+/-_"
FARTHEST = 7.0


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    return normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) if x > 0 else 1.0


class Prose(NamedTuple):
    """Ordinary text of a corpus: surprise of neighbours (folded), its mean and variance, and by alphabet how uneven characters are."""

    surprise: list[list[float]]
    mean: float
    variance: float
    excess: list[float]


def prose_of(pairs: np.ndarray) -> Prose:
    """From counts of neighbouring characters of COUNTED within words."""
    fold = np.array([FOLDED.get(c, 36) for c in COUNTED])
    folded = np.zeros((37, 37))
    np.add.at(folded, (fold[:, None], fold[None, :]), pairs)
    counts = folded[:36, :36] + 0.5
    surprise = np.minimum(-np.log(counts / counts.sum(1, keepdims=True)), FARTHEST)
    mean = float((counts * surprise).sum() / counts.sum())
    single, excess = pairs.sum(0) + pairs.sum(1) + 0.5, []
    for _, chars in ALPHABETS:
        own = single[[COUNTED.index(c) for c in chars]]
        excess.append(float(len(chars) * ((own / own.sum()) ** 2).sum() - 1))
    return Prose(surprise.tolist(), mean, float((counts * (surprise - mean) ** 2).sum() / counts.sum()), excess)


def prose(docs: DataFrame) -> Prose:
    """Counts over the words of all texts, added up in the tasks; each task gives one row."""
    symbol = np.full(256, len(COUNTED), np.int32)
    symbol[np.frombuffer(COUNTED.encode(), np.uint8)] = np.arange(len(COUNTED))
    n = len(COUNTED) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n * n, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                at = symbol[np.frombuffer(b" ".join([t or b"" for t in batch.column("text").to_pylist()]), np.uint8)]
                held += np.bincount(at[:-1] * n + at[1:], minlength=n * n)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["held"])

    total = np.zeros(n * n, np.int64)
    for row in docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "held binary").toLocalIterator():
        total += np.frombuffer(row["held"], np.int64)
    return prose_of(total.reshape(n, n)[:-1, :-1])


def inferred(body: str) -> int:
    """Number of the smallest alphabet that holds all characters."""
    own = set(body)
    return next(i for i, m in enumerate(MEMBERS) if own <= m)


def battery(body: str, kind: int) -> float:
    """p-value as a random string of the alphabet: three times the least of uniformity, runs and serial correlation."""
    codes, size, n = [CODES[kind][c] for c in body], len(CODES[kind]), len(body)
    even = chi2_upper(uniformity(body, size), size - 1)
    high = [2 * c >= size for c in codes]
    changes = sum(a != b for a, b in zip(high, high[1:], strict=False))
    share = (size // 2) / size
    expect = (n - 1) * 2 * share * (1 - share)
    runs = math.erfc(abs(changes - expect) / math.sqrt(2 * max(expect * 0.5, 1.0)))
    mean = (size - 1) / 2
    spread = n * (size * size - 1) / 12
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / spread
    linked = math.erfc(abs(serial) * math.sqrt(n) / math.sqrt(2))
    return min(1.0, 3 * min(even, runs, linked))


def uniformity(body: str, size: int) -> float:
    """Chi-squared of the characters against an even alphabet."""
    return sum(body.count(c) ** 2 for c in set(body)) * size / len(body) - len(body)


def as_prose(body: str, kind: int, usual: Prose) -> float:
    """p-value as ordinary text: twice the lesser of too even characters and too unusual neighbours."""
    size, n = len(CODES[kind]), len(body)
    mean, dev = size - 1 + n * usual.excess[kind], math.sqrt(2 * (size - 1) + 4 * n * usual.excess[kind])
    flat = normal_tail((mean - uniformity(body, size)) / dev)
    codes = [FOLDED.get(c, -1) for c in body]
    seen = [usual.surprise[a][b] for a, b in zip(codes, codes[1:], strict=False) if a >= 0 and b >= 0]
    odd = normal_tail((sum(seen) - len(seen) * usual.mean) / math.sqrt(len(seen) * usual.variance)) if seen and usual.variance else 1.0
    return min(1.0, 2 * min(flat, odd))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of strings to test."""
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if "/" not in s or 16 * s.count("/") <= len(s) and s.lower() != s and s.upper() != s and any(c.isdigit() for c in s):
            yield m.start(), m.end()
            continue
        at = m.start()
        for part in s.split("/"):
            if len(part.rstrip("=")) >= LEAST:
                yield at, at + len(part)
            at += len(part) + 1


def tested(text: str, base: list[tuple[int, int, int]], usual: Prose) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, length class, step) of the candidates outside base spans; step: -4 log10 of the p-value as ordinary text, 0 if not random."""
    at = 0
    for start, end in candidates(text):
        while at < len(base) and base[at][2] <= start:
            at += 1
        if any(e > start for _, _, e in itertools.takewhile(lambda b, end=end: b[0] < end, itertools.islice(base, at, None))):
            continue
        body = text[start:end].rstrip("=")
        kind = inferred(body)
        p = as_prose(body, kind, usual)
        step = min(STEPS, int(-4 * math.log10(max(p, 1e-15)))) if battery(body, kind) >= RANDOM_LEVEL else 0
        yield start, end, sum(end - start >= x for x in LENGTHS), step


def base_spans(text: str, lowered: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted by start, then kind."""
    spans = []
    if any(c in lowered for c in CUES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


FOUND = "doc_id long, spans array<struct<start:int,kind:int,end:int>>, tested array<struct<start:int,end:int,length:int,step:int>>"


def scanned(docs: DataFrame, usual: Prose) -> DataFrame:
    """Base spans and tested candidates of each document."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    test_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("step", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                spans, tests = [], []
                for raw in batch.column("text").to_pylist():
                    raw = raw or b""
                    text = raw.decode("utf-8", "replace")
                    base = base_spans(text, raw.lower())
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                    tests.append([dict(zip(("start", "end", "length", "step"), t, strict=True)) for t in tested(text, base, usual)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, span_type), pa.array(tests, test_type)], names=["doc_id", "spans", "tested"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, FOUND)


def discovery_steps(found: DataFrame) -> dict[int, int]:
    """By length class the least step that is a discovery (Benjamini-Hochberg on the histogram of all candidates)."""
    held = found.select(F.explode("tested").alias("t")).groupBy("t.length", "t.step").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for c in range(len(LENGTHS) + 1):
        by_step = {r["step"]: r["n"] for r in held if r["length"] == c}
        m, above = sum(by_step.values()), 0
        out[c] = STEPS + 1
        for s in range(STEPS, 0, -1):
            above += by_step.get(s, 0)
            if above and 10 ** (-s / 4) * m / above <= FALSE_SHARE:
                out[c] = s
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, all_spans: array of (start, kind, end) with kind an index of KINDS, in order."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = cut(scanned(own, prose(own)))
    steps = discovery_steps(found)
    table = F.array(*[F.lit(steps[c]) for c in range(len(LENGTHS) + 1)])
    extra = F.filter("tested", lambda t: t["step"] >= F.get(table, t["length"]))
    more = F.transform(extra, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return found.select("doc_id", F.array_sort(F.concat("spans", more)).alias("all_spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    name = F.array(*map(F.lit, KINDS))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("all_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("all_spans", lambda s: s["kind"] < 3)
    return scan(docs).select("doc_id", *[of(k).alias(f"n_{n}") for k, n in enumerate(KINDS)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every secret span replaced by [kind]; the base patterns and the same thresholds decide.

    The first pass sees all documents and only fixes the thresholds; the second rewrites each text where it
    is, so no text is shuffled.  ``length_col`` follows the new text where it exists; all other columns stay.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    usual = prose(own)
    steps = discovery_steps(cut(scanned(own, usual)))

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        spans = base_spans(text, text.encode("utf-8", "replace").lower())
        spans += [(start, 3, end) for start, end, length, step in tested(text, spans, usual) if step >= steps[length]]
        out, at = [], 0
        for s, k, e in sorted(spans):
            if e > at:
                out += [text[at:s], f"[{KINDS[k]}]"] if s >= at else []
                at = e
        return "".join(out) + text[at:]

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                i = names.index(text_col)
                texts = pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type)
                columns = [texts if j == i else batch.column(j) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in names:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType)).select(*names)
    return out


def span_digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
