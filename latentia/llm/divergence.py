"""Operator 13: source divergence audit.

For every language the terms in at least ``least`` of its documents are kept.  Each (lang, source) group and each language
gets smoothed per-billion shares p of the kept terms, and f(p, q) = floor((p - q)^2 / (p + q)) tells how far two of them are
apart.  Part ``pair``: f summed over all kept terms for every two sources of a language.  Part ``term``: the ten terms of a
group that are most over-represented against its language.

Texts are counted where they are (one row per task, group and distinct term leaves a task).  Kept terms are dealt by hash into
blocks of about ``TERMS`` terms of a language; a task holds a block as a dense int64 tile of groups by terms and computes
all pairs of groups by broadcasting one group's row against the others'.  The partial pair matrices are summed over blocks, the
blocks' ten best terms of each group are merged.  Where a language has more than ``GROUPS`` sources, a tile holds two blocks of
groups, so a tile's size is bounded by TERMS * 2 * GROUPS cells.

All arithmetic is exact: shares by long division in int64, good for counts up to 9e15.

Defined cases: null text, lang or source is ''; a group without terms gives pairs by its smoothed shares and no terms; a
language without kept terms gives pairs of value 0; equal rows count as often as they occur; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentia.llm.common import Scratch, cut

LEAST = 10
TOP = 10
TERMS, GROUPS = 512, 128
#: Distinct (group, term) entries that a task holds before it hands them on.
ENTRIES = 200_000
SCALE = 1_000_000_000
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, n_docs long"
TILE = "lang string, part string, i long, j long, term string, value long"


def counted(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Partial counts (lang, source, term, n, n_docs); each group also has a row without term."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (a, b), (n, n_docs) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a] * len(terms)), pa.array([b] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(n_docs[t] for t in n)], pa.int64())],
                names=["lang", "source", "term", "n", "n_docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for a, b, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                n, n_docs = held.setdefault((a, b), (Counter(), Counter()))
                size -= len(n)
                found = Counter((raw.as_py() or b"").translate(TO_TERMS).split())
                n.update(found)
                n_docs.update(found.keys())
                size += len(n)
                if size > ENTRIES:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    plain = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(run, COUNTED)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / whole) by long division in three steps of a thousand."""
    rest, out = counts + 2, np.zeros_like(counts + whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 1e9 + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


def tile(part: pd.DataFrame) -> pd.DataFrame:
    """Partial pair sums and the best terms of one block of terms and one or two blocks of groups.

    Rows without a term say which groups there are: dense number, block of groups, N, N of the language, V.
    """
    groups = part[part["term"].isna()].drop_duplicates("gi").sort_values("gi")
    cells = part[part["term"].notna()]
    numbers, first, second = groups["gi"].to_numpy(), int(part["a"].iloc[0]), int(part["b"].iloc[0])
    codes, terms = pd.factorize(cells["term"], sort=False)
    counts = np.zeros((len(groups), len(terms)), np.int64)
    counts[np.searchsorted(numbers, cells["gi"].to_numpy()), codes] = cells["n"].to_numpy()
    v = int(groups["v"].iloc[0])
    p = shares(counts, groups["size"].to_numpy()[:, None] + 2 * v) if len(terms) else counts
    of = groups["gb"].to_numpy()
    lang, out = part["lang"].iloc[0], []
    for x in np.flatnonzero(of == first):
        others = np.flatnonzero((of == second) & (numbers > numbers[x]))
        if len(others):
            sums = apart(p[x], p[others]).sum(1)
            out.append(pd.DataFrame({"lang": lang, "part": "pair", "i": numbers[x], "j": numbers[others], "term": None, "value": sums}))
    if first == second and len(terms):
        total = np.zeros(len(terms), np.int64)
        total[codes] = cells["total"].to_numpy()
        q = shares(total, np.full(len(terms), int(groups["lang_size"].iloc[0]) + 2 * v))
        for x in range(len(groups)):
            over = np.flatnonzero((counts[x] > 0) & (p[x] > q))
            values = apart(p[x, over], q[over]).tolist()
            best = heapq.nsmallest(TOP, zip([-f for f in values], [terms[t].encode() for t in over], strict=True))
            if best:
                out.append(pd.DataFrame({"lang": lang, "part": "term", "i": numbers[x], "j": None, "term": [t.decode() for _, t in best], "value": [-f for f, _ in best]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["lang", "part", "i", "j", "term", "value"])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank (from 1 in each group and part, value descending, then item ascending)."""
    with Scratch(docs.sparkSession, "divergence") as scratch:
        counts = scratch.cut(counted(docs, lang, source, text).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")))
        terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least)
        terms = scratch.cut(terms.select("lang", "term", "total"))
        kept = scratch.cut(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(terms, ["lang", "term"]))

        per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
        per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = counts.where("term IS NULL").select("lang", "source").join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
        groups = groups.withColumn("gi", place.cast("long")).withColumn("gb", F.floor(F.col("gi") / GROUPS)).na.fill(0, ["size", "v", "lang_size"])
        groups = groups.withColumn("blocks", F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1))).withColumn("last_gb", F.max("gb").over(Window.partitionBy("lang")))
        groups = scratch.cut(groups)

        block = F.pmod(F.xxhash64("term"), F.col("blocks"))
        named = kept.join(groups.select("lang", "source", "gi", "gb", "blocks", "last_gb"), ["lang", "source"]).withColumn("block", block)
        cells = named.select("lang", "block", "gi", "gb", "last_gb", "term", "n", "total", *[F.lit(None).cast("long").alias(c) for c in ("size", "lang_size", "v")])
        marks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        marks = marks.select("lang", "block", "gi", "gb", "last_gb", F.lit(None).cast("string").alias("term"), *[F.lit(None).cast("long").alias(c) for c in ("n", "total")], "size", "lang_size", "v")
        tiles = cells.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_gb"))))
        tiles = tiles.withColumn("a", F.least("gb", "other")).withColumn("b", F.greatest("gb", "other")).drop("other", "last_gb")
        parts = scratch.cut(tiles.groupBy("lang", "block", "a", "b").applyInPandas(tile, TILE))

        names = groups.select("lang", F.col("gi").alias("i"), "source")
        sums = parts.where("part = 'pair'").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        both = sums.union(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
        pairs = both.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
        best = parts.where("part = 'term'").join(names, ["lang", "i"]).withColumn("item", F.col("term"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int")
        columns = ["lang", "source", "part", "item", "value", "rank"]
        found = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(*columns)
        return cut(found.unionByName(best.withColumn("rank", rank).where(F.col("rank") <= TOP).select(*columns)))


SQL = """
    WITH d AS (
      SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
      FROM documents
    ), k AS (
      SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10
    ), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
    ), g AS (SELECT DISTINCT lang, source FROM d
    ), c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL
    ), cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), size AS (SELECT lang, source, sum(n) AS size FROM cell GROUP BY ALL
    ), p AS (SELECT cell.lang, cell.source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (size + 2 * v) AS p FROM cell JOIN size USING (lang, source) JOIN v USING (lang)
    ), q AS (
      SELECT t.lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY t.lang) + 2 * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM cell GROUP BY ALL) t JOIN v USING (lang)
    ), f AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    ), terms AS (
      SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
