"""Operator 6: near-duplicate detection with one-permutation MinHash.

1. Each text becomes its set of word shingles and a one-permutation sketch of 128 lanes (optimal
   densification), cut into 32 bands of 4.  Texts with equal sets are one node from here on.
2. Nodes meet in band buckets.  A bucket proposes star edges from its centre to its other members, never all
   pairs: at most one edge for each node and bucket.  The centre is the node with most company over all its buckets, so the original of a
   group of near copies is its centre in bucket after bucket.
3. Nodes of buckets with more than two members meet once more in finer buckets (two bands together, 64 for each node), whose
   centres are drawn by a hash, for members that were near each other but not near their centre.
4. Every edge is confirmed on full sets; confirmed links give connected components.

So edges grow in proportion to the nodes, whatever the size of a group, and hot buckets are split by Spark's skew join.
What is given up for that: two texts are found linked only by a path of confirmed star edges.  A link is missed if in every bucket
the two share, the centre is near to one of them at most; measured recall is in the README.

Defined cases: texts that are null or without words have an empty set and are linked with nothing;
texts with fewer words than a shingle are one shingle; equal sets are linked, whatever the ids;
null ids take the least id of their component and are never the kept row; an empty table gives an
empty result; extra columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.llm.common import BROADCAST_BYTES, Scratch, cut, slices
from latentia.llm.components import components, joined
from latentia.llm.shingles import OnePermutation, scramble, shingle_sets

BANDS, ROWS = 32, 4
#: A finer bucket joins a band with the one this many places on.
STEPS = (1, 5)
NODE_SALTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def node_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    sums = np.array([scramble(hashes ^ salt).sum(dtype=np.uint64) for salt in NODE_SALTS], np.uint64)
    return scramble(sums + np.uint64(len(hashes))).tobytes()


_schemes: dict[tuple[int, int], OnePermutation] = {}


def scheme(bands: int = BANDS, rows: int = ROWS) -> OnePermutation:
    """The hashing scheme, made once in each worker."""
    if (bands, rows) not in _schemes:
        _schemes[bands, rows] = OnePermutation(bands, rows)
    return _schemes[bands, rows]


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th, n, node, bands (32 longs of four 16-bit lanes; null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oph = scheme()
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets([t or b"" for t in batch.column("text").to_pylist()], k)
                lanes = np.array([oph.lanes(s) for s in sets if len(s)], np.uint16).reshape(-1, BANDS * ROWS)
                flat = pa.array(lanes.view(np.int64).ravel())
                full = np.array([len(s) > 0 for s in sets])
                ends = np.concatenate([[0], np.cumsum(full) * BANDS]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_key(s) if len(s) else None for s in sets], pa.binary()), lists],
                    names=["doc_id", "th", "n", "node", "bands"],
                )

    return docs.select("doc_id", "th", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, th long, n long, node binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, set for the wanted nodes (node, th, rep): their texts are read once more."""
    keys = wanted.select(F.col("th").alias("__th"), F.col("rep").alias("__rep"))
    if keys.count() * 48 <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    found = docs.join(keys, (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets([t or b"" for t in batch.column("text").to_pylist()], k)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node_key(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "set"])

    sets = found.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node binary, set array<long>")
    return sets.groupBy("node").agg(F.first("set").alias("set"))


def at_least(both: Column, total: Column, num: int, den: int) -> Column:
    """Whether ``both`` common shingles of ``total`` in two sets together reach num / den of the union."""
    return den * both >= num * (total - both)


def star_edges(rows: DataFrame, centres: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of each centre with the members of its bucket in other components, if their sizes allow a link.

    rows: key, node, root, n; centres: key, c (a struct of node, root, n).
    """
    met = rows.join(centres, "key").where(F.col("root") != F.col("c.root"))
    sized = met.where(at_least(F.least("n", "c.n"), F.col("n") + F.col("c.n"), num, den))
    return sized.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def confirmed(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The edges (a, b) with den * intersection >= num * union on full sets."""
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return edges.join(left, "a").join(right, "b").where(at_least(both, F.size("sa") + F.size("sb"), num, den)).select("a", "b")


def finer_keys(bands: str) -> Column:
    """A bucket for each band and step: the band's lanes and those of the band ``step`` places on."""
    numbers = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.concat(*[F.transform(numbers, lambda i, s=s: F.xxhash64(F.lit(s), i, F.get(bands, i), F.get(bands, (i + s) % BANDS))) for s in STEPS])


def near_duplicates(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept, one row per document; J >= num / den links."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession, "near") as scratch:
        sketches = scratch.cut(sketched(own, k))
        nodes = (
            sketches.where("n > 0")
            .groupBy("node")
            .agg(F.min("doc_id").alias("label"), F.min(F.struct("th", "doc_id", "n", "bands")).alias("r"))
            .select("node", "label", F.col("r.th").alias("th"), F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands"))
        )
        nodes = scratch.cut(nodes)
        buckets = nodes.select("node", "n", F.posexplode("bands").alias("band", "lanes")).select("node", "n", F.xxhash64("band", "lanes").alias("key"))
        shared = scratch.cut(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        rows = scratch.cut(buckets.join(shared, "key").withColumn("root", F.col("node")))
        company = rows.groupBy("node").agg(F.sum("m").alias("company"))
        centre = F.max(F.struct("company", "node", "root", "n"))
        centres = scratch.cut(rows.join(company, "node").groupBy("key").agg(centre.alias("c")))
        edges = scratch.cut(star_edges(rows, centres, num, den))
        met = scratch.cut(nodes.join(rows.select("node", (F.col("m") > 2).alias("crowded")).groupBy("node").agg(F.max("crowded").alias("crowded")), "node"))
        sets = scratch.cut(full_sets(own, met, k))
        label = components(scratch, scratch.cut(confirmed(edges, sets, num, den)))

        roots = met.where("crowded").join(label.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        finer = scratch.cut(roots).select("node", "root", "n", F.explode(finer_keys("bands")).alias("key"))
        drawn = F.min(F.struct(F.xxhash64("node", "key"), "node", "root", "n"))
        several = finer.groupBy("key").agg(drawn.alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "c")
        more = scratch.cut(star_edges(finer, scratch.cut(several), num, den))
        label = joined(scratch, label, scratch.cut(confirmed(more, sets, num, den)))

        linked = scratch.cut(label.join(nodes.select(F.col("node").alias("v"), "label"), "v"))
        least = scratch.cut(linked.groupBy("root").agg(F.min("label").alias("component")))
        linked = linked.join(least, "root").select(F.col("v").alias("node"), "component")
        final = scratch.cut(nodes.select("node", "label").join(linked, "node", "left").select("node", F.coalesce("component", "label").alias("component")))
        found = sketches.select("doc_id", "th", "n", "node").join(final, "node", "left")
        return cut(
            found.select(
                "doc_id",
                "th",
                F.col("n").alias("n_shingles"),
                F.coalesce("component", "doc_id").alias("component_id"),
                F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
            )
        )


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates (the least id), columns unchanged.

    The rows that go are fewer than those that stay, so they are what is joined.
    """
    found = near_duplicates(docs, k, num, den, id_col, text_col)
    gone = found.where(~F.col("kept") & (F.col("n_shingles") > 0)).select("doc_id", "th").distinct()
    again = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("component_id").agg(F.count(F.lit(1)).alias("c"), F.min("th").alias("first")).where("c > 1")
    gone, again = cut(gone), cut(again)
    small = gone.count() * 48 <= BROADCAST_BYTES
    hashed = docs.select(F.struct("*").alias("__doc"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__th"))
    match = F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__th") == F.col("__text"))
    out = gone.select(F.col("doc_id").alias("__gone"), F.col("th").alias("__text"))
    kept = hashed.join(F.broadcast(out) if small else out, match, "left_anti")
    if not again.limit(1).isEmpty():
        ids = again.select(F.col("component_id").alias("__again"), "first")
        once = kept.join(ids, F.col("__id") == F.col("__again"), "left_anti")
        repeated = kept.join(ids, (F.col("__id") == F.col("__again")) & (F.col("__th") == F.col("first")), "left_semi").dropDuplicates(["__id"])
        kept = once.unionByName(repeated)
    return kept.select("__doc.*")
