"""Operator 9: exact top-k search by pivot-table elimination.

Every vector gets a table row of distances to many pivots.  The distances place it exactly in the pivots' span and
give the length of the rest, so the smallest distance (the largest inner product) that two rows of the table allow
is known: the products of the places plus that of the rests.  Seven pivots for eight dimensions.

An eighth of the cells is searched first, in bound order until exact stopping; that gives each query a score that
its k-th best has at least, its floor.  In the other cells only candidates whose bound reaches the floor are looked at,
again in bound order until exact stopping.  Ties are evaluated, so the result is exact.

Queries and candidates meet in a grid of blocks of bounded size (an equi-join on block numbers);
only k rows per query and block leave a task.

Defined cases: vectors that are null, or hold null or non-finite components, or have a null id, take
no part; vectors are only compared with vectors of their own length; candidates of a query
row are all rows but the query's own, so of rows that share an id each asks for itself and may find the others; ties go to the smaller
id; fewer than k candidates give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from latentia.llm.common import cut

#: Pivots by dimensions, and the lengths of vectors that have pivots of their own.
PIVOT_SHARE, PIVOT_DIMS = 0.875, 16
#: Components of a block of candidates and of queries; queries bounded together.
CELL_SIZE, QUERY_SIZE, SLAB = 1 << 21, 1 << 20, 256
LEAST_CELLS, FIRST_CELLS = 48, 8
CHUNK = 8
#: Singular values below this share of the greatest are left out of the span; the pad covers rounding.
LEAST_SINGULAR, PAD = 1e-4, 1e-8


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """row_id (a number for each row), id, dim, v (array of long): floor(scale * x) of the valid vectors; to be stored before row_id is used twice."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias(vec_col))
        .where(F.col("id").isNotNull() & F.col(vec_col).isNotNull() & ok)
        .select(F.monotonically_increasing_id().alias("row_id"), "id", F.size(vec_col).alias("dim"), v.alias("v"))
    )


def choose_pivots(points: DataFrame, share: float = PIVOT_SHARE) -> dict[int, np.ndarray]:
    """Pivots for each of the PIVOT_DIMS most frequent lengths; vectors of other lengths have the origin alone."""
    dims = [r["dim"] for r in points.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(PIVOT_DIMS).collect()]
    out = {}
    for d in dims:
        rows = points.where(F.col("dim") == d).orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(int(share * d)).collect()
        out[d] = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), d)
    return out


def matrix(t: pa.Table, column: str, dim: int) -> np.ndarray:
    flat = t.column(column).combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten()).reshape(t.num_rows, dim)


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots and, last, to the origin."""
    sq = (x * x).sum(1)
    d2 = sq[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.hstack([np.sqrt(np.maximum(d2, 0)), np.sqrt(sq)[:, None]])


def span(pivots: np.ndarray) -> np.ndarray:
    """Matrix that takes products with the pivots to coordinates in their span."""
    u, size, _ = np.linalg.svd(pivots, full_matrices=False)
    keep = size > LEAST_SINGULAR * size.max(initial=0)
    return u[:, keep] / size[keep]


def places(table: np.ndarray, pivots: np.ndarray, to_span: np.ndarray) -> np.ndarray:
    """Coordinates in the pivots' span and, last, the length of the rest (never too short), from rows of the pivot table alone."""
    sq = table[:, -1] ** 2
    at = ((sq[:, None] + (pivots * pivots).sum(1) - table[:, :-1] ** 2) / 2) @ to_span
    return np.column_stack([at, np.sqrt(np.maximum(sq - (at * at).sum(1), 0) + PAD * sq)])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: by float64 where every partial sum fits, else by int64."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def eliminate(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query rows, candidate ids and scores of the k best of one block pair that reach the query's floor, and how many products were taken.

    qid: rows of the queries, crow and cid: rows and ids of the candidates.
    """
    qf, cf, to_span = q.astype(np.float64), c.astype(np.float64), span(pivots)
    tq, tc = pivot_table(qf, pivots), pivot_table(cf, pivots)
    pq, pc, longest = places(tq, pivots, to_span), places(tc, pivots, to_span), tc[:, -1].max(initial=0)
    out, taken = [(np.empty(0, np.int64),) * 3], 0
    for s in range(0, len(qid), SLAB):
        upper = pq[s : s + SLAB] @ pc.T
        upper += PAD * tq[s : s + SLAB, -1:] * longest + 1e-3
        for i, bounds in enumerate(upper, s):
            near = np.flatnonzero((bounds >= floor[i]) & (crow != qid[i]))
            near = near[np.argsort(-bounds[near], kind="stable")]
            at, step = 0, CHUNK
            ids = scores = np.empty(0, np.int64)
            while at < len(near) and not (len(scores) >= k and bounds[near[at]] < scores[k - 1]):
                part = near[at : at + step]
                ids = np.concatenate([ids, cid[part]])
                scores = np.concatenate([scores, inner(q[i : i + 1], c[part])[0]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores, taken = ids[best], scores[best], taken + len(part)
                at, step = at + step, step * 2
            good = scores >= floor[i]
            out.append((np.full(good.sum(), qid[i]), ids[good], scores[good]))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), taken


def top_k(queries: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; queries and points are stored tables (row_id, id, dim, v) of quantized()."""
    pivots = choose_pivots(points)
    size = points.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    dim = max(1, size["dim"])
    cells = max(LEAST_CELLS, -(-size["n"] * dim // CELL_SIZE))
    rows = -(-queries.count() * dim // QUERY_SIZE) or 1
    cell, row = F.pmod(F.xxhash64(F.lit(1), "row_id"), F.lit(cells)), F.pmod(F.xxhash64(F.lit(2), "row_id"), F.lit(rows))
    right = points.withColumn("cell", cell).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<bigint>")))
    keys, best = ["dim", "row", "cell"], Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64),) * 3
        if a.num_rows and b.num_rows:
            dim = a.column("dim")[0].as_py()
            p = pivots.get(dim, np.zeros((0, dim)))
            floor = np.asarray(a.column("floor").fill_null(np.iinfo(np.int64).min))
            found = eliminate(np.asarray(a.column("row_id")), matrix(a, "v", dim), floor, np.asarray(b.column("row_id")), np.asarray(b.column("id")), matrix(b, "v", dim), p, k)
        return pa.table(dict(zip(["query", "vec_id", "score"], found[:3], strict=True)))

    def met(asking: DataFrame, low: int, high: int) -> DataFrame:
        """The k best of each query (with a floor, or null) in the cells from low to below high."""
        spread = F.explode(F.sequence(F.lit(low), F.lit(high - 1)).cast("array<bigint>"))
        left = asking.withColumn("row", row).withColumn("cell", spread)
        left = left.select(*(F.col(c).alias(c) for c in left.columns))  # queries come from points: columns of their own
        there = right.where((F.col("cell") >= low) & (F.col("cell") < high))
        found = left.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(meet, "query long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = max(1, cells // FIRST_CELLS)
    begun = cut(met(queries.withColumn("floor", F.lit(None).cast("long")), 0, first))
    floors = begun.where(F.col("rank") == k).select(F.col("query").alias("row_id"), F.col("score").alias("floor"))
    rest = met(queries.join(floors, "row_id", "left"), first, cells)
    top = begun.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(queries.select(F.col("row_id").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top k of every row for the queries whose vec_id is divisible by ``every``."""
    points = cut(quantized(vectors, "vec_id", "embedding"))
    return top_k(points.where(F.pmod("id", F.lit(every)) == 0), points, k)
