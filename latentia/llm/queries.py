"""The thin queries over the operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latentia.llm import cotrain, divergence, lbl, licenses, media, minhash, mixing, packing, pii, pivots, prefixes, secrets, warc
from latentia.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op3_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 100 * intersection >= 85 * union of 3-word shingles, as this query's contract says."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"))


def op10_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OPERATORS = (op1_feistel_pii, op2_flac_media, op3_log_bilinear_scores, op4_source_mixing, op5_cotrained_quality, op6_minhash_near_dedup, op7_secret_scan, op8_warc_salvage, op9_pivot_topk, op10_cutting_stock_packing, op11_conversation_prefix_trie, op12_license_scan, op13_source_divergence)
QUERIES: dict[str, Query] = {f.__name__: f for f in OPERATORS}

ORACLES: dict[str, str] = {
    "op9_pivot_topk": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 50 = 0
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_conversation_prefix_trie": prefixes.SQL,
    "op12_license_scan": licenses.sql(),
    "op13_source_divergence": divergence.SQL,
}
