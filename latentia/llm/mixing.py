"""Operator 4: mix sources to target weights.

Tokens are added up per source, the shares become targets (water-filling under a cap of 3 times a
source's size), targets become repetition rates, and each document is emitted floor(rate) times
plus one hash-seeded Bernoulli copy with the fraction as its probability.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; equal
rows draw alike; an empty table gives an empty result; a source of size 0 has target and rate 0.
Extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentia.llm.common import BROADCAST_BYTES, cut, ordinal, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20240607


def unit_draw(*cols: Column, seed: int = SEED) -> Column:
    """A reproducible number in [0, 1) from the values of columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target, rate from rows (source, size).

    Uncapped targets are level * weight; the level rises each round by what the capped sources leave,
    until none is above its cap.  Each round is one aggregation over the table of sources.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordinal(per, [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    sources = cut(ranked.withColumn("weight", w).drop("rank"))
    total, level, done = None, 0.0, -1
    while True:
        over = F.col("source_size") * cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum("weight").alias("w"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(over, F.col("weight"))), F.lit(0.0)).alias("capped_w"),
            F.count_if(over).alias("n"),
        ).first()
        total = row["all"] or 0
        if row["n"] == done or not total:
            break
        done, free = row["n"], row["w"] - row["capped_w"]
        if free <= 0:
            break
        level = (total - cap * row["capped"]) / free
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("rate", rate)


def with_copies(rows: DataFrame, sized: DataFrame, draw: Column) -> DataFrame:
    """rows plus source_size, target, rate and copies; rows and sized have the column source."""
    targets = source_targets(sized).select(F.col("source").alias("__source"), "source_size", "target", "rate")
    held = targets.agg(F.sum(F.coalesce(F.length("__source"), F.lit(0)) + 64)).first()[0] or 0
    right = F.broadcast(targets) if held <= BROADCAST_BYTES else targets
    whole = F.floor("rate")
    return (
        rows.join(right, F.col("source").eqNullSafe(F.col("__source")), "left")
        .drop("__source")
        .withColumn("copies", (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("long"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each document as often as the mix takes it, columns unchanged."""
    sized = cut(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    kept = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(source_col).alias("source"))
    draw = unit_draw(F.col(f"__doc.{id_col}"), F.col(f"__doc.{text_col}"))
    out = with_copies(kept, sized, draw).where("copies > 0")
    return out.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__doc.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies, taken for every document.

    The texts are read once; what follows works on a table of ids, sizes and draws.
    """
    sized = cut(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), unit_draw(F.col("doc_id"), F.col("text")).alias("draw"))
    )
    out = with_copies(sized, sized, F.col("draw"))
    return out.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
