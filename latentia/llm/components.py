"""Connected components of a distributed edge list by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentia.llm.common import Scratch


def renamed(hooks: DataFrame) -> DataFrame:
    return hooks.select(F.col("v").alias("__r"), F.col("root").alias("__up"))


def flattened(scratch: Scratch, hooks: DataFrame, moved: int) -> DataFrame:
    """(v, root): follow v -> root until every root points to itself; each round halves the paths.

    moved: how many v do not point to themselves; with none there is nothing to follow.
    """
    while moved:
        stepped = hooks.join(renamed(hooks), F.col("root") == F.col("__r"), "left").select("v", F.coalesce("__up", "root").alias("root"), (F.col("__up") != F.col("root")).alias("moved"))
        stepped, moved = scratch.counted(stepped, F.col("moved"))
        hooks = stepped.select("v", "root")
    return hooks


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(v, root) for every end of the links (a, b); root is the least vertex of the component.

    A vertex with very many links is only aggregated (in the tasks first) or meets its one row in a join whose sides Spark can split.
    """
    label, edges, left = None, links.select("a", "b").where("a <> b"), 1
    while left:
        both = edges.union(edges.select("b", "a")).toDF("v", "w")
        hooks = flattened(scratch, *scratch.counted(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("root")), F.col("v") != F.col("root")))
        if label is None:
            label = hooks
        else:
            label = scratch.cut(label.join(renamed(hooks), F.col("root") == F.col("__r"), "left").select("v", F.coalesce("__up", "root").alias("root")))
        ends = [hooks.select(F.col("v").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
        crossing = edges.join(ends[0], "a").join(ends[1], "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges, left = scratch.counted(crossing, F.lit(True))
    return label


def joined(scratch: Scratch, label: DataFrame, links: DataFrame) -> DataFrame:
    """label after more links: only components that the links connect are worked on again."""
    ends = [label.select(F.col("v").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
    mapped = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = components(scratch, scratch.cut(mapped.where("a <> b").distinct()))
    old = label.join(renamed(up), F.col("root") == F.col("__r"), "left").select("v", F.coalesce("__up", "root").alias("root"))
    return scratch.cut(old.union(up.join(label.select("v"), "v", "left_anti").select("v", "root")))
