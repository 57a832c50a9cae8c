"""Tick sources: zipped CSV archives, Parquet, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions.expr import micros
from latentia.session import ship
from latentia.sources.archives import registered

MICROSECONDS_FROM = 100_000_000_000_000  # stamps this large are in microseconds, smaller ones in milliseconds


def zip_ticks(spark: SparkSession, path: str, strict: bool = False, members: str | None = None) -> DataFrame:
    """symbol (file name), us, seq, price from zip archives of CSVs, a partition for each member, read in blocks.

    Only id, price and time are converted.  ``strict`` demands exactly one CSV member; else the first member is read, or with
    members="all" every CSV.
    """
    raw = registered(spark).read.format("zip_ticks").option("members", members or ("strict" if strict else "first")).load(path)
    us = F.when(F.col("stamp") >= MICROSECONDS_FROM, F.col("stamp")).otherwise(F.col("stamp") * 1000)
    return raw.select("symbol", us.alias("us"), "seq", "price")


def csv_ticks(spark: SparkSession, path: str) -> DataFrame:
    """The same from unpacked CSV files, with Spark's own reader (splittable, columns pruned)."""
    schema = "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, timestamp long, is_buyer_maker boolean, is_best_match boolean"
    us = F.when(F.col("timestamp") >= MICROSECONDS_FROM, F.col("timestamp")).otherwise(F.col("timestamp") * 1000)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return spark.read.schema(schema).csv(path).select(name.alias("symbol"), us.alias("us"), F.col("agg_trade_id").alias("seq"), "price")


def checksums(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """file, sha256, expected, ok for files and a manifest (file, line): the first word of a line, lower-cased.  Files are hashed in blocks."""
    have = registered(spark).read.format("zip_report").option("digest", "true").load(path).select("file", "sha256")
    want = manifest.select("file", F.lower(F.split(F.trim("line"), r"\s+")[0]).alias("expected"))
    return have.join(want, "file", "full").withColumn("ok", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)))


def archive_report(spark: SparkSession, path: str, total: bool = False) -> DataFrame:
    """file, members, status, rows of each archive, counted without unpacking to disk; with ``total`` a last row adds them up.

    The total's status is ok only if every archive's is.
    """
    out = registered(spark).read.format("zip_report").load(path).drop("sha256")
    if not total:
        return out
    whole = out.agg(F.lit("total").alias("file"), F.sum("members").cast("int").alias("members"), F.when(F.count_if(F.col("status") != "ok") == 0, "ok").otherwise("incomplete").alias("status"), F.sum("rows").alias("rows"))
    return out.unionByName(whole)


def windows(spark: SparkSession, pattern: str, label: str = r"([^/]+)\.parquet") -> DataFrame:
    """All Parquet files of a glob with window_id taken from the path."""
    return spark.read.parquet(pattern).withColumn("window_id", F.regexp_extract(F.input_file_name(), label, 1))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (event type), us, seq, price of the events with a positive value."""
    e = ship(spark).read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    return e.select(F.col("event_type").alias("symbol"), micros("ts").alias("us"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (priority), us, seq, price of the orders; many share a time."""
    o = ship(spark).read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 0")
    return o.select(F.col("o_orderpriority").alias("symbol"), micros("o_orderdate").alias("us"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
