"""Shared pieces of the training-data operators.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere; lower-casing touches A-Z only.  ``bytes.split()``
and ``bytes.lower()`` have exactly those two meanings, which is why kernels work on UTF-8 bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from types import TracebackType

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from latentia.session import checkpoint_folder, ship

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: A table is broadcast by hint only below this many bytes, measured on the table itself.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files.

    Spark's cleaner removes them once nothing refers to them, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, flag: Column) -> tuple[DataFrame, int]:
    """cut(df) and the number of rows for which flag holds, counted on the way by the same job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(flag).alias("n")))
    return out, seen.get.get("n") or 0


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Parquet tables in a folder of their own under the shared checkpoint folder, deleted in the end.

    A table read back has no partitioning, so the next join exchanges both its sides and Spark can split a hot key
    (a checkpoint keeps the partitioning it was made with, which bars that).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        drop_folder(self.spark, self.path)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, flag: Column) -> tuple[DataFrame, int]:
        """cut(df) and the number of rows for which flag holds, counted by the writing job."""
        seen = Observation()
        out = self.cut(df.observe(seen, F.count_if(flag).alias("n")))
        return out, seen.get.get("n") or 0


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: each word becomes one letter, then the spaces go (no array of words)."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")), F.lit(0)).cast("long")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in a binary column and at most ``rows`` rows (one row at least), to bound memory."""
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if i - at >= rows or held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position of every row in the global order, without one task that sorts all rows.

    Range-partitions by the order, numbers rows within each range, and adds the sizes of the ranges
    before it; only the table of ranges (as many rows as partitions) meets in one window.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return (
        ranged.withColumn("__row", within)
        .join(F.broadcast(before), "__range")
        .withColumn(name, (F.col("__row") + F.col("__before")).cast("long"))
        .drop("__range", "__row", "__before")
    )
