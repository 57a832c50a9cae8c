"""Sinks: partitioned Parquet and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet under path, one folder per value of ``by``; reads that filter on it skip the others."""
    out = df.write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def text_report(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text; charts are drawn from the same frame outside the engine."""
    return df.limit(rows).toPandas().to_string(index=False)
