"""Reading the named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table, with only ``columns`` if any are named."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; null keys go.

    Redelivered rows carry the same content, so which one stays matters only
    for rows that were corrected.  A hot key is pre-aggregated by map tasks.
    """
    rest = [c for c in columns if c != key]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )
