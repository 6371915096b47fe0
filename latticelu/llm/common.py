"""Shared helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import new_path, shared_dir  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to a table in the shared folder and read it again.

    Cuts lineage in a way that survives lost executors, and keeps columns prunable.
    """
    spark = df.sparkSession
    path = f"{new_path(spark, name)}/t"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
