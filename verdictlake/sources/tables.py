"""Working tables laid out for the joins that run again and again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_clustered(df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "overwrite") -> None:
    """Save a table bucketed and sorted by its join keys.

    Claims and judgments bucketed alike by claim_id (or conversations by conv_id) are matched on
    resume without a shuffle of either side. Take a bucket count that keeps a bucket near the
    memory of one task, and the same for all tables that meet.
    """
    df.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def read_clustered(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
