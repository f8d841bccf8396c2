"""Input tables and intermediate results, all through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.session import settled, ship

__all__ = ["broadcast_if_few", "dealt_anew", "settled", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, by whatever file system its path names."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """`df` with the long column `key` written so that a join on it exchanges both sides.

    A side that an aggregation left dealt out by the key would be joined where it lies, and
    adaptive execution only splits a frequent key between two exchanges.
    """
    return df.withColumn(key, F.col(key).bitwiseOR(F.lit(0).cast("long")))


def broadcast_if_few(df: DataFrame, most: int) -> DataFrame:
    """`df`, to be broadcast if it has `most` rows or fewer; more are joined like any other."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
