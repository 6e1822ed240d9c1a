"""Saved splits and their ordered identity list."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.catalogue import present_identities


class SavedData(NamedTuple):
    train: DataFrame
    evaluation: DataFrame
    identities: list[str]


def write_splits(split_df: DataFrame, path: str) -> None:
    """One folder per split, plus the identity columns as a small table.

    Rows are rebalanced, so a slice that is small against the table it comes from is not
    one file per scanned part, and a large one has files of a sensible size.
    """
    spark = split_df.sparkSession
    split_df.hint("rebalance", "split").write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits")
    write_identities(spark, present_identities(split_df.columns), path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "id") -> None:
    """A table in sorted buckets of the id, for texts that are joined again and again:
    a later join on the id reads them in place and shuffles only the other side."""
    (
        df.write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table)
    )


def write_identities(spark: SparkSession, identities: list[str], path: str) -> None:
    rows = list(enumerate(identities))
    listed = spark.createDataFrame(rows, "ord int, identity string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/identities")


def read_identities(spark: SparkSession, path: str) -> list[str]:
    """The identity columns in order; one row per column of the comment table."""
    rows = spark.read.parquet(f"{path}/identities").orderBy("ord").collect()
    return [row["identity"] for row in rows]


def read_splits(spark: SparkSession, path: str) -> SavedData:
    """Training rows, evaluation rows and identities; each split reads its folder."""
    saved = spark.read.parquet(f"{path}/splits")
    return SavedData(
        saved.where(F.col("split") == "train").drop("split"),
        saved.where(F.col("split") == "eval").drop("split"),
        read_identities(spark, path),
    )
