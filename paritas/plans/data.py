"""Comments to saved splits."""

from __future__ import annotations

from pyspark.sql import SparkSession

from paritas.operators.split import train_eval_slices
from paritas.sources.comments import load_comments
from paritas.sources.splits import SavedData, read_splits, write_splits


def run_data(
    spark: SparkSession,
    source: str,
    data_dir: str,
    train_n: int = 20_000,
    eval_n: int = 5_000,
    seed: int = 42,
) -> SavedData:
    """Read, prepare, split and save the comment table.

    The CSV is landed as Parquet first: the split reads the ids three times and the
    texts once, which a compressed CSV can only serve by parsing everything.
    """
    landed = f"{data_dir}/comments"
    load_comments(spark, source).write.mode("overwrite").parquet(landed)
    comments = spark.read.parquet(landed)
    slices = train_eval_slices(comments, train_n, eval_n, seed=seed)
    write_splits(slices, data_dir)
    return read_splits(spark, data_dir)
