"""What the operators read from the session they run in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for tables written between jobs.

    It is the one ``spark.checkpoint.dir`` names. Tables written there are not removed
    here, as later steps may still read them; whoever owns the folder clears it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rank_ranges(spark: SparkSession) -> int:
    """How many score ranges to rank in: at least one per shuffle partition of the
    session, so the setting that sizes its shuffles sizes the ranking too. Finding a
    score's range takes four-way steps, hence a power of four."""
    ranges = 16
    while ranges < int(spark.conf.get("spark.sql.shuffle.partitions")):
        ranges *= 4
    return ranges


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written to the shared folder and read back.

    For results that are costly and read more than once, such as model scores: it
    cuts the lineage, and losing executors does not lose the work.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
