"""Small questions to the file system the session uses, asked through its readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.operators.ordering import with_shuffle_position


def _files(spark: SparkSession, path: str) -> DataFrame:
    """What lies below a path; only names are read, never contents."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        _files(spark, path)
    except AnalysisException:
        return False
    return True


def list_children(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, entry): the direct children of one folder, such as a model's, that are
    files or hold any."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index(F.url_decode("path"), f"/{name}/", -1)
    return (
        _files(spark, folder)
        .select(F.lit(folder).alias("folder"), F.substring_index(inside, "/", 1).alias("entry"))
        .distinct()
    )


def path_below(root: str) -> Column:
    """Where a row's file lies below ``root``, the path its table was read from, or its
    name if it is that path. It stays the same when the table is moved as a whole."""
    inside = f"{root.rstrip('/')}/".split("://", 1)[-1]
    path = F.url_decode("_metadata.file_path")
    at = F.instr(path, inside)
    below = F.substring(path, at + len(inside), F.length(path))
    return F.when(at > 0, below).otherwise(F.substring_index(path, "/", -1))


def file_numbers(paths: DataFrame) -> DataFrame:
    """(path, number): the distinct paths numbered from 0 without a gap.

    The numbers are positions in the order of the paths' hashes, found in buckets, so no
    task sees all paths. The same set of paths has the same numbers.
    """
    return with_shuffle_position(paths.select("path").distinct(), "path").select(
        "path", F.col("position").cast("long").alias("number")
    )
