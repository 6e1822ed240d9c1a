"""Parquet tables with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table. With a schema given, planning reads no file footer."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)

