"""Saved pipelines and model folders."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.sources.files import path_exists


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no saved pipeline at {path}, train it first")
    return PipelineModel.load(path)


def model_paths(listing: DataFrame) -> DataFrame:
    """(folder, path): where to load each model from.

    A folder with a configuration is the final model. Otherwise its checkpoint with
    the highest step number counts, compared as a number, and a folder without
    checkpoints stays as it is.
    """
    step = F.regexp_extract(F.col("entry"), r"^checkpoint-(?:.*-)?(\d+)$", 1)
    return (
        listing.withColumn("step", F.when(step != "", step.cast("long")))
        .groupBy("folder")
        .agg(
            F.bool_or(F.col("entry") == "config.json").alias("final"),
            F.max_by("entry", "step").alias("checkpoint"),
        )
        .select(
            "folder",
            F.when(F.col("final") | F.col("checkpoint").isNull(), F.col("folder"))
            .otherwise(F.concat_ws("/", "folder", "checkpoint"))
            .alias("path"),
        )
    )
