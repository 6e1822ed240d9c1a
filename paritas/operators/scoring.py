"""Batched scoring with any model, as an Arrow UDF.

The model is whatever ``make_predict_fn`` returns: a function from a NumPy array of
texts to a (batch, classes) array of logits. It is made once per Python worker, so a
network is loaded there and never serialised. Turning logits into probabilities
stays on the JVM.

A network pads the texts of a batch to the longest of them. Rows are therefore sorted by
length inside their partitions first: nothing is shuffled, every task keeps its mixture of
short and long texts, and a batch holds texts of about one length.

A model that needs an accelerator or more memory than the rest of a job names them in a
resource profile, which then holds for the stage that scores and for no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.functions.scores import logits_to_score, softmax_of_two
from paritas.functions.text import zero_shot_prompt

ENCODER_BATCH = 32
ZERO_SHOT_BATCH = 8


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def with_resources(df: DataFrame, profile: ResourceProfile | None) -> DataFrame:
    """The same rows, in a stage that runs with the resources of ``profile``. What follows
    without a shuffle is in that stage too. Without a profile nothing is changed."""
    return df if profile is None else df.mapInArrow(_same, df.schema, profile=profile)


def by_length(df: DataFrame, text: Column) -> DataFrame:
    """The rows of each partition from short texts to long ones."""
    return (
        df.withColumn("_length", F.length(text)).sortWithinPartitions("_length").drop("_length")
    )


def padding(df: DataFrame, text: str = "comment_text", batch_size: int = ENCODER_BATCH) -> DataFrame:
    """(characters, padded): how long the texts are together, and how long when each is
    padded to the longest of its batch, in the order in which batches are taken."""
    place = F.monotonically_increasing_id()
    part, row = F.shiftright(place, 33), place.bitwiseAND((1 << 33) - 1)
    sizes = df.select(
        F.coalesce(F.length(text), F.lit(0)).alias("size"),
        part.alias("part"),
        F.floor(row / batch_size).alias("batch"),
    )
    batches = sizes.groupBy("part", "batch").agg(
        F.sum("size").alias("size"), (F.max("size") * F.count("*")).alias("padded")
    )
    return batches.agg(F.sum("size").alias("characters"), F.sum("padded").alias("padded"))


def _logits(make_predict_fn: Callable, batch_size: int):
    return predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )


def score_texts(
    df: DataFrame,
    make_predict_fn: Callable,
    text: str = "comment_text",
    batch_size: int = ENCODER_BATCH,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add ``score`` from a classifier that returns one or two logits per text."""
    predict = _logits(make_predict_fn, batch_size)
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        by_length(with_resources(df, profile), whole)
        .withColumn("_logits", predict(whole))
        .withColumn("score", logits_to_score(F.col("_logits")))
        .drop("_logits")
    )


def score_zero_shot(
    df: DataFrame,
    make_predict_fn: Callable,
    text: str = "comment_text",
    batch_size: int = ZERO_SHOT_BATCH,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add ``score``, P(yes), from a model that answers the prompt with the logits
    of yes and no, in this order."""
    predict = _logits(make_predict_fn, batch_size)
    prompt = zero_shot_prompt(F.coalesce(F.col(text), F.lit("")))
    yes, no = F.get(F.col("_logits"), F.lit(0)), F.get(F.col("_logits"), F.lit(1))
    return (
        by_length(with_resources(df, profile), prompt)
        .withColumn("_logits", predict(prompt))
        .withColumn("score", softmax_of_two(no, yes))
        .drop("_logits")
    )
