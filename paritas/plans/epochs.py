"""Training by epochs, measured after each, resumable, with the best state kept.

An epoch is one pass over the training vectors: every part is learned by stochastic
gradient descent from the weights of the epoch before, and the parts' weights are averaged
by their rows. The state of an epoch is one weight per term, written before its metrics, so
an epoch counts when its metrics are there; a run that is started again goes on after the
last such epoch and comes to the same result, as rows are dealt and ordered by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.scores import sigmoid
from paritas.operators.classifier import (
    class_counts,
    fit_tfidf,
    model_vocabulary,
    vector_partitions,
)
from paritas.operators.metrics import bias_metrics, flat_metrics, with_active_groups
from paritas.operators.ordering import shuffle_key
from paritas.operators.split import truncate_then_split
from paritas.session import written
from paritas.sources.files import path_exists
from paritas.sources.models import load_pipeline, save_pipeline

EPOCHS = 3
RATE = 0.5
# States that are kept besides the last, which a further epoch would start from.
KEPT = 2
_STATE = "part int, n long, weights array<double>"


class Run(NamedTuple):
    """What a run has written: metrics of each epoch, and the kept states."""

    history: DataFrame
    kept: DataFrame


def _vectors(df: DataFrame, stages: Sequence, parts: int, seed: int) -> DataFrame:
    """(id, part, is_toxic, indices, values, ...): sparse vectors, dealt by their ids."""
    sparse = PipelineModel(stages).transform(df).withColumn("v", F.unwrap_udt("features"))
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(parts)).cast("int")
    kept = [c for c in ("groups",) if c in df.columns]
    return sparse.select(
        "id", part.alias("part"), "is_toxic", "v.indices", "v.values", *kept
    )


def _learned(
    vectors: DataFrame, start: np.ndarray, balance: tuple[float, float], epoch: int, seed: int
) -> DataFrame:
    """Every part's weights after one pass from ``start``; the last is the intercept."""
    rate = RATE / epoch
    shared = vectors.sparkSession.sparkContext.broadcast(start)  # one number per term

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, weights = None, 0, None

        def state() -> pa.RecordBatch:
            columns = {"part": [part], "n": [n], "weights": [weights]}
            types = [("part", pa.int32()), ("n", pa.int64()), ("weights", pa.list_(pa.float64()))]
            return pa.RecordBatch.from_pydict(columns, pa.schema(types))

        for batch in batches:
            parts, labels = (batch[c].to_pylist() for c in ("part", "is_toxic"))
            ends = batch["indices"].offsets.to_numpy()
            terms = batch["indices"].values.to_numpy()
            values = batch["values"].values.to_numpy()
            shift = batch["values"].offsets.to_numpy() - ends
            for i in range(batch.num_rows):
                if parts[i] != part:
                    if n:
                        yield state()
                    part, n, weights = parts[i], 0, shared.value.copy()
                low, high = ends[i], ends[i + 1]
                at, x = terms[low:high], values[low + shift[i] : high + shift[i]]
                margin = weights[at] @ x + weights[-1]
                step = 1.0 / (1.0 + np.exp(-margin)) - labels[i]
                step *= rate * balance[labels[i]]
                weights[at] -= step * x
                weights[-1] -= step
                n += 1
        if n:
            yield state()

    order = shuffle_key(F.col("id"), seed + epoch)
    return (
        vectors.withColumn("_order", order)
        .repartition("part")
        .sortWithinPartitions("part", "_order", "id")
        .select("part", F.col("is_toxic").cast("int").alias("is_toxic"), "indices", "values")
        .mapInArrow(learn, _STATE)
    )


def _averaged(states: DataFrame) -> DataFrame:
    """(place, weight) over all parts by their rows, without what the order of a sum
    changes."""
    entries = states.select("n", F.posexplode("weights").alias("place", "weight"))
    mean = F.sum(F.col("weight") * F.col("n")) / F.sum("n")
    return entries.groupBy("place").agg(F.round(mean, 10).alias("weight"))


def _weights(spark: SparkSession, path: str) -> np.ndarray:
    """A state as one array: a number per term, and the intercept."""
    rows = spark.read.parquet(path).orderBy("place").collect()
    return np.array([r["weight"] for r in rows])


def _score(weights: np.ndarray) -> Column:
    """The probability that a sparse vector's text is toxic."""
    known = F.from_json(F.lit(str(weights.tolist())), "array<double>")
    products = F.zip_with("values", "indices", lambda x, i: x * F.get(known, i))
    return sigmoid(F.aggregate(products, F.lit(float(weights[-1])), lambda a, b: a + b))


def logistic_model(
    spark: SparkSession, weights: Sequence[float], intercept: float
) -> LogisticRegressionModel:
    """A Spark ML model with given coefficients: those that a fit finds whose bounds leave
    no other."""
    size = len(weights)
    # Every entry varies, as a fit leaves out those that do not.
    rows = [(Vectors.dense([float(i)] * size), float(i)) for i in (0, 1)]
    exact, constant = Matrices.dense(1, size, list(weights)), Vectors.dense([intercept])
    return LogisticRegression(
        maxIter=0,
        standardization=False,
        lowerBoundsOnCoefficients=exact,
        upperBoundsOnCoefficients=exact,
        lowerBoundsOnIntercepts=constant,
        upperBoundsOnIntercepts=constant,
    ).fit(spark.createDataFrame(rows, ["features", "label"]))


def epoch_ranking(history: DataFrame) -> DataFrame:
    """(epoch, auc): one row per epoch, of a table with a row per identity and epoch."""
    return history.where(F.col("ord") == 0).select("epoch", F.col("overall_auc").alias("auc"))


def best_epochs(history: DataFrame, n: int = KEPT) -> list[int]:
    """The epochs with the greatest AUC, the best first; of equals the earliest, and
    undefined ones last."""
    rows = epoch_ranking(history).orderBy(F.desc_nulls_last("auc"), "epoch").limit(n).collect()
    return [r["epoch"] for r in rows]


def _measured(
    spark: SparkSession, run_dir: str, epoch: int, identities: Sequence[str]
) -> DataFrame:
    """The whole metric table of one epoch on the validation rows."""
    weights = _weights(spark, f"{run_dir}/state/epoch={epoch}")
    scored = spark.read.parquet(f"{run_dir}/validation").select(
        F.lit(str(epoch)).alias("model"), "id", "is_toxic", "groups", _score(weights).alias("score")
    )
    return bias_metrics(
        written(scored, "epoch-scores"), [(str(epoch),)], identities, ["model"]
    ).drop("model")


def run_epochs(
    prepared: DataFrame,
    identities: Sequence[str],
    run_dir: str,
    epochs: int = EPOCHS,
    n: int = -1,
    seed: int = 42,
    kept: int = KEPT,
) -> Run:
    """Train on the first 90 % of ``n`` shuffled rows and measure every epoch on the rest.

    ``run_dir`` holds the vectors, the state and the metrics of every epoch, the kept
    states, and the pipeline with the best of them as ``model``. Epochs that are there are
    not trained again, so a run goes on where it ended, or by more epochs.
    """
    spark = prepared.sparkSession
    if not path_exists(spark, f"{run_dir}/start"):
        split = truncate_then_split(prepared, n, seed=seed)
        train = split.where(F.col("split") == "train").drop("split")
        validation = split.where(F.col("split") == "validation").drop("split")
        counts = class_counts(train)
        if not (counts.negative and counts.positive):
            raise ValueError("training needs rows of both classes")
        tfidf = fit_tfidf(train)
        save_pipeline(PipelineModel(tfidf.stages), f"{run_dir}/stages")
        parts = vector_partitions(spark, counts.total, tfidf.entries)
        tables = {"train": train, "validation": with_active_groups(validation, identities)}
        for name, rows in tables.items():
            vectors = _vectors(rows, tfidf.stages, parts, seed)
            vectors.write.mode("overwrite").parquet(f"{run_dir}/{name}")
        # Written last, so that what stands before it is whole.
        start = [(counts.negative, counts.positive)]
        spark.createDataFrame(start, "negative long, positive long").write.mode(
            "overwrite"
        ).parquet(f"{run_dir}/start")
    stages = load_pipeline(spark, f"{run_dir}/stages").stages
    negative, positive = spark.read.parquet(f"{run_dir}/start").first()
    balance = tuple((negative + positive) / (2.0 * c) for c in (negative, positive))
    vectors = spark.read.parquet(f"{run_dir}/train")
    for epoch in range(1, epochs + 1):
        if path_exists(spark, f"{run_dir}/history/epoch={epoch}"):
            continue
        before = np.zeros(len(model_vocabulary(stages)) + 1)
        if epoch > 1:
            before = _weights(spark, f"{run_dir}/state/epoch={epoch - 1}")
        states = written(_learned(vectors, before, balance, epoch, seed), "epoch-parts")
        _averaged(states).coalesce(1).write.mode("overwrite").parquet(
            f"{run_dir}/state/epoch={epoch}"
        )
        measured = _measured(spark, run_dir, epoch, identities)
        measured.coalesce(1).write.mode("overwrite").parquet(f"{run_dir}/history/epoch={epoch}")
    history = spark.read.parquet(f"{run_dir}/history")
    best = best_epochs(history, kept)
    chosen = _weights(spark, f"{run_dir}/state/epoch={best[0]}")
    states = [
        (rank, epoch, _weights(spark, f"{run_dir}/state/epoch={epoch}").tolist())
        for rank, epoch in enumerate(best)
    ]
    spark.createDataFrame(states, "rank int, epoch int, weights array<double>").write.mode(
        "overwrite"
    ).parquet(f"{run_dir}/kept")
    model = logistic_model(spark, chosen[:-1].tolist(), float(chosen[-1]))
    save_pipeline(PipelineModel([*stages, model]), f"{run_dir}/model")
    return Run(history, spark.read.parquet(f"{run_dir}/kept"))


def epoch_metrics(history: DataFrame) -> DataFrame:
    """(epoch, metric, value): each epoch's ``roc_auc`` and defined subgroup metrics."""
    return flat_metrics(history, ["epoch"])
