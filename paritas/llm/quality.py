"""Quality classifier: hashed word n-grams, logistic regression by
follow-the-regularised-leader, scores as sparse dot products.

A text's features are its words, its pairs of adjacent words, and the shapes of both
(letters, capitals and digits as classes, the last characters of a word). A pair of
equal words is one feature whatever the word. Each is hashed into one of ``BUCKETS``
and weighs its count, divided by the length of the text's vector.

Null and empty texts have no feature; their score is the model's prior. Repeated rows
are scored each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm import texts

BUCKETS = 1 << 18
#: Labelled rows the model is fitted on at most; the rest of the labels is left out.
SAMPLE = 4000
EPOCHS = 4
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
#: Bytes at the end of a word that make its shape.
SHAPE_BYTES = 3


@dataclass(frozen=True)
class Model:
    """Weights by bucket, and the bias."""

    weights: np.ndarray
    bias: float


def features(piece: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of a slice, ordered by text; values have length 1 by text."""
    starts, ends, ranges = texts.words(piece.data, piece.offsets)
    word = texts.substring_hashes(piece.data, starts, ends)
    shape = texts.substring_hashes(
        _SHAPE[piece.data], np.maximum(starts, ends - SHAPE_BYTES), ends
    )
    text = texts.owners(ranges)
    pairs, pair_text, first = texts.ngrams(word, ranges, 2)
    same = word[first] == word[first + 1]
    pairs = np.where(same, np.uint64(1), pairs)
    shape_pairs, _, _ = texts.ngrams(shape, ranges, 2)
    kinds = [(text, word), (pair_text, pairs), (text, ~shape), (pair_text, ~shape_pairs)]
    owner = np.concatenate([owner for owner, _ in kinds])
    bucket = np.concatenate([texts.mix(h) & np.uint64(BUCKETS - 1) for _, h in kinds])
    owner, bucket, count = texts.distinct(owner, bucket.astype(np.int64))
    value = count.astype(np.float64)
    square = np.bincount(owner, value * value, piece.rows)
    return owner, bucket, value / np.sqrt(square[owner])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in texts.slices(batch["text"]):
            owner, bucket, value = features(piece)
            cuts = np.searchsorted(owner, np.arange(piece.rows + 1))
            rows = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            part = batch.slice(piece.first, piece.rows)
            yield pa.record_batch(
                [
                    part["key"],
                    part["label"],
                    pa.array([bucket[r].astype(np.int32).tobytes() for r in rows], pa.binary()),
                    pa.array([value[r].astype(np.float32).tobytes() for r in rows], pa.binary()),
                ],
                names=["key", "label", "buckets", "values"],
            )


def fit_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    buckets: int = BUCKETS,
    epochs: int = EPOCHS,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-2,
) -> Model:
    """Follow-the-proximally-regularised-leader with a learning rate per coordinate.

    ``rows`` are (buckets, values, label). The state of a coordinate is ``z``, the sum
    of its gradients less the pull of past weights, and ``n``, the sum of their squares.
    A weight is the closed-form minimiser given both, zero while ``|z| <= l1``. The
    bias is a coordinate without l1.
    """
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    penalty = np.full(buckets + 1, l1)
    penalty[buckets] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for where, values, label in rows:
            at = np.append(where, buckets)
            x = np.append(values, 1.0)
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(buckets + 1))
    return Model(w[:buckets].astype(np.float32), float(w[buckets]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``quality`` learned from at most ``sample`` labelled rows.

    The rows are those whose id has the smallest hash, so they are a function of the
    ids alone. Vectors are made on the executors; the driver gets no more than
    ``sample`` of them. Labels other than 0 and 1 are no labels; of contradicting labels
    the smaller counts. Without any label the model knows no better than 0.5.
    """
    ids = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").alias("key"))
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample)
    )
    labelled = (
        docs.select(F.col("doc_id").alias("key"), "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(ids), "key")
        .mapInArrow(_vectors, "key long, label int, buckets binary, values binary")
    )
    rows = sorted(labelled.collect(), key=lambda row: (_scattered(row.key), row.buckets))
    return fit_leader(
        [
            (np.frombuffer(r.buckets, np.int32), np.frombuffer(r["values"], np.float32), r.label)
            for r in rows
        ]
    )


def _scattered(key: int) -> int:
    return int(texts.mix(np.array([key], np.int64).view(np.uint64))[0])


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """The documents and ``score``, from their whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        weights, bias = shared.value.weights, shared.value.bias
        logits = [np.zeros(0)]
        for piece in texts.slices(column):
            owner, bucket, value = features(piece)
            logits.append(bias + np.bincount(owner, weights[bucket] * value, piece.rows))
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(np.concatenate(logits), -35, 35))))

    return docs.withColumn("score", scored("text"))


def held_out(parts: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(
        F.crc32(F.col("doc_id").cast("string")) % parts == remainder, F.lit(False)
    )


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from rows that are not held out."""
    model = fit(docs, labels.where(~held_out(5, 0)))
    return with_scores(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = fit(docs, labels.where(~held_out(5, 0)))
    return (
        with_scores(docs, model)
        .where(F.col("score") >= THRESHOLD)
        .select(*docs.columns)
    )
