"""Language identification: averaged hashed subword embeddings and a linear softmax,
trained by stochastic gradient descent in NumPy, with calibrated rejection.

A text's subwords are all runs of two, three and four bytes, A-Z lowered, where white
space, digits and ASCII punctuation count as one boundary byte; each run length has
``BUCKETS`` buckets of its own. A text is the average of its subwords' embeddings. The
softmax is linear, so a bucket's embedding enters only through its product with the output
matrix: scoring looks up one row of logits per subword, whatever the dimension.

Probabilities are calibrated on a part of the sample that training does not see, by one
temperature; so is the probability below which a prediction is ``rejected``: the least one
above which ``PRECISION`` of the accepted predictions there are right.

A null text and one without any letter are ``und`` with score 0 and rejected. Labels are
the values of ``lang`` seen in training; without any, every text is ``und``. Repeated rows
are scored each, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm import texts
from paritas.llm.quality import held_out

RUNS = (2, 3, 4)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
DIMENSION = 16
#: Rows the model is fitted on at most; a classifier's sample, chosen by hash of the id.
SAMPLE = 2000
#: Of these, every so many-th calibrates and does not train.
CALIBRATION = 5
EPOCHS = 8
RATE = 2.0
PRECISION = 0.99
UNDETERMINED = "und"

_FOLDED = texts.lowered(np.arange(256, dtype=np.uint8))
_FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass(frozen=True)
class Model:
    """Logits of every bucket, the labels, the temperature and the rejection bound."""

    logits: np.ndarray
    bias: np.ndarray
    labels: list[str]
    temperature: float
    reject_below: float


def subwords(piece: texts.Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run length: the bucket of every run in one text, and each text's range."""
    data = _FOLDED[piece.data].astype(np.uint32)
    out = []
    for k, n in enumerate(RUNS):
        count = max(0, len(data) - n + 1)
        value = np.zeros(count, np.uint32)
        for i in range(n):
            value = value * np.uint32(0x01000193) + data[i : i + count]
        value *= np.uint32(0x9E3779B1)
        bucket = (value >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + k * BUCKETS
        size = np.diff(piece.offsets)
        inside = np.ones(count, bool)
        for i in range(1, n):  # runs that would reach into the next text
            at = piece.offsets[1:] - i
            at = at[(at >= 0) & (at < count)]
            inside[at] = False
        ranges = np.concatenate([[0], np.cumsum(np.maximum(size - n + 1, 0))])
        out.append((bucket[inside], ranges))
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in texts.slices(batch["text"]):
            runs = subwords(piece)
            rows = []
            for i in range(piece.rows):
                found = np.concatenate([bucket[r[i] : r[i + 1]] for bucket, r in runs])
                where, count = np.unique(found, return_counts=True)
                rows.append((where.astype(np.int32), count.astype(np.float32)))
            part = batch.slice(piece.first, piece.rows)
            yield pa.record_batch(
                [
                    part["key"],
                    part["lang"],
                    pa.array([where.tobytes() for where, _ in rows], pa.binary()),
                    pa.array([count.tobytes() for _, count in rows], pa.binary()),
                ],
                names=["key", "lang", "buckets", "counts"],
            )


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], labels: list[str], seed: int = 0
) -> Model:
    """``rows`` are (buckets, shares of the subwords, label's place)."""
    rng = np.random.default_rng(seed)
    total = len(RUNS) * BUCKETS
    embedding = rng.normal(0, 0.1, (total, DIMENSION))
    output = rng.normal(0, 0.1, (len(labels), DIMENSION))
    bias = np.zeros(len(labels))
    fit = [row for i, row in enumerate(rows) if i % CALIBRATION] or rows
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            where, share, label = fit[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ embedding[where]
            error = _softmax(output @ hidden + bias)
            error[label] -= 1.0
            back = error @ output
            output -= rate * np.outer(error, hidden)
            bias -= 0.1 * rate * error
            embedding[where] -= rate * share[:, None] * back
    logits = embedding @ output.T
    temperature, bound = _calibrated(
        [row for i, row in enumerate(rows) if i % CALIBRATION == 0], logits, bias
    )
    return Model(logits.astype(np.float32), bias, labels, temperature, bound)


def _calibrated(rows: list, logits: np.ndarray, bias: np.ndarray) -> tuple[float, float]:
    """The temperature of least log-loss, and the rejection bound at that temperature."""
    if not rows:
        return 1.0, 0.0
    own = np.array([share @ logits[where] + bias for where, share, _ in rows])
    label = np.array([label for _, _, label in rows])
    each = np.arange(len(rows))
    grid = np.geomspace(0.2, 5.0, 41)
    loss = [-np.log(np.maximum(_softmax(own / t)[each, label], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    chances = _softmax(own / temperature)
    score, right = chances.max(axis=1), chances.argmax(axis=1) == label
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(rows) + 1)
    last_of_equal = np.append(np.diff(score[order]) != 0, True)
    good = np.flatnonzero((share >= PRECISION) & last_of_equal)
    if not len(good):
        return temperature, 1.0
    return temperature, float(score[order][good[-1]]) if good[-1] < len(rows) - 1 else 0.0


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``lang`` from at most ``sample`` of the rows with a text and a label.

    They are those whose id has the smallest hash: ids alone are sorted, then only the
    chosen rows are read whole.
    """
    usable = docs.where("text is not null and lang is not null and doc_id is not null")
    ids = (
        usable.select(F.col("doc_id").cast("long").alias("key"))
        .distinct()
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample)
    )
    rows = (
        usable.select(F.col("doc_id").cast("long").alias("key"), "lang", "text")
        .join(F.broadcast(ids), "key")
        .groupBy("key")
        .agg(F.min(F.struct("lang", "text")).alias("row"))
        .select("key", "row.*")
        .mapInArrow(_vectors, "key long, lang string, buckets binary, counts binary")
        .collect()
    )
    rows.sort(key=lambda row: row.key * 0x9E3779B97F4A7C15 % (1 << 64))
    labels = sorted({row.lang for row in rows})
    data = []
    for row in rows:
        counts = np.frombuffer(row.counts, np.float32)
        if len(counts):
            where = np.frombuffer(row.buckets, np.int32)
            data.append((where, counts / counts.sum(), labels.index(row.lang)))
    return train(data, labels) if data else Model(np.zeros((0, 0)), np.zeros(0), [], 1.0, 0.0)


def predicted(piece: texts.Slice, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each text's likeliest label, by its place, and its calibrated probability."""
    sums = np.zeros((piece.rows, len(model.labels)))
    counts = np.zeros(piece.rows)
    for bucket, ranges in subwords(piece):
        sums += texts.totals(model.logits[bucket].astype(np.float64), ranges)
        counts += np.diff(ranges)
    logits = sums / np.maximum(counts, 1)[:, None] + model.bias
    chances = _softmax(logits / model.temperature)
    return chances.argmax(axis=1), chances.max(axis=1)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def told(column: pa.Array) -> pa.Array:
        labels, scores = [], [np.zeros(0)]
        names = np.array([*shared.value.labels, UNDETERMINED], object)
        for piece in texts.slices(column):
            if len(names) > 1:
                label, score = predicted(piece, shared.value)
            else:
                label, score = np.zeros(piece.rows, np.int64), np.zeros(piece.rows)
            labels += names[label].tolist()
            scores.append(score)
        return pa.StructArray.from_arrays(
            [pa.array(labels, pa.string()), pa.array(np.concatenate(scores))],
            names=["lang_pred", "score"],
        )

    lettered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lettered = lettered.withColumn("lettered", has_letter)
    told_rows = lettered.select("doc_id", "lettered", told("text").alias("told"))
    label = F.when(F.col("lettered"), F.col("told.lang_pred")).otherwise(UNDETERMINED)
    score = F.when(label != UNDETERMINED, F.col("told.score")).otherwise(0.0)
    return told_rows.select(
        "doc_id",
        label.alias("lang_pred"),
        score.alias("score"),
        ((label == UNDETERMINED) | (score < model.reject_below)).alias("rejected"),
    )


def document_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned from rows not held out."""
    found = languages(docs, fit(docs.where(~held_out(3, 1))))
    return found.select(
        "doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected"
    )
