"""Quality and language models: held-out accuracy, plain recomputation, odd rows."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paritas.llm import langid, quality, texts

ODD = [None, "", " \n", "12 34 !?", "word", "the " * 20000, "Ω", "the of and to be"]


def odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the of"), (5, ODD[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn(
        "label", F.lit(2)
    )


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_quality_of_held_out_documents(spark, mini):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = quality.quality_scores(docs, labels)
    rows = found.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    known = [r for r in rows if r.held_out and r.quality is not None]
    right = sum(r.predicted == r.quality for r in known)
    assert len(known) > 500 and right / len(known) > 0.98
    assert all(r.predicted == 1 for r in known if r.quality == 1)


def test_sparse_dot_product_is_the_plain_one():
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.25)
    values = ["a b a b", "The The THE!! x9", "", "é é"]
    (piece,) = texts.slices(pa.array(values))
    owner, bucket, value = quality.features(piece)
    for i in range(len(values)):
        own = owner == i
        if own.any():
            assert math.isclose((value[own] ** 2).sum(), 1.0)
        assert len(set(bucket[own].tolist())) == own.sum()
    assert not (owner == 2).any()
    for limit in (1, 3, 8):  # the same whatever the slices
        parts = [quality.features(p) for p in texts.slices(pa.array(values), limit)]
        assert np.allclose(np.concatenate([p[2] for p in parts]), value)
    assert model.bias == 0.25


def test_leader_separates_and_shrinks():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        label = int(rng.integers(2))
        noise = rng.integers(2, 50, 5)
        where = np.unique(np.append(noise, label))
        rows.append((where, np.ones(len(where)) / math.sqrt(len(where)), label))
    model = quality.fit_leader(rows, buckets=64, epochs=3, l1=0.5)
    assert model.weights[1] > 0 > model.weights[0]
    assert (model.weights[50:] == 0).all() and (model.weights == 0).sum() > 20


def test_quality_odd_rows(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame(
        [(i, q) for i in (4, 7, 6, 1) for q in (1, 1)] + [(5, 0), (2, None), (None, 1), (3, 7)],
        "doc_id long, quality int",
    )
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (0, 1, 2)}
    assert len(blank) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = langid.document_languages(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.995
    assert all(0 <= r.score <= 1 for r in rows)
    accepted = [r for r in held if not r.rejected]
    assert len(accepted) > 0.9 * len(held)


def test_language_sums_are_the_plain_ones():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(len(langid.RUNS) * langid.BUCKETS, 2)).astype(np.float32)
    model = langid.Model(logits, np.array([0.1, -0.1]), ["x", "y"], 2.0, 0.0)
    values = ["abc de", "", "a", "ab", "Straße 12", "é"]
    (piece,) = texts.slices(pa.array(values))
    label, score = langid.predicted(piece, model)
    for i, value in enumerate(values):
        (one,) = texts.slices(pa.array([value]))
        alone, chance = langid.predicted(one, model)
        assert alone[0] == label[i] and math.isclose(chance[0], score[i])
        runs = [bucket for bucket, _ in langid.subwords(one)]
        raw = len(value.encode())
        assert [len(r) for r in runs] == [max(0, raw - n + 1) for n in langid.RUNS]


def test_language_odd_rows(spark):
    docs = odd_rows(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("b"))
    rows = langid.document_languages(docs).collect()
    assert len(rows) == len(ODD) + 2
    for row in rows:
        assert (row.lang_pred == "und") == (row.doc_id in (0, 1, 2, 3))
        assert row.lang_pred in ("und", "aa", "b")
    assert langid.document_languages(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.document_languages(unlabelled).collect()} == {"und"}


def test_rejection_bound_keeps_the_precision():
    logits = np.array([[4.0, 0.0], [0.0, 4.0], [0.3, 0.0]])
    rows = [(np.array([i % 2]), np.ones(1), i % 2) for i in range(50)]
    rows += [(np.array([2]), np.ones(1), i % 2) for i in range(50)]
    temperature, bound = langid._calibrated(rows, logits, np.zeros(2))
    chances = langid._softmax(logits / temperature)
    assert chances[2].max() < bound <= chances[0].max() and temperature > 0


@pytest.mark.parametrize("sample", [10, 500])
def test_sample_is_bounded(spark, mini, sample):
    docs = spark.read.parquet(f"{mini}/documents.parquet")
    assert langid.fit(docs, sample).labels
