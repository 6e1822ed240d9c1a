import hashlib

import pytest
from pyspark.sql import functions as F

from paritas.operators import ordering, split


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "id")


def expected_order(n, seed=42):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def of(df, name):
    return {r["id"] for r in df.where(F.col("split") == name).collect()}


def test_position_is_the_rank_in_the_shuffle(spark):
    rows = ordering.with_shuffle_position(ids(spark, 500)).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["position"])] == expected_order(500)
    assert sorted(r["position"] for r in rows) == list(range(500))


@pytest.mark.parametrize(("n", "train"), [(10, 9), (9, 8), (1, 0), (500, 450)])
def test_exact_ninety_ten(spark, n, train):
    df = split.split_train_eval(ids(spark, n))
    order = expected_order(n)
    assert of(df, "train") == set(order[:train])
    assert of(df, "eval") == set(order[train:])


def test_empty_table(spark):
    assert split.split_train_eval(ids(spark, 0)).count() == 0


def test_slices_are_the_first_rows_of_each_split(spark):
    df = split.train_eval_slices(ids(spark, 200), 30, 5)
    order = expected_order(200)
    assert of(df, "train") == set(order[:30])
    assert of(df, "eval") == set(order[180:185])


@pytest.mark.parametrize("n", [0, -1, 10_000])
def test_no_or_large_size_means_all(spark, n):
    df = split.train_eval_slices(ids(spark, 100), n, n)
    assert (len(of(df, "train")), len(of(df, "eval"))) == (90, 10)
    assert split.sample_rows(ids(spark, 100), n).count() == 100


def test_truncation_comes_before_the_split(spark):
    df = split.truncate_then_split(ids(spark, 200), 50, seed=7)
    order = expected_order(200, 7)
    assert of(df, "train") == set(order[:45])
    assert of(df, "validation") == set(order[45:50])


def test_sample_is_exact_and_ignores_partitioning(spark):
    samples = [
        {r["id"] for r in split.sample_rows(d, 37).collect()}
        for d in (ids(spark, 300), ids(spark, 300).repartition(5), ids(spark, 300).coalesce(1))
    ]
    assert samples[0] == samples[1] == samples[2] == set(expected_order(300)[:37])


def test_leakage_counts_shared_rows(spark):
    assert split.split_leakage(ids(spark, 50), ids(spark, 80)).first()["leaked"] == 50
