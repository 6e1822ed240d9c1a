import math

import pytest
from pyspark.sql import functions as F

from paritas.operators import ood


def parsed(spark, *values):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "id int, target_group string")
    return [r["groups"] for r in ood.with_groups(df).orderBy("id").collect()]


def test_group_fields(spark):
    cases = {
        "['black', 'women']": ["black", "women"],
        '["a\'b", "c"]': ["a'b", "c"],
        "asian, latino": ["asian", "latino"],
        " asian ,\tlatino\n": ["asian", "latino"],
        "none": [],
        "[broken]": ["[broken]"],
        "Black": ["Black"],
        "jewish, , Unknown,jewish": ["jewish"],
        "[]": [],
        "[' padded ', 'NULL', '']": [" padded "],
        "['a', 'b',]": ["a", "b"],
        "['a', None]": ["a"],
        "[1, 2]": ["1", "2"],
        "": [],
        "NaN": [],
    }
    assert parsed(spark, *cases) == list(cases.values())
    assert parsed(spark, None, "x")[0] == []


def test_list_fields_are_taken_as_they_are(spark):
    df = spark.createDataFrame(
        [(1, ["a", " b", "a", "none", None])], "id int, target_groups array<string>"
    )
    assert ood.with_groups(df).first()["groups"] == ["a", " b"]


def test_group_column_in_order_of_preference(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id int, group string, target_group string")
    assert ood.group_column(df) == "target_group"
    assert ood.with_groups(df.select("id")).first()["groups"] == []


def label(spark, column, kind, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {column} {kind}")
    return [r["label"] for r in ood.with_label(df).orderBy("id").collect()]


def test_label_cascade(spark):
    assert label(spark, "toxicity_human", "double", 3.0, 3.1, None, math.nan) == [0, 1, 0, 0]
    assert label(spark, "toxicity_human_annotated", "int", 1, 0) == [1, 0]
    assert label(spark, "label", "int", 1, 0) == [1, 0]
    assert label(spark, "toxicity", "int", 1, 0) == [1, 0]
    assert label(spark, "toxicity_score", "double", 0.5, 0.49, None) == [1, 0, 0]
    assert label(spark, "roberta_prediction", "string", "0.5", "0.1") == [1, 0]
    both = spark.createDataFrame([(4.0, 0)], "toxicity_human double, label int")
    assert ood.with_label(both).first()["label"] == 1
    with pytest.raises(ValueError, match="no label column"):
        label(spark, "other", "int", 1)


def test_text_column(spark):
    df = spark.createDataFrame([("g", "c")], "generation string, comment_text string")
    assert ood.with_text(df).first()["text"] == "g"
    assert ood.with_text(df.select("comment_text")).first()["text"] == "c"
    kept = spark.createDataFrame([("t", "g")], "text string, generation string")
    assert ood.with_text(kept).first()["text"] == "t"


def test_split_filter_only_with_a_split_column(spark):
    df = spark.createDataFrame([(1, "test"), (2, "train")], "id int, split string")
    assert [r["id"] for r in ood.test_split(df).collect()] == [1]
    assert ood.test_split(df.select("id")).count() == 2


def test_catalogue_in_order_of_first_appearance(spark):
    df = spark.createDataFrame(
        [(2, ["c", "a"]), (1, ["b", "a"]), (3, ["d"])], "id bigint, groups array<string>"
    )
    rows = ood.group_catalogue(df.repartition(3)).orderBy("first_row", "first_place").collect()
    assert [r["group"] for r in rows] == ["b", "a", "c", "d"]


def metrics(spark, groups):
    rows = [(i, i % 2, g) for i, g in enumerate(groups)]
    labelled = spark.createDataFrame(rows, "id bigint, label int, groups array<string>")
    predictions = labelled.select(
        "id", F.lit("m").alias("model"), F.col("label").cast("double").alias("score")
    )
    df = ood.ood_bias_metrics(labelled, predictions, ["m"])
    return {r["identity"]: r for r in df.collect()}


def test_metrics_over_parsed_groups(spark):
    got = metrics(spark, [["a"], ["a", "b"], ["B"], []])
    assert {k: r["total_examples"] for k, r in got.items()} == {"a": 2, "b": 1, "B": 1}
    assert got["a"]["subgroup_auc"] == 1.0
    assert got["b"]["subgroup_auc"] is None
    assert got["b"]["overall_auc"] == 1.0


def test_many_groups(spark):
    """As many groups as rows: none of them meets all others in one task."""
    labelled = spark.range(0, 100_000, 1, 8).selectExpr(
        "id", "int(id % 2) AS label", "array(concat('g', id)) AS groups"
    )
    predictions = labelled.selectExpr("id", "'m' AS model", "double(label) AS score")
    df = ood.ood_bias_metrics(labelled, predictions, ["m"])
    row = df.agg(
        F.count("*").alias("n"),
        F.sum("total_examples").alias("examples"),
        F.min("overall_auc").alias("auc"),
    ).first()
    assert tuple(row) == (100_000, 100_000, 1.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_placeholder_when_no_group_parses(spark):
    got = metrics(spark, [[], []])
    assert list(got) == ["placeholder"]
    assert got["placeholder"]["total_examples"] == 0
    assert got["placeholder"]["overall_auc"] == 1.0
    assert got["placeholder"]["subgroup_auc"] is None
