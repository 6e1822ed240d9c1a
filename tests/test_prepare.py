import math

import pytest
from pyspark.sql import functions as F

from paritas.catalogue import IDENTITY_COLUMNS, ModelSpec, present_identities
from paritas.checks import fixtures as fx
from paritas.operators.prepare import prepare_comments, subgroup_members

SCHEMA = "id bigint, comment_text string, target double, black double, asian double, other int"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_expected_columns_of_the_comment_table(spark, small):
    df = fx.jigsaw(spark, small)
    assert df.count() > 0
    for column in ("comment_text", "target", "male", "female", "black", "white"):
        assert column in df.columns


def test_preparation_keeps_label_target_and_identities(spark, small):
    df = prepare_comments(fx.jigsaw(spark, small))
    assert df.columns == ["id", "comment_text", "target", "is_toxic", *IDENTITY_COLUMNS]
    nulls = df.select(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns if c != "target"]
    ).first()
    assert sum(nulls) == 0


def test_labels_and_scores(spark):
    df = prepare_comments(
        raw(
            spark,
            (1, "a", 0.5, 0.2, None, 9),
            (2, None, 0.49, math.nan, 0.6, 9),
            (3, "", None, 1.0, 0.5, 9),
            (4, "d", math.nan, 0.0, 0.51, 9),
        )
    )
    assert df.columns == ["id", "comment_text", "target", "is_toxic", "asian", "black"]
    rows = {r["id"]: r for r in df.collect()}
    assert [rows[i]["is_toxic"] for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert rows[2]["comment_text"] == ""
    assert (rows[1]["asian"], rows[2]["black"]) == (0.0, 0.0)
    assert {tuple(r) for r in subgroup_members(df).collect()} == {
        (2, "asian"),
        (3, "black"),
        (4, "asian"),
    }


def test_threshold_and_raw_text_are_options(spark):
    df = prepare_comments(raw(spark, (1, None, 0.3, 0.0, 0.0, 0)), 0.3, clean_text=False)
    row = df.first()
    assert (row["is_toxic"], row["comment_text"]) == (1, None)


def test_identities_in_catalogue_order():
    assert present_identities(["white", "x", "asian", "male"]) == ["asian", "male", "white"]


@pytest.mark.parametrize(
    ("phase", "key", "header"),
    [
        ("raw", "o/m Raw", "Raw o/m"),
        ("finetuned", "o/m Finetuned", "Fine-tuned o/m"),
        ("zero_shot", "o/m Raw", "o/m"),
        ("baseline", "o/m", "o/m"),
    ],
)
def test_model_names(phase, key, header):
    spec = ModelSpec("o/m", phase)
    assert (spec.key, spec.prediction_header) == (key, header)
