"""Out-of-domain tables: varying label, text and group columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.catalogue import METRIC_COLUMNS
from paritas.functions.groups import parse_groups
from paritas.functions.values import above, zero_if_missing
from paritas.operators.metrics import (
    GROUP,
    beside_whole,
    gated,
    located,
    metrics_per_group,
    named_units,
)
from paritas.session import written

# Column names under which such tables carry their groups and text.
GROUP_COLUMNS = ("target_groups", "target_group", "group")
TEXT_COLUMNS = ("text", "generation", "comment_text")

# Fixed value: name reported when no row has a readable group.
PLACEHOLDER = "placeholder"


def test_split(df: DataFrame) -> DataFrame:
    """Only the test rows, if the table has a split column at all."""
    return df.where(F.col("split") == "test") if "split" in df.columns else df


def _label(columns: Sequence[str]) -> Column:
    if "toxicity_human" in columns:
        return above(F.col("toxicity_human"), 3.0).cast("int")
    for name in ("toxicity_human_annotated", "label", "toxicity"):
        if name in columns:
            return F.col(name)
    for name in ("toxicity_score", "roberta_prediction"):
        if name in columns:
            return (zero_if_missing(F.col(name)) >= F.lit(0.5)).cast("int")
    raise ValueError(f"no label column among {list(columns)}")


def with_label(df: DataFrame) -> DataFrame:
    """Set ``label`` from the first label column the table has.

    Human ratings count above 3; annotated labels are taken as they are; scores
    and classifier outputs count from 0.5 on.
    """
    return df.withColumn("label", _label(df.columns))


def with_text(df: DataFrame) -> DataFrame:
    """Set ``text`` from the first text column the table has."""
    name = next((c for c in TEXT_COLUMNS if c in df.columns), None)
    return df if name in (None, "text") else df.withColumn("text", F.col(name))


def group_column(df: DataFrame) -> str | None:
    return next((c for c in GROUP_COLUMNS if c in df.columns), None)


def with_groups(df: DataFrame) -> DataFrame:
    """Add ``groups``: the distinct group names of each row, as an array."""
    name = group_column(df)
    if name is None:
        return df.withColumn("groups", F.array().cast(T.ArrayType(T.StringType())))
    return df.withColumn("groups", parse_groups(F.col(name), df.schema[name].dataType))


def group_members(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Long membership table (id, group) of a table with ``groups``."""
    return df.select(id_col, F.explode("groups").alias("group"))


def group_catalogue(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(group, first_row, first_place): distinct names and where each appears first.

    Sorting by the two positions gives the order of first appearance. A partial
    minimum per name is all that is shuffled, however common the name is.
    """
    first = F.min(F.struct(F.col(id_col).alias("row"), F.col("place"))).alias("first")
    return (
        df.select(id_col, F.posexplode("groups").alias("place", "group"))
        .groupBy("group")
        .agg(first)
        .select(
            "group",
            F.col("first.row").alias("first_row"),
            F.col("first.place").alias("first_place"),
        )
    )


def or_placeholder(catalogue: DataFrame) -> DataFrame:
    """The catalogue, or one placeholder row if it is empty."""
    none = catalogue.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    return catalogue.unionByName(
        none.select(
            F.lit(PLACEHOLDER).alias("group"),
            F.lit(0).cast(catalogue.schema["first_row"].dataType).alias("first_row"),
            F.lit(0).alias("first_place"),
        )
    )


def ood_bias_metrics(
    labelled: DataFrame,
    predictions: DataFrame,
    models: Sequence[str],
    threshold: float = 0.5,
    ranges: int | None = None,
) -> DataFrame:
    """(model, identity, first_row, first_place, total_examples, metrics) over
    parsed groups.

    ``labelled`` has id, label and groups, ``predictions`` model, id and score. All
    models are evaluated in one plan.
    """
    keys, listed = ["model"], [(m,) for m in models]
    # Groups are parsed once; what is read again is an id, a label and a short list.
    narrow = written(labelled.select("id", "label", "groups"), "ood-labels")
    catalogue = or_placeholder(written(group_catalogue(narrow), "ood-groups"))
    wanted = located(predictions, listed, keys).select("unit", "id", "score")
    scored = wanted.join(narrow.withColumnRenamed("label", "is_toxic"), "id")
    units = F.sequence(F.lit(0), F.lit(len(models) - 1))
    # The whole table, as null, next to every group.
    groups = catalogue.select(F.col("group").alias(GROUP)).unionByName(
        scored.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("string").alias(GROUP))
    )
    groups = groups.select(F.explode(units).alias("unit"), GROUP)
    metrics = written(
        metrics_per_group(scored, groups, ["unit"], threshold, wanted, ranges, marked=True),
        "ood-metrics",
    )
    metrics = beside_whole(metrics, ["unit"], metrics.where(F.col(GROUP).isNull()))
    metrics = gated(metrics, narrow)
    return (
        named_units(metrics, listed, keys)
        .join(catalogue, F.col(GROUP) == F.col("group"))
        .select(
            "model",
            F.col("group").alias("identity"),
            "first_row",
            "first_place",
            "total_examples",
            *METRIC_COLUMNS,
        )
    )
