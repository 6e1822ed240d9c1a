"""Comparison of all models, and their predictions side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.catalogue import (
    BASELINE,
    METRIC_COLUMNS,
    METRIC_HEADERS,
    ModelSpec,
    safe_name,
)
from paritas.functions.values import binary_prediction

# Fixed value: name of the line that holds the values of the whole data set.
OVERALL_NAME = "Overall Dataset"

# Columns of the compiled prediction table before the models.
PREDICTION_BASE = ("sentence", "dataset", "true_label")

# Metrics that make up each section of the report.
SECTIONS = {
    "overall_auc": ("overall_auc",),
    "subgroup_auc": ("subgroup_auc",),
    "fnr": ("overall_fnr", "subgroup_fnr"),
    "fpr": ("overall_fpr", "subgroup_fpr"),
}


def report_header(model: str, metric: str) -> str:
    """``<model> <metric>``, the metric without its number in the CSV files."""
    return f"{model} {METRIC_HEADERS[metric].split('. ', 1)[1]}"


def base_model(models: Sequence[str]) -> str:
    """The model whose identities the report lists: the baseline, else the first."""
    return "Baseline" if "Baseline" in models else models[0]


def final_report(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """(ord, identity, total_examples, one column per model and metric).

    ``metrics`` is long: one row per model and identity. The list of models is
    known, so the wide table is a single conditional aggregate, and identities the
    base model lacks are dropped by the same aggregate.
    """
    base = F.col("model") == base_model(models)
    wide = [
        F.max(F.when(F.col("model") == model, F.col(metric))).alias(
            report_header(model, metric)
        )
        for model in models
        for metric in METRIC_COLUMNS
    ]
    return (
        metrics.where(F.col("model").isin(*models))
        .groupBy("identity")
        .agg(
            F.max(F.when(base, F.col("ord"))).alias("ord"),
            F.max(F.when(base, F.col("total_examples"))).alias("total_examples"),
            *wide,
        )
        .where(F.col("ord").isNotNull())
        .select(
            "ord",
            "identity",
            "total_examples",
            *[_quoted(model, metric) for model in models for metric in METRIC_COLUMNS],
        )
    )


def _quoted(model: str, metric: str) -> Column:
    return F.col(f"`{report_header(model, metric)}`")


def report_section(report: DataFrame, section: str, models: Sequence[str]) -> DataFrame:
    """One section of the report: identity and the section's metrics per model.

    The overall AUC is the same on every line, so that section keeps the first.
    """
    columns = [
        _quoted(model, metric) for model in models for metric in SECTIONS[section]
    ]
    if section == "overall_auc":
        return report.where(F.col("ord") == 0).select(
            F.lit(OVERALL_NAME).alias("identity"), *columns
        )
    return report.select("identity", *columns)


def preview(metrics: DataFrame, rows: int = 10) -> DataFrame:
    """The first lines of a metric table in reporting order."""
    order = [c for c in ("model", "ord", "first_row", "first_place") if c in metrics.columns]
    return metrics.orderBy(*order).limit(rows)


def bias_gaps(metrics: DataFrame) -> DataFrame:
    """Subgroup minus overall value, the way the report is meant to be read."""
    gaps = [
        (F.col(f"subgroup_{name}") - F.col(f"overall_{name}")).alias(f"{name}_gap")
        for name in ("auc", "fnr", "fpr")
    ]
    return metrics.select("dataset", "model", "identity", *gaps)


def prediction_count_gate(
    base: Mapping[str, DataFrame], predictions: DataFrame, models: Sequence[str]
) -> DataFrame:
    """(dataset, model, rows, predictions, complete) for every data set and model.

    A model's predictions are used only if there are as many as rows. The counts
    read no column beyond dataset and model, which are folders on disk.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows")
            for name, df in base.items()
        ],
    )
    registry = rows.select(
        "dataset", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "rows"
    )
    found = (
        predictions.where(F.col("model").isin(*models))
        .groupBy("dataset", "model")
        .agg(F.count(F.lit(1)).alias("predictions"))
    )
    n = F.coalesce(F.col("predictions"), F.lit(0))
    return registry.join(found, ["dataset", "model"], "left").select(
        "dataset",
        "model",
        "rows",
        n.alias("predictions"),
        ((n > 0) & (n == F.col("rows"))).alias("complete"),
    )


def compile_predictions(
    base: Mapping[str, DataFrame],
    predictions: DataFrame,
    models: Sequence[ModelSpec],
    threshold: float = 0.5,
) -> DataFrame:
    """(sentence, dataset, true_label, one 0/1 column per model).

    ``base`` maps a data set's name to its (id, sentence, true_label). Predictions
    of a data set are first made wide, one narrow row per id, and meet the texts in
    one join on the id. If the texts are stored in buckets of the id, that join
    shuffles only the predictions. A model whose predictions are incomplete gets nulls.
    """
    keys = [m.key for m in models]
    gate = prediction_count_gate(base, predictions, keys)
    # One row per data set of ``base``: a handful, so it is safe to broadcast.
    complete = gate.groupBy("dataset").agg(
        *[
            F.bool_or(F.when(F.col("model") == key, F.col("complete"))).alias(f"ok{i}")
            for i, key in enumerate(keys)
        ]
    )
    label = binary_prediction(F.col("score"), threshold)
    columns = [
        F.max(F.when(F.col("model") == key, label)).alias(f"p{i}") for i, key in enumerate(keys)
    ]
    sections = []
    for name, df in base.items():
        wanted = (F.col("dataset") == name) & F.col("model").isin(*keys)
        wide = predictions.where(wanted).groupBy("id").agg(*columns)
        sections.append(
            df.select("id", "sentence", "true_label")
            .join(wide, "id", "left")
            .withColumn("dataset", F.lit(name))
        )
    return (
        reduce(DataFrame.unionByName, sections)
        .join(F.broadcast(complete), "dataset", "left")
        .select(
            *PREDICTION_BASE,
            *[
                F.when(F.col(f"ok{i}"), F.col(f"p{i}")).alias(model.prediction_header)
                for i, model in enumerate(models)
            ],
        )
    )


def with_display_names(
    df: DataFrame, models: Sequence[str], column: str = "safe_name"
) -> DataFrame:
    """Add ``model``: the registered name behind a file-safe one, else that itself."""
    by_safe_name = {safe_name(m): m for m in models}
    pairs = [F.lit(v) for pair in by_safe_name.items() for v in pair]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.withColumn(
        "model", F.coalesce(F.try_element_at(known, F.col(column)), F.col(column))
    )


def result_files(listing: DataFrame, file_col: str = "file") -> DataFrame:
    """(file, safe_name, phase, ...) of the metric tables in a listing of result files.

    The ending tells the phase; reports, predictions and anything else are left out. Other
    columns stay.
    """
    name = F.col(file_col)
    raw = F.regexp_extract(name, r"^(.*)_raw_metrics\.csv$", 1)
    tuned = F.regexp_extract(name, r"^(.*)_finetuned_metrics\.csv$", 1)
    phase = (
        F.when(name == "baseline_metrics.csv", F.lit(BASELINE))
        .when(name.endswith("_raw_metrics.csv"), F.lit("raw"))
        .when(name.endswith("_finetuned_metrics.csv"), F.lit("finetuned"))
    )
    safe = F.when(phase == BASELINE, F.lit("Baseline")).when(phase == "raw", raw).otherwise(tuned)
    others = [c for c in listing.columns if c != file_col]
    named = listing.select(
        name.alias("file"), safe.alias("safe_name"), phase.alias("phase"), *others
    )
    return named.where(F.col("phase").isNotNull())
