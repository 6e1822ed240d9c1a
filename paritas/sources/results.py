"""Metric tables, predictions and reports on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.catalogue import (
    BASELINE,
    FINETUNED,
    METRIC_COLUMNS,
    METRIC_HEADERS,
    ModelSpec,
    safe_name,
)
from paritas.operators.report import result_files, with_display_names

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("identity", T.StringType()),
        T.StructField("total_examples", T.LongType()),
        *[T.StructField(name, T.DoubleType()) for name in METRIC_COLUMNS],
    ]
)


# The names of result files, here and below.


def metric_file(model: ModelSpec) -> str:
    """File name that tells model and phase of a metric table."""
    if model.phase == BASELINE:
        return "baseline_metrics.csv"
    phase = FINETUNED if model.phase == FINETUNED else "raw"
    return f"{safe_name(model.name)}_{phase}_metrics.csv"


def _csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null is an empty field, and texts keep their blanks."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def public_metrics(metrics: DataFrame, with_model: bool = False) -> DataFrame:
    """Metrics under their public headers, in reporting order."""
    order = [c for c in ("ord", "first_row", "first_place") if c in metrics.columns]
    if with_model:
        order = ["model", *order]
    names = ["identity", "total_examples", *METRIC_COLUMNS]
    if with_model:
        names = ["model", *names]
    return metrics.orderBy(*order).select(
        *[F.col(name).alias(METRIC_HEADERS[name]) for name in names]
    )


def write_metrics(metrics: DataFrame, folder: str, models: Sequence[ModelSpec]) -> None:
    """One CSV per model; ``metrics`` has few rows and may hold several models."""
    for model in models:
        of_model = metrics.where(F.col("model") == model.key)
        _csv(public_metrics(of_model).coalesce(1), f"{folder}/{metric_file(model)}")


# Fixed value: the baseline's name in the out-of-domain table.
OOD_BASELINE_NAME = "Baseline (TF-IDF + LR)"


def write_ood_metrics(metrics: DataFrame, folder: str, models: Sequence[ModelSpec]) -> None:
    """All models in one CSV, the model first and under its bare name."""
    bare = {m.key: OOD_BASELINE_NAME if m.phase == BASELINE else m.name for m in models}
    names = F.create_map(*[F.lit(v) for pair in bare.items() for v in pair])
    named = metrics.withColumn(
        "model", F.coalesce(F.try_element_at(names, F.col("model")), F.col("model"))
    )
    public = public_metrics(named, with_model=True)
    _csv(public.coalesce(1), f"{folder}/ood_toxigen_metrics.csv")


#: Split at commas outside of quotes.
_FIELDS = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _unquoted(field: Column) -> Column:
    """A CSV field without its quotes."""
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    quoted = F.startswith(field, F.lit('"')) & F.endswith(field, F.lit('"'))
    return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def _metric_texts(read: DataFrame, folder: str) -> DataFrame:
    """(file, part, value): the whole texts of a folder's files. ``file`` is the entry of
    the folder, which may itself be a folder of parts."""
    part = F.url_decode("_metadata.file_path")
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index(part, f"/{root}/", -1)
    return read.select(F.substring_index(inside, "/", 1).alias("file"), part.alias("part"), "value")


def _metric_lines(texts: DataFrame) -> DataFrame:
    """Lines of CSV files as (..., ord, fields), each a map from its file's headers to its
    fields. A file is a metric table, so its lines are few: one per identity."""
    others = [c for c in texts.columns if c not in ("part", "value")]
    lines = texts.select(
        *others, "part", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")
    ).where(F.col("value") != "")
    split = F.transform(F.split("value", _FIELDS), _unquoted)
    in_part = Window.partitionBy("part").orderBy("line")
    in_file = Window.partitionBy("file").orderBy("part", "line")
    return (
        lines.withColumn("fields", split)
        .withColumn("header", F.first("fields").over(in_part))
        .withColumn("head", F.min("line").over(in_part))
        .where(F.col("line") > F.col("head"))
        .withColumn("ord", (F.row_number().over(in_file) - 1).cast("long"))
        .select(*others, "ord", F.map_from_arrays("header", "fields").alias("fields"))
    )


def read_metric_files(spark: SparkSession, folder: str, models: Sequence[str]) -> DataFrame:
    """(model, ord, identity, total_examples, metrics) of all metric CSVs in a folder.

    The model and its phase come from the file name; other files are not used. All files
    are read in one scan and each file's columns are taken by its own header, as some have
    more than others. The position of an identity is that in its file.
    """
    schema = T.StructType(
        [
            T.StructField("model", T.StringType()),
            T.StructField("ord", T.LongType()),
            *METRIC_SCHEMA.fields,
        ]
    )
    try:
        read = spark.read.text(f"{folder.rstrip('/')}/*_metrics.csv", wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    texts = result_files(_metric_texts(read, folder))
    lines = with_display_names(_metric_lines(texts), models)
    suffix = (
        F.when(F.col("phase") == BASELINE, F.lit(""))
        .when(F.col("phase") == FINETUNED, F.lit(" Finetuned"))
        .otherwise(F.lit(" Raw"))
    )
    value = {
        field.name: F.nullif(F.try_element_at("fields", F.lit(METRIC_HEADERS[field.name])), F.lit(""))
        for field in METRIC_SCHEMA.fields
    }
    return lines.select(
        F.concat("model", suffix).alias("model"),
        "ord",
        *[value[field.name].cast(field.dataType).alias(field.name) for field in METRIC_SCHEMA.fields],
    )


def write_predictions(predictions: DataFrame, path: str, append: bool = False) -> None:
    """(dataset, model, id, score) as Parquet, one folder per data set and model.

    Only the folders in ``predictions`` are replaced, or added to, so models can be scored
    one by one; counting a model's predictions reads no column.
    """
    (
        predictions.select("dataset", "model", "id", F.col("score").cast("double").alias("score"))
        .write.mode("append" if append else "overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "model")
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = "id bigint, score double, dataset string, model string"
    return spark.read.schema(schema).parquet(path)


def prediction_file(model: ModelSpec, out_of_domain: bool = False) -> str:
    """File name of a model's predictions in their public CSV form."""
    phase = {BASELINE: "", FINETUNED: "_finetuned", "raw": "_raw", "zero_shot": "_llama"}
    ending = "_ood" if out_of_domain else ""
    return f"preds_{safe_name(model.name)}{phase[model.phase]}{ending}.csv"


def write_prediction_csv(
    scored: DataFrame, folder: str, model: ModelSpec, out_of_domain: bool = False
) -> None:
    """Text and score of every row as CSV files, written in parallel."""
    text = "text" if out_of_domain else "comment_text"
    public = scored.select(text, F.col("score").alias("toxicity_score"))
    _csv(public, f"{folder}/{prediction_file(model, out_of_domain)}")


def write_report(report: DataFrame, folder: str) -> None:
    public = report.orderBy("ord").select(
        F.col("identity").alias(METRIC_HEADERS["identity"]),
        F.col("total_examples").alias(METRIC_HEADERS["total_examples"]),
        *[F.col(f"`{c}`") for c in report.columns[3:]],
    )
    _csv(public.coalesce(1), f"{folder}/final_report.csv")


def write_compiled_predictions(compiled: DataFrame, folder: str) -> None:
    """The row-level prediction table; as large as the data, so in many files."""
    _csv(compiled, f"{folder}/final_predictions.csv")
