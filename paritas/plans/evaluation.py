"""Scoring saved evaluation rows with many models, and measuring all of them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.catalogue import BASELINE, METRIC_COLUMNS, ZERO_SHOT, ModelSpec, safe_name
from paritas.operators.classifier import score_baseline, train_baseline
from paritas.operators.metrics import evaluate_predictions, rows_mark
from paritas.operators.scoring import score_texts, score_zero_shot
from paritas.session import written
from paritas.sources.files import list_children, path_exists
from paritas.sources.models import load_pipeline, model_paths, save_pipeline
from paritas.sources.results import (
    metric_file,
    read_predictions,
    write_metrics,
    write_prediction_csv,
    write_predictions,
)
from paritas.sources.splits import read_splits

log = logging.getLogger(__name__)

COMMENTS = "Jigsaw"
#: Rows whose scores are committed together.
ROWS_PER_FRAGMENT = 1_000_000
EVALUATED = (
    "dataset string, ord int, identity string, total_examples bigint, "
    + ", ".join(f"{name} double" for name in METRIC_COLUMNS)
    + ", model string"
)
BASELINE_MODEL = ModelSpec("Baseline", BASELINE)


def as_predictions(scored: DataFrame, dataset: str, model: ModelSpec) -> DataFrame:
    return scored.select(
        F.lit(dataset).alias("dataset"), F.lit(model.key).alias("model"), "id", "score"
    )


def score_model(df: DataFrame, model: ModelSpec, make_predict_fn: Callable, text: str) -> DataFrame:
    if model.phase == ZERO_SHOT:
        return score_zero_shot(df, make_predict_fn, text)
    return score_texts(df, make_predict_fn, text)


def _fragments_done(spark: SparkSession, manifest: str) -> tuple[int, set[int]]:
    """How many fragments a model's scoring has, and which are committed; (0, none) if it
    has not begun."""
    if not path_exists(spark, manifest):
        return 0, set()
    rows = spark.read.parquet(manifest).collect()  # a row per fragment
    return max(r["fragments"] for r in rows), {r["fragment"] for r in rows if r["fragment"] >= 0}


def landed_fragments(
    df: DataFrame, text: str, folder: str, rows_per_fragment: int = ROWS_PER_FRAGMENT
) -> tuple[DataFrame, int]:
    """``df`` and its number of fragments; if there are several, its ids and texts landed
    below ``folder`` in one folder per fragment, so that one can be read without the
    others. The folder's name tells which rows it holds: a table with others is landed
    anew, and one with the same is there already."""
    seen = df.agg(F.count(F.lit(1)).alias("n"), rows_mark(F.col("id")).alias("mark")).first()
    fragments = max(1, -(-seen["n"] // rows_per_fragment))
    if fragments == 1:
        return df, 1
    path = f"{folder}/{seen['n']}-{seen['mark'] & 0xFFFFFFFFFFFFFFFF:016x}-{fragments}"
    spark = df.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        part = F.pmod(F.xxhash64("id"), F.lit(fragments)).cast("int")
        df.select("id", text, part.alias("fragment")).write.mode("overwrite").partitionBy(
            "fragment"
        ).parquet(path)
    return spark.read.parquet(path), fragments


def score_in_fragments(
    df: DataFrame,
    fragments: int,
    dataset: str,
    model: ModelSpec,
    make_predict_fn: Callable,
    results_dir: str,
    text: str = "comment_text",
    at_most: int | None = None,
) -> bool:
    """Score a table fragment by fragment, and write each as soon as it is scored; all that
    are left, or ``at_most`` so many. Tells whether all are there now.

    A manifest row follows every committed fragment. A scoring that was cut off goes on
    with the fragments that have none, and of these scores only ids that have no score, so
    nothing is scored twice and no id gets a second prediction. When all fragments are
    there a further call starts over: its first fragment replaces what was written.
    """
    spark = df.sparkSession
    path = f"{results_dir}/predictions"
    manifest = f"{results_dir}/manifest/{dataset}/{safe_name(model.key)}"
    planned, done = _fragments_done(spark, manifest)
    if planned != fragments or len(done) == fragments:
        done = set()
        _record(spark, manifest, -1, fragments, "overwrite")
    left = [k for k in range(fragments) if k not in done]
    for k in left[:at_most]:
        rows = df if fragments == 1 else df.where(F.col("fragment") == k)
        if k:
            found = read_predictions(spark, path).where(
                (F.col("dataset") == dataset) & (F.col("model") == model.key)
            )
            rows = rows.join(found.select("id"), "id", "left_anti")
        scored = as_predictions(score_model(rows, model, make_predict_fn, text), dataset, model)
        write_predictions(scored, path, append=k > 0)
        _record(spark, manifest, k, fragments, "append")
    return at_most is None or at_most >= len(left)


def _record(spark: SparkSession, manifest: str, fragment: int, fragments: int, mode: str) -> None:
    rows = spark.createDataFrame([(fragment, fragments)], "fragment int, fragments int")
    rows.coalesce(1).write.mode(mode).parquet(manifest)


def write_model_scores(
    df: DataFrame,
    dataset: str,
    models: Mapping[ModelSpec, Callable],
    results_dir: str,
    text: str = "comment_text",
    rows_per_fragment: int = ROWS_PER_FRAGMENT,
) -> list[ModelSpec]:
    """Score a table with each model and write the predictions, model by model.

    A model that fails is logged and left out; the others go on. Large tables are scored
    in fragments; what a model wrote survives whatever happens to the next fragment or
    model, and is not scored again by the next call.
    """
    rows, fragments = landed_fragments(df, text, f"{results_dir}/texts/{dataset}", rows_per_fragment)
    done = []
    for model, make_predict_fn in models.items():
        try:
            score_in_fragments(rows, fragments, dataset, model, make_predict_fn, results_dir, text)
            done.append(model)
        except Exception:
            log.exception("scoring %s with %s failed", dataset, model.name)
    return done


def run_baseline(spark: SparkSession, data_dir: str, results_dir: str) -> DataFrame:
    """Train the baseline on the saved training rows, score the evaluation rows, and
    write model, predictions and metrics."""
    data = read_splits(spark, data_dir)
    model_path = f"{results_dir}/baseline_pipeline"
    save_pipeline(train_baseline(data.train), model_path)
    scored = score_baseline(load_pipeline(spark, model_path), data.evaluation)
    write_predictions(
        as_predictions(scored, COMMENTS, BASELINE_MODEL), f"{results_dir}/predictions"
    )
    return run_metrics(spark, data_dir, results_dir, [BASELINE_MODEL])


def run_models(
    spark: SparkSession,
    data_dir: str,
    results_dir: str,
    models: Mapping[ModelSpec, Callable],
) -> DataFrame:
    """Score the saved evaluation rows with raw, fine-tuned or zero-shot models and
    write predictions and metrics of those that worked; of none, the result is empty."""
    data = read_splits(spark, data_dir)
    done = write_model_scores(data.evaluation, COMMENTS, models, results_dir)
    return run_metrics(spark, data_dir, results_dir, done)


def run_finetuned(
    spark: SparkSession,
    data_dir: str,
    results_dir: str,
    folders: Mapping[ModelSpec, str],
    load: Callable[[str], Callable],
) -> DataFrame:
    """:func:`run_models` with models loaded from their folders: the final model there,
    or its newest checkpoint. ``load`` makes a model function of a path. Models that have
    a metric table already are not scored again."""
    models = {}
    for model, folder in folders.items():
        if not path_exists(spark, folder):
            log.warning("no model at %s", folder)
        elif path_exists(spark, f"{results_dir}/{metric_file(model)}"):
            log.info("%s is evaluated already, skipping", model.name)
        else:
            row = model_paths(list_children(spark, folder)).first()
            models[model] = load(row["path"] if row else folder)
    return run_models(spark, data_dir, results_dir, models)


def run_metrics(
    spark: SparkSession, data_dir: str, results_dir: str, models: Sequence[ModelSpec]
) -> DataFrame:
    """Metrics of all given models from their written predictions, in one plan."""
    if not models:
        return spark.createDataFrame([], EVALUATED)
    data = read_splits(spark, data_dir)
    path = f"{results_dir}/predictions"
    predictions = read_predictions(spark, path).where(F.col("dataset") == COMMENTS)
    metrics = evaluate_predictions(
        data.evaluation, predictions, [(COMMENTS, m.key) for m in models], data.identities
    )
    # The metrics are a few rows per model; one written table serves all CSV files.
    table = f"{results_dir}/metrics/{COMMENTS}"
    metrics.coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("model").parquet(table)
    saved = spark.read.parquet(table)
    write_metrics(saved, results_dir, models)
    return saved


def export_predictions(
    texts: DataFrame, dataset: str, results_dir: str, models: Sequence[ModelSpec]
) -> None:
    """Predictions next to their texts in the public CSV form. ``texts`` has the id
    and ``comment_text``, or ``text`` if the data set is out of domain.

    All models' predictions meet the texts in one join, whose result is written and read
    once per model. A model that does not have one prediction for every text is not
    exported.
    """
    predictions = read_predictions(texts.sparkSession, f"{results_dir}/predictions")
    text = "comment_text" if dataset == COMMENTS else "text"
    columns = []
    for i, model in enumerate(models):
        own = F.col("model") == model.key
        columns.append(F.max(F.when(own, F.col("score"))).alias(f"s{i}"))
        columns.append(F.count_if(own).alias(f"n{i}"))
    wanted = predictions.where(
        (F.col("dataset") == dataset) & F.col("model").isin(*[m.key for m in models])
    )
    wide = wanted.groupBy("id").agg(*columns)
    joined = written(texts.select("id", text).join(wide, "id", "left").drop("id"), "export")
    # A model's own texts with one prediction that is a number.
    once = [F.count_if((F.col(f"n{i}") == 1) & F.col(f"s{i}").isNotNull()) for i in range(len(models))]
    counts = joined.agg(
        F.count(F.lit(1)).alias("rows"), *[n.alias(f"n{i}") for i, n in enumerate(once)]
    ).first()
    for i, model in enumerate(models):
        if counts[f"n{i}"] < counts["rows"]:
            log.warning("%s does not have one prediction for every text, not exported", model.name)
            continue
        scored = joined.select(text, F.col(f"s{i}").alias("score"))
        write_prediction_csv(scored, results_dir, model, out_of_domain=dataset != COMMENTS)


def skip_if_done(spark: SparkSession, path: str, make: Callable[[], None]) -> bool:
    """Run ``make`` unless its output exists already; tell whether it ran."""
    if path_exists(spark, path):
        log.info("%s exists, skipping", path)
        return False
    make()
    return True
