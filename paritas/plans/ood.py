"""Evaluation of all models on an out-of-domain table."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.catalogue import METRIC_COLUMNS, ModelSpec
from paritas.operators.classifier import score_baseline
from paritas.operators.ood import ood_bias_metrics, with_groups
from paritas.plans.evaluation import BASELINE_MODEL, as_predictions, write_model_scores
from paritas.sources.comments import read_ood
from paritas.sources.files import path_exists
from paritas.sources.models import load_pipeline
from paritas.sources.results import read_predictions, write_ood_metrics, write_predictions

OUT_OF_DOMAIN = "ToxiGen"
OOD_EVALUATED = (
    "model string, identity string, first_row bigint, first_place int, total_examples bigint, "
    + ", ".join(f"{name} double" for name in METRIC_COLUMNS)
)

log = logging.getLogger(__name__)


def run_ood(
    spark: SparkSession,
    sources: Sequence[str],
    results_dir: str,
    models: Mapping[ModelSpec, Callable],
    sample: int = -1,
) -> DataFrame:
    """Score the table with the saved baseline, if there is one, and every model, then
    measure all of them over the parsed groups in one plan. If none worked, the result is
    empty and no metrics are written."""
    table = read_ood(spark, sources, sample)
    path = f"{results_dir}/predictions"
    done = []
    saved = f"{results_dir}/baseline_pipeline"
    if path_exists(spark, saved):
        scored = score_baseline(load_pipeline(spark, saved), table, "text")
        write_predictions(as_predictions(scored, OUT_OF_DOMAIN, BASELINE_MODEL), path)
        done.append(BASELINE_MODEL)
    done += write_model_scores(table, OUT_OF_DOMAIN, models, results_dir, "text")
    if not done:
        log.warning("no model could be evaluated out of domain, nothing is written")
        return spark.createDataFrame([], OOD_EVALUATED)
    predictions = read_predictions(spark, path).where(F.col("dataset") == OUT_OF_DOMAIN)
    metrics = ood_bias_metrics(with_groups(table), predictions, [m.key for m in done])
    written = f"{results_dir}/metrics/{OUT_OF_DOMAIN}"
    metrics.write.mode("overwrite").parquet(written)
    metrics = spark.read.parquet(written)
    write_ood_metrics(metrics, results_dir, done)
    return metrics
