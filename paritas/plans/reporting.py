"""The comparison report and the compiled predictions, from written results."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.catalogue import ModelSpec
from paritas.operators.report import compile_predictions, final_report
from paritas.plans.evaluation import COMMENTS
from paritas.plans.ood import OUT_OF_DOMAIN
from paritas.sources.comments import read_ood
from paritas.sources.results import (
    read_metric_files,
    read_predictions,
    write_compiled_predictions,
    write_report,
)
from paritas.sources.splits import read_splits

log = logging.getLogger(__name__)


def run_report(spark: SparkSession, results_dir: str, models: Sequence[ModelSpec]) -> DataFrame:
    """Write and return the wide report of all metric files found."""
    metrics = read_metric_files(spark, results_dir, [m.name for m in models])
    # Names of the models that have a metric file: as many as there are files.
    found = {row["model"] for row in metrics.select("model").distinct().collect()}
    keys = [m.key for m in models if m.key in found]
    if not keys:
        return metrics
    report = final_report(metrics, keys)
    write_report(report, results_dir)
    return report


def run_compiled_predictions(
    spark: SparkSession,
    data_dir: str,
    results_dir: str,
    models: Sequence[ModelSpec],
    ood_sources: Sequence[str] = (),
    sample: int = -1,
) -> DataFrame:
    """Write and return all predictions side by side, of both data sets."""
    evaluation = read_splits(spark, data_dir).evaluation
    base = {
        COMMENTS: evaluation.select(
            "id", F.col("comment_text").alias("sentence"), F.col("is_toxic").alias("true_label")
        )
    }
    try:
        table = read_ood(spark, ood_sources, sample) if ood_sources else None
    except AnalysisException:
        log.warning("no out-of-domain table can be read, only comments are compiled")
        table = None
    if table is not None:
        base[OUT_OF_DOMAIN] = table.select(
            "id", F.col("text").alias("sentence"), F.col("label").alias("true_label")
        )
    predictions = read_predictions(spark, f"{results_dir}/predictions")
    compiled = compile_predictions(base, predictions, models)
    write_compiled_predictions(compiled, results_dir)
    return compiled
