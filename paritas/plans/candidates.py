"""Training several candidates and keeping the one with the best AUC."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.operators.classifier import (
    class_counts,
    fit_tfidf,
    fit_logistic,
    weighted_features,
)
from paritas.operators.metrics import best_run, bias_metrics, with_active_groups
from paritas.operators.split import truncate_then_split
from paritas.session import written
from paritas.sources.models import save_pipeline

# Weights of the L2 penalty to choose from.
PENALTIES = (0.1, 1.0, 10.0)


def candidate_name(penalty: float) -> str:
    return f"L2={penalty:g}"


def train_candidates(
    train: DataFrame, penalties: Sequence[float] = PENALTIES
) -> dict[str, PipelineModel]:
    """One pipeline per penalty; texts are turned into vectors once for all."""
    counts = class_counts(train)
    tfidf = fit_tfidf(train)
    features = weighted_features(train, tfidf, counts)
    try:
        models = fit_logistic(features, counts.total, penalties)
        return {
            candidate_name(penalty): PipelineModel([*tfidf.stages, model])
            for penalty, model in zip(penalties, models, strict=True)
        }
    finally:
        features.unpersist()


def candidate_scores(
    validation: DataFrame, candidates: dict[str, PipelineModel]
) -> DataFrame:
    """Validation rows scored by every candidate, with the model's name."""
    names = list(candidates)
    shared = PipelineModel(candidates[names[0]].stages[:-1]).transform(validation)
    scored = []
    for name in names:
        probability = vector_to_array(F.col("probability"))[1]
        scored.append(
            candidates[name]
            .stages[-1]
            .transform(shared)
            .select(*validation.columns, F.lit(name).alias("model"), probability.alias("score"))
        )
    return reduce(DataFrame.unionByName, scored)


def candidate_metrics(
    prepared: DataFrame,
    identities: Sequence[str],
    n: int = -1,
    seed: int = 42,
    penalties: Sequence[float] = PENALTIES,
) -> tuple[DataFrame, DataFrame, dict[str, PipelineModel]]:
    """Train on the first 90 % of ``n`` shuffled rows, measure on the rest: the metrics,
    the scored rows they come from, and the candidates."""
    split = truncate_then_split(prepared, n, seed=seed)
    train = split.where(F.col("split") == "train").drop("split")
    validation = split.where(F.col("split") == "validation").drop("split")
    candidates = train_candidates(train, penalties)
    scores = with_active_groups(candidate_scores(validation, candidates), identities)
    scored = written(scores.select("model", "id", "is_toxic", "score", "groups"), "candidates")
    keys = ["model"]
    measured = bias_metrics(scored, [(name,) for name in candidates], identities, keys)
    return measured, scored, candidates


def run_candidates(
    prepared: DataFrame,
    identities: Sequence[str],
    model_path: str,
    n: int = -1,
    seed: int = 42,
    penalties: Sequence[float] = PENALTIES,
) -> DataFrame:
    """Train, measure, and save the candidate with the greatest overall AUC."""
    measured, _, candidates = candidate_metrics(prepared, identities, n, seed, penalties)
    best = best_run(measured.where(F.col("ord") == 0)).first()
    if best["run"] is None:
        raise ValueError("no candidate has a defined AUC on the validation rows")
    save_pipeline(candidates[best["run"]], model_path)
    return measured
