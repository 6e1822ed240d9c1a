"""Training by epochs: what is measured, kept, resumed and saved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.operators.classifier import score_baseline
from paritas.plans.epochs import best_epochs, epoch_metrics, logistic_model, run_epochs
from paritas.sources.models import load_pipeline

WORDS = ("red", "green", "blue", "black", "white", "grey")


@pytest.fixture(scope="module")
def comments(spark):
    """Toxic comments hold more of the last words; every third is about identity a."""
    chosen = np.random.default_rng(1)
    rows = []
    for i in range(240):
        toxic = i % 2
        weights = np.array([3, 3, 2, 1, 1, 1]) if not toxic else np.array([1, 1, 2, 2, 3, 3])
        words = chosen.choice(WORDS, 6, p=weights / weights.sum())
        rows.append((i, " ".join(words), toxic, 0.9 if i % 3 == 0 else 0.0, 0.0))
    schema = "id long, comment_text string, is_toxic int, a double, b double"
    return spark.createDataFrame(rows, schema)


def aucs(run):
    rows = run.history.where("ord = 0").orderBy("epoch").collect()
    return [(r["epoch"], r["overall_auc"]) for r in rows]


def test_a_resumed_run_selects_the_same(spark, comments, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    whole = run_epochs(comments, ["a", "b"], one, epochs=3)
    first = run_epochs(comments, ["a", "b"], two, epochs=1)
    assert [e for e, _ in aucs(first)] == [1] and first.kept.count() == 1
    # What a lost run leaves behind: a state without metrics is trained again.
    spark.createDataFrame([(0, 99.0)], "place int, weight double").write.parquet(
        f"{two}/state/epoch=2"
    )
    resumed = run_epochs(comments, ["a", "b"], two, epochs=3)
    assert aucs(resumed) == aucs(whole) and [e for e, _ in aucs(whole)] == [1, 2, 3]
    kept = [
        [(r["rank"], r["epoch"], r["weights"]) for r in run.kept.orderBy("rank").collect()]
        for run in (whole, resumed)
    ]
    assert kept[0] == kept[1] and len(kept[0]) == 2
    best = kept[0][0]
    assert best[1] == best_epochs(whole.history)[0]
    assert dict(aucs(whole))[best[1]] == max(auc for _, auc in aucs(whole)) > 0.7
    model = load_pipeline(spark, f"{two}/model").stages[-1]
    assert [*model.coefficients, model.intercept] == pytest.approx(best[2], abs=1e-12)
    scored = score_baseline(load_pipeline(spark, f"{one}/model"), comments)
    assert scored.where(F.col("score").between(0, 1)).count() == 240


def test_metrics_of_an_epoch_are_whole(spark, comments, tmp_path):
    run = run_epochs(comments, ["a", "b"], str(tmp_path / "run"), epochs=1)
    rows = {r["identity"]: r for r in run.history.collect()}
    assert rows.keys() == {"a", "b"} and rows["b"]["total_examples"] == 0
    found = {r["metric"]: r["value"] for r in epoch_metrics(run.history).collect()}
    assert found["roc_auc"] == rows["a"]["overall_auc"]
    assert "b_subgroup_auc" not in found


def test_best_epochs_with_ties_and_undefined_ones(spark):
    rows = [(1, 0, None), (2, 0, 0.8), (3, 0, 0.9), (4, 0, 0.9), (4, 1, 0.95)]
    history = spark.createDataFrame(rows, "epoch int, ord int, overall_auc double")
    assert best_epochs(history, 4) == [3, 4, 2, 1]


def test_one_class_cannot_be_trained(spark, comments, tmp_path):
    with pytest.raises(ValueError, match="both classes"):
        run_epochs(comments.where("is_toxic = 1"), ["a"], str(tmp_path / "x"))


def test_a_model_of_given_weights(spark):
    model = logistic_model(spark, [0.5, -1.25, 0.0], -0.75)
    assert model.coefficients.toArray().tolist() == [0.5, -1.25, 0.0]
    assert model.intercept == -0.75
