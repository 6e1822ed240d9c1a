from pyspark.sql import functions as F

from paritas.catalogue import BASELINE, FINETUNED, METRIC_COLUMNS, RAW, ModelSpec
from paritas.operators import report

BASE = ModelSpec("Baseline", BASELINE)
TUNED = ModelSpec("o/m", FINETUNED)
PLAIN = ModelSpec("o/m", RAW)


def metrics(spark, *rows):
    schema = "model string, ord int, identity string, total_examples bigint, " + ", ".join(
        f"{name} double" for name in METRIC_COLUMNS
    )
    return spark.createDataFrame([(m, o, i, n, *[v] * 6) for m, o, i, n, v in rows], schema)


def test_base_model_decides_the_rows(spark):
    long = metrics(
        spark,
        ("o/m Raw", 0, "a", 9, 0.5),
        ("o/m Raw", 1, "only here", 9, 0.6),
        ("Baseline", 0, "a", 3, 0.7),
        ("Baseline", 1, "b", 4, 0.8),
        ("ignored", 0, "a", 1, 0.1),
    )
    rows = report.final_report(long, ["o/m Raw", "Baseline"]).orderBy("ord").collect()
    assert [r["identity"] for r in rows] == ["a", "b"]
    assert [r["total_examples"] for r in rows] == [3, 4]
    assert [r["o/m Raw Overall AUC"] for r in rows] == [0.5, None]
    assert [r["Baseline Subgroup FPR"] for r in rows] == [0.7, 0.8]
    without = report.final_report(long, ["o/m Raw"]).orderBy("ord").collect()
    assert [r["identity"] for r in without] == ["a", "only here"]


def test_sections(spark):
    long = metrics(spark, ("Baseline", 0, "a", 3, 0.7), ("Baseline", 1, "b", 4, 0.8))
    wide = report.final_report(long, ["Baseline"])
    overall = report.report_section(wide, "overall_auc", ["Baseline"])
    assert overall.collect() == [("Overall Dataset", 0.7)]
    assert report.report_section(wide, "fnr", ["Baseline"]).columns == [
        "identity",
        "Baseline Overall FNR",
        "Baseline Subgroup FNR",
    ]
    assert report.report_section(wide, "subgroup_auc", ["Baseline"]).count() == 2


def test_no_metrics_give_an_empty_report(spark):
    assert report.final_report(metrics(spark).limit(0), ["Baseline"]).count() == 0


def compiled(spark, predictions, models):
    base = {
        "Jigsaw": spark.createDataFrame(
            [(i, f"s{i}", i % 2) for i in range(4)], "id bigint, sentence string, true_label int"
        ),
        "ToxiGen": spark.createDataFrame(
            [(0, "t0", 1)], "id bigint, sentence string, true_label int"
        ),
    }
    table = spark.createDataFrame(
        predictions, "dataset string, model string, id bigint, score double"
    )
    return report.compile_predictions(base, table, models)


def test_predictions_side_by_side(spark):
    complete = [("Jigsaw", "Baseline", i, s) for i, s in enumerate([0.5, 0.49, 0.9, 0.0])]
    short = [("Jigsaw", "o/m Finetuned", i, 0.9) for i in range(3)]
    df = compiled(spark, complete + short, [BASE, TUNED, PLAIN])
    assert df.columns == [
        "sentence",
        "dataset",
        "true_label",
        "Baseline",
        "Fine-tuned o/m",
        "Raw o/m",
    ]
    rows = {r["sentence"]: r for r in df.collect()}
    assert [rows[f"s{i}"]["Baseline"] for i in range(4)] == [1, 0, 1, 0]
    # Three predictions for four rows, and none at all: the whole column is null.
    assert all(r["Fine-tuned o/m"] is None and r["Raw o/m"] is None for r in rows.values())
    assert rows["t0"]["Baseline"] is None
    assert rows["t0"]["true_label"] == 1


def test_too_many_predictions_are_not_used_either(spark):
    five = [("Jigsaw", "Baseline", i, 0.9) for i in range(5)]
    assert compiled(spark, five, [BASE]).where(F.col("Baseline").isNotNull()).count() == 0


def test_result_files(spark):
    names = [
        "baseline_metrics.csv",
        "a_raw_metrics.csv",
        "a_finetuned_metrics.csv",
        "final_report.csv",
        "ood_toxigen_metrics.csv",
        "preds_a_raw.csv",
    ]
    listing = spark.createDataFrame([(n,) for n in names], "file string")
    assert {tuple(r) for r in report.result_files(listing).collect()} == {
        ("baseline_metrics.csv", "Baseline", "baseline"),
        ("a_raw_metrics.csv", "a", "raw"),
        ("a_finetuned_metrics.csv", "a", "finetuned"),
    }


def test_display_names(spark):
    df = spark.createDataFrame([("o_m",), ("x_y",)], "safe_name string")
    named = report.with_display_names(df, ["o/m"]).collect()
    assert {tuple(r) for r in named} == {("o_m", "o/m"), ("x_y", "x_y")}
    assert report.with_display_names(df, []).count() == 2


def test_preview_in_reporting_order(spark):
    long = metrics(spark, *[("Baseline", o, f"i{o:02d}", 1, 0.5) for o in reversed(range(12))])
    assert [r["identity"] for r in report.preview(long).collect()] == [
        f"i{o:02d}" for o in range(10)
    ]
