"""From a gzipped CSV to the report, as a user would run it."""

import gzip
import shutil

import pytest
from pyspark.sql import functions as F

from paritas.catalogue import FINETUNED, RAW, ZERO_SHOT, ModelSpec, safe_name
from paritas.checks import fixtures as fx
from paritas.checks.stubs import length_model, yes_no_model
from paritas.plans.data import run_data
from paritas.plans.evaluation import (
    BASELINE_MODEL,
    export_predictions,
    run_baseline,
    run_finetuned,
    run_models,
    skip_if_done,
    write_model_scores,
)
from paritas.plans.ood import run_ood
from paritas.plans.reporting import run_compiled_predictions, run_report
from paritas.sources.comments import (
    comment_file,
    load_comments,
    parse_comments,
    read_comments,
    read_ood,
)
from paritas.sources.files import file_numbers, list_children
from paritas.sources.results import (
    metric_file,
    prediction_file,
    read_metric_files,
    read_predictions,
    write_predictions,
)
from paritas.sources.splits import read_splits

RAW_MODEL = ModelSpec("org/tiny", RAW)
TUNED = ModelSpec("org/tiny", FINETUNED)
CHAT = ModelSpec("org/chat", ZERO_SHOT)
BROKEN = ModelSpec("org/broken", RAW)
MODELS = [BASELINE_MODEL, RAW_MODEL, TUNED, CHAT, BROKEN]


def broken_model():
    def make():
        raise RuntimeError("no such model")

    return make


@pytest.fixture(scope="module")
def root(spark, small, tmp_path_factory):
    """A comment CSV with quotes and line breaks in its texts, and an OOD table."""
    folder = tmp_path_factory.mktemp("root")
    pdf = fx.jigsaw(spark, small).withColumn(
        "comment_text", F.concat(F.lit('say "hi",\n'), F.col("comment_text"))
    ).toPandas()
    pdf.insert(1, "unused", "x")
    with gzip.open(folder / "train.csv.gz", "wt", encoding="utf-8", newline="") as out:
        pdf.to_csv(out, index=False)
    fx.toxigen(spark, small).write.parquet(str(folder / "ood"))
    return str(folder)


def test_csv_columns_come_by_name(spark, small, root):
    df = read_comments(spark, root)
    assert "unused" not in df.columns
    assert dict(df.dtypes)["target"] == "double"
    assert df.count() == fx.jigsaw(spark, small).count()
    expected = fx.jigsaw(spark, small).select("id", "target", "asian")
    assert df.select("id", "target", "asian").exceptAll(expected).count() == 0
    texts = load_comments(spark, root).where(F.col("comment_text") != "")
    assert texts.where(~F.col("comment_text").startswith('say "hi",\n')).count() == 0
    assert load_comments(spark, root, clean_text=False).where("comment_text is null").count() > 0


def test_split_names(root):
    assert comment_file(root, "train").endswith("train.csv.gz")
    assert comment_file(root, "test").endswith("test_private_expanded.csv.gz")
    with pytest.raises(ValueError, match="unknown split"):
        comment_file(root, "dev")


def test_ood_source_falls_back(spark, root):
    first = read_ood(spark, [f"{root}/ood"])
    assert {"text", "label"} <= set(first.columns)
    assert first.where("split <> 'test'").count() == 0
    second = read_ood(spark, [f"{root}/nothing", f"{root}/ood"])
    assert second.count() > first.count()
    assert read_ood(spark, [f"{root}/ood"], sample=5).count() == 5
    with pytest.raises(Exception, match="nothing"):
        read_ood(spark, [f"{root}/nothing"])


def test_existing_work_is_skipped(spark, root, tmp_path):
    ran = []
    assert not skip_if_done(spark, f"{root}/ood", lambda: ran.append(1))
    assert skip_if_done(spark, str(tmp_path / "new"), lambda: ran.append(2))
    assert ran == [2]


def test_children_of_a_folder(spark, root):
    entries = {r["entry"] for r in list_children(spark, root).collect()}
    assert {"train.csv.gz", "ood"} <= entries


def test_file_names():
    assert metric_file(BASELINE_MODEL) == "baseline_metrics.csv"
    assert metric_file(TUNED) == "org_tiny_finetuned_metrics.csv"
    assert metric_file(CHAT) == "org_chat_raw_metrics.csv"
    assert prediction_file(BASELINE_MODEL) == "preds_Baseline.csv"
    assert prediction_file(RAW_MODEL, True) == "preds_org_tiny_raw_ood.csv"
    assert prediction_file(CHAT) == "preds_org_chat_llama.csv"


def test_whole_pipeline(spark, root, tmp_path):
    data_dir, results = str(tmp_path / "data"), str(tmp_path / "results")
    data = run_data(spark, root, data_dir, train_n=150, eval_n=-1)
    assert (data.train.count(), data.evaluation.count()) == (150, 20)
    assert data.identities[:2] == ["asian", "atheist"]

    assert run_baseline(spark, data_dir, results).count() == 24
    made = run_models(
        spark,
        data_dir,
        results,
        {RAW_MODEL: length_model(), BROKEN: broken_model(), CHAT: yes_no_model()},
    )
    assert {r["model"] for r in made.select("model").distinct().collect()} >= {
        "org/tiny Raw",
        "org/chat Raw",
    }
    run_models(spark, data_dir, results, {TUNED: length_model()})

    found = read_metric_files(spark, results, [m.name for m in MODELS])
    assert {r["model"] for r in found.select("model").distinct().collect()} == {
        "Baseline",
        "org/tiny Raw",
        "org/tiny Finetuned",
        "org/chat Raw",
    }
    header = spark.read.option("header", True).csv(f"{results}/baseline_metrics.csv").columns
    assert header[:3] == ["Identity", "Total Examples", "1. Overall AUC"]

    ood = run_ood(spark, [f"{root}/ood"], results, {TUNED: length_model()})
    assert {r["model"] for r in ood.collect()} == {"Baseline", "org/tiny Finetuned"}
    written = spark.read.option("header", True).csv(f"{results}/ood_toxigen_metrics.csv")
    assert written.columns[:3] == ["Model", "Identity", "Total Examples"]
    assert {r["Model"] for r in written.collect()} == {"Baseline (TF-IDF + LR)", "org/tiny"}

    report = run_report(spark, results, MODELS)
    assert [r["identity"] for r in report.orderBy("ord").collect()] == data.identities
    assert "org/tiny Finetuned Subgroup AUC" in report.columns
    saved = spark.read.option("header", True).csv(f"{results}/final_report.csv")
    assert saved.count() == 24

    compiled = run_compiled_predictions(spark, data_dir, results, MODELS, [f"{root}/ood"])
    counts = compiled.groupBy("dataset").agg(
        F.count("*").alias("n"),
        F.count("Baseline").alias("baseline"),
        F.count("Raw org/tiny").alias("raw"),
        F.count("Raw org/broken").alias("broken"),
    )
    by_dataset = {r["dataset"]: r for r in counts.collect()}
    jigsaw, toxigen = by_dataset["Jigsaw"], by_dataset["ToxiGen"]
    assert (jigsaw["n"], jigsaw["baseline"], jigsaw["raw"], jigsaw["broken"]) == (20, 20, 20, 0)
    assert toxigen["n"] == toxigen["baseline"] > toxigen["raw"] == 0

    export_predictions(data.evaluation, "Jigsaw", results, [BASELINE_MODEL])
    export_predictions(read_ood(spark, [f"{root}/ood"]), "ToxiGen", results, [BASELINE_MODEL])
    outside = spark.read.option("header", True).csv(f"{results}/preds_Baseline_ood.csv")
    assert outside.columns == ["text", "toxicity_score"]
    exported = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .csv(f"{results}/preds_Baseline.csv")
    )
    assert exported.columns == ["comment_text", "toxicity_score"]
    assert exported.count() == 20
    assert read_splits(spark, data_dir).train.columns[:4] == [
        "id",
        "comment_text",
        "target",
        "is_toxic",
    ]


def test_all_models_fail_and_the_run_goes_on(spark, root, tmp_path):
    data_dir, results = str(tmp_path / "data"), str(tmp_path / "results")
    run_data(spark, root, data_dir, train_n=50, eval_n=20)
    assert run_models(spark, data_dir, results, {BROKEN: broken_model()}).count() == 0


def test_newest_checkpoint_is_scored_once(spark, root, tmp_path):
    data_dir, results = str(tmp_path / "data"), str(tmp_path / "results")
    run_data(spark, root, data_dir, train_n=50, eval_n=20)
    for step in (5, 40):
        folder = tmp_path / "model" / f"checkpoint-{step}"
        folder.mkdir(parents=True)
        (folder / "weights").write_text("w")
    loaded = []

    def load(path):
        loaded.append(path)
        return length_model()

    folders = {TUNED: str(tmp_path / "model"), BROKEN: str(tmp_path / "nothing")}
    assert run_finetuned(spark, data_dir, results, folders, load).count() == 24
    assert run_finetuned(spark, data_dir, results, folders, load).count() == 0
    assert [path.rsplit("/", 1)[-1] for path in loaded] == ["checkpoint-40"]


def test_compiled_table_without_out_of_domain_source(spark, root, tmp_path):
    data_dir, results = str(tmp_path / "data"), str(tmp_path / "results")
    run_data(spark, root, data_dir, train_n=50, eval_n=20)
    run_models(spark, data_dir, results, {TUNED: length_model()})
    compiled = run_compiled_predictions(spark, data_dir, results, [TUNED], [f"{root}/gone"])
    assert {r["dataset"] for r in compiled.collect()} == {"Jigsaw"}


def test_ids_of_a_table_without_them_stay(spark, root, tmp_path):
    path = str(tmp_path / "plain")
    spark.read.parquet(f"{root}/ood").drop("id").repartition(3).write.parquet(path)
    first = read_ood(spark, [path])
    assert first.select("id").distinct().count() == first.count() > 0
    again = read_ood(spark, [path]).select("id", F.col("text").alias("again"))
    assert first.join(again, "id").where("text = again").count() == first.count()
    assert read_ood(spark, [path], sample=1).count() == 1


def test_ids_of_a_table_without_them_outlive_a_move(spark, root, tmp_path):
    first, second = (str(tmp_path / name / "part of it") for name in ("here", "there"))
    rows = spark.read.parquet(f"{root}/ood").drop("id").withColumn("half", F.col("generation") > "m")
    rows.repartition(3).write.partitionBy("half").parquet(first)
    shutil.copytree(first, second)
    ids = [
        {(r["id"], r["text"]) for r in read_ood(spark, [path]).collect()}
        for path in (first, f"{second}/")
    ]
    assert ids[0] == ids[1] and len({i for i, _ in ids[0]}) == len(ids[0])


def test_files_have_numbers_of_their_own(spark):
    paths = spark.range(200_000).selectExpr("concat('day=', id % 977, '/part-', id) AS path")
    numbers = file_numbers(paths.union(paths))
    found = numbers.agg(
        F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.max("number").alias("m")
    ).first()
    assert tuple(found) == (200_000, 200_000, 199_999)
    assert numbers.exceptAll(file_numbers(paths.orderBy("path"))).count() == 0


def write_comments(tmp_path, lines):
    with gzip.open(tmp_path / "train.csv.gz", "wt", encoding="utf-8") as file:
        file.write("\n".join(["id,target,comment_text,asian", *lines]) + "\n")


def test_malformed_comments(spark, tmp_path):
    lines = [
        '1,0.5,"two\nlines, ""quoted""",0.25',
        "2,n/a,plain,NaN",
        "3,0.5.1,two wrong,x",
        "4,0.5",
        '5,1e-1,"odd" quotes" here,',
        "six,0.1,no id,0",
        "7,0.2,too many,0.1,0.2,0.3",
        "8, 0.75 ,blanks,1",
    ]
    write_comments(tmp_path, lines)
    comments = parse_comments(spark, str(tmp_path))
    rows = {r["id"]: tuple(r)[1:] for r in comments.rows.collect()}
    assert rows.keys() == {1, 2, 5, 8}
    assert rows[1] == ('two\nlines, "quoted"', 0.5, 0.25)
    assert rows[2] == ("plain", None, None)
    assert rows[5][1:] == (0.1, None) and rows[8][1:] == (0.75, 1.0)
    bad = {tuple(r)[1:] for r in comments.quarantine.collect()}
    assert bad == {
        (2, "3", "target", "0.5.1"), (2, "3", "asian", "x"), (5, "six", "id", "six"),
        (3, "4", None, "4,0.5"), (6, "7", None, "7,0.2,too many,0.1,0.2,0.3"),
    }
    with pytest.raises(ValueError, match="4 of 8 comments are malformed.*'record': 2"):
        read_comments(spark, str(tmp_path))
    assert read_comments(spark, str(tmp_path), tolerated=0.5).count() == 4


def counting_model(log, poison=None):
    """Length logits; writes down how many texts it has seen, and fails at ``poison`` unless
    the log says it has failed before."""

    def make():
        import os

        inner = length_model()()

        def predict(texts):
            if poison in texts.ravel() and not os.path.exists(f"{log}.failed"):
                open(f"{log}.failed", "w").close()
                raise RuntimeError("lost")
            with open(log, "a") as out:
                out.write(f"{len(texts)}\n")
            return inner(texts)

        return predict

    return make


def test_a_lost_scoring_job_goes_on_with_the_rest(spark, tmp_path):
    results, log = str(tmp_path / "results"), str(tmp_path / "log")
    df = spark.range(400).selectExpr("id", "concat('text ', repeat('x', int(id % 50))) AS comment_text")
    df = df.withColumn("comment_text", F.when(F.col("id") == 123, "poison").otherwise(F.col("comment_text")))
    model = {RAW_MODEL: counting_model(log, "poison")}

    def seen():
        return sum(map(int, open(log).read().split()))

    def scores():
        return read_predictions(spark, f"{results}/predictions")

    assert write_model_scores(df, "Jigsaw", model, results, rows_per_fragment=50) == []
    first, committed = seen(), scores().count()
    assert 0 < committed < 400 and committed <= first
    assert write_model_scores(df, "Jigsaw", model, results, rows_per_fragment=50) == [RAW_MODEL]
    # Only what was not committed is scored by the second call.
    assert seen() - first == 400 - committed
    assert scores().count() == scores().select("id").distinct().count() == 400
    # Rows whose manifest entry was lost are not scored twice.
    manifest = f"{results}/manifest/Jigsaw/{safe_name(RAW_MODEL.key)}"
    spark.createDataFrame([(-1, 8), *[(k, 8) for k in range(5)]], "fragment int, fragments int").write.mode(
        "overwrite"
    ).parquet(manifest)
    before = seen()
    assert write_model_scores(df, "Jigsaw", model, results, rows_per_fragment=50) == [RAW_MODEL]
    assert seen() == before and scores().count() == 400
    # A finished model starts over, and other rows are landed anew.
    fewer = df.where("id < 300")
    assert write_model_scores(fewer, "Jigsaw", model, results, rows_per_fragment=50) == [RAW_MODEL]
    assert scores().count() == 300


def test_two_predictions_for_a_text_are_not_exported(spark, tmp_path):
    results = str(tmp_path / "results")
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, comment_text string")
    rows = [("Jigsaw", RAW_MODEL.key, i, 0.5) for i in (1, 2, 2)]
    rows += [("Jigsaw", TUNED.key, i, 0.5) for i in (1, 2)]
    schema = "dataset string, model string, id long, score double"
    write_predictions(spark.createDataFrame(rows, schema), f"{results}/predictions")
    export_predictions(texts, "Jigsaw", results, [RAW_MODEL, TUNED])
    found = {r["entry"] for r in list_children(spark, results).collect()}
    assert found == {"predictions", prediction_file(TUNED)}


def test_out_of_domain_without_a_working_model(spark, root, tmp_path):
    results = str(tmp_path / "results")
    found = run_ood(spark, [f"{root}/ood"], results, {BROKEN: broken_model()})
    assert found.count() == 0 and "overall_auc" in found.columns


def test_metric_files_are_one_scan(spark, tmp_path):
    """Quoted names, columns in another order, missing ones, parts, and other files."""
    folder = tmp_path / "results"
    (folder / "b_raw_metrics.csv").mkdir(parents=True)
    header = "Identity,Total Examples,1. Overall AUC\n"
    (folder / "a_raw_metrics.csv").write_text(header + '"x, ""y""",3,0.5\nz,,\n')
    (folder / "b_raw_metrics.csv" / "part-0.csv").write_text("1. Overall AUC,Identity\n0.25,x\n")
    (folder / "b_raw_metrics.csv" / "part-1.csv").write_text("1. Overall AUC,Identity\n0.75,z\n")
    (folder / "final_report.csv").write_text("no,metrics\n1,2\n")
    found = read_metric_files(spark, str(folder), ["a", "b"])
    rows = [tuple(r)[:5] for r in found.orderBy("model", "ord").collect()]
    assert rows == [
        ("a Raw", 0, 'x, "y"', 3, 0.5), ("a Raw", 1, "z", None, None),
        ("b Raw", 0, "x", None, 0.25), ("b Raw", 1, "z", None, 0.75),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    assert read_metric_files(spark, str(tmp_path / "nothing"), ["a"]).count() == 0


def test_report_of_an_empty_folder_is_empty(spark, tmp_path):
    assert run_report(spark, str(tmp_path), MODELS).count() == 0
