"""What the physical plans must look like to hold at scale."""

import re

from pyspark.sql import functions as F

from paritas.checks import fixtures as fx
from paritas.checks.queries import QUERIES
from paritas.operators import split
from paritas.operators.prepare import prepare_comments
from paritas.operators.report import compile_predictions, prediction_count_gate
from paritas.operators.terms import document_terms, document_tokens
from paritas.sources.results import read_predictions, write_predictions
from paritas.sources.splits import write_bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_never_read_texts_or_scan_twice(spark, small):
    text = plan(QUERIES["bias_metrics"](spark, small))
    assert "text:string" not in text
    scans = re.findall(r"FileScan parquet.*?Location: \S+\[\S*/(\w+)\.parquet\]", text)
    # Labels and predictions for the metrics; labels to count them, and predictions for
    # the cut points.
    assert scans.count("documents") <= 4


def test_metrics_join_on_the_id_once(spark, small):
    for name in ("bias_metrics", "incomplete_predictions_metrics"):
        text = plan(QUERIES[name](spark, small))
        assert len(re.findall(r"Join \[id#\d+L?\], \[id#\d+L?\]", text)) == 1
        # The fingerprint goes through the one aggregate, which hashes ids of the whole.
        assert re.search(r"HashAggregate\([^\n]*partial_bit_xor\([^\n]*xxhash64\(id", text)


def test_metrics_have_no_window_over_everything(spark, small):
    text = plan(QUERIES["bias_metrics"](spark, small))
    windows = re.findall(r"windowspecdefinition\(([^)]*)", text)
    assert windows
    assert all("unit" in w for w in windows)
    # Single partitions merge quantile sketches, or count the labelled rows.
    assert all(
        "kll_merge_agg_double" in before or "bit_xor(xxhash64(id" in before
        for before in re.findall(r"([^\n]*)\n[^\n]*Exchange SinglePartition", text)
    )


def test_metric_shuffles_do_not_carry_model_names(spark, small):
    text = plan(QUERIES["bias_metrics"](spark, small))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert any("range" in k for k in keys)
    assert not any("model" in k or "dataset" in k for k in keys)


def test_split_does_not_shuffle_the_rows(spark, small):
    df = fx.table(spark, small, "documents").withColumnRenamed("doc_id", "id")
    text = plan(split.split_train_eval(df))
    main = text.split("Subquery")[0]
    assert "Exchange" not in main
    assert "Window" not in main
    # Texts are read once, for the result; locating the limit reads ids only.
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert len(schemas) == 2
    assert "doc_id:bigint" in schemas


def test_terms_of_a_document_need_no_shuffle(spark, small):
    df = fx.table(spark, small, "documents").withColumnRenamed("doc_id", "id")
    text = plan(document_terms(document_tokens(df)))
    assert "Exchange" not in text
    # Tokens are computed once and not again for each of their uses.
    assert text.count("regexp_extract_all") == 1


def test_columns_reach_the_scan(spark, small, tmp_path):
    path = str(tmp_path / "comments")
    prepare_comments(fx.jigsaw(spark, small)).write.parquet(path)
    text = plan(prepare_comments(spark.read.parquet(path)).select("id", "is_toxic"))
    assert "ReadSchema: struct<id:bigint,target:double>" in text


def test_saved_split_reads_its_folder_only(spark, small, tmp_path):
    path = str(tmp_path / "splits")
    split.split_train_eval(fx.jigsaw(spark, small)).write.partitionBy("split").parquet(path)
    train = spark.read.parquet(path).where(F.col("split") == "train")
    pruned = r"PartitionFilters: \[isnotnull\(split#\d+\), \(split#\d+ = train\)\]"
    assert re.search(pruned, plan(train))


def test_bucketed_texts_are_not_shuffled_for_the_compiled_table(spark, small, tmp_path):
    texts = prepare_comments(fx.jigsaw(spark, small)).selectExpr(
        "id", "comment_text AS sentence", "is_toxic AS true_label"
    )
    write_bucketed(texts, "bucketed_texts", str(tmp_path / "bucketed"), 8)
    predictions_path = str(tmp_path / "predictions")
    write_predictions(fx.scores(spark, small), predictions_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compiled = compile_predictions(
            {fx.DATASET: spark.table("bucketed_texts")},
            read_predictions(spark, predictions_path),
            fx.REGISTRY,
        )
        text = plan(compiled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_texts")
    join = text[text.index("SortMergeJoin") :]
    left = join[: join.index("Exchange hashpartitioning(id")]
    assert "bucketed_texts" in left or "sentence:string" in left
    assert "Bucketed: true" in join


def test_counting_predictions_reads_no_column(spark, small, tmp_path):
    path = str(tmp_path / "predictions")
    write_predictions(fx.scores(spark, small), path)
    gate = prediction_count_gate(
        {fx.DATASET: fx.table(spark, small, "documents")},
        read_predictions(spark, path),
        fx.MODEL_KEYS,
    )
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(gate))) == {""}
