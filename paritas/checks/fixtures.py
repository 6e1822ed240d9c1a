"""Input tables of the checked queries, derived from the given Parquet tables.

``FIXTURES.md`` lists the formulas. Each is written here as a projection over the
whole of its source tables; :mod:`paritas.checks.oracle` states them as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.catalogue import BASELINE, FINETUNED, IDENTITY_COLUMNS, RAW, ZERO_SHOT, ModelSpec
from paritas.operators.ood import test_split
from paritas.sources.tables import read_table

DATASET, OOD_DATASET = "Jigsaw", "ToxiGen"

# Three models with scores in the ``scores`` view, and one that has no predictions.
REGISTRY = (
    ModelSpec("Baseline", BASELINE),
    ModelSpec("tiny-a", RAW),
    ModelSpec("tiny-b", FINETUNED),
    ModelSpec("org/chat", ZERO_SHOT),
)
MODEL_KEYS = tuple(model.key for model in REGISTRY)
SCORED_MODELS = MODEL_KEYS[:3]


# Declared, so that no job has to look a schema up.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def _documents_with_labels(
    spark: SparkSession, sf_dir: str, how: str, spread_texts: bool = False
) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    if spread_texts:  # by the key they are joined on, so that costly work has all cores
        documents = documents.repartition("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return documents.join(labels, "doc_id", how)


def _identity(k: int, name: str) -> str:
    score = (
        f"CAST(IF((doc_id * 7 + {k}) % {k + 2} = 0, 50, 0) + (doc_id * 13 + {k}) % 51"
        " AS DOUBLE) / 100"
    )
    if name == "other_disability":
        score = "0D"
    elif name == "hindu":
        score = f"IF(toxic = 0, {score}, 0D)"
    return f"IF((doc_id + {k}) % 11 <> 0, {score}, NULL) AS {name}"


def jigsaw(spark: SparkSession, sf_dir: str, spread_texts: bool = False) -> DataFrame:
    """Raw comments: null texts and targets, boundary values, 24 identities."""
    return _documents_with_labels(spark, sf_dir, "left", spread_texts).selectExpr(
        "doc_id AS id",
        "IF(doc_id % 50 <> 7, text, NULL) AS comment_text",
        "CAST(toxic * 50 + (doc_id * 37) % 50 AS DOUBLE) / 100 AS target",
        *[_identity(k, name) for k, name in enumerate(IDENTITY_COLUMNS)],
    )


def scores(spark: SparkSession, sf_dir: str, dataset: str = DATASET) -> DataFrame:
    """(dataset, model, id, score) of three models with different skill."""
    points = (
        "coalesce(toxic, 0) * 40 + (doc_id * 7919) % 61",
        "coalesce(toxic, 0) * 15 + (doc_id * 104729) % 86",
        "(doc_id * 611953) % 101",
    )
    entries = ", ".join(
        f"struct('{dataset}' AS dataset, '{model}' AS model, doc_id AS id,"
        f" CAST({p} AS DOUBLE) / 100 AS score)"
        for model, p in zip(SCORED_MODELS, points, strict=True)
    )
    return _documents_with_labels(spark, sf_dir, "left").selectExpr(f"inline(array({entries}))")


def toxigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-domain table: other column names, messy group field, own split."""
    doc = F.col("doc_id")
    by_residue = (
        "['black', 'women']",
        "asian, latino",
        "none",
        None,
        "[broken]",
        "Black",
        "jewish, , Unknown,jewish",
        "[]",
    )
    spellings = F.array(*[F.lit(v) for v in by_residue])
    return _documents_with_labels(spark, sf_dir, "inner").select(
        doc.alias("id"),
        F.col("text").alias("generation"),
        F.get(spellings, (doc % 8).cast("int")).alias("target_group"),
        ((10 + F.col("toxic") * 15 + (doc * 37) % 21).cast("double") / 10).alias(
            "toxicity_human"
        ),
        F.when(doc % 4 != 1, "test").otherwise("train").alias("split"),
    )


def ood_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for the out-of-domain test rows; the fine-tuned model was run on
    the unfiltered table, so that its count does not match."""
    rows = toxigen(spark, sf_dir).select("id", "split")
    made = scores(spark, sf_dir, OOD_DATASET)
    partial = F.col("model") == SCORED_MODELS[2]
    on_test = made.where(~partial).join(test_split(rows).select("id"), "id", "left_semi")
    on_all = made.where(partial).join(rows.select("id"), "id", "left_semi")
    return on_test.unionByName(on_all)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two class logits per row, and the whole vector they are taken from."""
    vector = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.slice(vector, 1, 2).alias("logits"),
        vector.alias("vocabulary_logits"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.col("label").alias("group"),
    )


def result_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as they occur in a results folder, one per document."""
    source = F.concat(F.lit("org_"), F.col("source"))
    kinds = F.array(
        F.lit("baseline_metrics.csv"),
        F.concat(source, F.lit("_raw_metrics.csv")),
        F.concat(source, F.lit("_finetuned_metrics.csv")),
        F.lit("final_report.csv"),
        F.lit("ood_toxigen_metrics.csv"),
        F.concat(F.lit("preds_"), source, F.lit("_raw.csv")),
    )
    return table(spark, sf_dir, "documents").select(
        F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("file")
    )


def model_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, entry): model folders with checkpoints, some with a final model."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "lang", "source").alias("folder"),
        F.when((F.col("lang") == "de") & (doc % 7 == 0), F.lit("config.json"))
        .when(doc % 11 == 0, F.lit("runs"))
        .otherwise(F.concat(F.lit("checkpoint-"), doc.cast("string")))
        .alias("entry"),
    )
