"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.catalogue import IDENTITY_COLUMNS, METRIC_HEADERS
from paritas.checks import fixtures as fx
from paritas.checks.stubs import length_model, yes_no_model
from paritas.functions.scores import (
    logits_to_score,
    sigmoid,
    softmax_of_two,
    zero_shot_score,
)
from paritas.functions.text import tokenize, without_stop_words, zero_shot_prompt
from paritas.functions.values import binary_prediction
from paritas.operators import classifier, metrics, ood, ordering, prepare, report, split, terms
from paritas.operators.scoring import score_texts, score_zero_shot
from paritas.plans import evaluation
from paritas.plans.candidates import candidate_metrics
from paritas.plans.epochs import epoch_ranking, run_epochs
from paritas.session import scratch_path, written
from paritas.sources import comments as comment_source
from paritas.sources import models as model_source
from paritas.sources import results as result_source
from paritas.sources import splits as split_source

Query = Callable[[SparkSession, str], DataFrame]

IDENTITIES = list(IDENTITY_COLUMNS)
REGISTERED = [(fx.DATASET, key) for key in fx.MODEL_KEYS]
TRAIN_N, EVAL_N, TRUNCATED, SAMPLE = 500, 60, 700, 100
OTHER_SEED = 7

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    return query_as(function.__name__)(function)


def query_as(name: str) -> Callable[[Query], Query]:
    """Register a query under a name that is taken by an operator here."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _prepared(spark: SparkSession, sf_dir: str, spread_texts: bool = False) -> DataFrame:
    return prepare.prepare_comments(fx.jigsaw(spark, sf_dir, spread_texts))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.attach_predictions(_prepared(spark, sf_dir), fx.scores(spark, sf_dir))


def _named(df: DataFrame) -> DataFrame:
    """Replace group positions by identity names; null is the whole table."""
    names = prepare.text_array(IDENTITIES)
    rest = [c for c in df.columns if c != metrics.GROUP]
    return df.select(F.get(names, F.col(metrics.GROUP)).alias("identity"), *rest)


def _rounded(column: Column, name: str) -> Column:
    return F.round(column, 6).alias(name)


# --- preparation ---


@query
def prep_binarize_target(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", "target", "is_toxic")


@query
def prep_clean_text(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", "comment_text")


@query
def prep_identity_fill(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", *IDENTITIES)


@query
def prep_full(spark, sf_dir):
    return _prepared(spark, sf_dir)


@query
def prep_keep_null_text(spark, sf_dir):
    return prepare.prepare_comments(fx.jigsaw(spark, sf_dir), clean_text=False)


@query
def subgroup_membership(spark, sf_dir):
    return prepare.subgroup_members(_prepared(spark, sf_dir))


@query
def identity_unpivot(spark, sf_dir):
    return prepare.identity_scores(fx.jigsaw(spark, sf_dir))


@query
def binarize_scores(spark, sf_dir):
    return fx.scores(spark, sf_dir).select(
        "dataset", "model", "id", binary_prediction(F.col("score")).alias("prediction")
    )


# --- order, splits, samples ---


@query
def seeded_shuffle_rank(spark, sf_dir):
    return ordering.with_shuffle_position(_prepared(spark, sf_dir).select("id"))


@query
def split_90_10(spark, sf_dir):
    return split.split_train_eval(_prepared(spark, sf_dir)).select("id", "split")


@query
def split_counts(spark, sf_dir):
    return split.split_counts(split.split_train_eval(_prepared(spark, sf_dir)))


def _slice(spark, sf_dir, name, train_n=TRAIN_N, eval_n=EVAL_N):
    slices = split.train_eval_slices(_prepared(spark, sf_dir), train_n, eval_n)
    return slices.where(F.col("split") == name).select("id", "is_toxic")


@query
def slice_train(spark, sf_dir):
    return _slice(spark, sf_dir, "train")


@query
def slice_eval(spark, sf_dir):
    return _slice(spark, sf_dir, "eval")


@query
def slice_train_all(spark, sf_dir):
    return _slice(spark, sf_dir, "train", train_n=0, eval_n=-1)


@query
def truncate_then_split(spark, sf_dir):
    return split.truncate_then_split(_prepared(spark, sf_dir), TRUNCATED, seed=OTHER_SEED).select(
        "id", "split"
    )


@query
def ood_sample(spark, sf_dir):
    return split.sample_rows(fx.toxigen(spark, sf_dir), SAMPLE).select("id", "target_group")


@query
def split_leakage(spark, sf_dir):
    prepared = _prepared(spark, sf_dir).select("id")
    other = split.truncate_then_split(prepared, -1, seed=OTHER_SEED)
    train = other.where(F.col("split") == "train")
    evaluation = split.split_train_eval(prepared).where(F.col("split") == "eval")
    return split.split_leakage(train, evaluation)


# --- metrics ---


@query
def confusion_counts(spark, sf_dir):
    return _named(metrics.confusion_counts(_scored(spark, sf_dir)))


def _whole(df: DataFrame) -> DataFrame:
    return df.where(F.col(metrics.GROUP).isNull())


def _parts(df: DataFrame) -> DataFrame:
    return df.where(F.col(metrics.GROUP).isNotNull())


def _whole_only(scored: DataFrame) -> DataFrame:
    """Scored rows without groups, when only the whole table is asked about."""
    return scored.withColumn("groups", F.array().cast("array<int>"))


@query
def overall_fnr(spark, sf_dir):
    rates = metrics.confusion_rates(metrics.confusion_counts(_whole_only(_scored(spark, sf_dir))))
    return _whole(rates).select("dataset", "model", "fnr")


@query
def overall_fpr(spark, sf_dir):
    rates = metrics.confusion_rates(metrics.confusion_counts(_whole_only(_scored(spark, sf_dir))))
    return _whole(rates).select("dataset", "model", "fpr")


def _located(spark, sf_dir):
    """Scores and scored rows with a model's number in place of its names."""
    keys = ["dataset", "model"]
    return metrics.located(fx.scores(spark, sf_dir), REGISTERED, keys)


def _group_auc(spark, sf_dir, whole_only=False):
    scores = _located(spark, sf_dir)
    scored = metrics.attach_predictions(_prepared(spark, sf_dir), scores)
    if whole_only:
        scored = _whole_only(scored)
    auc = metrics.group_auc(scored, ["unit"], scores=scores)
    return metrics.named_units(auc, REGISTERED, ["dataset", "model"])


@query
def overall_auc(spark, sf_dir):
    return _whole(_group_auc(spark, sf_dir, True)).select("dataset", "model", "auc")


@query
def subgroup_auc(spark, sf_dir):
    return _named(_parts(_group_auc(spark, sf_dir))).select("dataset", "model", "identity", "auc")


@query
def subgroup_rates(spark, sf_dir):
    rates = metrics.confusion_rates(metrics.confusion_counts(_scored(spark, sf_dir)))
    return _named(_parts(rates)).select("dataset", "model", "identity", "fnr", "fpr")


@query
def subgroup_sizes(spark, sf_dir):
    return _named(metrics.group_sizes(_scored(spark, sf_dir)))


@query
def auc_prefix_counts(spark, sf_dir):
    scores = _located(spark, sf_dir)
    scored = metrics.attach_predictions(_prepared(spark, sf_dir), scores)
    counts = metrics.score_prefix_counts(scored, ["unit"], scores=scores)
    return _named(metrics.named_units(counts, REGISTERED, ["dataset", "model"]))


@query
def bias_metrics(spark, sf_dir):
    return metrics.evaluate_predictions(
        _prepared(spark, sf_dir), fx.scores(spark, sf_dir), REGISTERED, IDENTITIES
    )


def _incomplete(spark, sf_dir):
    """The second model lacks rows; the third has two predictions for some and none for
    as many others."""
    rows = fx.scores(spark, sf_dir)
    second, third = (F.col("model") == name for name in fx.SCORED_MODELS[1:])
    moved = F.when(third & (F.col("id") % 10 == 3), F.col("id") - 1).otherwise(F.col("id"))
    return rows.where(~(second & (F.col("id") % 10 == 3))).withColumn("id", moved)


@query
def incomplete_predictions_metrics(spark, sf_dir):
    return metrics.evaluate_predictions(
        _prepared(spark, sf_dir), _incomplete(spark, sf_dir), REGISTERED, IDENTITIES
    )


@query
def empty_identity_rows(spark, sf_dir):
    return bias_metrics(spark, sf_dir).where(F.col("total_examples") == 0)


@query
def metrics_flat(spark, sf_dir):
    return metrics.flat_metrics(bias_metrics(spark, sf_dir))


@query
def best_run(spark, sf_dir):
    return metrics.best_run(bias_metrics(spark, sf_dir).where(F.col("ord") == 0))


@query
def bias_gap(spark, sf_dir):
    return report.bias_gaps(bias_metrics(spark, sf_dir))


# --- out of domain ---


@query
def ood_test_filter(spark, sf_dir):
    return ood.test_split(fx.toxigen(spark, sf_dir)).select("id", "split")


def _labelled_by(spark, sf_dir, name, value):
    table = fx.toxigen(spark, sf_dir).withColumn(name, value).drop("toxicity_human")
    return ood.with_label(table).select("id", "label")


@query
def ood_label_human(spark, sf_dir):
    return ood.with_label(fx.toxigen(spark, sf_dir)).select("id", "label")


@query
def ood_label_as_is(spark, sf_dir):
    rating = (F.col("toxicity_human") > 2).cast("int")
    return _labelled_by(spark, sf_dir, "toxicity_human_annotated", rating)


@query
def ood_label_score(spark, sf_dir):
    return _labelled_by(spark, sf_dir, "toxicity_score", F.col("toxicity_human") / 5)


@query
def ood_label_classifier(spark, sf_dir):
    return _labelled_by(
        spark, sf_dir, "roberta_prediction", (F.col("toxicity_human") / 5).cast("string")
    )


@query
def ood_text_column(spark, sf_dir):
    return ood.with_text(fx.toxigen(spark, sf_dir)).select(
        "id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars")
    )


def _grouped(spark, sf_dir, test_only=False):
    table = fx.toxigen(spark, sf_dir)
    if test_only:
        table = ood.test_split(table)
    return ood.with_groups(ood.with_label(table))


@query
def ood_parse_groups(spark, sf_dir):
    return _grouped(spark, sf_dir).select(
        "id",
        F.array_join(F.array_sort("groups"), "|").alias("groups"),
        F.size("groups").alias("n_groups"),
    )


@query
def ood_group_membership(spark, sf_dir):
    return ood.group_members(_grouped(spark, sf_dir))


@query
def ood_group_catalog(spark, sf_dir):
    return ood.group_catalogue(_grouped(spark, sf_dir))


def _ood_metrics(spark, sf_dir, labelled):
    return ood.ood_bias_metrics(
        labelled, fx.scores(spark, sf_dir, fx.OOD_DATASET), fx.SCORED_MODELS
    )


@query
def ood_bias_metrics(spark, sf_dir):
    return _ood_metrics(spark, sf_dir, _grouped(spark, sf_dir, test_only=True))


@query
def ood_bias_metrics_unfiltered(spark, sf_dir):
    return _ood_metrics(spark, sf_dir, _grouped(spark, sf_dir))


@query
def ood_bias_metrics_without_id(spark, sf_dir):
    """The table loses its id; labels, predictions and groups meet by the made one."""
    root = scratch_path(spark, "ood")
    table = fx.toxigen(spark, sf_dir)
    scores = fx.scores(spark, sf_dir, fx.OOD_DATASET)
    wide = scores.groupBy("id").agg(
        *[
            F.max(F.when(F.col("model") == name, F.col("score"))).alias(f"s{i}")
            for i, name in enumerate(fx.SCORED_MODELS)
        ]
    )
    table.join(wide, "id").drop("id").write.parquet(root)
    rows = ood.with_groups(comment_source.read_ood(spark, [root]))
    predictions = rows.select(
        "id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("model"), F.col(f"s{i}").alias("score"))
                    for i, name in enumerate(fx.SCORED_MODELS)
                ]
            )
        ),
    )
    again = ood.with_groups(comment_source.read_ood(spark, [root]))
    measured = ood.ood_bias_metrics(again, predictions, fx.SCORED_MODELS)
    return measured.drop("first_row", "first_place")


@query
def ood_no_groups(spark, sf_dir):
    """No value of the group field names a group: one placeholder per model."""
    table = fx.toxigen(spark, sf_dir).withColumn("target_group", F.lit("none, Unknown"))
    return _ood_metrics(spark, sf_dir, ood.with_groups(ood.with_label(table)))


# --- report ---


def _report(spark, sf_dir):
    return report.final_report(bias_metrics(spark, sf_dir), fx.MODEL_KEYS)


@query
def final_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query
def report_overall_auc(spark, sf_dir):
    return report.report_section(_report(spark, sf_dir), "overall_auc", fx.MODEL_KEYS)


@query
def report_subgroup_auc(spark, sf_dir):
    return report.report_section(_report(spark, sf_dir), "subgroup_auc", fx.MODEL_KEYS)


@query
def report_fnr(spark, sf_dir):
    return report.report_section(_report(spark, sf_dir), "fnr", fx.MODEL_KEYS)


@query
def report_fpr(spark, sf_dir):
    return report.report_section(_report(spark, sf_dir), "fpr", fx.MODEL_KEYS)


def _prediction_base(spark, sf_dir):
    test = ood.with_text(ood.with_label(ood.test_split(fx.toxigen(spark, sf_dir))))
    return {
        fx.DATASET: _prepared(spark, sf_dir).select(
            "id", F.col("comment_text").alias("sentence"), F.col("is_toxic").alias("true_label")
        ),
        fx.OOD_DATASET: test.select(
            "id", F.col("text").alias("sentence"), F.col("label").alias("true_label")
        ),
    }


def _all_predictions(spark, sf_dir):
    return fx.scores(spark, sf_dir).unionByName(fx.ood_predictions(spark, sf_dir))


@query
def prediction_count_gate(spark, sf_dir):
    return report.prediction_count_gate(
        _prediction_base(spark, sf_dir), _all_predictions(spark, sf_dir), fx.MODEL_KEYS
    )


@query
def final_predictions(spark, sf_dir):
    return report.compile_predictions(
        _prediction_base(spark, sf_dir), _all_predictions(spark, sf_dir), fx.REGISTRY
    )


DISPLAYED = tuple(f"org/src{i}" for i in range(10))


@query
def model_display_names(spark, sf_dir):
    names = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("org_"), F.col("source")).alias("safe_name")
    )
    return report.with_display_names(names, DISPLAYED)


@query
def result_file_names(spark, sf_dir):
    return report.result_files(fx.result_listing(spark, sf_dir))


@query
def latest_checkpoint(spark, sf_dir):
    return model_source.model_paths(fx.model_listing(spark, sf_dir))


# --- model outputs ---


@query
def softmax_two_class(spark, sf_dir):
    pair = F.col("logits")
    score = softmax_of_two(F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))
    return fx.logits(spark, sf_dir).select("id", _rounded(score, "score"))


@query
def sigmoid_one_logit(spark, sf_dir):
    score = sigmoid(F.get(F.col("logits"), F.lit(0)))
    return fx.logits(spark, sf_dir).select("id", _rounded(score, "score"))


@query_as("logits_to_score")
def logits_to_score_by_size(spark, sf_dir):
    """Two logits for odd ids and a single one for even ids, in one column."""
    length = F.when(F.col("id") % 2 == 1, 2).otherwise(1)
    logits = F.slice(F.col("vocabulary_logits"), F.lit(1), length)
    return fx.logits(spark, sf_dir).select("id", _rounded(logits_to_score(logits), "score"))


YES_ENTRY, NO_ENTRY = 7, 3


@query_as("zero_shot_score")
def zero_shot_score_from_vocabulary(spark, sf_dir):
    score = zero_shot_score(F.col("vocabulary_logits"), YES_ENTRY, NO_ENTRY)
    return fx.logits(spark, sf_dir).select("id", _rounded(score, "score"))


@query_as("zero_shot_prompt")
def zero_shot_prompts(spark, sf_dir):
    prompt = zero_shot_prompt(F.col("comment_text"))
    return _prepared(spark, sf_dir).select(
        "id", F.md5(prompt).alias("digest"), F.length(prompt).cast("bigint").alias("n_chars")
    )


# --- text ---


def _texts(spark, sf_dir):
    prepared = _prepared(spark, sf_dir, spread_texts=True)
    return prepared.select("id", F.col("comment_text").alias("text"))


def _token_digest(spark, sf_dir, tokens):
    return _texts(spark, sf_dir).select("id", tokens.alias("tokens")).select(
        "id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query_as("tokenize")
def tokenized(spark, sf_dir):
    return _token_digest(spark, sf_dir, tokenize(F.col("text")))


@query_as("tokenize_no_stopwords")
def tokenized_no_stopwords(spark, sf_dir):
    return _token_digest(spark, sf_dir, without_stop_words(tokenize(F.col("text"))))


def _statistics(spark, sf_dir):
    return terms.term_statistics(terms.document_tokens(_texts(spark, sf_dir)))


@query
def vocabulary_topk(spark, sf_dir):
    return terms.vocabulary(_statistics(spark, sf_dir), classifier.VOCABULARY_SIZE).select(
        "term", "tf"
    )


@query
def vocabulary_sketched(spark, sf_dir):
    """The same terms by a sample, exact counts of likely terms, and buckets of the rest."""
    tokens = terms.document_tokens(_texts(spark, sf_dir))
    kept = terms.corpus_vocabulary(tokens, classifier.VOCABULARY_SIZE, sketched=True)
    return kept.select("term", "tf")


@query
def tfidf_idf(spark, sf_dir):
    kept = terms.vocabulary(_statistics(spark, sf_dir), classifier.VOCABULARY_SIZE)
    weighted = terms.with_idf(kept, _texts(spark, sf_dir))
    return weighted.select("term", "tf", "df", _rounded(F.col("idf"), "idf"))


@query
def term_counts(spark, sf_dir):
    kept = terms.vocabulary(_statistics(spark, sf_dir), classifier.VOCABULARY_SIZE)
    tokens = terms.document_tokens(_texts(spark, sf_dir))
    return terms.term_counts(tokens, kept)


@query
def tfidf_weights(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    stages = classifier.tfidf_stages(texts, "text")
    weights = classifier.tfidf_weights(texts, stages)
    return weights.select("id", "term", _rounded(F.col("weight"), "weight"))


@query
def balanced_class_weights(spark, sf_dir):
    return classifier.balanced_class_weights(_prepared(spark, sf_dir))


# --- models ---


@cache
def _baseline_paths(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Saved splits and pipeline of the baseline, made once per session and input."""
    data, model = scratch_path(spark, "data"), scratch_path(spark, "baseline")
    split_source.write_splits(split.train_eval_slices(_prepared(spark, sf_dir, True), -1, -1), data)
    trained = classifier.train_baseline(split_source.read_splits(spark, data).train)
    model_source.save_pipeline(trained, model)
    return data, model


def _baseline(spark, sf_dir):
    data, model = _baseline_paths(spark, sf_dir)
    return split_source.read_splits(spark, data), model_source.load_pipeline(spark, model)


# The largest entry the gradient of the summed loss may have at the solution, as a share
# of the rows it is summed over. The fit ends when the loss changes by a millionth, and
# near its least value a loss changes with the square of the gradient.
GRADIENT_SHARE = 1e-3


def _coefficients(spark, model):
    """(term, coefficient) of a pipeline's logistic regression; as many as the vocabulary."""
    values = model.stages[-1].coefficients.toArray().tolist()
    rows = list(zip(classifier.model_vocabulary(model.stages), values, strict=True))
    return spark.createDataFrame(rows, "term string, coefficient double")


def _residuals(train, model, counts):
    """Training rows with the weighted ``residual`` of their score."""
    weight = F.when(
        F.col("is_toxic") == 1, F.lit(counts.total / (2.0 * counts.positive))
    ).otherwise(F.lit(counts.total / (2.0 * counts.negative)))
    return classifier.score_baseline(model, train).withColumn(
        "residual", weight * (F.col("score") - F.col("is_toxic"))
    )


def _gradient_entries(train, model, counts, sums):
    """(id, residual, term, weight) of all training rows with an id. Rows that share an id
    have the sum of their residuals.

    A row's own residual goes with its entries, so they are not joined by id. Only ids that
    repeat are looked up, in a table of their own, whose size lets Spark choose the join.
    """
    repeated = written(
        sums.where((F.col("n") > 1) & F.col("id").isNotNull()).select("id", "total"),
        "repeated-ids",
    )
    rows = _residuals(train.where(F.col("id").isNotNull()), model, counts).drop("score")
    rows = rows.join(repeated, "id", "left").withColumn(
        "residual", F.coalesce("total", "residual")
    )
    return classifier.tfidf_weights(rows, model.stages[:-1], carried=["residual"])


def _largest_gradient(train, model, counts):
    """The largest entry of the gradient of the weighted loss and its penalty, summed up
    from the vectors of all training rows."""
    by_id = _residuals(train, model, counts).groupBy("id")
    sums = written(
        by_id.agg(F.sum("residual").alias("total"), F.count(F.lit(1)).alias("n")), "residuals"
    )
    by_term = _gradient_entries(train, model, counts, sums).groupBy("term").agg(
        F.sum(F.col("weight") * F.col("residual")).alias("loss")
    )
    coefficients = _coefficients(train.sparkSession, model)
    gradient = coefficients.join(by_term, "term", "left").select(
        F.abs(F.coalesce("loss", F.lit(0.0)) + F.col("coefficient")).alias("entry")
    )
    return gradient.unionByName(
        sums.agg(F.abs(F.sum("total")).alias("entry"))
    ).agg(F.max("entry").alias("largest"))


@query
def baseline_train_summary(spark, sf_dir):
    data, model = _baseline(spark, sf_dir)
    counts = classifier.class_counts(data.train)
    largest = _largest_gradient(data.train, model, counts).scalar()
    return data.train.agg(
        F.count(F.lit(1)).alias("n_train"),
        F.sum("is_toxic").alias("n_positive"),
        F.lit(len(classifier.model_vocabulary(model.stages))).cast("bigint").alias(
            "vocabulary_size"
        ),
        (largest <= F.lit(GRADIENT_SHARE * counts.total)).alias("gradient_small"),
    )


def _recomputed(table, scored, model, text):
    """``scored`` with ``as_recomputed``: whether the score is what the coefficients give
    for the weights of the text's terms."""
    texts = table.select("id", F.coalesce(F.col(text), F.lit("")).alias("comment_text"))
    weights = classifier.tfidf_weights(texts, model.stages[:-1])
    sums = (
        weights.join(_coefficients(table.sparkSession, model), "term")
        .groupBy("id")
        .agg(F.sum(F.col("weight") * F.col("coefficient")).alias("sum"))
    )
    again = sigmoid(F.coalesce("sum", F.lit(0.0)) + F.lit(float(model.stages[-1].intercept)))
    return scored.join(sums, "id", "left").withColumn(
        "as_recomputed", F.abs(F.col("score") - again) < 1e-9
    )


@query
def baseline_scores(spark, sf_dir):
    data, model = _baseline(spark, sf_dir)
    scored = classifier.score_baseline(model, data.evaluation).select("id", "is_toxic", "score")
    return _recomputed(data.evaluation, scored, model, "comment_text").select(
        "id", "is_toxic", "as_recomputed"
    )


def _auc_by_ranks(rows, *keys):
    """(keys, by_ranks): AUC from average ranks, for (keys, score, label) rows."""
    in_order = Window.partitionBy(*keys).orderBy("score")
    peers = F.count(F.lit(1)).over(Window.partitionBy(*keys, "score"))
    rank = F.rank().over(in_order) + (peers - 1) / 2
    sums = rows.withColumn("rank", rank).groupBy(*keys).agg(
        F.sum("label").cast("double").alias("p"),
        F.sum(1 - F.col("label")).cast("double").alias("q"),
        F.sum(F.when(F.col("label") == 1, F.col("rank"))).alias("ranks"),
    )
    area = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    defined = (F.col("p") > 0) & (F.col("q") > 0)
    return sums.select(*keys, F.when(defined, area).alias("by_ranks"))


def _auc_checked(measured, by_ranks, identity):
    """Metrics with ``auc_as_by_ranks``: whether both AUC are the same, or undefined."""
    again = by_ranks.withColumnRenamed(identity, "_identity")
    same = F.coalesce(
        F.abs(F.col("subgroup_auc") - F.col("by_ranks")) < 1e-12,
        F.col("subgroup_auc").isNull() & F.col("by_ranks").isNull(),
    )
    joined = measured.join(again, measured["identity"] == again["_identity"], "left")
    return joined.withColumn("auc_as_by_ranks", same)


@query
def baseline_bias_metrics(spark, sf_dir):
    data, model = _baseline(spark, sf_dir)
    scored = classifier.score_baseline(model, data.evaluation)
    scored = written(scored.drop("comment_text"), "baseline-scores")
    members = prepare.subgroup_members(scored, data.identities)
    rows = scored.select("id", "score", F.col("is_toxic").alias("label")).join(members, "id")
    measured = _measured(scored, data.identities, "Baseline")
    return _auc_checked(measured, _auc_by_ranks(rows, "identity"), "identity").select(
        "dataset", "model", "ord", "identity", "total_examples", "auc_as_by_ranks"
    )


def _measured(scored: DataFrame, identities: list[str], model: str) -> DataFrame:
    narrow = metrics.with_active_groups(scored, identities).select(
        F.lit(fx.DATASET).alias("dataset"),
        F.lit(model).alias("model"),
        "id",
        "is_toxic",
        "score",
        "groups",
    )
    return metrics.bias_metrics(written(narrow, "scores"), [(fx.DATASET, model)], identities)


def _baseline_ood(spark, sf_dir):
    _, model = _baseline(spark, sf_dir)
    table = ood.with_text(ood.with_label(ood.test_split(fx.toxigen(spark, sf_dir))))
    scored = classifier.score_baseline(model, table, "text").select("id", "label", "score")
    return table, scored, model


@query
def baseline_ood_scores(spark, sf_dir):
    table, scored, model = _baseline_ood(spark, sf_dir)
    return _recomputed(table, scored, model, "text").select("id", "label", "as_recomputed")


@query
def baseline_ood_bias_metrics(spark, sf_dir):
    labelled = _grouped(spark, sf_dir, test_only=True)
    scored = written(_baseline_ood(spark, sf_dir)[1], "baseline-scores")
    rows = scored.select("id", "score", "label").join(ood.group_members(labelled), "id")
    measured = ood.ood_bias_metrics(
        labelled, scored.select(F.lit("Baseline").alias("model"), "id", "score"), ["Baseline"]
    )
    return _auc_checked(measured, _auc_by_ranks(rows, "group"), "group").select(
        "model", "identity", "first_row", "first_place", "total_examples", "auc_as_by_ranks"
    )


@query
def epoch_selection(spark, sf_dir):
    """Training for one epoch, then resumed up to three: measured epochs, kept states, and
    whether the model saved in the end is the best epoch's, by its own scores."""
    run_dir = scratch_path(spark, "epochs")
    prepared = _prepared(spark, sf_dir, True)
    run_epochs(prepared, IDENTITIES, run_dir, epochs=1, seed=OTHER_SEED)
    run = run_epochs(prepared, IDENTITIES, run_dir, epochs=3, seed=OTHER_SEED)
    model = model_source.load_pipeline(spark, f"{run_dir}/model")
    table = split.truncate_then_split(prepared, -1, seed=OTHER_SEED)
    validation = table.where(F.col("split") == "validation")
    scored = classifier.score_baseline(model, validation)
    saved = metrics.bias_metrics(
        written(
            metrics.with_active_groups(scored, IDENTITIES).select(
                F.lit("best").alias("model"), "id", "is_toxic", "score", "groups"
            ),
            "epoch-scores",
        ),
        [("best",)],
        IDENTITIES,
        ["model"],
    ).where(F.col("ord") == 0)
    best = epoch_ranking(run.history).agg(F.max("auc").alias("auc")).scalar()
    same = F.max(F.abs(F.col("overall_auc") - best) < 1e-9)
    return run.history.where(F.col("ord") == 0).agg(
        F.count("epoch").alias("n_epochs"),
        F.lit(run.kept.select(F.count("*")).scalar()).alias("n_kept"),
        (F.min("overall_auc") > 0.5).alias("better_than_chance"),
        saved.select(same.alias("same")).scalar().alias("saved_is_best"),
    )


@query
def candidate_selection(spark, sf_dir):
    """Validation rows of every candidate, and whether the chosen one has the best AUC."""
    prepared = _prepared(spark, sf_dir, True)
    measured, scored = candidate_metrics(prepared, IDENTITIES)[:2]
    whole = written(measured.where(F.col("ord") == 0), "candidates").select("model", "overall_auc")
    chosen = metrics.best_run(whole).select(F.col("run"), F.col("auc"))
    best = whole.agg(F.max("overall_auc").alias("best"))
    rows = scored.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))
    fits = best.join(chosen, F.col("auc") == F.col("best")).select(
        F.col("run").isNotNull().alias("chosen_is_best")
    )
    return rows.select("model", "n_rows", fits.scalar().alias("chosen_is_best"))


@query
def batch_scores(spark, sf_dir):
    scored = score_texts(_prepared(spark, sf_dir, True), length_model())
    return scored.select("id", _rounded(F.col("score"), "score"))


@query
def resumed_scores(spark, sf_dir):
    """Scoring in four fragments that ends after two, and goes on with another call."""
    results = scratch_path(spark, "resumed")
    texts = _prepared(spark, sf_dir).select("id", "comment_text")
    table, fragments = evaluation.landed_fragments(
        texts, "comment_text", results, -(-texts.count() // 4)
    )
    for at_most in (2, None):
        evaluation.score_in_fragments(
            table, fragments, fx.DATASET, fx.REGISTRY[1], length_model(), results, at_most=at_most
        )
    found = result_source.read_predictions(spark, f"{results}/predictions")
    return found.select("id", _rounded(F.col("score"), "score"))


@query
def batch_bias_metrics(spark, sf_dir):
    scored = score_texts(_prepared(spark, sf_dir, True), length_model())
    return _measured(scored, IDENTITIES, "length")


@query
def zero_shot_scores(spark, sf_dir):
    scored = score_zero_shot(_prepared(spark, sf_dir, True), yes_no_model())
    return scored.select("id", _rounded(F.col("score"), "score"))


@query
def zero_shot_bias_metrics(spark, sf_dir):
    scored = score_zero_shot(_prepared(spark, sf_dir, True), yes_no_model())
    return _measured(scored, IDENTITIES, "yes-no")


# --- written and read back ---


@query
def csv_comments_roundtrip(spark, sf_dir):
    """The comment table as gzipped CSV, read by name and prepared."""
    root = scratch_path(spark, "comments")
    (
        fx.jigsaw(spark, sf_dir)
        .write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("compression", "gzip")
        .csv(comment_source.comment_file(root, "train"))
    )
    return comment_source.load_comments(spark, root)


@query
def csv_quarantine(spark, sf_dir):
    """Comments with words for missing numbers, which are null, and with texts that are no
    numbers, which are quarantined with their place."""
    root = scratch_path(spark, "comments")
    target = F.when(F.col("id") % 29 == 3, "n/a").when(F.col("id") % 29 == 5, "high")
    asian = F.when(F.col("id") % 31 == 7, '0,5 "or so"')
    rows = fx.jigsaw(spark, sf_dir)
    broken = rows.withColumns(
        {
            "target": F.coalesce(target, F.col("target").cast("string")),
            "asian": F.coalesce(asian, F.col("asian").cast("string")),
        }
    )
    (
        broken.write.option("header", True)
        .option("escape", '"')
        .option("compression", "gzip")
        .csv(comment_source.comment_file(root, "train"))
    )
    comments = comment_source.parse_comments(spark, root)
    bad = comments.quarantine.select(F.col("id").cast("long").alias("id"), "column", "value")
    sound = comments.rows.select(
        "id", F.lit("target").alias("column"), F.col("target").cast("string").alias("value")
    )
    return bad.unionByName(sound)


@query
def ood_source_fallback(spark, sf_dir):
    """The first source is missing, so the second one is taken, unfiltered."""
    root = scratch_path(spark, "ood")
    fx.toxigen(spark, sf_dir).write.parquet(f"{root}/second")
    table = comment_source.read_ood(spark, [f"{root}/first", f"{root}/second"])
    return table.select("id", "label", F.md5("text").alias("digest"))


@query
def saved_splits_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "splits")
    slices = split.train_eval_slices(_prepared(spark, sf_dir), -1, -1)
    split_source.write_splits(slices, path)
    data = split_source.read_splits(spark, path)
    tagged = [
        df.select("id", "target", "is_toxic", F.lit(name).alias("split"), *data.identities)
        for name, df in (("train", data.train), ("eval", data.evaluation))
    ]
    return tagged[0].unionByName(tagged[1])


@query
def predictions_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    result_source.write_predictions(_all_predictions(spark, sf_dir), path)
    return result_source.read_predictions(spark, path)


@query
def metric_files_roundtrip(spark, sf_dir):
    folder = scratch_path(spark, "results")
    measured = written(bias_metrics(spark, sf_dir), "metrics")
    result_source.write_metrics(measured, folder, fx.REGISTRY)
    names = [model.name for model in fx.REGISTRY]
    return result_source.read_metric_files(spark, folder, names)


@query
def metric_files_without_totals(spark, sf_dir):
    """Metric CSVs that lack the column of sizes, their columns in another order."""
    folder = scratch_path(spark, "results")
    measured = written(bias_metrics(spark, sf_dir), "metrics")
    for model in fx.REGISTRY:
        public = result_source.public_metrics(measured.where(F.col("model") == model.key))
        names = [c for c in reversed(public.columns) if c != METRIC_HEADERS["total_examples"]]
        table = public.select(*[F.col(f"`{c}`") for c in names]).coalesce(1)
        table.write.option("header", True).csv(f"{folder}/{result_source.metric_file(model)}")
    return result_source.read_metric_files(spark, folder, [m.name for m in fx.REGISTRY])


@query
def report_preview(spark, sf_dir):
    return report.preview(bias_metrics(spark, sf_dir).where(F.col("model") == fx.MODEL_KEYS[0]))


@query
def report_file_roundtrip(spark, sf_dir):
    """The written report, read back by its public headers."""
    folder = scratch_path(spark, "report")
    result_source.write_report(written(_report(spark, sf_dir), "report"), folder)
    saved = spark.read.option("header", True).csv(f"{folder}/final_report.csv")
    auc = report.report_header(fx.MODEL_KEYS[0], "overall_auc")
    return saved.select(
        F.col(METRIC_HEADERS["identity"]).alias("identity"),
        F.col(f"`{METRIC_HEADERS['total_examples']}`").cast("bigint").alias("total_examples"),
        F.col(f"`{auc}`").cast("double").alias("auc"),
    )
