import math
import re

import pytest
from pyspark.resource import (
    ExecutorResourceRequests,
    ResourceProfileBuilder,
    TaskResourceRequests,
)
from pyspark.sql import functions as F

from paritas.checks.queries import _largest_gradient
from paritas.checks.stubs import length_model, yes_no_model
from paritas.functions.scores import logits_to_score, zero_shot_score
from paritas.functions.text import (
    ENGLISH_STOP_WORDS,
    tokenize,
    tokens_sql,
    without_stop_words,
)
from paritas.operators import classifier, scoring, terms
from paritas.operators.scoring import by_length, padding, score_texts, score_zero_shot
from paritas.plans.candidates import run_candidates
from paritas.sources.models import load_pipeline, model_paths, save_pipeline


def test_tokens(spark):
    df = spark.createDataFrame([("Don't STOP a_b 12 é été x ÜBER-Größe",)], "text string")
    tokens = df.select(tokenize(F.col("text"))).first()[0]
    assert tokens == ["don", "stop", "a_b", "12", "été", "über", "größe"]
    kept = df.select(without_stop_words(tokenize(F.col("text")))).first()[0]
    assert kept == ["stop", "a_b", "12", "été", "über", "größe"]
    assert df.select(without_stop_words(tokenize(F.col("text")), [])).first()[0] == tokens


def test_stop_words_are_those_of_the_library(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def documents(spark):
    return spark.createDataFrame(
        [(1, "bb aa bb cc"), (2, "aa bb"), (3, ""), (4, None)], "id bigint, text string"
    )


def test_term_statistics(spark):
    tokens = terms.document_tokens(documents(spark), stop_words=[])
    counted = {tuple(r) for r in terms.document_terms(tokens).collect()}
    assert counted == {(1, "aa", 1), (1, "bb", 2), (1, "cc", 1), (2, "aa", 1), (2, "bb", 1)}
    statistics = terms.term_statistics(tokens)
    assert {tuple(r) for r in statistics.collect()} == {
        ("aa", 2, 2),
        ("bb", 3, 2),
        ("cc", 1, 1),
    }
    top = terms.vocabulary(statistics, 2)
    assert {r["term"] for r in top.collect()} == {"aa", "bb"}
    idf = {r["term"]: r["idf"] for r in terms.with_idf(top, documents(spark)).collect()}
    assert idf["aa"] == pytest.approx(math.log(5 / 3) + 1)
    kept = terms.term_counts(tokens, top)
    assert {r["term"] for r in kept.collect()} == {"aa", "bb"}


def test_tfidf_vectors_have_unit_length(spark):
    df = documents(spark).na.fill("")
    stages = classifier.tfidf_stages(df, "text", size=10, stop_words=["cc"])
    weights = classifier.tfidf_weights(df, stages).collect()
    assert {r["term"] for r in weights} == {"aa", "bb"}
    for i in (1, 2):
        assert sum(r["weight"] ** 2 for r in weights if r["id"] == i) == pytest.approx(1)


def comments(spark):
    rows = [(i, f"bad ugly word{i % 5}" if i % 4 == 0 else f"nice word{i % 5}", int(i % 4 == 0))
            for i in range(80)]
    return spark.createDataFrame(rows, "id bigint, comment_text string, is_toxic int")


def test_balanced_weights(spark):
    weights = {
        r["label"]: r["weight"]
        for r in classifier.balanced_class_weights(comments(spark)).collect()
    }
    assert weights == {0: 80 / 120, 1: 80 / 40}


def test_baseline_separates_saves_and_loads(spark, tmp_path):
    model = classifier.train_baseline(comments(spark))
    save_pipeline(model, str(tmp_path / "m"))
    again = load_pipeline(spark, str(tmp_path / "m"))
    scored = classifier.score_baseline(again, comments(spark))
    assert scored.columns == ["id", "comment_text", "is_toxic", "score"]
    bounds = scored.groupBy("is_toxic").agg(F.min("score"), F.max("score")).collect()
    by_class = {r[0]: (r[1], r[2]) for r in bounds}
    assert by_class[1][0] > 0.5 > by_class[0][1]
    other = comments(spark).select("id", F.col("comment_text").alias("text"))
    renamed = classifier.score_baseline(again, other, "text")
    assert renamed.columns == ["id", "text", "score"]
    assert {r["score"] for r in renamed.collect()} == {r["score"] for r in scored.collect()}
    nothing = spark.createDataFrame([(1, None)], "id bigint, text string")
    assert 0 < classifier.score_baseline(again, nothing, "text").first()["score"] < 1


def test_baseline_solution_is_a_minimum_of_the_summed_loss(spark):
    """Gradient of sum(w * loss) + |b|^2 / 2 vanishes, the penalty being on the sum."""
    df = comments(spark)
    model = classifier.train_baseline(df)
    rows = model.transform(df).select("features", "is_toxic", "probability").collect()
    gradient = model.stages[-1].coefficients.toArray().copy()
    for r in rows:
        weight = 80 / (2 * (20 if r["is_toxic"] else 60))
        gradient += weight * (r["probability"][1] - r["is_toxic"]) * r["features"].toArray()
    assert max(abs(gradient)) < 1e-2


def test_gradient_shuffles_sums_of_terms(spark):
    """Entries meet the residual in their own row, so none of them is shuffled by its id.
    Of rows that share an id, each has the sum of the residuals; those without one have none."""
    unique = comments(spark)
    model = classifier.train_baseline(unique)
    counts = classifier.class_counts(unique)
    shared = unique.withColumn("id", F.expr("IF(id < 6, NULL, IF(id < 20, id % 7, id))"))
    for df in (unique, shared):
        rows = model.transform(df).select("id", "features", "is_toxic", "probability").collect()
        gradient, intercept = model.stages[-1].coefficients.toArray().copy(), 0.0
        for r in rows:
            same = [o for o in rows if r["id"] is not None and o["id"] == r["id"]]
            for o in same:
                residual = 80 / (2 * (20 if o["is_toxic"] else 60))
                residual *= o["probability"][1] - o["is_toxic"]
                gradient += residual * r["features"].toArray()
            residual = 80 / (2 * (20 if r["is_toxic"] else 60))
            intercept += residual * (r["probability"][1] - r["is_toxic"])
        largest = _largest_gradient(df, model, counts)
        expected = max(*abs(gradient), abs(intercept))
        assert largest.first()["largest"] == pytest.approx(expected, abs=1e-9)
        plan = largest._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"term"}


def test_training_needs_both_classes(spark):
    with pytest.raises(ValueError, match="both classes"):
        classifier.train_baseline(comments(spark).where("is_toxic = 0"))


def test_missing_pipeline_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_pipeline(spark, str(tmp_path / "none"))


def test_logits(spark):
    df = spark.createDataFrame(
        [([0.0, 0.0],), ([1000.0, -1000.0],), ([-1000.0, 1000.0],), ([2.0],), ([-1000.0],)],
        "logits array<float>",
    )
    got = [r[0] for r in df.select(logits_to_score(F.col("logits"))).collect()]
    assert got == [0.5, 0.0, 1.0, pytest.approx(1 / (1 + math.exp(-2))), 0.0]
    picked = spark.createDataFrame([([5.0, 1.0, 1.0],)], "logits array<float>")
    score = picked.select(zero_shot_score(F.col("logits"), yes=1, no=2)).first()[0]
    assert score == 0.5


def test_batched_scoring(spark):
    rows = [(1, "x" * 30), (2, None), (3, "é" * 60)]
    df = spark.createDataFrame(rows, "id int, comment_text string")
    scores = {r["id"]: r["score"] for r in score_texts(df, length_model(), batch_size=2).collect()}
    assert scores[1] == 0.5
    assert scores[2] == pytest.approx(1 / (1 + math.exp(3)))
    assert scores[3] == pytest.approx(1 / (1 + math.exp(-3)))
    asked = {r["id"]: r["score"] for r in score_zero_shot(df, yes_no_model()).collect()}
    assert all(0 < s < 1 for s in asked.values())


def test_model_paths(spark):
    listing = spark.createDataFrame(
        [
            ("a", "checkpoint-9"),
            ("a", "checkpoint-100"),
            ("a", "checkpoint-10"),
            ("b", "checkpoint-5"),
            ("b", "config.json"),
            ("c", "runs"),
        ],
        "folder string, entry string",
    )
    assert {tuple(r) for r in model_paths(listing).collect()} == {
        ("a", "a/checkpoint-100"),
        ("b", "b"),
        ("c", "c"),
    }


def test_best_candidate_is_saved(spark, tmp_path):
    path = str(tmp_path / "best")
    prepared = comments(spark).withColumn("asian", F.lit(1.0))
    measured = run_candidates(prepared, ["asian"], path, penalties=(0.5, 5.0))
    assert {r["model"] for r in measured.collect()} == {"L2=0.5", "L2=5"}
    assert load_pipeline(spark, path).stages[-1].numFeatures > 0


def corpus(spark, documents, words):
    """Documents whose words follow a power law, so that few are frequent."""
    row = "array_join(transform(sequence(1, 30), i -> concat('w', cast(pow(rand(7), 4) * {} as int))), ' ')"
    return spark.range(documents).selectExpr("id", row.format(words) + " AS text").cache()


@pytest.mark.parametrize(("size", "documents", "buckets"), [(50, 40, 64), (50, 2_000, 1 << 14), (5_000, 100, 8)])
def test_sketched_vocabulary_is_exact(spark, size, documents, buckets):
    """From a poor sample with few buckets, from all documents, and of more than there are."""
    tokens = terms.document_tokens(corpus(spark, 2_000, 3_000))
    found = terms.frequent_terms(tokens, size, documents=documents, buckets=buckets)
    expected = terms.vocabulary(terms.term_statistics(tokens), size).collect()
    assert terms.vocabulary(found, size).collect() == expected


def test_sketch_shuffles_a_bounded_number_of_rows(spark):
    """Unlikely terms leave a task as buckets, however many there are."""
    tokens = terms.document_tokens(corpus(spark, 4_000, 1_000_000))
    likely = spark.createDataFrame([("w0",), ("w1",)], "term string")
    found = terms.bucketed_statistics(tokens, likely, buckets=100)
    assert terms.term_statistics(tokens).count() > 10_000
    rows = found.collect()
    assert len(rows) == 102 and {r["term"] for r in rows if r["bucket"] is None} == {"w0", "w1"}
    assert sum(r["tf"] for r in rows) == 4_000 * 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The one shuffle is of sums that each task has made by term or bucket.
    keys = set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan.split("Initial Plan")[0]))
    assert len(keys) == 1 and "_known" in keys.pop()
    assert "partial_sum(n" in plan[plan.index("Exchange hashpartitioning") :]


def test_vocabulary_in_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    statistics = terms.term_statistics(terms.document_tokens(corpus(spark, 200, 500)))
    expected = terms.vocabulary(statistics, 40).collect()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * terms.MERGED_PARTITIONS))
        assert terms.vocabulary(statistics, 40).collect() == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tokens_of_the_pipeline_are_those_of_the_vocabulary(spark):
    texts = ["I'll don't say: Ünïcode_1 a b2 über-all", "", None, "the THE x1\ty2 'quoted\\'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for words in (ENGLISH_STOP_WORDS, ["don't", "b2", "back\\slash"], []):
        plain = terms.document_tokens(df, "text", "id", words).orderBy("id").collect()
        made = df.selectExpr("id", f"{tokens_sql('`text`', words)} AS tokens")
        assert made.orderBy("id").collect() == plain


def test_vectors_are_cached_by_their_bytes(spark):
    assert classifier.vector_partitions(spark, 0, 0) == 1
    assert classifier.vector_partitions(spark, 1_000, 10_000) == 1
    assert classifier.vector_partitions(spark, 10_000, 1_000_000) == 4
    assert classifier.vector_partitions(spark, 10_000, 10_000_000) == 8
    parts = classifier.vector_partitions(spark, 10**9, 10**11)
    assert 10**9 * 100 + 10**11 * 12 <= parts * classifier.PARTITION_BYTES


def test_vectors_of_many_passes_are_cached_by_cores(spark):
    """As every partition shuffles a gradient in each pass, shuffle partitions, which grow
    with the table, do not make more of them than cores."""
    cores = spark.sparkContext.defaultParallelism
    df = comments(spark)
    stages = classifier.tfidf_stages(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(100 * cores))
        for waves in (1, 3):
            size = waves * cores * classifier.PARTITION_BYTES
            tfidf = classifier.Tfidf(stages, size // classifier.ENTRY_BYTES - 80_000)
            counts = classifier.class_counts(df)
            features = classifier.weighted_features(df, tfidf, counts)
            assert features.rdd.getNumPartitions() == waves * cores
            assert features.count() == 80
            features.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert classifier.pass_partitions(spark, 1_000, 10_000) == 1
    parts = classifier.pass_partitions(spark, 10**9, 10**11)
    assert 10**9 * 100 + 10**11 * 12 <= parts * classifier.PARTITION_BYTES


def test_batches_by_length_pad_less(spark):
    """The same rows and scores, no shuffle, and next to no padding."""
    df = spark.range(2_000, numPartitions=4).selectExpr(
        "id", "IF(id % 100 = 7, NULL, repeat('x', int(id * 7919 % 400))) AS comment_text"
    )
    sorted_rows = by_length(df, F.col("comment_text"))
    assert sorted_rows.exceptAll(df).count() == 0 == df.exceptAll(sorted_rows).count()
    before, after = (padding(rows).first() for rows in (df, sorted_rows))
    assert before["characters"] == after["characters"] < after["padded"]
    assert before["padded"] > 1.8 * before["characters"]
    assert after["padded"] < 1.2 * after["characters"]
    scored = score_texts(df, length_model())
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.columns == [*df.columns, "score"]


def test_the_scoring_stage_carries_its_resources(spark):
    rows = [(1, "short"), (2, "a longer text"), (3, None)]
    df = spark.createDataFrame(rows, "id bigint, comment_text string")
    needs = TaskResourceRequests().cpus(1).resource("gpu", 1)
    has = ExecutorResourceRequests().resource("gpu", 1)
    profile = ResourceProfileBuilder().require(needs).require(has).build
    plain = score_texts(df, length_model())
    assert score_texts(df, length_model(), profile=profile).schema == plain.schema
    assert plain.count() == 3
    for scored in (score_texts, score_zero_shot):  # a local master has no such resources
        with pytest.raises(Exception, match="ResourceProfile"):
            scored(df, yes_no_model(), profile=profile).collect()


def test_a_stage_of_resources_keeps_its_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id bigint, comment_text string")
    assert sorted(df.mapInArrow(scoring._same, df.schema).collect()) == sorted(df.collect())
