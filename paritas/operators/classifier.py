"""The TF-IDF and logistic-regression baseline on Spark ML."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.text import ENGLISH_STOP_WORDS, tokens_sql
from paritas.operators.terms import corpus_vocabulary, document_tokens, with_idf

VOCABULARY_SIZE = 10_000
MAX_ITERATIONS = 1_000

# Bytes of vectors in one cached partition at most, and those that are worth a task in
# each of the hundreds of passes; what a row and an entry take.
PARTITION_BYTES, TASK_BYTES = 64 << 20, 4 << 20
ROW_BYTES, ENTRY_BYTES = 100, 12


class ClassCounts(NamedTuple):
    negative: int
    positive: int

    @property
    def total(self) -> int:
        return self.negative + self.positive


def balanced_class_weights(df: DataFrame, label: str = "is_toxic") -> DataFrame:
    """(label, n, weight): n / (2 * n_label), so both classes weigh the same."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.withColumn(
        "weight", total.cast("double") / (F.lit(2.0) * F.col("n").cast("double"))
    )


def class_counts(df: DataFrame, label: str = "is_toxic") -> ClassCounts:
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("negative"),
        F.count_if(F.col(label) == 1).alias("positive"),
    ).first()
    return ClassCounts(row["negative"], row["positive"])


class Tfidf(NamedTuple):
    """Fitted stages from text to vectors, and the entries all vectors have together."""

    stages: list
    entries: int


def fit_tfidf(
    df: DataFrame,
    text: str = "comment_text",
    size: int = VOCABULARY_SIZE,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
) -> Tfidf:
    """Fitted stages from text to L2-normalised TF-IDF vectors.

    The vocabulary, at most ``size`` terms with their idf, is what the model
    consists of and is the only thing fetched. One expression makes the tokens of the
    vocabulary and of the vectors. Spark ML's own idf lacks the trailing one, so the
    weights are an element-wise product.
    """
    words = list(stop_words)
    # Any id does that spreads: documents are counted one by one and only sampled by it.
    texts = df.select(F.xxhash64(text).alias("id"), text)
    found = corpus_vocabulary(document_tokens(texts, text, "id", words), size, "id")
    rows = sorted(
        with_idf(found, df).select("term", "idf", "tf", "df").collect(),
        key=lambda r: (-r["tf"], r["term"]),
    )
    tokenizer = SQLTransformer(
        statement=f"SELECT *, {tokens_sql(f'`{text}`', words)} AS _tokens FROM __THIS__"
    )
    counter = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in rows], inputCol="_tokens", outputCol="_counts"
    )
    weigher = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]),
        inputCol="_counts",
        outputCol="_weighted",
    )
    normalizer = Normalizer(p=2.0, inputCol="_weighted", outputCol="features")
    return Tfidf([tokenizer, counter, weigher, normalizer], sum(r["df"] for r in rows))


def tfidf_stages(
    df: DataFrame,
    text: str = "comment_text",
    size: int = VOCABULARY_SIZE,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
) -> list:
    """The stages of :func:`fit_tfidf`."""
    return fit_tfidf(df, text, size, stop_words).stages


def model_vocabulary(stages: Sequence) -> list[str]:
    """The terms of a pipeline, in the order of its vectors' entries."""
    return next(s.vocabulary for s in stages if isinstance(s, CountVectorizerModel))


def text_column(stages: Sequence) -> str:
    """The text column that a pipeline's first stage reads."""
    return stages[0].getStatement().split("`")[1]


def tfidf_weights(
    df: DataFrame, stages: list, id_col: str = "id", carried: Sequence[str] = ()
) -> DataFrame:
    """(id, term, weight) from fitted TF-IDF stages, read off the sparse vectors. Columns
    ``carried`` along stand after the id, so that they need no join with the entries."""
    kept = [id_col, *carried]
    vectors = PipelineModel(stages).transform(df)
    sparse = F.unwrap_udt(F.col("features"))
    entries = vectors.select(*kept, sparse.alias("v")).select(
        *kept, F.inline(F.arrays_zip(F.col("v.indices"), F.col("v.values")))
    )
    # The vocabulary as one constant array; a blank is never part of a term.
    terms = F.split(F.lit(" ".join(model_vocabulary(stages))), " ")
    return entries.select(
        *kept, F.get(terms, F.col("indices")).alias("term"), F.col("values").alias("weight")
    )


def _vector_bytes(rows: int, entries: int) -> int:
    return rows * ROW_BYTES + entries * ENTRY_BYTES


def vector_partitions(spark: SparkSession, rows: int, entries: int) -> int:
    """How many partitions to cache vectors in, by their bytes. A block of the cache has a
    limit, so there are enough. Every pass is a job that visits all of them, so there are
    no more than the session shuffles into unless the limit asks for it, and few vectors
    are in few partitions, as a task would cost more than its share of the pass."""
    size = _vector_bytes(rows, entries)
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return max(1, spread, -(-size // PARTITION_BYTES))


def pass_partitions(spark: SparkSession, rows: int, entries: int) -> int:
    """How many partitions to cache vectors in whose sums are gathered again and again.

    Each partition shuffles a gradient, a number per term, in every one of up to a thousand
    passes. More partitions than the session has cores save no time, so there is one per
    core, or as many more for each as the limit of :func:`vector_partitions` asks for.
    """
    cores = spark.sparkContext.defaultParallelism
    waves = max(1, -(-_vector_bytes(rows, entries) // (PARTITION_BYTES * cores)))
    return min(vector_partitions(spark, rows, entries), waves * cores)


def weighted_features(
    df: DataFrame, tfidf: Tfidf, counts: ClassCounts, label: str = "is_toxic"
) -> DataFrame:
    """(features, label, weight) ready for repeated passes; the caller unpersists."""
    weight = F.when(
        F.col(label) == 1, F.lit(counts.total / (2.0 * max(counts.positive, 1)))
    ).otherwise(F.lit(counts.total / (2.0 * max(counts.negative, 1))))
    vectors = (
        PipelineModel(tfidf.stages)
        .transform(df)
        .select("features", F.col(label).cast("double").alias("label"), weight.alias("weight"))
    )
    parts = pass_partitions(df.sparkSession, counts.total, tfidf.entries)
    return vectors.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)


def fit_logistic(
    features: DataFrame, rows: int, penalties: Sequence[float] = (1.0,)
) -> list[LogisticRegressionModel]:
    """Balanced logistic regressions, one per weight of the L2 penalty.

    The penalty is stated against the sum of losses; Spark's loss is their mean, so
    it is divided by the number of rows. The fits share the features and run side by
    side, since each one is a long row of short jobs.
    """
    logistic = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        maxIter=MAX_ITERATIONS,
        tol=1e-6,
    )
    fits = logistic.fitMultiple(
        features, [{logistic.regParam: penalty / rows} for penalty in penalties]
    )
    fit_next = inheritable_thread_target(features.sparkSession)(lambda _: next(fits))
    with ThreadPool(len(penalties)) as pool:
        models = dict(pool.map(fit_next, penalties, chunksize=1))
    return [models[i] for i in range(len(penalties))]


def train_baseline(
    train: DataFrame,
    text: str = "comment_text",
    label: str = "is_toxic",
    size: int = VOCABULARY_SIZE,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
) -> PipelineModel:
    """Fit the whole baseline; the result maps a text column to probabilities."""
    counts = class_counts(train, label)
    if not (counts.negative and counts.positive):
        raise ValueError("training needs rows of both classes")
    tfidf = fit_tfidf(train, text, size, stop_words)
    features = weighted_features(train, tfidf, counts, label)
    try:
        (model,) = fit_logistic(features, counts.total)
    finally:
        features.unpersist()
    return PipelineModel([*tfidf.stages, model])


def score_baseline(model: PipelineModel, df: DataFrame, text: str | None = None) -> DataFrame:
    """Add ``score``, P(positive). ``text`` names the text column if it differs
    from the one the model was trained on."""
    trained_on = text_column(model.stages)
    source = df
    if text is not None and text != trained_on:
        source = source.withColumn(trained_on, F.col(text))
    source = source.withColumn(trained_on, F.coalesce(F.col(trained_on), F.lit("")))
    scored = model.transform(source)
    return scored.select(
        *[c for c in df.columns], vector_to_array(F.col("probability"))[1].alias("score")
    )
