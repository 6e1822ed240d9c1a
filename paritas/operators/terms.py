"""Term statistics of a text column.

A document is one row, so everything per document is computed inside the row and
needs no shuffle; only (term, count) pairs, already summed up per task, travel.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paritas.functions.text import ENGLISH_STOP_WORDS, tokenize, without_stop_words
from paritas.session import written

# Shuffle partitions whose most frequent terms meet in one task.
MERGED_PARTITIONS = 64

# Documents, about, in which likely frequent terms are looked for, how many times as many
# terms are taken as are asked for, and the buckets in which all others are counted.
SAMPLED_DOCUMENTS = 100_000
LIKELY_FACTOR = 4
BUCKETS = 1 << 18
# Shuffle partitions of a session whose corpora are so large that counting every distinct
# term costs more than a second look at the texts.
SKETCH_FROM_PARTITIONS = 2_000


def document_tokens(
    df: DataFrame,
    text: str = "text",
    id_col: str = "id",
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(id, tokens): the tokens of each text in order, stop words left out."""
    words = tokenize(F.coalesce(F.col(text), F.lit("")))
    return df.select(id_col, without_stop_words(words, stop_words).alias("tokens"))


def _runs(ordered: Column) -> Column:
    """Start positions of the runs of equal items in a sorted array."""
    positions = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1))
    return F.filter(
        positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
    )


def document_terms(tokens: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, term, n): how often each distinct term occurs in each document."""
    ordered = tokens.select(id_col, F.sort_array("tokens").alias("ordered"))
    runs = ordered.select(id_col, "ordered", _runs(F.col("ordered")).alias("starts"))

    def entry(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), i + 1), F.size("ordered"))
        term = F.get(F.col("ordered"), start)
        return F.struct(term.alias("term"), (end - start).alias("n"))

    return runs.select(id_col, F.inline(F.transform(F.col("starts"), entry)))


def term_statistics(tokens: DataFrame, id_col: str = "id") -> DataFrame:
    """(term, tf, df): occurrences, and documents with the term, in one shuffle."""
    return (
        document_terms(tokens, id_col)
        .groupBy("term")
        .agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    )


def vocabulary(statistics: DataFrame, size: int = 10_000) -> DataFrame:
    """The most frequent terms of the corpus; of equals, the first in order.

    Every task sends its first ``size`` terms on. Tasks meet in groups first, as many as
    the session's shuffle partitions ask for, so no task gets more than some of them.
    """
    order = [F.desc("tf"), F.asc("term")]
    partitions = int(statistics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-partitions // MERGED_PARTITIONS)
    if parts > 1:
        part = F.pmod(F.xxhash64("term"), F.lit(parts))
        place = F.row_number().over(W.partitionBy(part).orderBy(*order))
        statistics = statistics.withColumn("_place", place).where(F.col("_place") <= size)
    return statistics.select("term", "tf", "df").orderBy(*order).limit(size)


def _likely_terms(tokens: DataFrame, size: int, id_col: str, documents: int) -> DataFrame:
    """The terms that a sample of the documents, chosen by id, holds most often."""
    parts = max(1, tokens.count() // documents)
    sample = tokens.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == 0)
    return written(vocabulary(term_statistics(sample, id_col), size).select("term"), "likely-terms")


def bucketed_statistics(
    tokens: DataFrame, likely: DataFrame, id_col: str = "id", buckets: int = BUCKETS
) -> DataFrame:
    """(term, bucket, tf, df): exact for the likely terms, whose bucket is null; all other
    terms are summed up in hash buckets, whose term is null.

    A task shuffles at most a row per likely term and bucket, however many terms it has.
    A bucket's ``tf`` is an upper bound for each of its terms.
    """
    known = F.broadcast(likely.select(F.col("term").alias("_known")))  # a parameter bounds it
    counted = document_terms(tokens, id_col).join(known, F.col("term") == F.col("_known"), "left")
    bucket = F.when(F.col("_known").isNull(), F.pmod(F.xxhash64("term"), F.lit(buckets)))
    return counted.groupBy(F.col("_known").alias("term"), bucket.alias("bucket")).agg(
        F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df")
    )


def frequent_terms(
    tokens: DataFrame,
    size: int = 10_000,
    id_col: str = "id",
    documents: int = SAMPLED_DOCUMENTS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(term, tf, df): exact statistics of terms that hold the ``size`` most frequent ones.

    A sample proposes candidates, and one pass counts them exactly and all others in
    buckets. A bucket that holds less than the last wanted candidate proves that none of
    its terms is wanted. If buckets hold more, as many do in a small corpus, a further
    pass counts the terms of just these exactly, so the result never rests on the sample.
    """
    likely = _likely_terms(tokens, LIKELY_FACTOR * size, id_col, documents)
    counted = written(bucketed_statistics(tokens, likely, id_col, buckets), "term-buckets")
    exact = counted.where(F.col("term").isNotNull()).select("term", "tf", "df")
    last = vocabulary(exact, size).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
    wanted = last["tf"] if last["n"] == size else 0
    suspects = counted.where(F.col("bucket").isNotNull() & (F.col("tf") >= wanted)).select("bucket")
    if suspects.isEmpty():
        return exact
    # Broadcast: at most ``buckets`` numbers, and the likely terms.
    others = (
        document_terms(tokens, id_col)
        .withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
        .join(F.broadcast(suspects), "bucket", "left_semi")
        .join(F.broadcast(likely), "term", "left_anti")
        .groupBy("term")
        .agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    )
    return exact.unionByName(others)


def corpus_vocabulary(
    tokens: DataFrame, size: int = 10_000, id_col: str = "id", sketched: bool | None = None
) -> DataFrame:
    """(term, tf, df) of the ``size`` most frequent terms.

    Counting every term is one pass, whose shuffle grows with tasks times distinct terms;
    :func:`frequent_terms` takes more passes and a bounded shuffle. Both give the same
    result. Unless ``sketched`` says which, the setting that sizes the session's shuffles
    decides.
    """
    if sketched is None:
        partitions = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sketched = partitions >= SKETCH_FROM_PARTITIONS
    found = frequent_terms(tokens, size, id_col) if sketched else term_statistics(tokens, id_col)
    return vocabulary(found, size)


def with_idf(statistics: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the smoothed inverse document frequency ln((1+n)/(1+df)) + 1."""
    n = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    ratio = (F.lit(1.0) + n.cast("double")) / (F.lit(1.0) + F.col("df").cast("double"))
    return statistics.withColumn("idf", F.ln(ratio) + F.lit(1.0))


def term_counts(tokens: DataFrame, terms: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, term, n) of the terms in a vocabulary."""
    return (
        document_terms(tokens, id_col)
        .join(terms.select("term"), "term")
        .select(id_col, "term", "n")
    )
