"""The comment table as gzipped CSV, and out-of-domain tables with a fallback."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.catalogue import present_identities
from paritas.operators.ood import test_split, with_label, with_text
from paritas.operators.prepare import prepare_comments
from paritas.operators.split import sample_rows
from paritas.session import written
from paritas.sources.files import file_numbers, path_below

# File of each split below the data root.
SPLIT_FILES = {"train": "train.csv.gz", "test": "test_private_expanded.csv.gz"}

# Texts that stand for a missing number.
NO_NUMBER = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A")

#: Share of malformed records that are left out before reading fails.
TOLERATED = 0.01
#: Files up to which their table of numbers, some 100 bytes each, is sent to every task.
BROADCAST_FILES = 500_000
_RECORD = "_malformed_record"

log = logging.getLogger(__name__)


def comment_file(root: str, split: str) -> str:
    if split not in SPLIT_FILES:
        raise ValueError(f"unknown split {split!r}, expected one of {sorted(SPLIT_FILES)}")
    return f"{root.rstrip('/')}/{SPLIT_FILES[split]}"


class Comments(NamedTuple):
    """Sound rows with typed columns, and what was wrong with the others."""

    rows: DataFrame
    quarantine: DataFrame


def _problems(raw: DataFrame, numbers: Sequence[str]) -> Column:
    """What keeps a record from being read, as (column, value); the column is null and the
    value the whole record if it has too few fields or too many."""

    def unread(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        bad = _number(value).isNotNull() & _number(value).try_cast(kind).isNull()
        return F.when(bad, F.struct(F.lit(name).alias("column"), value.alias("value")))

    broken = F.when(
        F.col(_RECORD).isNotNull(),
        F.struct(F.lit(None).cast("string").alias("column"), F.col(_RECORD).alias("value")),
    )
    whole = [unread("id", "long")] if "id" in raw.columns else []
    fields = F.array_compact(F.array(*whole, *[unread(n, "double") for n in numbers]))
    return F.when(F.col(_RECORD).isNotNull(), F.array(broken)).otherwise(fields)


def _number(text: Column) -> Column:
    """The text of a number; null where one of the usual words for nothing stands."""
    return F.when(~F.trim(text).isin(*NO_NUMBER), F.trim(text))


def parse_comments(
    spark: SparkSession, root: str, split: str = "train", partitions: int | None = None
) -> Comments:
    """The comment table, matched to its header by name, and (file, record, id, column,
    value) of every field of it that is no number where one belongs.

    A gzip file is read by one task, so its records are spread over the cluster right
    away and landed in the shared folder, from where rows and quarantine are read. A
    record's number counts from 0 in its file and does not count the header.
    """
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    path = comment_file(root, split)
    names = read.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RECORD]])
    # Without pruning, so that a record's fields are counted.
    raw = (
        read.schema(schema)
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("columnPruning", False)
        .csv(path)
    )
    numbers = [c for c in ["target", *present_identities(names)] if c in names]
    parsed = raw.select(
        F.col("_metadata.file_name").alias("_file"),
        F.monotonically_increasing_id().alias("_place"),
        (F.col("id") if "id" in names else F.lit(None).cast("string")).alias("_raw_id"),
        _problems(raw, numbers).alias("_problems"),
        *[_number(F.col(c)).try_cast("long").alias(c) for c in ["id"] if c in names],
        *[c for c in ["comment_text"] if c in names],
        *[_number(F.col(f"`{c}`")).try_cast("double").alias(c) for c in numbers],
    )
    parts = partitions or spark.sparkContext.defaultParallelism
    landed = written(parsed.repartition(parts), "comments")
    first = landed.groupBy("_file").agg(F.min("_place").alias("_first"))
    quarantine = (
        landed.where(F.size("_problems") > 0)
        .join(first, "_file")
        .select(
            F.col("_file").alias("file"),
            (F.col("_place") - F.col("_first")).alias("record"),
            F.col("_raw_id").alias("id"),
            F.inline("_problems"),
        )
    )
    rows = landed.where(F.size("_problems") == 0)
    return Comments(rows.drop("_file", "_place", "_raw_id", "_problems"), quarantine)


def read_comments(
    spark: SparkSession,
    root: str,
    split: str = "train",
    partitions: int | None = None,
    tolerated: float = TOLERATED,
) -> DataFrame:
    """The sound rows of :func:`parse_comments`. More than the tolerated share of others is
    an error that names the first of them."""
    comments = parse_comments(spark, root, split, partitions)
    bad = comments.quarantine.select("file", "record").distinct().count()
    total = bad + comments.rows.count()
    if bad > tolerated * total:
        example = comments.quarantine.orderBy("file", "record").first().asDict()
        raise ValueError(f"{bad} of {total} comments are malformed, the first is {example}")
    if bad:
        log.warning("%d of %d comments are malformed and left out", bad, total)
    return comments.rows


def load_comments(
    spark: SparkSession,
    root: str,
    split: str = "train",
    threshold: float = 0.5,
    clean_text: bool = True,
) -> DataFrame:
    """Read and prepare one split of the comment table."""
    return prepare_comments(read_comments(spark, root, split), threshold, clean_text)


def with_file_ids(table: DataFrame, root: str) -> DataFrame:
    """The table with an ``id``, made where it has none from file and row in the file.

    The upper half is the file's number among all files of the table, the lower half the
    row, so ids never repeat. They are the same whenever the same files are read, wherever
    the table lies, and so join predictions with labels and texts across jobs. One pass
    over the files' names finds the numbers; no row is shuffled as long as their table is
    small enough to be sent to every task.
    """
    if "id" in table.columns:
        return table
    files = table.select(path_below(root).alias("path")).distinct()
    numbers = written(file_numbers(files), "file-numbers").withColumnRenamed("path", "_path")
    if numbers.count() <= BROADCAST_FILES:
        numbers = F.broadcast(numbers)
    rows = table.select(
        path_below(root).alias("_path"), F.col("_metadata.row_index").alias("_row"), "*"
    )
    made = F.shiftleft("number", 32) + F.col("_row")
    return rows.join(numbers, "_path").select(made.alias("id"), *table.columns)


def read_ood(
    spark: SparkSession, paths: Sequence[str], sample: int = -1, id_column: str = "id"
) -> DataFrame:
    """The first readable out-of-domain table, with ``id``, ``label`` and ``text`` set.

    Only the first source is a mixed one that its own split column has to narrow;
    the sample, if asked for, is exact and reproducible. ``id_column`` names the id of a
    table that has one under another name.
    """
    failure: Exception | None = None
    for i, path in enumerate(paths):
        try:
            table = spark.read.parquet(path)
        except AnalysisException as error:
            failure = error
            continue
        if id_column != "id" and id_column in table.columns:
            table = table.drop("id").withColumnRenamed(id_column, "id")
        rows = with_file_ids(table, path)
        rows = test_split(rows) if i == 0 else rows
        return with_text(sample_rows(with_label(rows), sample))
    raise failure or ValueError("no out-of-domain source given")
