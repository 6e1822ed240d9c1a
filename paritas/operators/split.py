"""Exact train and evaluation splits, slices and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators.ordering import precedes

TRAIN_SHARE = 0.9


def _train_rows(total: Column) -> Column:
    return F.floor(F.lit(TRAIN_SHARE) * total.cast("double"))


def _at_most(n: int, available: Column) -> Column:
    """The wanted number of rows: 0 or less means all of them."""
    return F.least(F.lit(n).cast("long"), available) if n > 0 else available


def split_train_eval(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Add ``split``: the first 90 % of the shuffled rows train, the rest eval."""
    (in_train,) = precedes(df, [_train_rows], id_col, seed)
    return df.withColumn("split", F.when(in_train, F.lit("train")).otherwise(F.lit("eval")))


def train_eval_slices(
    df: DataFrame,
    train_n: int = 20_000,
    eval_n: int = 5_000,
    id_col: str = "id",
    seed: int = 42,
) -> DataFrame:
    """The split, reduced to the first ``train_n`` training and ``eval_n``
    evaluation rows of the shuffled table."""
    train_end, in_train, eval_end = precedes(
        df,
        [
            lambda total: _at_most(train_n, _train_rows(total)),
            _train_rows,
            lambda total: _train_rows(total) + _at_most(eval_n, total - _train_rows(total)),
        ],
        id_col,
        seed,
    )
    split = F.when(train_end, F.lit("train")).when(~in_train & eval_end, F.lit("eval"))
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def truncate_then_split(
    df: DataFrame, n: int = -1, id_col: str = "id", seed: int = 42
) -> DataFrame:
    """Keep the first ``n`` shuffled rows, then split those 90/10."""
    in_train, kept = precedes(
        df,
        [
            lambda total: _train_rows(_at_most(n, total)),
            lambda total: _at_most(n, total),
        ],
        id_col,
        seed,
    )
    split = F.when(in_train, F.lit("train")).when(kept, F.lit("validation"))
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def sample_rows(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement; all rows when ``n`` is 0 or less,
    or not below the size of the table."""
    if n <= 0:
        return df
    (kept,) = precedes(df, [lambda total: _at_most(n, total)], id_col, seed)
    return df.where(kept)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_leakage(train: DataFrame, evaluation: DataFrame, id_col: str = "id") -> DataFrame:
    """How many evaluation rows also occur in a training table."""
    return (
        evaluation.select(id_col)
        .join(train.select(id_col), id_col, "left_semi")
        .agg(F.count(F.lit(1)).alias("leaked"))
    )
