"""Reproducible shuffles without a global sort.

Rows are ordered by the md5 of (seed, id), then by id. That order is a function
of the row alone: it does not depend on partitioning, file order or retries. The
leading hex digits of the hash cut the table into even buckets, so an exact
position is the number of rows in the buckets before plus the position inside one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Four hex digits: at most 65,536 buckets, the size bound of every table that is
# broadcast or windowed as a whole below. Hashes are even, so 10^11 rows still
# give buckets of about 1.5 million narrow rows.
HEX_DIGITS = 4


def shuffle_key(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def _bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, HEX_DIGITS), 16, 10).cast("int")


def _keys(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    key = shuffle_key(F.col(id_col), seed)
    return df.select(F.col(id_col).alias("_id"), key.alias("_key")).withColumn(
        "_bucket", _bucket(F.col("_key"))
    )


def _bucket_offsets(keys: DataFrame) -> DataFrame:
    """(_bucket, n, before, total): one row per hash bucket, 65,536 at most, which
    is why a window over the whole of it is safe."""
    counts = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    return counts.select(
        "_bucket",
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(everything).alias("total"),
    )


def with_shuffle_position(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Add ``position``, the 0-based place of each row in the shuffled table."""
    keyed = df.withColumn("_key", shuffle_key(F.col(id_col), seed)).withColumn(
        "_bucket", _bucket(F.col("_key"))
    )
    offsets = _bucket_offsets(_keys(df, id_col, seed)).select("_bucket", "before")
    local = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", id_col))
    return (
        keyed.withColumn("_local", local)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("position", F.col("before") + F.col("_local") - 1)
        .drop("_key", "_bucket", "_local", "before")
    )


def precedes(
    df: DataFrame,
    limits: Sequence[Callable[[Column], Column]],
    id_col: str = "id",
    seed: int = 42,
) -> list[Column]:
    """For each limit, a condition that holds for the first ``limit`` rows in
    shuffle order.

    A limit is a function from the row count to a position. The rows at those
    positions are located from a scan of the id column alone: bucket counts first,
    then an exact order inside only the buckets that contain a limit. What comes
    back is one value to compare with, so wide rows are neither sorted nor
    shuffled, whatever the limit is.
    """
    keys = _keys(df, id_col, seed)
    total = F.col("total")
    wanted = F.array(*[limit(total).cast("long") for limit in limits])
    # At most one row per limit.
    points = (
        _bucket_offsets(keys)
        .select("_bucket", "n", "before", F.posexplode(wanted).alias("cut", "k"))
        .where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n")))
        .select("_bucket", "cut", (F.col("k") - F.col("before")).alias("offset"))
    )
    in_bucket = W.partitionBy("cut", "_bucket").orderBy("_key", "_id")
    at_cut = (
        keys.join(F.broadcast(points), "_bucket")
        .withColumn("place", F.row_number().over(in_bucket) - 1)
        .where(F.col("place") == F.col("offset"))
    )
    row = F.struct("_key", "_id")
    cuts = at_cut.agg(
        F.struct(
            *[
                F.max(F.when(F.col("cut") == i, row)).alias(f"c{i}")
                for i in range(len(limits))
            ]
        ).alias("cuts")
    ).scalar()
    here = F.struct(
        shuffle_key(F.col(id_col), seed).alias("_key"), F.col(id_col).alias("_id")
    )
    # No row stands at a limit beyond the end: then every row precedes it.
    return [
        F.coalesce(here < cuts.getField(f"c{i}"), F.lit(True)) for i in range(len(limits))
    ]
