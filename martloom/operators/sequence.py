"""Order of rows inside a key, also when one key holds most of the table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.operators.storage import settled

#: Rows that ``dealt`` gives a task.
PER_TASK = 150_000


def sequence_within(df: DataFrame, key: str, order: Sequence[str], previous: str) -> DataFrame:
    """Adds ``seq`` (1-based place in the key) and ``previous_<previous>`` (value one row before).

    ``order`` must end in a unique column. Rows are range partitioned by key and order and numbered
    inside each partition, so a key of any size spreads over many tasks. A key that goes on in the
    next partitions carries its row count and last value over to them.
    """
    prev = f"previous_{previous}"
    parts = settled(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", key).orderBy(*order)
    numbered = parts.withColumn("seq", F.row_number().over(inside).cast("bigint")).withColumn(
        prev, F.lag(previous).over(inside)
    )
    # From here to the carried values every frame has at most two rows per range partition.
    k = F.col(key).alias("k")
    ends = parts.groupBy("_part").agg(F.min(F.struct(k)).alias("_first"), F.max(F.struct(k)).alias("_last"))
    before = F.lag("_last").over(Window.orderBy("_part"))
    going_on = (
        ends.withColumn("_before", before)
        .where("_before is not null and _first.k <=> _before.k")
        .select(F.col("_first.k").alias("_key"))
        .distinct()
    )
    pieces = (
        parts.join(F.broadcast(going_on), F.col(key).eqNullSafe(F.col("_key")))
        .groupBy("_part", "_key")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max_by(previous, F.struct(*order)).alias("_value"))
    )
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        F.col("_part").alias("_at"), "_key",
        F.sum("_rows").over(earlier).alias("_seen"), F.last("_value").over(earlier).alias("_carried"),
    ).where("_seen is not null")
    starts = F.col("_seen").isNotNull() & (F.col("seq") == 1)
    return (
        numbered.join(
            F.broadcast(carried), (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left"
        )
        .withColumn(prev, F.when(starts, F.col("_carried")).otherwise(F.col(prev)))
        .withColumn("seq", F.col("seq") + F.coalesce("_seen", F.lit(0)))
        .select(*df.columns, "seq", prev)
    )


def parts(spark: SparkSession, rows: int) -> int:
    """The number of partitions that ``rows`` rows are dealt into."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / PER_TASK))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt by ``key`` into partitions of about ``PER_TASK`` of its ``rows``.

    The number of partitions grows with the table and adaptive execution keeps it, so what a task
    sorts does not grow; grouping and joining on ``key`` (and more) later needs no other shuffle.
    A table that is stored in as many buckets of ``key`` is not shuffled at all.
    """
    return df.repartition(parts(df.sparkSession, rows), key)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key. Spark cuts each key to one row per map task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")


def most_frequent(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Mode of ``value`` per key; NULLs do not count, ties go to the largest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return counts.groupBy(key).agg(F.max_by(value, F.struct("_n", value)).alias(out))


def distinct_count(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """COUNT(DISTINCT value) per key as dedup, then count: no hot key, no row expansion."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(key, value)
        .agg(F.lit(1).alias("_one"))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias(out))
    )
