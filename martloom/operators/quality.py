"""Data-quality operators: null shares, key and foreign-key checks, outlier counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions import rate_where, rnd
from martloom.operators.ranking import quantiles


def null_profile(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and percentage of NULLs per column, in one pass."""
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("total_rows"),
        *[rate_where(F.col(c).isNull(), 4).alias(f"pct_null_{c}") for c in columns or df.columns],
    )


def key_check(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows, distinct keys, keys that occur more than once, rows with a NULL key part."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.lit(name).alias("table_name"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.count_if(F.col("n") > 1).alias("duplicated_keys"),
            F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_key_rows"),
        )
    )


def fk_check(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows without a parent. Parents must be unique on the key."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    marked = per_key.join(parent.select(key, F.lit(True).alias("_found")), key, "left")
    return marked.agg(
        F.lit(name).alias("relation"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"),
    )


def iqr_outliers(df: DataFrame, value: str) -> DataFrame:
    """Quartile fence and the number of values outside it."""
    q = quantiles(df, value, [0.25, 0.75])
    fence = q.select(
        F.struct(
            "q0", "q1",
            (F.col("q0") - 1.5 * (F.col("q1") - F.col("q0"))).alias("low"),
            (F.col("q1") + 1.5 * (F.col("q1") - F.col("q0"))).alias("high"),
        ).alias("f")
    ).scalar()
    return df.select(F.col(value).alias("v"), fence.alias("f")).agg(
        F.max("f.q0").alias("q1"),
        F.max("f.q1").alias("q3"),
        rnd(F.max("f.low"), 6).alias("lower_fence"),
        rnd(F.max("f.high"), 6).alias("upper_fence"),
        F.count_if((F.col("v") < F.col("f.low")) | (F.col("v") > F.col("f.high"))).alias("outliers"),
    )
