"""Ranks, running totals and quantiles over a whole table, without a one-task window.

Two building blocks:

* ``value_profile`` reduces the table to one row per distinct value (map-side combined), range
  partitions those rows and turns per-partition totals into running totals. Tied rows share a
  profile row, which is what RANGE frames, RANK, DENSE_RANK and PERCENT_RANK need, and a value
  held by a third of the rows costs one profile row.
* ``global_position`` gives every row its place in a total order: range partition, sort inside
  partitions, then add the sizes of the partitions before. The order must end in a unique
  column; ties are then spread over partitions like any other rows.

Both settle the range-partitioned rows before partition totals are taken: the bounds of a range
exchange come from a sample, so the totals and the rows must come from the same run of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions import as_col, rnd
from martloom.operators.storage import settled, written

_IN_PARTITION = (1 << 33) - 1


def value_profile(
    df: DataFrame, value: str, sums: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """One row per distinct non-null ``value``.

    Columns: the value, ``n`` rows, ``cum_n`` rows up to and with it, ``dense_rank``, and
    ``cum_<c>`` for each summed column (integers, so that totals are exact).
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    per_value = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    )
    parts = settled(
        per_value.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    )
    counted = {"n": F.col("n"), "_one": F.lit(1), **{c: F.col(c) for c in sums}}
    # One row per range partition, so this window never sees more rows than partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_part")
        .agg(*[F.sum(c).alias(f"_t_{k}") for k, c in counted.items()])
        .select(
            "_part",
            *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in counted],
        )
    )
    inside = (
        Window.partitionBy("_part")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = {k: F.col(f"_b_{k}") + F.sum(c).over(inside) for k, c in counted.items()}
    # Bounded by the number of range partitions.
    return parts.join(F.broadcast(offsets), "_part").select(
        value,
        "n",
        running["n"].alias("cum_n"),
        running["_one"].alias("dense_rank"),
        *[running[c].alias(f"cum_{c}") for c in sums],
    )


def global_position(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Adds ``out`` (1-based place in ``order``) and ``total_rows``."""
    parts = settled(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = (
        parts.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(everything).alias("total_rows"),
        )
    )
    return (
        parts.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per range partition
        .withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(_IN_PARTITION) + 1)
        .drop("_part", "_id", "_before")
    )


def ntile_of(position: str, total: str, buckets: int) -> Column:
    """NTILE bucket of a position: the first ``total % buckets`` buckets get one row more."""
    r, n = F.col(position), F.col(total)
    size = F.floor(n / buckets)
    extra = n % buckets
    longer = extra * (size + 1)
    return F.when(r <= longer, F.ceil(r / (size + 1))).otherwise(
        extra + F.ceil(F.try_divide(r - longer, size))
    ).cast("bigint")


def with_ntile(df: DataFrame, order: Sequence[Column], buckets: int, out: str) -> DataFrame:
    placed = global_position(df, order, "_position")
    return placed.withColumn(out, ntile_of("_position", "total_rows", buckets)).drop(
        "_position", "total_rows"
    )


def quantiles(df: DataFrame, value: str, probs: Sequence[float], digits: int = 6) -> DataFrame:
    """One row with the exact interpolated quantiles ``q0``, ``q1``, … of the non-null values.

    Reads each quantile off the value profile, so no task ever holds the whole column.
    """
    profile = value_profile(df.select(value), value)
    n = profile.agg(F.max("cum_n").alias("n")).scalar()
    cols = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (n - 1)
        low = F.min(F.when(F.col("cum_n") > F.floor(place), F.col(value).cast("double")))
        high = F.min(F.when(F.col("cum_n") > F.ceil(place), F.col(value).cast("double")))
        cols.append((low, high, place - F.floor(place), f"q{i}"))
    grouped = profile.agg(
        *[c for lo, hi, _, name in cols for c in (lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi"))]
    )
    return grouped.select(
        *[
            rnd(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * w, digits)
            .alias(name)
            for _, _, w, name in cols
        ]
    )


def literals(one_row: DataFrame) -> dict[str, Column]:
    """The values of a one-row summary as literals, so that plans compare with constants."""
    row = one_row.first()
    return {
        f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema
    }


def quantile_scalars(df: DataFrame, value: str, probs: Sequence[float]) -> list[Column]:
    """The quantiles as constants, ready to be compared with a column."""
    found = literals(quantiles(df, value, probs))
    return [found[f"q{i}"] for i in range(len(probs))]


def share_of_total(c: Column | str, digits: int = 2) -> Column:
    """Percentage of the column total. Only for frames with a bounded number of rows."""
    c = as_col(c)
    return rnd(F.try_divide(c * 100.0, F.sum(c).over(Window.partitionBy()).cast("double")), digits)


def grouped_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5,
                     out: str | None = None) -> DataFrame:
    """Exact discrete quantile of ``value`` per group of ``keys``: the smallest value whose share of
    the group's n non-null values at or below it reaches q, that is the value at 1-based place
    ``max(ceil(n * q), 1)`` in ascending order (for q = 0.5 the lower median). One row per group that has a non-null value; null keys form groups of their own.

    Rows are reduced to one per (group, distinct value) with its count, range partitioned on
    (group, value) and written once, so a group with millions of distinct values is spread over many
    partitions. Per partition and group the counts are summed; running sums over those blocks (at
    most one row per partition a group) give each block's offset, and running counts inside a block
    give each value's place. No task ever holds a whole group.
    """
    out = out or value
    ks = list(keys) or ["_all"]
    keyed = df.where(F.col(value).isNotNull()).select(
        *([F.col(k) for k in keys] or [F.lit(0).alias("_all")]), F.col(value).alias("_v"))
    per_value = keyed.groupBy(*ks, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(
        per_value.repartitionByRange(*ks, "_v").withColumn("_part", F.spark_partition_id()), "quantile")
    by_key = Window.partitionBy(*ks)
    blocks = ranged.groupBy("_part", *ks).agg(F.sum("_n").alias("_block")).select(
        "_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)],
        F.coalesce(F.sum("_block").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_block").over(by_key).alias("_total"),
    )
    inside = Window.partitionBy("_part", *ks).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("_cum", F.sum("_n").over(inside))
    same = [running["_part"] == blocks["_part"]] + [running[k].eqNullSafe(blocks[f"_k{i}"]) for i, k in enumerate(ks)]
    joined = running.join(blocks, same)
    place = F.greatest(F.ceil(F.col("_total") * F.lit(float(q))), F.lit(1))
    cum = F.col("_before") + F.col("_cum")
    return joined.where((cum >= place) & (cum - F.col("_n") < place)).select(
        *[running[k] for k in keys], F.col("_v").alias(out))


def with_group_quantile(summary: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, out: str,
                        q: float = 0.5, digits: int | None = None) -> DataFrame:
    """``summary`` (one row per group of ``keys``, holding a placeholder column ``out``) with ``out``
    set to the exact quantile of ``value`` over ``rows`` of the group; null where a group has none."""
    found = grouped_quantile(rows, keys, value, q, "_q")
    found = found.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_q")
    same = [summary[k].eqNullSafe(found[f"_g{i}"]) for i, k in enumerate(keys)]
    if keys:
        joined = summary.join(found, same, "left")
    else:
        # One summary row and at most one quantile row: a left join on a constant.
        joined = summary.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one", "left")
    q_col = rnd(F.col("_q"), digits) if digits is not None else F.col("_q")
    return joined.select(*[q_col.alias(c) if c == out else F.col(c) for c in summary.columns])
