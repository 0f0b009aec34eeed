"""Registry and shorthand of the report queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import label_order, money_avg, money_sum, rate_where, rnd
from martloom.operators.ranking import share_of_total

# (mart, number) -> function of (stored mart, warehouse)
REPORTS: dict[tuple[str, int], Callable] = {}


def report(mart: str, number: int):
    def register(fn):
        REPORTS[(mart, number)] = fn
        return fn

    return register


def rows() -> Column:
    return F.count(F.lit(1))


def grouped(m: DataFrame, by: list, **aggs: Column) -> DataFrame:
    return m.groupBy(*by).agg(*[c.alias(name) for name, c in aggs.items()])


def whole(m: DataFrame, **aggs: Column) -> DataFrame:
    return m.agg(*[c.alias(name) for name, c in aggs.items()])


def mean(c: Column | str, digits: int = 2) -> Column:
    return rnd(F.avg(c), digits)


def total(c: Column | str) -> Column:
    return rnd(money_sum(c))


def money_mean(c: Column | str) -> Column:
    return rnd(money_avg(c))


def rate(c: str | Column) -> Column:
    return rate_where(F.col(c) if isinstance(c, str) else c)


def with_share(df: DataFrame, of: str, name: str) -> DataFrame:
    """Adds each group's percentage. The frame holds one row per group."""
    return df.withColumn(name, share_of_total(of))


def by_label(df: DataFrame, column: str, labels: list[str] | tuple[str, ...]) -> DataFrame:
    return df.orderBy(label_order(column, labels))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)
