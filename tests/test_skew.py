"""One customer owns a third of all orders: the numbering of the sequence is that of a window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from martloom.operators import sequence
from martloom.plans import advanced, customer, financial
from martloom.plans.warehouse import Warehouse
from martloom.sources.star import star_tables


def windowed(df, key, order, previous):
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("seq", F.row_number().over(w).cast("bigint")).withColumn(
        f"previous_{previous}", F.lag(previous).over(w))


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    tables = star_tables(spark, sf_dir)
    tables["orders"] = tables["orders"].withColumn(
        "customer_id", F.when(F.col("order_id") % 3 == 0, 1).otherwise(F.col("customer_id")))
    return tables


@pytest.mark.parametrize("mart", ["aov_analysis", "churn_prediction", "propensity_scores", "repeat_purchase"])
def test_same_rows_either_way(spark, raw, mart, monkeypatch):
    spread = Warehouse(spark, raw, entry.CONFIG).mart(mart)
    for module in (advanced, customer, financial):
        assert module.sequence_within is sequence.sequence_within
        monkeypatch.setattr(module, "sequence_within", windowed)
    plain = Warehouse(spark, raw, entry.CONFIG).mart(mart)
    assert spread.count() == plain.count() > 0
    assert spread.exceptAll(plain).count() == 0
