"""Staging and order facts deal their rows by order into partitions that grow with the table."""

import re

from pyspark.sql import functions as F

import pytest

from martloom.operators import sequence
from martloom.operators.sequence import dealt
from martloom.plans import common
from martloom.plans.warehouse import Warehouse


def test_partitions_grow_with_the_rows(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    few, many = (dealt(df, "k", rows).rdd.getNumPartitions() for rows in (10, 15_000_000))
    assert (few, many) == (spark.sparkContext.defaultParallelism, 100)


def test_order_facts_shuffle_every_table_once(layers):
    facts = common.order_facts(*[layers.stg(t) for t in ("orders", "payments", "reviews", "order_items")])
    plan = facts._jdf.queryExecution().executedPlan().toString()
    # Orders, payments, reviews and items; distinct products and the joins need no other shuffle.
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", plan)) == 4
    assert len(re.findall(r"(?<!Broadcast)Exchange", plan)) == 4


def test_distinct_products_and_first_payment(layers):
    facts = layers.facts("orders")
    items, payments = layers.stg("order_items"), layers.stg("payments")
    want = items.groupBy("order_id").agg(F.count_distinct("product_id").alias("p"), F.count("*").alias("n")).join(
        payments.groupBy("order_id").agg(F.min("payment_sequential").alias("s"), F.max("payment_value").alias("v")),
        "order_id").join(payments.select(
            "order_id", F.col("payment_sequential").alias("s"), F.col("payment_type").alias("t")), ["order_id", "s"])
    got = facts.select("order_id", "products", "items", "max_payment", "opening_method")
    assert want.count() > 0
    assert want.select("order_id", "p", "n", "v", "t").exceptAll(got).count() == 0


@pytest.fixture
def bucketed(spark, layers, monkeypatch):
    """The layers as a table far above 150,000 rows has them: no broadcasts, many partitions."""
    monkeypatch.setattr(sequence, "PER_TASK", 300)
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, -1)
    yield Warehouse(spark, layers.raw, layers.cfg)
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((\w+)#", plan)


@pytest.mark.parametrize("name", ["payments", "order_items"])
def test_rows_below_orders_are_shuffled_once(bucketed, name):
    # A semi join would run below the dealing and shuffle the rows twice.
    bucketed.stg("orders")
    assert exchanges(bucketed.staging_plan(name)) == ["order_id"]


def test_order_facts_read_buckets_without_a_shuffle(bucketed, layers):
    tables = [bucketed.stg(t) for t in ("orders", "payments", "reviews", "order_items")]
    assert len(set(f.rsplit("_", 1)[-1] for f in tables[0].inputFiles())) == sequence.parts(
        bucketed.spark, bucketed.order_rows()) > 4
    facts = common.order_facts(*tables, bucketed.order_rows())
    assert exchanges(facts) == ["order_id"]  # the reviews
    assert exchanges(common.payment_facts(tables[1], tables[0])) == []
    for name in ("orders", "items", "payments"):
        got, want = bucketed.facts(name), layers.facts(name)
        assert got.schema == want.schema
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
