"""Fact tables that the marts share. Each is stored once; no mart joins payments, reviews or items
to orders again.

* order facts: one row per order with the sums of its payments, reviews and items. Every child is
  reduced to one row per order before the join, so no child multiplies another.
* item facts: one row per item with its order's customer and time and its product's category.
* payment facts: one row per payment with its order's customer and status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions import cents
from martloom.operators.sequence import dealt


def completed(facts: DataFrame) -> DataFrame:
    return facts.where("is_completed")


def order_facts(
    orders: DataFrame, payments: DataFrame, reviews: DataFrame, items: DataFrame, rows: int | None = None
) -> DataFrame:
    """Payment, review and item columns are NULL for orders without such rows.

    Every table is dealt once by order into the same partitions, whose number grows with the child
    rows (or with ``rows``, which also sized the stored buckets of orders, payments and items; these
    are then not shuffled); the sums, the distinct products and the joins all work inside them.
    """
    size = rows or max(payments.count(), items.count())

    def by_order(df: DataFrame, *columns: str) -> DataFrame:
        return dealt(df.select(*columns), "order_id", size)

    opening = F.min(F.struct("payment_sequential", "payment_type", "payment_installments", "payment_value"))
    paid = by_order(
        payments, "order_id", "payment_sequential", "payment_type", "payment_installments",
        "payment_value", "is_credit_card", "is_boleto",
    ).groupBy("order_id").agg(
        F.sum(cents("payment_value")).alias("paid_c"),
        F.count(F.lit(1)).alias("payments"),
        F.max("payment_value").alias("max_payment"),
        F.min("payment_value").alias("min_payment"),
        F.max(F.struct("payment_value", "payment_type"))["payment_type"].alias("primary_method"),
        F.sum("payment_installments").alias("installments"),
        F.max("payment_installments").alias("max_installments"),
        # At most one entry per payment type.
        F.sort_array(F.collect_set("payment_type")).alias("payment_methods"),
        F.count_if("is_credit_card").alias("credit_card_payments"),
        F.count_if("is_boleto").alias("boleto_payments"),
        opening.alias("opening"),
    )
    latest = F.struct("review_creation_date", "review_id")
    reviewed = by_order(
        reviews, "order_id", "review_id", "review_score", "review_comment_message",
        "review_creation_date", "has_comment",
    ).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.sum("review_score").alias("score"),
        F.count_if("has_comment").alias("commented"),
        F.count_if(F.col("review_score") >= 4).alias("positive"),
        F.count_if(F.col("review_score") <= 2).alias("negative"),
        F.max_by("review_score", latest).alias("review_score"),
        F.max_by("review_comment_message", latest).alias("review_comment_message"),
    )
    bought = by_order(
        items, "order_id", "product_id", "seller_id", "price", "freight_value"
    ).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(cents("price")).alias("price_c"),
        F.sum(cents("freight_value")).alias("freight_c"),
        F.count_distinct("product_id").alias("products"),
        F.max(F.struct("price", "seller_id"))["seller_id"].alias("main_seller_id"),
    )
    return (
        by_order(orders, *orders.columns).join(paid, "order_id", "left")
        .join(reviewed, "order_id", "left")
        .join(bought, "order_id", "left")
        .withColumns({
            "opening_method": F.col("opening.payment_type"),
            "opening_installments": F.col("opening.payment_installments"),
            "opening_value": F.col("opening.payment_value"),
        })
        .drop("opening")
    )


def item_facts(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """``category`` is NULL for a product that is not known."""
    return (
        items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
        .join(orders.select("order_id", "customer_id", "order_purchase_timestamp", "is_completed"), "order_id")
        .join(products.select("product_id", F.col("product_category_name_english").alias("category")),
              "product_id", "left")
    )


def payment_facts(payments: DataFrame, orders: DataFrame) -> DataFrame:
    return payments.select(
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"
    ).join(orders.select("order_id", "customer_id", "is_completed", "is_canceled"), "order_id")


def categorised(items: DataFrame) -> DataFrame:
    """Completed items of known categories."""
    return completed(items).where(F.col("category").isNotNull())
