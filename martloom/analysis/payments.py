"""Payment behaviour: methods, funnel, installments, correlations."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.analysis.common import analysis
from martloom.functions import (
    day_diff, from_cents, money_avg, money_sum, pearson, ratio, rnd,
)
from martloom.operators.ranking import share_of_total
from martloom.reports.common import grouped, mean, rows

NUMERIC = ("payment_installments", "payment_value", "aov", "review_score", "approval_days", "total_items")


def payment_measures(w) -> DataFrame:
    """One row per payment with its order's value, status, review and size; stored once."""
    def build():
        orders = w.facts("orders").select(
            "order_id", from_cents("paid_c").alias("aov"),
            F.col("order_approved_at").isNotNull().cast("int").alias("approved"),
            F.col("is_delivered").cast("int").alias("delivered"), "review_score",
            day_diff("order_approved_at", "order_purchase_timestamp").alias("approval_days"),
            F.coalesce("items", F.lit(0)).alias("total_items"))
        return w.facts("payments").select(
            "order_id", "payment_type", "payment_installments", "payment_value").join(orders, "order_id")

    return w.keep("payment_measures", build)


@analysis("pay_method_summary")
def method_summary(w):
    g = grouped(payment_measures(w), ["payment_type"], order_count=rows(),
                avg_payment_value=rnd(money_avg("payment_value"), 3),
                total_payment_value=money_sum("payment_value"),
                avg_installments=mean("payment_installments", 3), avg_aov=rnd(money_avg("aov"), 3),
                approval_rate=mean("approved", 3), delivery_rate=mean("delivered", 3),
                avg_review_score=mean("review_score", 3))
    return g.withColumns({"order_share": share_of_total("order_count", 6),
                          "revenue_share": share_of_total("total_payment_value", 6)})


@analysis("pay_funnel")
def funnel(w):
    """Share of payments that reach approval and delivery, and where the others stop."""
    g = grouped(payment_measures(w), ["payment_type"], orders=rows(), approved=F.sum("approved"),
                delivered=F.sum("delivered"))
    delivered = rnd(ratio("delivered", "orders"), 3)
    return g.select(
        "*", rnd(ratio("approved", "orders"), 3).alias("approval_rate"),
        delivered.alias("delivery_rate"), delivered.alias("conversion_rate"),
        rnd(1 - ratio("approved", "orders"), 3).alias("drop_at_approval"),
        rnd(ratio(F.col("approved") - F.col("delivered"), "orders"), 3).alias("drop_at_delivery"))


@analysis("pay_installments")
def installments(w):
    return grouped(payment_measures(w), ["payment_installments"], order_count=rows(),
                   payment_value=rnd(money_avg("payment_value"), 3), aov=rnd(money_avg("aov"), 3),
                   approved=mean("approved", 3), review_score=mean("review_score", 3)
                   ).orderBy("payment_installments")


@analysis("pay_correlations")
def correlations(w):
    """Pearson correlation of each pair of measures, every pair over its complete rows."""
    pairs = list(combinations_with_replacement(NUMERIC, 2))
    row = payment_measures(w).agg(*[rnd(pearson(a, b), 6).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("measure"), F.lit(b).alias("other"), F.col(f"{a}|{b}").alias("correlation"))
             for a, b in pairs]
    return row.select(F.inline(F.array(*cells)))
