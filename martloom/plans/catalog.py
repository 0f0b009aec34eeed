"""Every mart by name, with the tables it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from martloom.plans import advanced, customer, financial, operational
from martloom.plans.warehouse import Warehouse

MARTS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "customer_base": lambda w: customer.mart_customer_base(
        w.customers(), w.facts("orders"), w.facts("items"), w.cfg
    ),
    "customer_rfm": lambda w: customer.mart_customer_rfm(w.mart("customer_base"), w.cfg),
    "customer_ltv": lambda w: customer.mart_customer_ltv(w.customers(), w.facts("orders"), w.cfg),
    "customer_cohort_retention": lambda w: customer.mart_customer_cohort_retention(w.facts("orders")),
    "customer_segments": lambda w: customer.mart_customer_segments(
        w.mart("customer_base"), w.mart("customer_rfm"), w.mart("customer_ltv"),
        w.mart("delivery_performance"), w.facts("orders"), w.facts("items"), w.facts("payments"),
    ),
    "customer_age": lambda w: customer.mart_customer_age(w.mart("customer_base"), w.cfg),
    "churn_prediction": lambda w: customer.mart_churn_prediction(
        w.facts("orders"), w.facts("items"), w.facts("payments"), w.customers(),
        w.mart("customer_rfm"), w.cfg,
    ),
    "aov_analysis": lambda w: financial.mart_aov_analysis(w.facts("orders"), w.customers(), w.cfg),
    "geographic_performance": lambda w: financial.mart_geographic_performance(w.mart("customer_ltv")),
    "revenue_summary": lambda w: financial.mart_revenue_summary(w.facts("orders")),
    "unit_economics": lambda w: financial.mart_unit_economics(
        w.mart("customer_ltv"), w.mart("customer_rfm"), w.facts("items"), w.cfg
    ),
    "category_performance": lambda w: operational.mart_category_performance(w.facts("items")),
    "delivery_performance": lambda w: operational.mart_delivery_performance(
        w.facts("orders"), w.customers(), w.stg("sellers")
    ),
    "payment_analysis": lambda w: operational.mart_payment_analysis(w.facts("orders")),
    "installment_analysis": lambda w: operational.installment_analysis(w.facts("orders")),
    "repeat_purchase": lambda w: operational.mart_repeat_purchase(w.facts("orders"), w.cfg),
    "seller_performance": lambda w: operational.mart_seller_performance(
        w.facts("items"), w.facts("orders"), w.stg("sellers"), w.mart("delivery_performance")
    ),
    "revenue_cohort": lambda w: advanced.mart_revenue_cohort(w.facts("orders")),
    "payment_cohort": lambda w: advanced.mart_payment_cohort(
        w.facts("orders"), w.facts("payments"), w.cfg
    ),
    "purchase_frequency": lambda w: advanced.mart_purchase_frequency(w.facts("orders"), w.cfg),
    "nps_cohort": lambda w: advanced.mart_nps_cohort(
        w.stg("reviews"), w.orders(), w.mart("customer_base")
    ),
    "propensity_scores": lambda w: advanced.mart_propensity_scores(
        w.customers(), w.facts("orders"), w.facts("items"), w.facts("payments"), w.cfg
    ),
}
