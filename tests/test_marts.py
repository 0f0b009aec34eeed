import datetime as dt

import pytest
from contracts import CONTRACTS
from pyspark.sql import Window
from pyspark.sql import functions as F

from martloom.config import MartConfig
from martloom.plans.catalog import MARTS
from martloom.plans.warehouse import Warehouse
from test_staging import order, raw, ts

CFG = MartConfig(as_of=dt.date(2018, 9, 1))


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns(layers, name):
    assert layers.mart(name).columns == CONTRACTS[name].split()


def test_every_mart_has_a_contract():
    assert set(CONTRACTS) | {"installment_analysis"} == set(MARTS)


@pytest.fixture(scope="module")
def small(spark):
    """One order with two payments, three items and two reviews; two more plain orders."""
    tables = {
        "customers": raw(spark, "customers", [("c1", "c1", 2000, "x", "SP"), ("c2", "c2", 3000, "x", "RJ")]),
        "sellers": raw(spark, "sellers", [("s1", 2500, "x", "SP"), ("s2", 2600, "y", "MG")]),
        "products": raw(spark, "products", [("p1", "a", 1, 1, 1, 1.0, 1.0, 1.0, 1.0), ("p2", "b", 1, 1, 1, 1.0, 1.0, 1.0, 1.0)]),
        "category_translation": raw(spark, "category_translation", [("a", "alpha"), ("b", "beta")]),
        "orders": raw(spark, "orders", [order("o1", 0, 1, 2, 12, 9, customer="c1"),
                                        order("o2", 40, 41, 42, 45, 60, customer="c1"),
                                        order("o3", 5, 6, 7, None, 30, customer="c2", status="invoiced")]),
        "payments": raw(spark, "payments", [("o1", 1, "voucher", 1, 10.0), ("o1", 2, "credit_card", 4, 50.0),
                                            ("o2", 1, "boleto", 1, 20.0), ("o3", 1, "boleto", 1, 5.0)]),
        "reviews": raw(spark, "reviews", [("r1", "o1", 1, None, "bad", ts(13), None), ("r2", "o1", 4, None, None, ts(20), None),
                                          ("r3", "o2", 5, None, None, ts(50), None)]),
        "order_items": raw(spark, "order_items", [
            ("o1", 1, "p1", "s1", ts(3), 20.0, 2.0), ("o1", 2, "p1", "s1", ts(3), 10.0, 1.0),
            ("o1", 3, "p2", "s2", ts(3), 25.0, 2.0), ("o2", 1, "p2", "s2", ts(44), 18.0, 2.0)]),
    }
    return Warehouse(spark, tables, CFG)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_children_do_not_multiply_each_other(small):
    base = by(small.mart("customer_base"), "customer_id")["c1"]
    assert (base.total_orders, base.total_revenue, base.total_items_purchased, base.total_reviews) == (2, 80.0, 4, 3)
    assert (base.total_freight_paid, base.unique_products_purchased, base.unique_sellers_purchased_from) == (7.0, 2, 2)
    assert base.preferred_payment_method == "credit_card" and base.delayed_orders == 1
    aov = by(small.mart("aov_analysis"), "order_id")
    assert (aov["o1"].order_value, aov["o1"].items_per_order, aov["o1"].total_freight_value) == (60.0, 3, 5.0)
    assert aov["o1"].payment_methods_used == ["credit_card", "voucher"] and aov["o1"].payment_method_segment == "mixed"
    assert (aov["o1"].customer_order_sequence, aov["o2"].customer_order_sequence) == (1, 2)
    assert aov["o3"].items_bin == "many_items" and aov["o3"].avg_item_price == 0.0
    churn = by(small.mart("churn_prediction"), "customer_id")
    assert (churn["c1"].total_spent, churn["c1"].total_orders, churn["c1"].avg_days_between_purchases) == (80.0, 2, 40.0)
    assert churn["c2"].stddev_days_between_purchases == 0.0 and churn["c2"].num_categories_purchased == 0
    propensity = by(small.mart("propensity_scores"), "customer_id")["c1"]
    assert (propensity.monetary, propensity.first_purchase_value, propensity.total_reviews) == (80.0, 60.0, 2)


def test_customers_without_a_risk_rank_first(spark):
    tables = {
        "customers": raw(spark, "customers", [(c, c, 2000, "x", "SP") for c in ("a", "b", "c")]),
        "products": raw(spark, "products", []), "category_translation": raw(spark, "category_translation", []),
        "orders": raw(spark, "orders", [order("o1", 0, 1, 2, 3, 9, customer="a"), order("o2", 100, 101, 102, 103, 150, customer="b"),
                                        order("o3", 50, 51, 52, 53, 90, customer="c")]),
        "payments": raw(spark, "payments", [("o1", 1, "boleto", 1, 10.0), ("o2", 1, "boleto", 1, 20.0)]),
        "reviews": raw(spark, "reviews", []), "order_items": raw(spark, "order_items", []),
    }
    # One order each, so the frequency score and with it every risk is NULL.
    rows = by(Warehouse(spark, tables, CFG).mart("churn_prediction"), "customer_id")
    assert {r.churn_risk_percentile_pct for r in rows.values()} == {0.0}
    assert all(r.churn_risk_score is None and r.frequency_score is None for r in rows.values())


def test_one_delivery_row_per_order_with_the_latest_review(small):
    rows = by(small.mart("delivery_performance"), "order_id")
    assert set(rows) == {"o1", "o2"}
    o1 = rows["o1"]
    assert (o1.review_score, o1.seller_id, o1.freight_value, o1.delivery_delay) == (4, "s2", 5.0, 3)
    assert (o1.delay_severity, o1.delivery_route, o1.is_same_state_delivery) == ("1-3 days late", "MG → SP", False)
    assert rows["o2"].delay_severity == "On Time"


def test_trend_compares_last_with_first_review(small):
    nps = by(small.mart("nps_cohort"), "customer_id")["c1"]
    assert (nps.nps_trend, nps.score_volatility, nps.total_reviews) == ("Improving", 4, 3)
    assert nps.primary_nps_category == "Promoter" and nps.is_recovered_detractor == 1


def test_repeat_timing(small):
    rows = by(small.mart("repeat_purchase"), "customer_id")
    assert (rows["c1"].days_to_second_purchase, rows["c1"].days_to_second_purchase_bin) == (40, "31-60")
    assert rows["c2"].days_to_second_purchase_bin == "no_second_purchase" and rows["c2"].second_purchase_date is None


def test_seller_figures_count_item_rows(small):
    rows = by(small.mart("seller_performance"), "seller_id")
    assert (rows["s2"].seller_revenue, rows["s2"].seller_orders, rows["s2"].seller_total_reviews) == (43.0, 2, 3)
    assert rows["s1"].primary_category == "alpha" and rows["s1"].revenue_rank == 2


def test_retention_counts_the_month_after(small):
    cells = {(r.cohort_month, r.months_since_first_purchase): r for r in small.mart("customer_cohort_retention").collect()}
    assert cells[("2018-01", 0)].retained_customers == 2 and cells[("2018-01", 0)].cohort_revenue == 65.0
    assert cells[("2018-01", 1)].retention_rate == 50.0 and cells[("2018-01", 1)].cumulative_revenue == 85.0


# --- invariants on the supplied data -------------------------------------------------------

def test_shares_add_up(layers):
    for mart, column in (("category_performance", "category_share"), ("payment_analysis", "order_share_pct"),
                         ("geographic_performance", "revenue_concentration_pct"), ("seller_performance", "revenue_share_pct")):
        assert layers.mart(mart).agg(F.sum(column)).first()[0] == pytest.approx(100, abs=0.2), mart


def test_every_grain_has_the_same_revenue(layers):
    totals = {r.time_period: round(r.v, 2) for r in layers.mart("revenue_summary").groupBy("time_period").agg(
        F.sum("total_revenue").alias("v")).collect()}
    done = layers.orders().where("is_completed").select("order_id")
    source = layers.stg("payments").join(done, "order_id").agg(F.sum("payment_value")).first()[0]
    assert len(totals) == 3 and set(totals.values()) == {round(source, 2)}


def test_retention_starts_at_100_and_revenue_grows(layers):
    m = layers.mart("customer_cohort_retention")
    assert m.where("months_since_first_purchase = 0 and retention_rate <> 100").count() == 0
    w = Window.partitionBy("cohort_month").orderBy("months_since_first_purchase")
    steps = m.withColumn("d", F.col("cumulative_revenue") - F.lag("cumulative_revenue").over(w))
    assert steps.where("d < 0").count() == 0


def test_one_row_per_customer(layers):
    for mart in ("customer_base", "customer_rfm", "customer_ltv", "customer_segments", "churn_prediction",
                 "repeat_purchase", "payment_cohort", "purchase_frequency", "nps_cohort", "propensity_scores"):
        df = layers.mart(mart)
        assert df.count() == df.select("customer_id").distinct().count() > 0, mart


def test_pareto_curve_ends_at_one(layers):
    m = layers.mart("purchase_frequency")
    r = m.agg(F.max("cumulative_revenue_pct").alias("r"), F.max("cumulative_customer_pct").alias("c")).first()
    assert (r.r, r.c) == (1.0, 100.0)


def test_rebuild_gives_the_same_rows(layers):
    for mart in ("customer_rfm", "churn_prediction", "purchase_frequency"):
        again = layers.mart_plan(mart)
        assert again.exceptAll(layers.mart(mart)).count() == 0


def single_task_feeds(plan: str) -> list[str]:
    """The first operator below each exchange that gathers everything in one task."""
    lines = [line.lstrip(" :+-*()0123456789") for line in plan.splitlines()]
    feeds = []
    for i, line in enumerate(lines):
        if line.startswith("Exchange SinglePartition"):
            feeds.append(next(x for x in lines[i + 1:] if not x.startswith(("Project", "Filter"))))
    return feeds


@pytest.mark.parametrize("name", sorted(MARTS))
def test_one_task_only_ever_receives_aggregates(layers, name):
    """Ranks, running totals and thresholds over customers, orders or sellers stay distributed."""
    plan = layers.mart_plan(name)._jdf.queryExecution().executedPlan().toString()
    for feed in single_task_feeds(plan):
        # Joined category rows are as few as categories.
        assert "Aggregate" in feed.split("(")[0] or "Join [category" in feed, feed


def test_the_plan_check_notices_a_global_window(layers):
    bad = layers.mart("customer_base").withColumn("t", F.ntile(5).over(Window.orderBy("total_revenue")))
    feeds = single_task_feeds(bad._jdf.queryExecution().executedPlan().toString())
    assert feeds and "Aggregate" not in feeds[0].split("(")[0]
