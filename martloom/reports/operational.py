"""Reports on the operational marts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from martloom.functions import at_least, bins, money_sum, pct, ranges, ratio, rnd
from martloom.operators.ranking import with_group_quantile
from martloom.plans.operational import INSTALLMENT_BINS
from martloom.reports.common import (
    by_label, grouped, mean, money_mean, rate, report, rows, top, total, whole, with_share,
)

# --- category_performance ----------------------------------------------------------------


def _best(m, k, by, *columns):
    return top(m, k, F.desc(by), "category").select("category", *columns)


@report("category_performance", 1)
def categories_by_revenue(m, w):
    return _best(m, 10, "category_revenue", "category_revenue", "category_share", "cumulative_share",
                 "category_orders", "category_units", "avg_price_per_category")


@report("category_performance", 2)
def categories_by_units(m, w):
    return _best(m, 10, "category_units", "category_units", "category_orders", "category_revenue",
                 "avg_price_per_category")


@report("category_performance", 3)
def categories_by_growth(m, w):
    return _best(m.where("revenue_prev_3m > 0"), 10, "category_growth_pct", "revenue_last_3m",
                 "revenue_prev_3m", "category_growth_pct", "category_revenue")


@report("category_performance", 4)
def category_margins(m, w):
    kind = at_least("avg_margin_pct", [(80, "High Margin (80%+)"), (70, "Good Margin (70-80%)"),
                                       (60, "Average Margin (60-70%)")], "Low Margin (<60%)")
    return m.select("category", "category_revenue", "category_margin", "avg_margin_pct", "avg_freight",
                    kind.alias("margin_category")).orderBy(F.desc("avg_margin_pct"))


@report("category_performance", 5)
def category_repeats(m, w):
    return _best(m, 15, "repeat_purchase_rate_category", "unique_customers", "repeat_customers",
                 "repeat_purchase_rate_category", "category_revenue")


@report("category_performance", 6)
def category_crossing(m, w):
    return _best(m, 15, "cross_category_rate", "unique_customers", "cross_category_customers",
                 "cross_category_rate", "category_revenue")


@report("category_performance", 7)
def category_pareto(m, w):
    side = bins("cumulative_share", [(80, "Top 80% Revenue")], "Bottom 20% Revenue")
    return grouped(m, [side.alias("pareto_group")], num_categories=rows(),
                   total_revenue=total("category_revenue"), total_share=total("category_share"))


@report("category_performance", 8)
def category_prices(m, w):
    labels = ("Budget (<R$50)", "Economy (R$50-100)", "Mid-Range (R$100-200)", "Premium (R$200+)")
    price = bins("avg_price_per_category", list(zip((50, 100, 200), labels)), labels[3], closed=False)
    g = grouped(m, [price.alias("price_segment")], num_categories=rows(),
                total_revenue=total("category_revenue"), avg_price=mean("avg_price_per_category"),
                avg_units=mean("category_units", 0))
    return by_label(g, "price_segment", labels)


@report("category_performance", 9)
def category_engagement(m, w):
    return _best(m, 15, "revenue_per_customer", "unique_customers", "revenue_per_customer",
                 "orders_per_customer", "units_per_order", "category_revenue")


@report("category_performance", 10)
def category_summary(m, w):
    return whole(m, total_categories=rows(), total_revenue=total("category_revenue"),
                 avg_revenue_per_category=money_mean("category_revenue"),
                 overall_avg_price=mean("avg_price_per_category"),
                 overall_avg_margin=mean("avg_margin_pct"),
                 overall_repeat_rate=mean("repeat_purchase_rate_category"))


# --- delivery_performance ----------------------------------------------------------------

SEVERITY = ("On Time", "1-3 days late", "4-7 days late", "8-15 days late", "15+ days late")


def _sla():
    return rate(~F.col("is_delayed"))


@report("delivery_performance", 1)
def delivery_overall(m, w):
    return whole(m, total_orders=rows(), on_time_orders=F.count_if(~F.col("is_delayed")),
                 delayed_orders=F.count_if("is_delayed"), sla_compliance_rate=_sla(),
                 avg_delivery_days_actual=mean("delivery_time_actual", 1),
                 avg_delivery_days_estimated=mean("delivery_time_estimated", 1),
                 avg_delay_when_late=mean(F.when(F.col("is_delayed"), F.col("delivery_delay")), 1))


@report("delivery_performance", 2)
def delivery_severity(m, w):
    g = grouped(m, ["delay_severity"], num_orders=rows(), avg_delay_days=mean("delivery_delay", 1),
                avg_review_score=mean("review_score"))
    return by_label(with_share(g, "num_orders", "pct_orders"), "delay_severity", SEVERITY)


@report("delivery_performance", 3)
def delivery_states(m, w):
    return grouped(m, ["customer_state"], total_orders=rows(),
                   on_time_orders=F.count_if(~F.col("is_delayed")), sla_compliance_rate=_sla(),
                   avg_delivery_days=mean("delivery_time_actual", 1),
                   avg_delay_days=mean("delivery_delay", 1)).orderBy(F.desc("sla_compliance_rate"))


@report("delivery_performance", 4)
def delivery_routes(m, w):
    g = grouped(m, ["delivery_route"], total_orders=rows(), sla_compliance_rate=_sla(),
                avg_delivery_days=mean("delivery_time_actual", 1),
                avg_delay_days=mean("delivery_delay", 1), avg_freight=money_mean("freight_value"))
    return top(g.where("total_orders >= 50"), 20, F.desc("total_orders"), "delivery_route")


@report("delivery_performance", 5)
def delivery_same_state(m, w):
    return grouped(m, ["is_same_state_delivery"], total_orders=rows(), sla_compliance_rate=_sla(),
                   avg_delivery_days=mean("delivery_time_actual", 1),
                   avg_carrier_time=mean("carrier_time", 1), avg_transit_time=mean("transit_time", 1),
                   avg_freight=money_mean("freight_value"))


@report("delivery_performance", 6)
def delivery_reviews(m, w):
    g = grouped(m.where("review_score is not null"), ["delay_severity"], orders_with_reviews=rows(),
                avg_review_score=mean("review_score"), avg_delay_days=mean("delivery_delay", 1))
    return by_label(g, "delay_severity", SEVERITY)


@report("delivery_performance", 7)
def delivery_freight(m, w):
    g = grouped(m, ["delay_severity"], total_orders=rows(), avg_freight=money_mean("freight_value"),
                avg_freight_per_day=mean("freight_per_day"),
                avg_delivery_days=mean("delivery_time_actual", 1))
    return by_label(g, "delay_severity", SEVERITY)


@report("delivery_performance", 8)
def delivery_pickup(m, w):
    speed = bins("carrier_time", [(2, "Fast pickup (0-2 days)"), (5, "Normal pickup (3-5 days)")],
                 "Slow pickup (6+ days)")
    return grouped(m.where("carrier_time is not null"), [speed.alias("carrier_speed")],
                   total_orders=rows(), avg_carrier_days=mean("carrier_time", 1),
                   avg_transit_days=mean("transit_time", 1),
                   avg_total_delivery_days=mean("delivery_time_actual", 1), sla_compliance_rate=_sla())


@report("delivery_performance", 9)
def delivery_distance(m, w):
    distance = F.col("distance_proxy")
    band = (F.when(distance < 5000, "Near (<5k zip diff)")
            .when(distance <= 20000, "Medium (5k-20k)").otherwise("Far (20k+)"))
    return grouped(m, [band.alias("distance_category")], total_orders=rows(),
                   avg_delivery_days=mean("delivery_time_actual", 1), sla_compliance_rate=_sla(),
                   avg_freight=money_mean("freight_value"))


# --- payment_analysis: projections of a mart with one row per method ---------------------

def _methods(m, order, *columns):
    return m.orderBy(order).select("payment_method_primary", *columns)


@report("payment_analysis", 1)
def methods_shares(m, w):
    return _methods(m, F.desc("revenue_share_pct"), "total_orders", "order_share_pct", "total_revenue",
                    "revenue_share_pct", "avg_order_value")


@report("payment_analysis", 2)
def methods_conversion(m, w):
    return _methods(m, F.desc("conversion_rate"), "total_orders", "successful_orders",
                    "canceled_orders", "conversion_rate", "cancellation_rate")


@report("payment_analysis", 3)
def methods_values(m, w):
    return _methods(m, F.desc("avg_order_value"), "avg_order_value", "min_order_value",
                    "max_order_value", "total_revenue")


@report("payment_analysis", 4)
def methods_installments(m, w):
    return _methods(m, F.desc("avg_installments_per_method"), "avg_installments_per_method",
                    "max_installments_per_method", "avg_order_value")


@report("payment_analysis", 5)
def methods_mixed(m, w):
    return _methods(m, F.desc("pct_multiple_methods"), "total_orders", "orders_with_multiple_methods",
                    "pct_multiple_methods")


@report("payment_analysis", 6)
def installment_bins(m, w):
    """From the payment rows: an order counts once in each of its bins."""
    label = ranges("payment_installments", INSTALLMENT_BINS, None)
    binned = w.facts("payments").select(
        label.alias("installment_bin"), "order_id", "payment_value", "is_completed")
    per_order = binned.where("installment_bin is not null").groupBy("installment_bin", "order_id").agg(
        rows().alias("n"), F.count_if("is_completed").alias("done"),
        money_sum("payment_value").alias("v"))
    g = grouped(per_order, ["installment_bin"], total_orders=rows(),
                avg_payment_value=rnd(ratio(money_sum("v"), F.sum("n"))), total_revenue=total("v"),
                conversion_rate=rnd(pct(F.sum("done"), F.sum("n"))))
    return by_label(with_share(g, "total_orders", "order_pct"), "installment_bin",
                    [b[2] for b in INSTALLMENT_BINS])


@report("payment_analysis", 7)
def methods_grades(m, w):
    conversion, value = F.col("conversion_rate"), F.col("avg_order_value")
    typical = m.agg(rnd(F.avg("avg_order_value"), 6).alias("v")).scalar()
    grade = (F.when((conversion >= 95) & (value >= typical), "Excellent")
             .when((conversion >= 90) | (value >= typical), "Good")
             .when(conversion >= 80, "Average").otherwise("Needs Improvement"))
    return _methods(m, F.asc("revenue_rank"), "total_orders", "order_share_pct", "revenue_share_pct",
                    "avg_order_value", "conversion_rate", "cancellation_rate",
                    "avg_installments_per_method", grade.alias("performance_category"))


@report("payment_analysis", 8)
def methods_pareto(m, w):
    line = Window.orderBy(F.desc("revenue_share_pct"))  # one row per method
    return m.select("payment_method_primary", "revenue_share_pct",
                    rnd(F.sum("revenue_share_pct").over(line)).alias("cumulative_revenue_pct"))


# --- repeat_purchase ---------------------------------------------------------------------

@report("repeat_purchase", 1)
def repeat_rate(m, w):
    return whole(m, total_customers=rows(), repeat_customers=F.sum("is_repeat_customer"),
                 repeat_purchase_rate=rate(F.col("is_repeat_customer") == 1))


def _returned(m):
    return m.where("has_second_purchase = 1")


@report("repeat_purchase", 2)
def repeat_timing(m, w):
    g = grouped(_returned(m), ["days_to_second_purchase_bin"], customer_count=rows())
    return by_label(with_share(g, "customer_count", "percentage"), "days_to_second_purchase_bin",
                    ("0-30", "31-60", "61-90", "91-180", "180+"))


@report("repeat_purchase", 3)
def repeat_frequency(m, w):
    g = grouped(m, ["purchase_frequency_bin"], customer_count=rows())
    return by_label(with_share(g, "customer_count", "percentage"), "purchase_frequency_bin",
                    ("1x", "2x", "3-5x", "6-10x", "11+"))


@report("repeat_purchase", 4)
def repeat_cohorts(m, w):
    return grouped(m, ["cohort_month"], total_customers=rows(), second_purchases=F.sum("has_second_purchase"),
                   second_purchase_rate=rate(F.col("has_second_purchase") == 1)).orderBy("cohort_month")


@report("repeat_purchase", 5)
def repeat_windows(m, w):
    days = (30, 60, 90)
    return whole(_returned(m), total_repeat_customers=rows(),
                 **{f"within_{d}_days": F.sum(f"purchased_within_{d}_days") for d in days},
                 **{f"pct_within_{d}_days": rate(F.col(f"purchased_within_{d}_days") == 1) for d in days})


@report("repeat_purchase", 6)
def repeat_statistics(m, w):
    gap = "days_to_second_purchase"
    returned = _returned(m)
    summary = whole(returned, repeat_customers=rows(), avg_days_to_second_purchase=mean(gap),
                    median_days_to_second_purchase=F.lit(None).cast(returned.schema[gap].dataType),
                    min_days_to_second_purchase=F.min(gap), max_days_to_second_purchase=F.max(gap))
    return with_group_quantile(summary, returned, [], gap, "median_days_to_second_purchase")


# --- seller_performance ------------------------------------------------------------------

TIERS = ("Top 10 Seller", "Top 20% Revenue", "Top 50% Revenue", "Top 80% Revenue", "Bottom 20% Revenue")


@report("seller_performance", 1)
def sellers_by_revenue(m, w):
    return top(m, 20, F.desc("seller_revenue"), "seller_id").select(
        "seller_id", "seller_state", "seller_revenue", "revenue_share_pct", "seller_orders",
        "seller_avg_review", "seller_delivery_performance", "revenue_rank")


@report("seller_performance", 2)
def sellers_by_orders(m, w):
    return top(m, 20, F.desc("seller_orders"), "seller_id").select(
        "seller_id", "seller_state", "seller_orders", "seller_units", "seller_revenue",
        "seller_avg_price", "order_rank")


@report("seller_performance", 3)
def seller_tiers(m, w):
    g = grouped(m, ["seller_tier"], num_sellers=rows(), total_revenue=total("seller_revenue"),
                revenue_share=mean_sum("revenue_share_pct"), avg_review_score=mean("seller_avg_review"))
    return by_label(g, "seller_tier", TIERS)


def mean_sum(c):
    """Sum of a column with more than two decimals, rounded."""
    return rnd(F.sum(F.col(c).cast("decimal(18,4)")))


@report("seller_performance", 4)
def seller_reviews(m, w):
    grade = at_least("seller_avg_review", [(4.5, "Excellent (4.5+)"), (4.0, "Good (4.0-4.5)"),
                                           (3.5, "Average (3.5-4.0)")], "Below Average (<3.5)")
    return grouped(m.where("seller_total_reviews >= 5"), [grade.alias("review_category")],
                   num_sellers=rows(), avg_revenue=money_mean("seller_revenue"),
                   avg_orders=mean("seller_orders", 1), avg_review=mean("seller_avg_review")
                   ).orderBy(F.desc("avg_review"))


@report("seller_performance", 5)
def seller_punctuality(m, w):
    g = grouped(m, ["seller_tier"], num_sellers=rows(), avg_sla_compliance=mean("seller_delivery_performance"),
                avg_delivery_days=mean("avg_delivery_days", 1), avg_review_score=mean("seller_avg_review"))
    return by_label(g, "seller_tier", TIERS)


@report("seller_performance", 6)
def seller_places(m, w):
    g = grouped(m, ["seller_region", "seller_state"], num_sellers=rows(),
                total_revenue=total("seller_revenue"), avg_revenue_per_seller=money_mean("seller_revenue"),
                avg_review_score=mean("seller_avg_review"))
    return top(g, 15, F.desc("total_revenue"), "seller_state")


def _seller_groups(m, label, name):
    return grouped(m, [label.alias(name)], num_sellers=rows(), avg_revenue=money_mean("seller_revenue"),
                   avg_orders=mean("seller_orders", 1), avg_review=mean("seller_avg_review"))


@report("seller_performance", 7)
def seller_diversity(m, w):
    level = ranges("seller_categories", [(1, 1, "Single Category"), (2, 3, "Low Diversity (2-3)"),
                                         (4, 6, "Medium Diversity (4-6)")], "High Diversity (7+)")
    return _seller_groups(m, level, "diversity_level").orderBy(F.desc("avg_revenue"))


@report("seller_performance", 8)
def seller_lifecycle(m, w):
    labels = ("0-3 months", "4-6 months", "7-12 months", "12+ months")
    period = bins("seller_active_months", list(zip((3, 6, 12), labels)), labels[3])
    g = grouped(m, [period.alias("activity_period")], num_sellers=rows(),
                avg_revenue=money_mean("seller_revenue"), avg_revenue_per_month=mean("revenue_per_month"),
                avg_review=mean("seller_avg_review"))
    return by_label(g, "activity_period", labels)


@report("seller_performance", 9)
def seller_concentration(m, w):
    """Herfindahl-Hirschman index: sum of the squared revenue shares."""
    share = F.col("revenue_share_pct").cast("decimal(12,4)")
    index = whole(m, hhi_index=rnd(F.sum(share * share)))
    return index.withColumn("market_concentration_level", bins(
        "hhi_index", [(100, "Highly Competitive"), (1500, "Competitive"),
                      (2500, "Moderately Concentrated")], "Highly Concentrated", closed=False))


@report("seller_performance", 10)
def seller_scorecard(m, w):
    most = m.agg(F.max("seller_revenue").alias("v")).scalar()
    score = rnd(ratio("seller_revenue", most) * 0.4 + F.col("seller_avg_review") / 5.0 * 0.3
                + F.col("seller_delivery_performance") / 100.0 * 0.3, 3)
    scored = m.where("seller_total_reviews >= 10").select(
        "seller_id", "seller_state", "seller_revenue", "seller_orders", "seller_avg_review",
        "seller_delivery_performance", "positive_review_rate", "revenue_rank",
        score.alias("balanced_score"))
    return top(scored, 20, F.desc("balanced_score"), "seller_id")
