"""First look at the marts: key figures, distributions, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from martloom.analysis.common import analysis
from martloom.functions import (
    cents, from_cents, money_avg, money_sum, pct, rate_where, rnd,
)
from martloom.operators.quality import iqr_outliers, key_check
from martloom.operators.ranking import quantiles
from martloom.reports.common import grouped, mean, money_mean, rate, rows, top, total, whole


@analysis("eda_mart_summary")
def mart_summary(w):
    return whole(w.mart("customer_base"), total_customers=rows(),
                 unique_customers=F.count_distinct("customer_id"), avg_revenue=money_mean("total_revenue"),
                 avg_orders=mean("total_orders"), repeat_customers=F.count_if("is_repeat_customer"),
                 repeat_rate=rate("is_repeat_customer"))


@analysis("eda_rfm_segments")
def rfm_segments(w):
    return grouped(w.mart("customer_rfm"), ["rfm_segment"], customer_count=rows(),
                   total_revenue=total("monetary"), avg_ltv=money_mean("monetary")
                   ).orderBy(F.desc("total_revenue"))


@analysis("eda_kpis")
def kpis(w):
    return whole(w.mart("customer_base"), total_customers=rows(), total_revenue=money_sum("total_revenue"),
                 total_orders=F.sum("total_orders"), avg_order_value=mean("avg_order_value", 6),
                 repeat_rate=rate_where(F.col("is_repeat_customer"), 6),
                 avg_ltv=money_avg("total_revenue"))


@analysis("eda_revenue_stats")
def revenue_stats(w):
    new, old = money_sum("new_customer_revenue"), money_sum("repeat_customer_revenue")
    return whole(w.mart("revenue_summary").where("time_period = 'monthly'"),
                 total_revenue=money_sum("total_revenue"), avg_monthly_revenue=money_avg("total_revenue"),
                 peak_month_revenue=F.max("total_revenue"), lowest_month_revenue=F.min("total_revenue"),
                 new_customer_revenue=new, repeat_customer_revenue=old,
                 new_share_pct=rnd(pct(new, new + old), 4), repeat_share_pct=rnd(pct(old, new + old), 4))


@analysis("eda_ltv_stats")
def ltv_stats(w):
    base = w.mart("customer_base")
    q = quantiles(base, "total_revenue", [0.25, 0.5, 0.75, 0.9, 0.95]).select(F.struct("*")).scalar()
    basic = whole(base, n=rows(), mean=money_avg("total_revenue"),
                  std=rnd(F.stddev_samp("total_revenue"), 6), min=F.min("total_revenue"),
                  max=F.max("total_revenue"))
    return basic.select("*", *[q[f"q{i}"].alias(name)
                               for i, name in enumerate(("p25", "median", "p75", "p90", "p95"))])


@analysis("eda_ltv_histogram")
def ltv_histogram(w, bars: int = 50):
    """Customers per equal-width bar of lifetime value."""
    base = w.mart("customer_base").select(cents("total_revenue").alias("c"))
    edge = base.agg(F.struct(F.min("c").alias("lo"), F.max("c").alias("hi")).alias("e")).scalar()
    width = (edge["hi"] - edge["lo"]) / F.lit(float(bars))
    place = F.floor(F.try_divide((F.col("c") - edge["lo"]).cast("double"), width))
    bar = F.least(F.coalesce(place, F.lit(0)), F.lit(bars - 1))
    return grouped(base, [bar.alias("bar")], customers=rows(), min_value=from_cents(F.min("c")),
                   max_value=from_cents(F.max("c"))).orderBy("bar")


@analysis("eda_order_frequency")
def order_frequency(w):
    return top(grouped(w.mart("customer_base"), ["total_orders"], customers=rows()), 10, "total_orders")


@analysis("eda_buyer_types")
def buyer_types(w):
    once, more = F.col("total_orders") == 1, F.col("total_orders") > 1
    return whole(w.mart("customer_base"), one_time_buyers=F.count_if(once), one_time_pct=rate(once),
                 repeat_buyers=F.count_if(more), repeat_pct=rate(more))


@analysis("eda_review_scores")
def review_scores(w):
    scored = w.mart("customer_base").where("avg_review_score > 0")
    median = quantiles(scored, "avg_review_score", [0.5]).scalar()
    return whole(scored, reviewing_customers=rows(), avg_score=mean("avg_review_score", 6),
                 pct_four_plus=rate_where(F.col("avg_review_score") >= 4, 4)
                 ).withColumn("median_score", median)


@analysis("eda_top_states")
def top_states(w):
    """Revenue share of the five largest states."""
    states = w.mart("geographic_performance")
    everything = states.agg(money_sum("total_revenue").alias("v")).scalar()
    leaders = top(states, 5, F.desc("total_revenue"), "customer_state")
    return whole(leaders, top_5_revenue=money_sum("total_revenue")).withColumn(
        "total_revenue", everything).withColumn("top_5_pct", rnd(pct("top_5_revenue", "total_revenue"), 4))


@analysis("eda_region_stats")
def region_stats(w):
    return grouped(w.mart("geographic_performance"), ["customer_region"],
                   total_customers=F.sum("total_customers"), total_revenue=total("total_revenue"),
                   avg_ltv=mean("avg_ltv"), repurchase_rate=mean("repurchase_rate"))


@analysis("eda_category_share")
def category_share(w):
    """Share of the ten largest categories within the twenty largest."""
    order = [F.desc("category_revenue"), F.col("category")]
    listed = top(w.mart("category_performance"), 20, *order)
    everything = listed.agg(money_sum("category_revenue").alias("v")).scalar()
    return whole(top(listed, 10, *order), top_10_revenue=money_sum("category_revenue")).withColumn(
        "listed_revenue", everything).withColumn("top_10_pct", rnd(pct("top_10_revenue", "listed_revenue"), 4))


@analysis("eda_null_counts")
def null_counts(w):
    base = w.mart("customer_base")
    return whole(base, **{c: F.count_if(F.col(c).isNull()) for c in base.columns})


@analysis("eda_duplicate_keys")
def duplicate_keys(w):
    return key_check(w.mart("customer_base"), ["customer_id"], "mart_customer_base")


@analysis("eda_ltv_outliers")
def ltv_outliers(w):
    return iqr_outliers(w.mart("customer_base"), "total_revenue")
