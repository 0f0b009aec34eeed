"""Reports on the financial marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from martloom.functions import at_least, bins, money_sum, pearson, rnd
from martloom.reports.common import (
    by_label, grouped, mean, money_mean, report, rows, top, total, whole, with_share,
)

# --- aov_analysis ------------------------------------------------------------------------


def _sizes():
    return {"order_count": rows(), "avg_order_value": money_mean("order_value"),
            "avg_items_per_order": mean("items_per_order")}


@report("aov_analysis", 1)
def aov_overall(m, w):
    return whole(m, total_orders=rows(), overall_aov=money_mean("order_value"),
                 avg_items_per_order=mean("items_per_order"), avg_item_price=mean("avg_item_price"),
                 min_order_value=rnd(F.min("order_value")), max_order_value=rnd(F.max("order_value")))


@report("aov_analysis", 2)
def aov_bins(m, w):
    g = with_share(grouped(m, ["value_bin"], **_sizes()), "order_count", "percentage")
    return by_label(g, "value_bin", ("low", "medium", "high", "premium"))


@report("aov_analysis", 3)
def aov_methods(m, w):
    return grouped(m, ["payment_method_segment"], **_sizes(), avg_installments=mean("max_installments")
                   ).orderBy(F.desc("avg_order_value"))


@report("aov_analysis", 4)
def aov_item_bins(m, w):
    g = grouped(m, ["items_bin"], order_count=rows(), avg_order_value=money_mean("order_value"),
                avg_item_price=mean("avg_item_price"),
                avg_freight_ratio=mean("freight_to_value_ratio", 4))
    return by_label(g, "items_bin", ("single_item", "few_items", "multiple_items", "many_items"))


@report("aov_analysis", 5)
def aov_months(m, w):
    return grouped(m, ["order_month"], order_count=rows(), monthly_aov=money_mean("order_value"),
                   avg_items_per_order=mean("items_per_order"), total_revenue=total("order_value")
                   ).orderBy("order_month")


@report("aov_analysis", 6)
def aov_states(m, w):
    g = grouped(m.where("customer_state is not null"), ["customer_state"], **_sizes())
    return top(g, 10, F.desc("avg_order_value"), "customer_state")


@report("aov_analysis", 7)
def aov_correlations(m, w):
    return whole(m, value_items_correlation=rnd(pearson("order_value", "items_per_order"), 6),
                 value_price_correlation=rnd(pearson("order_value", "avg_item_price"), 6),
                 items_price_correlation=rnd(pearson("items_per_order", "avg_item_price"), 6))


@report("aov_analysis", 8)
def aov_high_value(m, w):
    return grouped(m, ["is_high_value_order"], **_sizes(), avg_installments=mean("max_installments"))


# --- geographic_performance --------------------------------------------------------------

@report("geographic_performance", 1)
def geo_top(m, w):
    return top(m, 10, F.desc("total_revenue"), "customer_state").select(
        "customer_state", "customer_region", "total_customers", F.col("total_revenue").alias("revenue"),
        "revenue_concentration_pct", "avg_ltv", "repurchase_rate", "growth_potential")


@report("geographic_performance", 2)
def geo_80_20(m, w):
    return whole(m.where("cumulative_revenue_pct <= 80"), num_states=rows(),
                 total_revenue=money_sum("total_revenue"),
                 pct_of_total_revenue=money_sum("revenue_concentration_pct"))


@report("geographic_performance", 3)
def geo_regions(m, w):
    return grouped(m, ["customer_region"], num_states=rows(), total_customers=F.sum("total_customers"),
                   total_revenue=total("total_revenue"), avg_ltv=mean("avg_ltv"),
                   avg_repurchase_rate=mean("repurchase_rate")).orderBy(F.desc("total_revenue"))


@report("geographic_performance", 4)
def geo_potential(m, w):
    g = grouped(m, ["growth_potential"], num_states=rows(), avg_ltv=mean("avg_ltv"),
                avg_repurchase_rate=mean("repurchase_rate"), total_revenue=total("total_revenue"))
    return by_label(g, "growth_potential", ("High Potential", "Medium Potential", "Low Potential"))


@report("geographic_performance", 5)
def geo_penetration(m, w):
    g = grouped(m, ["market_penetration_category"], num_states=rows(),
                total_customers=F.sum("total_customers"), total_revenue=total("total_revenue"),
                total_revenue_pct=total("revenue_concentration_pct"))
    return by_label(g, "market_penetration_category", (
        "High Penetration", "Medium Penetration", "Low Penetration", "Very Low Penetration"))


@report("geographic_performance", 6)
def geo_ranks(m, w):
    ranks = ("ltv_rank", "revenue_rank", "customer_rank", "repurchase_rank")
    return m.select("customer_state", "customer_region", *ranks,
                    rnd(sum(F.col(r) for r in ranks) / 4.0).alias("avg_rank")).orderBy("avg_rank")


# --- revenue_summary ---------------------------------------------------------------------

def _monthly(m):
    return m.where("time_period = 'monthly'")


@report("revenue_summary", 1)
def revenue_periods(m, w):
    return grouped(m, ["time_period"], period_count=rows(), first_date=F.min("revenue_date"),
                   last_date=F.max("revenue_date"), avg_revenue=money_mean("total_revenue")
                   ).orderBy("time_period")


@report("revenue_summary", 2)
def revenue_reconciliation(m, w):
    source = w.stg("payments").agg(total("payment_value").alias("t")).scalar()
    return whole(_monthly(m), mart_total_revenue=total("total_revenue")).withColumn(
        "source_total_revenue", source)


@report("revenue_summary", 3)
def revenue_new_repeat(m, w):
    return grouped(m, ["time_period"], total_new_revenue=total("new_customer_revenue"),
                   total_repeat_revenue=total("repeat_customer_revenue"),
                   avg_repeat_rate=mean("repeat_revenue_rate")).orderBy("time_period")


@report("revenue_summary", 4)
def revenue_growth(m, w):
    return top(_monthly(m), 12, F.desc("revenue_date")).select(
        "revenue_date", rnd("total_revenue").alias("monthly_revenue"),
        rnd("revenue_growth_mom_pct").alias("mom_growth_pct"), rnd("repeat_revenue_rate").alias("repeat_rate"))


@report("revenue_summary", 5)
def revenue_quality(m, w):
    return whole(m, total_rows=rows(), null_revenue_rows=F.count_if(F.col("total_revenue").isNull()),
                 null_customer_rows=F.count_if(F.col("total_customers").isNull()),
                 null_date_rows=F.count_if(F.col("revenue_date").isNull()))


@report("revenue_summary", 6)
def revenue_best(m, w):
    return top(_monthly(m), 10, F.desc("total_revenue"), "revenue_date").select(
        "revenue_date", "time_period", rnd("total_revenue").alias("revenue"), "total_orders",
        rnd("repeat_revenue_rate").alias("repeat_rate"))


# --- unit_economics ----------------------------------------------------------------------

def _kind(m, *kinds):
    return m.where(F.col("segmentation_type").isin(*kinds))


@report("unit_economics", 1)
def unit_rfm(m, w):
    return _kind(m, "RFM Segment").select(
        "segment_name", "num_customers", "avg_ltv", "avg_cac_proxy", "avg_ltv_cac_ratio",
        "avg_payback_months", "avg_contribution_margin").orderBy(F.desc("avg_ltv"))


@report("unit_economics", 2)
def unit_states(m, w):
    return top(_kind(m, "State"), 10, F.desc("total_revenue"), "segment_name").select(
        F.col("segment_name").alias("state"), F.col("segment_region").alias("region"),
        "num_customers", "avg_ltv", "avg_ltv_cac_ratio", "avg_margin_pct", "avg_contribution_margin")


@report("unit_economics", 3)
def unit_regions(m, w):
    return _kind(m, "Region").orderBy(F.desc("total_revenue")).select(
        F.col("segment_name").alias("region"), "num_customers", "total_revenue", "avg_ltv",
        "avg_aov", "avg_ltv_cac_ratio", "avg_payback_months")


@report("unit_economics", 4)
def unit_cohorts(m, w):
    return _kind(m, "Cohort").orderBy("segment_name").select(
        F.col("segment_name").alias("cohort"), "num_customers", "avg_ltv", "avg_ltv_cac_ratio",
        "avg_customer_lifespan_months", "avg_monthly_revenue")


PROFITABILITY = [(3, "Excellent"), (2, "Good"), (1, "Break Even")]


@report("unit_economics", 5)
def unit_profitability(m, w):
    return _kind(m, "RFM Segment", "Region").select(
        "segmentation_type", "segment_name", "num_customers", "avg_ltv", "avg_ltv_cac_ratio",
        "avg_contribution_margin",
        at_least("avg_ltv_cac_ratio", PROFITABILITY, "Loss").alias("profitability_category"),
    ).orderBy(F.desc("avg_ltv_cac_ratio"))


@report("unit_economics", 6)
def unit_margins(m, w):
    return _kind(m, "RFM Segment").select(
        "segmentation_type", "segment_name", "avg_gross_revenue", "avg_total_freight",
        "avg_net_revenue", "avg_margin_pct", "avg_contribution_margin").orderBy(F.desc("avg_margin_pct"))


@report("unit_economics", 7)
def unit_payback(m, w):
    speed = bins("avg_payback_months", [(3, "Fast (0-3 months)"), (6, "Medium (3-6 months)"),
                                        (12, "Slow (6-12 months)")], "Very Slow (12+ months)")
    return _kind(m, "RFM Segment").where("avg_payback_months is not null").select(
        "segmentation_type", "segment_name", "avg_ltv", "avg_cac_proxy", "avg_payback_months",
        "avg_monthly_revenue", speed.alias("payback_category")).orderBy("avg_payback_months")


@report("unit_economics", 8)
def unit_concentration(m, w):
    return grouped(m, ["segmentation_type"], num_segments=F.count_distinct("segment_name"),
                   total_revenue=total("total_revenue"), overall_avg_ltv=mean("avg_ltv"),
                   overall_avg_ltv_cac_ratio=mean("avg_ltv_cac_ratio")).orderBy(F.desc("total_revenue"))


@report("unit_economics", 9)
def unit_best(m, w):
    large = _kind(m, "RFM Segment", "State").where("num_customers >= 100")
    return top(large, 15, F.desc("avg_ltv_cac_ratio"), "segmentation_type", "segment_name").select(
        "segmentation_type", "segment_name", "num_customers", "total_revenue", "avg_ltv_cac_ratio",
        "avg_contribution_margin", "avg_margin_pct")
