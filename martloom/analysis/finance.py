"""Financial summary tables built from the revenue, geography and unit-economics marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.analysis.common import analysis
from martloom.functions import at_least, cents, from_cents, ratio, rnd
from martloom.reports.common import mean, money_mean, total, whole
from martloom.reports.financial import PROFITABILITY
from martloom.sources.raw import metric_rows


def _monthly(w) -> DataFrame:
    return w.mart("revenue_summary").where("time_period = 'monthly'")


@analysis("fin_revenue_trend")
def revenue_trend(w):
    return _monthly(w).select(
        "revenue_date", "total_revenue", "new_customer_revenue", "repeat_customer_revenue",
        "total_orders", "total_customers", "avg_order_value", "revenue_growth_mom_pct"
    ).orderBy("revenue_date")


@analysis("fin_unit_economics")
def unit_economics(w):
    return w.mart("unit_economics").select(
        "segmentation_type", "segment_name", "num_customers", "avg_ltv", "avg_cac_proxy",
        "avg_ltv_cac_ratio", "avg_payback_months", "avg_contribution_margin", "avg_margin_pct",
        "total_revenue")


@analysis("fin_profitability")
def profitability(w):
    return w.mart("unit_economics").select(
        "segmentation_type", "segment_name", "num_customers", "avg_ltv_cac_ratio",
        at_least("avg_ltv_cac_ratio", PROFITABILITY, "Loss").alias("profitability_category"),
        "avg_contribution_margin", "total_revenue")


def pl_components(gross, freight, customers, cac: float) -> dict:
    """Profit-and-loss proxy: variable cost 60 % of gross, freight cost 80 % of freight."""
    net, variable, acquisition = gross - freight, gross * 0.6, customers * F.lit(cac)
    contribution = net - variable - acquisition
    return {
        "Gross Revenue": gross, "Total Freight": freight, "Net Revenue": net,
        "Variable Costs": variable, "CAC Total": acquisition, "Freight Cost": freight * 0.8,
        "Contribution Margin": contribution, "Margin %": ratio(contribution, gross) * 100}


@analysis("fin_pl_proxy")
def pl_proxy(w):
    """Over one segmentation, so that each customer counts once."""
    one = w.mart("unit_economics").where("segmentation_type = 'RFM Segment'")
    n = F.col("num_customers")
    sums = whole(one, g=from_cents(F.sum(cents("avg_gross_revenue") * n)),
                 f=from_cents(F.sum(cents("avg_total_freight") * n)), n=F.sum(n))
    lines = pl_components(F.col("g"), F.col("f"), F.col("n"), w.cfg.cac)
    return metric_rows(sums.select(*[rnd(c, 4).alias(k) for k, c in lines.items()]))


@analysis("fin_summary")
def summary(w):
    monthly, units, states = _monthly(w), w.mart("unit_economics"), w.mart("geographic_performance")
    row = whole(monthly, **{
        "Total Revenue": total("total_revenue"), "Average Monthly Revenue": money_mean("total_revenue"),
        "Latest MoM Growth": rnd(F.max_by("revenue_growth_mom_pct", "revenue_date"), 4)})
    unit = units.agg(F.struct(*[
        mean(c, 4).alias(c) for c in ("avg_ltv", "avg_ltv_cac_ratio", "avg_payback_months",
                                      "avg_contribution_margin", "avg_margin_pct")]).alias("u")).scalar()
    near = states.agg(F.count_if(F.col("cumulative_revenue_pct") <= 80).alias("n")).scalar()
    return metric_rows(row.select(
        "*", unit["avg_ltv"].alias("Average LTV"), unit["avg_ltv_cac_ratio"].alias("LTV/CAC Ratio"),
        unit["avg_payback_months"].alias("Payback Period"),
        unit["avg_contribution_margin"].alias("Contribution Margin"),
        unit["avg_margin_pct"].alias("Margin Percentage"), near.alias("States with 80% Revenue")))


@analysis("fin_growth_trend")
def growth_trend(w):
    """Mean month-over-month growth of the last six months, for every month."""
    last_six = Window.orderBy("revenue_date").rowsBetween(-5, 0)  # one row per month
    growth = F.col("revenue_growth_mom_pct")
    return _monthly(w).select("revenue_date", rnd(growth, 6).alias("revenue_growth_mom_pct"),
                              rnd(F.avg(growth).over(last_six), 6).alias("trailing_growth_pct"))
