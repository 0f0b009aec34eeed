"""Reports on the advanced marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from martloom.functions import at_least, money_sum, pct, ratio, rnd
from martloom.reports.common import (
    by_label, grouped, mean, money_mean, rate, report, rows, top, total, whole, with_share,
)

# --- revenue_cohort ----------------------------------------------------------------------


def _cohort_totals(m):
    """Revenue and value per head of each cohort, compared with the mean cohort."""
    g = grouped(m, ["cohort_month", "cohort_size"], total_cohort_revenue=money_sum("cohort_revenue"),
                max_ltv=F.max("cumulative_revenue_per_customer"),
                avg_ltv=mean("cumulative_revenue_per_customer"))
    head = rnd(ratio("total_cohort_revenue", "cohort_size"), 6)
    typical = g.agg(rnd(F.avg(head), 6).alias("v")).scalar()
    return g.withColumn("performance_category",
                        F.when(head > typical, "Above Average").otherwise("Below Average"))


@report("revenue_cohort", 1)
def cohort_revenue(m, w):
    return _cohort_totals(m).orderBy(F.desc("total_cohort_revenue"))


@report("revenue_cohort", 2)
def cohort_retention(m, w):
    return grouped(m.where("months_since_cohort <= 12"), ["months_since_cohort"],
                   cohorts_observed=F.count_distinct("cohort_month"),
                   avg_retention_rate_pct=rnd(F.avg("active_customer_rate") * 100),
                   avg_ltv=mean("cumulative_revenue_per_customer"),
                   avg_monthly_value=mean("monthly_revenue_per_cohort_customer")
                   ).orderBy("months_since_cohort")


@report("revenue_cohort", 3)
def cohort_months(m, w):
    return grouped(m, ["order_month"], active_cohorts=F.count_distinct("cohort_month"),
                   total_monthly_revenue=money_sum("cohort_revenue"),
                   total_active_customers=F.sum("active_customers"),
                   revenue_per_active_customer=rnd(ratio(money_sum("cohort_revenue"), F.sum("active_customers")))
                   ).orderBy("order_month")


@report("revenue_cohort", 4)
def cohort_best(m, w):
    return top(_cohort_totals(m), 10, F.desc("avg_ltv"), "cohort_month")


@report("revenue_cohort", 5)
def cohort_matrix(m, w):
    months = [0, 1, 2, 3, 6, 12]
    wide = m.groupBy("cohort_month").pivot("months_since_cohort", months).agg(F.max("cohort_revenue"))
    return wide.select("cohort_month", *[F.coalesce(str(k), F.lit(0.0)).alias(f"month_{k}_revenue")
                                         for k in months]).orderBy(F.desc("cohort_month"))


@report("revenue_cohort", 6)
def cohort_completeness(m, w):
    row = whole(m, a=F.count_distinct("cohort_month").cast("double"), b=mean("cohort_size", 0),
                c=total("cohort_revenue"), d=F.max("months_since_cohort").cast("double"))
    names = ("Total Cohorts", "Average Cohort Size", "Total Revenue Tracked", "Max Months Tracked")
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in zip(names, row.columns)])))


# --- payment_cohort ----------------------------------------------------------------------

COHORT = ["cohort_payment"]


def _repeat_rate():
    return rate(F.col("is_repeat_customer") == 1)


@report("payment_cohort", 1)
def pay_ltv(m, w):
    return grouped(m, COHORT, customer_count=rows(), avg_ltv=money_mean("total_revenue"),
                   avg_aov=mean("avg_order_value"), avg_orders_per_customer=mean("order_frequency"),
                   retention_rate_pct=_repeat_rate()).orderBy(F.desc("avg_ltv"))


@report("payment_cohort", 2)
def pay_migration(m, w):
    return grouped(m, ["migration_pattern"], customer_count=rows(), avg_ltv=money_mean("total_revenue"),
                   avg_orders=mean("order_frequency"),
                   avg_consistency_pct=rnd(F.avg("payment_method_consistency") * 100)
                   ).orderBy(F.desc("customer_count"))


@report("payment_cohort", 3)
def pay_installments(m, w):
    return grouped(m, COHORT, avg_initial_installments=mean("first_payment_installments"),
                   avg_initial_order_value=money_mean("first_purchase_value"),
                   avg_lifetime_installments=mean("avg_installments_all_orders"),
                   max_installments_used=mean("max_installments_used")
                   ).orderBy(F.desc("avg_initial_installments"))


@report("payment_cohort", 4)
def pay_paths(m, w):
    g = grouped(m.where("has_payment_method_migration = 1"), ["migration_path"], customer_count=rows(),
                avg_ltv=money_mean("total_revenue"), avg_orders=mean("order_frequency"),
                avg_method_diversity=mean("payment_method_diversity"))
    return top(g, 10, F.desc("customer_count"), "migration_path")


@report("payment_cohort", 5)
def pay_consistency(m, w):
    kind = at_least("payment_method_consistency", [(1, "Always_Same_Method"), (0.7, "Mostly_Consistent"),
                                                   (0.4, "Mixed_Methods")], "Highly_Variable")
    return grouped(m, [kind.alias("consistency_segment")], customer_count=rows(),
                   avg_ltv=money_mean("total_revenue"), avg_orders=mean("order_frequency"),
                   avg_aov=mean("avg_order_value")).orderBy(F.desc("avg_ltv"))


@report("payment_cohort", 6)
def pay_value_segments(m, w):
    return grouped(m, [*COHORT, "customer_value_segment"], customer_count=rows(),
                   avg_ltv=money_mean("total_revenue"), avg_orders=mean("order_frequency"),
                   retention_rate_pct=_repeat_rate()).orderBy(*COHORT, F.desc("avg_ltv"))


@report("payment_cohort", 7)
def pay_years(m, w):
    return grouped(m, [*COHORT, F.year("first_purchase_date").alias("cohort_year")], customer_count=rows(),
                   avg_ltv=money_mean("total_revenue"), avg_lifetime_days=mean("customer_lifetime_days", 1),
                   avg_orders=mean("order_frequency")).orderBy(F.desc("cohort_year"), F.desc("avg_ltv"))


@report("payment_cohort", 8)
def pay_high_value(m, w):
    high = F.col("customer_value_segment") == "High_Value"
    return grouped(m, COHORT, total_customers=rows(), high_value_customers=F.count_if(high),
                   high_value_pct=rate(high),
                   avg_high_value_ltv=money_mean(F.when(high, F.col("total_revenue")))
                   ).orderBy(F.desc("high_value_pct"))


# --- purchase_frequency ------------------------------------------------------------------

FREQUENCY = ("1x", "2x", "3-5x", "6-10x", "11+")


@report("purchase_frequency", 1)
def frequency_bins(m, w):
    g = grouped(m, ["frequency_bin"], customer_count=rows(), revenue=money_sum("total_revenue"),
                avg_orders=mean("num_orders"), avg_revenue=money_mean("total_revenue"))
    g = with_share(with_share(g, "customer_count", "pct_customers"), "revenue", "pct_revenue")
    return by_label(g.drop("revenue"), "frequency_bin", FREQUENCY)


@report("purchase_frequency", 2)
def one_time_buyers(m, w):
    once = F.col("num_orders") == 1
    return whole(m, one_time_buyers=F.count_if(once), pct_one_time_buyers=rate(once),
                 avg_one_time_revenue=money_mean(F.when(once, F.col("total_revenue"))),
                 avg_one_time_order_value=mean(F.when(once, F.col("avg_order_value"))))


@report("purchase_frequency", 3)
def pareto_segments(m, w):
    g = grouped(m, ["pareto_segment"], customer_count=rows(), total_revenue=total("total_revenue"),
                avg_revenue_per_customer=money_mean("total_revenue"))
    g = with_share(with_share(g, "customer_count", "pct_customers"), "total_revenue", "pct_revenue")
    return by_label(g, "pareto_segment", ("Top_20%", "Next_30%", "Bottom_50%"))


@report("purchase_frequency", 4)
def revenue_concentration(m, w):
    def upto(p):
        inside = F.when(F.col("cumulative_customer_pct") <= p, F.col("total_revenue")).otherwise(0)
        return rnd(pct(money_sum(inside), money_sum("total_revenue")))

    return whole(m, **{f"top_{p}_pct_revenue": upto(p) for p in (20, 50, 80)})


@report("purchase_frequency", 5)
def frequency_value(m, w):
    g = grouped(m, ["frequency_bin", "value_segment"], customer_count=rows(),
                avg_revenue=money_mean("total_revenue"),
                avg_monthly_frequency=mean("monthly_purchase_rate", 3))
    return g.orderBy("frequency_bin", "value_segment")


@report("purchase_frequency", 6)
def frequency_tenure(m, w):
    g = grouped(m, ["frequency_bin"], avg_tenure_days=mean("customer_tenure_days", 1),
                avg_orders=mean("num_orders"), avg_monthly_rate=mean("monthly_purchase_rate", 3))
    return by_label(g, "frequency_bin", FREQUENCY)


@report("purchase_frequency", 7)
def frequency_completeness(m, w):
    return whole(m, total_customers=rows(), unique_bins=F.count_distinct("frequency_bin"),
                 min_orders=F.min("num_orders"), max_orders=F.max("num_orders"),
                 avg_orders_per_customer=mean("num_orders"), total_revenue_analyzed=total("total_revenue"))


# --- nps_cohort --------------------------------------------------------------------------

def _is(category):
    return F.col("primary_nps_category") == category


@report("nps_cohort", 1)
def nps_overall(m, w):
    up, down = F.count_if(_is("Promoter")), F.count_if(_is("Detractor"))
    return whole(m, total_customers=rows(), promoters=up, passives=F.count_if(_is("Passive")),
                 detractors=down, net_promoter_score=rnd(pct(up - down, rows())))


@report("nps_cohort", 2)
def nps_ltv(m, w):
    return grouped(m, ["primary_nps_category"], customer_count=rows(), avg_ltv=money_mean("total_revenue"),
                   avg_aov=mean("avg_order_value"), avg_orders=mean("total_orders"),
                   retention_rate=rate("is_repeat_customer")).orderBy(F.desc("avg_ltv"))


@report("nps_cohort", 3)
def nps_first_order(m, w):
    return grouped(m, ["first_order_nps_category"], customer_count=rows(),
                   avg_ltv=money_mean("total_revenue"), retention_rate=rate("is_repeat_customer"),
                   avg_lifespan_days=mean("customer_lifespan_days", 1)).orderBy(F.desc("retention_rate"))


@report("nps_cohort", 4)
def nps_recovery(m, w):
    return grouped(m.where("nps_journey <> 'Stable'"), ["nps_journey"], customer_count=rows(),
                   avg_ltv=money_mean("total_revenue"), avg_final_score=mean("avg_review_score"),
                   avg_orders=mean("total_orders")).orderBy(F.desc("customer_count"))


@report("nps_cohort", 5)
def nps_trends(m, w):
    return grouped(m, ["nps_trend"], customer_count=rows(), avg_ltv=money_mean("total_revenue"),
                   avg_score=mean("avg_review_score"), retention_rate=rate("is_repeat_customer")
                   ).orderBy(F.desc("customer_count"))


@report("nps_cohort", 6)
def nps_impact(m, w):
    impact = F.col("estimated_nps_impact_value").cast("decimal(18,6)")
    return grouped(m, ["primary_nps_category"], customers=rows(), total_revenue=total("total_revenue"),
                   estimated_impact=rnd(F.sum(impact)),
                   avg_retention_prob=mean("estimated_retention_probability", 3)
                   ).orderBy(F.desc("estimated_impact"))


@report("nps_cohort", 7)
def nps_value(m, w):
    return grouped(m, ["nps_value_segment"], customer_count=rows(), avg_ltv=money_mean("total_revenue"),
                   avg_score=mean("avg_review_score"),
                   recovery_rate=rate(F.col("is_recovered_detractor") == 1)).orderBy(F.desc("avg_ltv"))


# --- propensity_scores -------------------------------------------------------------------

@report("propensity_scores", 1)
def propensity_completeness(m, w):
    checked = {"recency": "recency_days", "frequency": "frequency", "monetary": "monetary",
               "reviews": "avg_review_score", "category_affinity": "top_category"}
    return whole(m, total_customers=rows(), **{f"has_{k}": F.count(c) for k, c in checked.items()})


@report("propensity_scores", 2)
def propensity_features(m, w):
    return whole(m, avg_recency=mean("recency_days", 1), avg_frequency=mean("frequency", 1),
                 avg_monetary=money_mean("monetary"), avg_review=mean("avg_review_score"),
                 avg_category_diversity=mean("unique_categories_purchased", 1))


@report("propensity_scores", 3)
def propensity_status(m, w):
    return grouped(m, ["current_customer_status"], customers=rows(), avg_ltv=money_mean("monetary"),
                   avg_orders=mean("frequency", 1))


@report("propensity_scores", 4)
def propensity_categories(m, w):
    g = grouped(m.where("top_category is not null"), ["top_category"], customers=rows(),
                avg_ltv=money_mean("monetary"))
    return top(g, 10, F.desc("customers"), "top_category")


@report("propensity_scores", 5)
def propensity_first_order(m, w):
    return grouped(m.where("first_payment_method is not null"), ["first_payment_method"], customers=rows(),
                   repeat_rate=rate(F.col("frequency") > 1),
                   avg_first_review=mean("first_order_review_score")).orderBy(F.desc("customers"))
