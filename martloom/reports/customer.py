"""Reports on the customer marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions import cents, from_cents, lookup, pct, ratio, rnd, to_long
from martloom.functions.fixed import AGE_BINS, RFM_ACTIONS, RFM_DEFAULT_ACTION
from martloom.operators.ranking import share_of_total, value_profile, with_group_quantile
from martloom.operators.sequence import top_per_group
from martloom.reports.common import (
    by_label, grouped, mean, money_mean, rate, report, rows, top, total, whole, with_share,
)

SEGMENTS = tuple(RFM_ACTIONS)


def revenue_of_top(m: DataFrame, cuts: dict[str, object]) -> DataFrame:
    """Rows and revenue among the first K customers by revenue, for each named K.

    Tied customers have the same revenue, so the profile of distinct revenues is enough; it does
    not matter which of them the cut falls between. ``cuts`` maps a label to a function of N.
    """
    profile = value_profile(
        m.select(cents("total_revenue").alias("c")), "c", descending=True
    )
    n = profile.agg(F.max("cum_n").alias("n")).scalar()
    before = F.col("cum_n") - F.col("n")
    taken = {k: F.greatest(F.lit(0), F.least(F.col("n"), cut(n) - before)) for k, cut in cuts.items()}
    return profile.agg(
        F.sum(F.col("c") * F.col("n")).alias("all_c"),
        *[e.alias(f"{p}_{k}") for k, t in taken.items()
          for p, e in (("c", F.sum(F.col("c") * t)), ("n", F.sum(t)))],
    )


# --- customer_base -----------------------------------------------------------------------

@report("customer_base", 1)
def base_totals(m, w):
    return whole(m, total_customers=rows(), unique_customers=F.count_distinct("customer_id"))


@report("customer_base", 2)
def base_types(m, w):
    return with_share(grouped(m, ["is_repeat_customer"], customer_count=rows()), "customer_count", "percentage")


@report("customer_base", 3)
def base_concentration(m, w):
    row = revenue_of_top(m, {"1": lambda n: F.floor(n * 0.01), "10": lambda n: F.floor(n * 0.10)})
    return row.select(
        rnd(ratio("c_1", "all_c") * 100).alias("top_1_pct_revenue"),
        rnd(ratio("c_10", "all_c") * 100).alias("top_10_pct_revenue"),
    )


@report("customer_base", 4)
def base_averages(m, w):
    return whole(m, avg_orders=mean("total_orders"), avg_revenue=money_mean("total_revenue"),
                 avg_review=mean("avg_review_score"), avg_recency_days=mean("recency_days"),
                 avg_lifespan_days=mean("customer_lifespan_days"))


@report("customer_base", 5)
def base_status(m, w):
    return whole(m, repeat_customers=F.count_if("is_repeat_customer"),
                 churned_customers=F.count_if("is_churned"),
                 satisfied_customers=F.count_if("is_satisfied_customer"),
                 customers_with_delivery_issues=F.count_if("has_delivery_issues"))


# --- customer_rfm ------------------------------------------------------------------------

@report("customer_rfm", 1)
def rfm_distribution(m, w):
    g = grouped(m, ["rfm_segment"], num_customers=rows(), avg_recency_days=mean("recency", 1),
                avg_frequency=mean("frequency", 1), avg_monetary=money_mean("monetary"))
    return with_share(g, "num_customers", "pct_customers").orderBy(F.desc("num_customers"))


@report("customer_rfm", 2)
def rfm_revenue(m, w):
    g = grouped(m, ["rfm_segment"], num_customers=rows(), total_revenue=total("monetary"),
                avg_ltv=money_mean("monetary"), avg_aov=mean("avg_order_value"))
    return with_share(g, "total_revenue", "pct_revenue").orderBy(F.desc("total_revenue"))


@report("customer_rfm", 3)
def rfm_repurchase(m, w):
    return grouped(m, ["rfm_segment"], total_customers=rows(),
                   repeat_customers=F.count_if("is_repeat_customer"),
                   repurchase_rate_pct=rate("is_repeat_customer")).orderBy(F.desc("repurchase_rate_pct"))


@report("customer_rfm", 4)
def rfm_scores(m, w):
    keys = ["r_score", "f_score", "m_score"]
    return grouped(m, keys, num_customers=rows(), avg_revenue=money_mean("monetary")).orderBy(
        *[F.desc(k) for k in keys])


@report("customer_rfm", 5)
def rfm_top_segments(m, w):
    best = ("Champions", "Loyal Customers", "Potential Loyalists", "Can't Lose Them", "At Risk")
    return grouped(m.where(F.col("rfm_segment").isin(*best)), ["rfm_segment"], customers=rows(),
                   total_revenue=total("monetary"), avg_ltv=money_mean("monetary"),
                   avg_orders=mean("frequency", 1), avg_recency_days=mean("recency", 0)
                   ).orderBy(F.desc("total_revenue"))


@report("customer_rfm", 6)
def rfm_actions(m, w):
    g = grouped(m, ["rfm_segment"], customers=rows(), revenue=total("monetary"),
                avg_recency=mean("recency", 0), avg_frequency=mean("frequency", 1),
                avg_monetary=money_mean("monetary"))
    g = g.withColumn("recommended_action", lookup("rfm_segment", RFM_ACTIONS, RFM_DEFAULT_ACTION))
    return by_label(g, "rfm_segment", (*SEGMENTS, "Other"))


@report("customer_rfm", 7)
def rfm_regions(m, w):
    return grouped(m, ["customer_region", "rfm_segment"], customers=rows(), revenue=total("monetary")
                   ).orderBy("customer_region", F.desc("revenue"))


# --- customer_ltv ------------------------------------------------------------------------

@report("customer_ltv", 1)
def ltv_summary(m, w):
    summary = whole(m, total_customers=rows(), avg_clv=money_mean("total_revenue"),
                    median_clv=F.lit(None).cast("double"),
                    max_clv=rnd(F.max("total_revenue")), min_clv=rnd(F.min("total_revenue")))
    return with_group_quantile(summary, m, [], "total_revenue", "median_clv", digits=2)


@report("customer_ltv", 2)
def ltv_segments(m, w):
    g = grouped(m, ["clv_segment"], customers=rows(), avg_revenue=money_mean("total_revenue"),
                total_revenue=total("total_revenue"))
    return by_label(with_share(g, "total_revenue", "revenue_pct"), "clv_segment",
                    ("VIP", "High", "Medium", "Low"))


@report("customer_ltv", 3)
def ltv_top_customers(m, w):
    row = revenue_of_top(m, {str(p): (lambda n, p=p: to_long(n * (p / 100.0))) for p in (1, 5, 10)})
    lines = F.array(*[
        F.struct(F.lit(f"Top {p}%").alias("segment"), F.col(f"n_{p}").alias("customers"),
                 rnd(from_cents(f"c_{p}")).alias("total_revenue"),
                 rnd(pct(f"c_{p}", "all_c")).alias("revenue_pct"))
        for p in (1, 5, 10)
    ])
    return row.select(F.inline(lines))


STATE_COLUMNS = ("customer_state", "customer_region", "total_customers_state", "avg_ltv_state",
                 "median_ltv_state", "total_revenue_state", "avg_aov_state",
                 "repurchase_rate_state", "revenue_concentration_pct", "state_ltv_rank")


@report("customer_ltv", 4)
def ltv_states(m, w):
    return m.select(*STATE_COLUMNS).distinct().orderBy("state_ltv_rank")


@report("customer_ltv", 5)
def ltv_pareto(m, w):
    states = m.select("customer_state", "total_revenue_state", "revenue_concentration_pct").distinct()
    line = Window.orderBy(F.desc("total_revenue_state"))  # one row per state
    return states.select(
        "customer_state", F.col("total_revenue_state").alias("revenue"),
        F.col("revenue_concentration_pct").alias("pct_of_total"),
        rnd(F.sum("revenue_concentration_pct").over(line)).alias("cumulative_pct"),
    ).orderBy(F.desc("revenue"))


@report("customer_ltv", 6)
def ltv_state_repurchase(m, w):
    return m.select("customer_state", "total_customers_state", "repurchase_rate_state",
                    "avg_ltv_state").distinct().orderBy(F.desc("repurchase_rate_state"))


# --- customer_cohort_retention -----------------------------------------------------------

OFFSET = "months_since_first_purchase"


def _at(month: int, value: str):
    return F.max(F.when(F.col(OFFSET) == month, F.col(value)))


@report("customer_cohort_retention", 1)
def retention_matrix(m, w):
    months = [0, 1, 2, 3, 6, 12]
    wide = m.groupBy("cohort_month", "cohort_size").pivot(OFFSET, months).agg(F.max("retention_rate"))
    return wide.select("cohort_month", "cohort_size",
                       *[F.col(str(k)).alias(f"M{k}") for k in months]).orderBy("cohort_month")


@report("customer_cohort_retention", 2)
def retention_curve(m, w):
    return grouped(m, [OFFSET, "month_label"], avg_retention_rate=mean("retention_rate"),
                   num_cohorts=F.count_distinct("cohort_month"),
                   total_retained_customers=F.sum("retained_customers")).orderBy(OFFSET)


@report("customer_cohort_retention", 3)
def retention_best_worst(m, w):
    m3 = m.where(F.col(OFFSET) == 3).select(
        "cohort_month", "cohort_size", F.col("retention_rate").alias("m3_retention_rate"),
        F.col("retained_customers").alias("m3_retained_customers"))

    def five(label, order):
        return top(m3, 5, order, "cohort_month").select(F.lit(label).alias("category"), "*")

    return five("Best Cohorts", F.desc("m3_retention_rate")).unionByName(
        five("Worst Cohorts", F.asc("m3_retention_rate")))


@report("customer_cohort_retention", 4)
def retention_revenue(m, w):
    return grouped(m, [OFFSET, "month_label"], avg_customer_retention=mean("retention_rate"),
                   total_revenue=total("cohort_revenue"),
                   avg_revenue_per_customer=mean("revenue_per_customer"),
                   num_cohorts=F.count_distinct("cohort_month")).orderBy(OFFSET)


@report("customer_cohort_retention", 5)
def cohort_summary(m, w):
    best = F.max("cumulative_revenue")
    g = grouped(m, ["cohort_month", "cohort_size"], total_cohort_revenue=rnd(best),
                **{f"m{k}_retention": _at(k, "retention_rate") for k in (1, 3, 6)})
    return g.withColumn("ltv_per_customer", rnd(ratio("total_cohort_revenue", "cohort_size"))
                        ).orderBy("cohort_month")


@report("customer_cohort_retention", 6)
def retention_decay(m, w):
    before = F.lag("retention_rate").over(Window.partitionBy("cohort_month").orderBy(OFFSET))
    steps = m.withColumn("change", F.col("retention_rate") - before).where("change is not null")
    return grouped(steps, [OFFSET], avg_retention=mean("retention_rate"),
                   avg_retention_change=mean("change"), max_decay=rnd(F.min("change")),
                   num_cohorts=F.count_distinct("cohort_month")).orderBy(OFFSET)


# --- customer_segments -------------------------------------------------------------------

BY = ["segment_name"]


@report("customer_segments", 1)
def segment_distribution(m, w):
    return with_share(grouped(m, BY, num_customers=rows()), "num_customers", "pct_customers").orderBy(
        F.desc("num_customers"))


@report("customer_segments", 2)
def segment_profile(m, w):
    return grouped(m, BY, num_customers=rows(), avg_ltv=money_mean("monetary"),
                   avg_aov=mean("avg_order_value"), avg_frequency=mean("frequency", 1),
                   avg_recency_days=mean("recency", 0),
                   avg_category_diversity=mean("category_diversity", 1),
                   avg_review_score=mean("avg_review_score")).orderBy(F.desc("avg_ltv"))


@report("customer_segments", 3)
def segment_revenue(m, w):
    g = grouped(m, BY, customers=rows(), total_revenue=total("monetary"), avg_ltv=money_mean("monetary"))
    return with_share(g, "total_revenue", "pct_revenue").orderBy(F.desc("total_revenue"))


@report("customer_segments", 4)
def segment_categories(m, w):
    g = grouped(m, [*BY, "preferred_category"], num_customers=rows(),
                avg_category_diversity=mean("category_diversity", 1))
    return top_per_group(g, BY, [F.desc("num_customers"), "preferred_category"], 3).orderBy(
        *BY, F.desc("num_customers"))


@report("customer_segments", 5)
def segment_payments(m, w):
    g = grouped(m, [*BY, "preferred_payment_method"], num_customers=rows(),
                avg_installments=mean("avg_installments", 1))
    return top_per_group(g, BY, [F.desc("num_customers"), "preferred_payment_method"], 1).orderBy(*BY)


@report("customer_segments", 6)
def segment_patterns(m, w):
    returning = m.where("avg_days_between_purchases is not null")
    return grouped(returning, BY, avg_pct_weekend=mean("pct_weekend_shopper", 1),
                   avg_pct_night=mean("pct_night_shopper", 1),
                   avg_days_between_purchases=mean("avg_days_between_purchases", 0)
                   ).orderBy(F.desc("avg_pct_weekend"))


@report("customer_segments", 7)
def segment_experience(m, w):
    return grouped(m, BY, avg_review_score=mean("avg_review_score"),
                   avg_pct_delayed=mean("pct_delayed_orders", 1),
                   avg_freight_paid=money_mean("total_freight_paid")).orderBy(F.desc("avg_review_score"))


@report("customer_segments", 8)
def segment_regions(m, w):
    return grouped(m, [*BY, "customer_region"], num_customers=rows(), total_revenue=total("monetary")
                   ).orderBy(*BY, F.desc("total_revenue"))


@report("customer_segments", 9)
def segment_by_rfm(m, w):
    return grouped(m, [*BY, "rfm_segment"], num_customers=rows(), avg_ltv=money_mean("monetary")
                   ).orderBy(*BY, F.desc("num_customers"))


@report("customer_segments", 10)
def segment_spread(m, w):
    def sd(c):
        return rnd(F.stddev_samp(c))

    return grouped(m, BY, stddev_ltv=sd("monetary"), stddev_aov=sd("avg_order_value"),
                   stddev_frequency=sd("frequency"), stddev_category_diversity=sd("category_diversity")
                   ).orderBy(*BY)


# --- customer_age: projections of a six-row mart -----------------------------------------

def _aged(m, *columns):
    return by_label(m, "customer_age_bin", AGE_BINS).select("customer_age_bin", *columns)


@report("customer_age", 1)
def age_distribution(m, w):
    return _aged(m.withColumn("pct_of_total", share_of_total("customers_in_bin")),
                 "customers_in_bin", "pct_of_total", "avg_age_days_in_bin", "avg_orders_in_bin")


@report("customer_age", 2)
def age_ltv_curve(m, w):
    return _aged(m, F.col("avg_revenue_in_bin").alias("avg_ltv"), "cumulative_revenue",
                 "avg_orders_in_bin", "avg_aov_in_bin", "monthly_order_frequency")


@report("customer_age", 3)
def age_churn(m, w):
    return _aged(m, "customers_in_bin", "churn_rate_bin", "active_rate_bin", "repeat_rate_bin")


@report("customer_age", 4)
def age_stages(m, w):
    stage = (F.when(F.col("is_honeymoon_period"), "Honeymoon Period (0-6m)")
             .when(F.col("is_danger_zone"), "Danger Zone (6-12m)")
             .when(F.col("is_mature_period"), "Mature Period (12+m)"))
    return grouped(m, [stage.alias("lifecycle_stage")], total_customers=F.sum("customers_in_bin"),
                   avg_orders=mean("avg_orders_in_bin"), avg_revenue=mean("avg_revenue_in_bin"),
                   avg_aov=mean("avg_aov_in_bin"), avg_churn_rate=mean("churn_rate_bin")
                   ).orderBy("lifecycle_stage")


@report("customer_age", 5)
def age_frequency(m, w):
    return _aged(m, "monthly_order_frequency", "avg_orders_in_bin", "revenue_growth_rate_pct")


@report("customer_age", 6)
def age_best(m, w):
    return m.select("customer_age_bin", "avg_revenue_in_bin", "revenue_rank", "orders_rank",
                    "retention_rank").orderBy("revenue_rank")


@report("customer_age", 7)
def age_progress(m, w):
    return _aged(m, "cumulative_customers", "cumulative_revenue", "cumulative_orders",
                 rnd(ratio("cumulative_revenue", "cumulative_customers")).alias("avg_ltv_cumulative"))


# --- customer_churn ----------------------------------------------------------------------

def _churned():
    return {"customers": rows(), "churned": F.count_if("is_churned"), "churn_rate_pct": rate("is_churned")}


@report("customer_churn", 1)
def churn_rate(m, w):
    return whole(m, total_customers=rows(), churned_customers=F.count_if("is_churned"),
                 churn_rate_pct=rate("is_churned"))


@report("customer_churn", 2)
def churn_by_risk(m, w):
    return grouped(m, ["churn_risk_segment"], **_churned(), avg_risk_score=mean("churn_risk_score", 1),
                   avg_days_since_purchase=mean("days_since_last_purchase", 1)
                   ).orderBy(F.desc("avg_risk_score"))


@report("customer_churn", 3)
def churn_by_rfm(m, w):
    return grouped(m, ["rfm_segment"], **_churned(), avg_risk_score=mean("churn_risk_score", 1),
                   avg_ltv=money_mean("total_spent")).orderBy(F.desc("churn_rate_pct"))


@report("customer_churn", 4)
def churn_by_state(m, w):
    g = grouped(m, ["customer_state"], **_churned(), avg_risk_score=mean("churn_risk_score", 1))
    return top(g, 10, F.desc("customers"), "customer_state")


@report("customer_churn", 5)
def churn_by_payment(m, w):
    return grouped(m, ["preferred_payment_method"], **_churned(),
                   avg_risk_score=mean("churn_risk_score", 1)).orderBy(F.desc("customers"))


@report("customer_churn", 6)
def churn_watch_list(m, w):
    active = m.where(~F.col("is_churned")).select(
        "customer_id", "customer_state", "churn_risk_score", "churn_risk_percentile_pct",
        "days_since_last_purchase", "total_orders", rnd("total_spent").alias("total_spent"),
        "rfm_segment", "avg_review_score", "pct_delayed_orders")
    return top(active, 100, F.desc("churn_risk_score"), "customer_id")


@report("customer_churn", 7)
def churn_feature_means(m, w):
    features = {
        "High Recency": F.col("recency_score"), "Low Frequency": F.col("frequency_score"),
        "Low Monetary": F.col("monetary_score"), "Delayed Orders %": F.col("pct_delayed_orders") * 100,
        "Low Review Score": F.col("avg_review_score"),
    }
    lost = F.col("is_churned")
    row = m.agg(*[
        F.struct(F.lit(name).alias("feature"),
                 rnd(F.avg(F.when(lost, c).otherwise(0))).alias("avg_when_churned"),
                 rnd(F.avg(F.when(lost, 0).otherwise(c))).alias("avg_when_active")).alias(f"f{i}")
        for i, (name, c) in enumerate(features.items())
    ])
    return row.select(F.inline(F.array(*row.columns)))


@report("customer_churn", 8)
def churn_histogram(m, w):
    low = (F.floor(F.col("churn_risk_score") / 10) * 10).alias("risk_score_bin")
    return grouped(m, [low], **_churned()).orderBy("risk_score_bin")


@report("customer_churn", 9)
def churn_nulls(m, w):
    checked = {"customer_id": "customer_id", "recency": "days_since_last_purchase",
               "frequency": "total_orders", "monetary": "total_spent", "risk_score": "churn_risk_score"}
    return whole(m, **{f"null_{k}": F.count_if(F.col(c).isNull()) for k, c in checked.items()})


@report("customer_churn", 10)
def churn_outreach(m, w):
    urgent = m.where((F.col("churn_risk_percentile_pct") >= 90) & ~F.col("is_churned"))
    return whole(urgent, top_10_pct_customers=rows(), avg_ltv_at_risk=money_mean("total_spent"),
                 total_ltv_at_risk=total("total_spent"),
                 avg_days_inactive=mean("days_since_last_purchase", 1))
