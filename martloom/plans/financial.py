"""Financial marts: order value, geography, revenue over time, unit economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import MartConfig
from martloom.functions import (
    as_timestamp,
    at_least,
    cents,
    from_cents,
    money_avg,
    money_sum,
    month_start,
    pct,
    ranges,
    rate_where,
    ratio,
    rnd,
    week_start,
)
from martloom.operators.ranking import share_of_total, with_group_quantile
from martloom.operators.sequence import sequence_within
from martloom.plans.common import completed


def mart_aov_analysis(facts: DataFrame, customers: DataFrame, cfg: MartConfig) -> DataFrame:
    """One row per completed, paid order: value, size, freight and payment segments."""
    paid = completed(facts).where("paid_c > 0").withColumn("order_value", from_cents("paid_c"))
    numbered = sequence_within(
        paid, "customer_id", ["order_purchase_timestamp", "order_id"], "order_id",
    )
    value, bought = F.col("order_value"), F.col("order_purchase_timestamp")
    n = F.coalesce("items", F.lit(0))
    freight = from_cents("freight_c")
    freight_ratio = ratio(freight, value)
    methods, parts = F.col("payment_methods"), F.col("max_installments")
    return numbered.join(
        customers.select("customer_id", "customer_state", "customer_city"), "customer_id", "left"
    ).select(
        "order_id", "customer_id", "customer_state", "customer_city", "order_value",
        n.alias("items_per_order"),
        F.coalesce("products", F.lit(0)).alias("unique_products_per_order"),
        freight.alias("total_freight_value"),
        F.when(n > 0, ratio(value, n)).otherwise(0.0).alias("avg_item_price"),
        F.when(n > 0, ratio(freight, n)).otherwise(0.0).alias("avg_freight_per_item"),
        freight_ratio.alias("freight_to_value_ratio"),
        F.when(value < 50, "low").when(value <= 150, "medium").when(value <= 300, "high")
        .otherwise("premium").alias("value_bin"),
        ranges(n, [(1, 1, "single_item"), (2, 3, "few_items"), (4, 6, "multiple_items")],
               "many_items").alias("items_bin"),
        F.when(F.size(methods) > 1, "mixed")
        .otherwise(F.concat(F.element_at(methods, 1), F.lit("_only")))
        .alias("payment_method_segment"),
        ranges(parts, [(1, 1, "no_installments"), (2, 3, "few_installments"),
                       (4, 6, "medium_installments")], "many_installments")
        .alias("installments_segment"),
        "order_purchase_timestamp",
        as_timestamp(month_start(bought)).alias("order_month"),
        as_timestamp(week_start(bought)).alias("order_week"),
        F.year(bought).alias("order_year"),
        F.quarter(bought).alias("order_quarter"),
        methods.alias("payment_methods_used"), "max_installments", "credit_card_payments", "boleto_payments",
        (value > 1000).cast("int").alias("is_high_value_order"),
        (n > 5).cast("int").alias("is_high_item_count_order"),
        F.coalesce(freight_ratio > 0.3, F.lit(False)).cast("int").alias("has_high_freight_ratio"),
        F.col("seq").alias("customer_order_sequence"),
    )


def mart_geographic_performance(ltv: DataFrame) -> DataFrame:
    """One row per state. All windows run over the states, of which there are few."""
    states = ltv.groupBy("customer_state", "customer_region").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if("is_repeat_customer").alias("repeat_customers"),
        rnd(money_sum("total_revenue")).alias("total_revenue"),
        rnd(money_avg("total_revenue")).alias("avg_ltv"),
        F.lit(None).cast("double").alias("median_ltv"),
        rnd(F.max("total_revenue")).alias("max_ltv"),
        rnd(F.min("total_revenue")).alias("min_ltv"),
        F.sum("total_orders").alias("total_orders"),
        rnd(F.avg("total_orders")).alias("avg_orders_per_customer"),
        rnd(F.avg("avg_order_value")).alias("avg_aov"),
        rate_where(F.col("is_repeat_customer")).alias("repurchase_rate"),
        rnd(F.avg("customer_lifespan_days")).alias("avg_customer_lifespan_days"),
        rnd(F.avg("orders_per_month")).alias("avg_orders_per_month"),
    )
    everything = Window.partitionBy()

    def rank(c: str) -> Column:
        return F.dense_rank().over(Window.orderBy(F.desc(c)))

    revenue_c = cents("total_revenue")
    ranked = states.select(
        "*",
        share_of_total("total_revenue").alias("revenue_concentration_pct"),
        rnd(pct(F.sum(revenue_c).over(Window.orderBy(F.desc("total_revenue"))),
                F.sum(revenue_c).over(everything))).alias("cumulative_revenue_pct"),
        share_of_total("total_customers").alias("customer_concentration_pct"),
        rank("avg_ltv").alias("ltv_rank"),
        rank("total_revenue").alias("revenue_rank"),
        rank("total_customers").alias("customer_rank"),
        rank("repurchase_rate").alias("repurchase_rank"),
        rnd(F.avg("avg_ltv").over(everything), 6).alias("_mean_ltv"),
    )
    rich = F.col("avg_ltv") >= F.col("_mean_ltv")
    out = ranked.select(
        *[c for c in ranked.columns if c != "_mean_ltv"],
        rnd(ratio("total_customers", F.col("total_revenue") / 1000000.0)).alias(
            "customers_per_million_revenue"),
        rnd(ratio("total_revenue", "total_customers")).alias("revenue_per_customer"),
        at_least("revenue_concentration_pct",
                 [(10, "High Penetration"), (5, "Medium Penetration"), (2, "Low Penetration")],
                 "Very Low Penetration").alias("market_penetration_category"),
        F.when((F.col("repurchase_rate") >= 15) & rich, "High Potential")
        .when((F.col("repurchase_rate") >= 10) | rich, "Medium Potential")
        .otherwise("Low Potential").alias("growth_potential"),
    )
    # Exact medians per state, joined once the windows over states are taken.
    return with_group_quantile(out, ltv, ["customer_state", "customer_region"], "total_revenue", "median_ltv",
                               digits=2)


def mart_revenue_summary(facts: DataFrame) -> DataFrame:
    """Revenue by day, week and month, split into first-month and later revenue.

    Orders are first reduced to one row per customer and day. Each grain then adds up its own
    (customer, period) rows, so that counting customers is counting rows. A customer has at most
    one row per calendar day, which bounds the window that finds the first month.
    """
    daily = (
        completed(facts)
        .groupBy("customer_id", F.to_date("order_purchase_timestamp").alias("day"))
        .agg(F.count("paid_c").alias("orders"), F.sum("payments").alias("payments"),
             F.sum("paid_c").alias("paid_c"))
    )
    first_day = F.min("day").over(Window.partitionBy("customer_id"))
    # The first month counts unpaid completed orders too; the revenue rows do not.
    rows = daily.withColumn("is_new", month_start("day") == month_start(first_day)).where("orders > 0")

    def grain(label: str, period: Column) -> DataFrame:
        per_customer = rows.groupBy("customer_id", period.alias("revenue_date")).agg(
            F.sum("orders").alias("orders"),
            F.sum("payments").alias("payments"),
            F.sum("paid_c").alias("paid_c"),
            F.coalesce(F.sum(F.when(F.col("is_new"), F.col("paid_c"))), F.lit(0)).alias("new_c"),
            F.bool_or("is_new").alias("any_new"),
            F.bool_or(~F.col("is_new")).alias("any_old"),
        )
        return per_customer.groupBy("revenue_date").agg(
            F.lit(label).alias("time_period"),
            F.sum("orders").alias("total_orders"),
            F.count(F.lit(1)).alias("total_customers"),
            F.count_if("any_new").alias("new_customers"),
            F.count_if("any_old").alias("repeat_customers"),
            from_cents(F.sum("paid_c")).alias("total_revenue"),
            from_cents(F.sum("new_c")).alias("new_customer_revenue"),
            from_cents(F.sum("paid_c") - F.sum("new_c")).alias("repeat_customer_revenue"),
            ratio(from_cents(F.sum("paid_c")), F.sum("payments")).alias("avg_order_value"),
        )

    day = F.col("day")
    periods = (
        grain("daily", day)
        .unionByName(grain("weekly", week_start(day)))
        .unionByName(grain("monthly", month_start(day)))
    )
    # Calendar-sized from here: one row per period.
    line = Window.partitionBy("time_period").orderBy("revenue_date")
    revenue, monthly = F.col("total_revenue"), F.col("time_period") == "monthly"

    def back(n: int) -> Column:
        return F.when(monthly, F.lag("total_revenue", n).over(line))

    grown = periods.select(
        "*",
        from_cents(F.sum(cents(revenue)).over(
            line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("cumulative_revenue"),
        back(1).alias("previous_period_revenue"),
        back(12).alias("previous_year_revenue"),
    )

    def growth(base: str) -> Column:
        return ratio(revenue - F.col(base), base) * 100

    mom = growth("previous_period_revenue")
    repeat_share = ratio("repeat_customer_revenue", revenue)
    return grown.select(
        "revenue_date", "time_period", "total_orders", "total_customers", "new_customers",
        "repeat_customers", "total_revenue", "new_customer_revenue", "repeat_customer_revenue",
        "avg_order_value", "cumulative_revenue", "previous_period_revenue",
        mom.alias("revenue_growth_mom_pct"),
        "previous_year_revenue",
        growth("previous_year_revenue").alias("revenue_growth_yoy_pct"),
        (ratio("repeat_customers", "total_customers") * 100).alias("repeat_customer_rate"),
        (repeat_share * 100).alias("repeat_revenue_rate"),
        ratio(revenue, "total_customers").alias("revenue_per_customer"),
        ratio("new_customer_revenue", "new_customers").alias("revenue_per_new_customer"),
        ratio("repeat_customer_revenue", "repeat_customers").alias("revenue_per_repeat_customer"),
        (revenue > 10000).alias("is_high_revenue_day"),
        (mom > 0).alias("is_positive_growth"),
        (repeat_share > 0.3).alias("has_high_repeat_rate"),
    )


def mart_unit_economics(ltv: DataFrame, rfm: DataFrame, items: DataFrame, cfg: MartConfig) -> DataFrame:
    """Value, margin and payback per RFM segment, state, region and acquisition quarter.

    Each customer row is repeated once per segmentation and everything is added up in one
    aggregation, so the customer table is read once.
    """
    economics = (
        completed(items)
        .groupBy("customer_id")
        .agg(
            F.sum(cents("price")).alias("gross_c"),
            F.sum(cents("freight_value")).alias("freight_c"),
            rnd(F.avg(ratio(F.col("price") - F.col("freight_value"), "price")) * 100).alias("margin"),
        )
    )
    cac = F.lit(cfg.cac)
    revenue = F.col("total_revenue")
    months = rnd(F.col("customer_lifespan_days") / 30.0)
    net = from_cents(F.coalesce(F.col("gross_c") - F.col("freight_c"), F.lit(0)))
    quarter = F.date_format("first_purchase_date", "yyyy-'Q'q")

    def segment(kind: str, name: Column, region: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), region.alias("region"))

    nowhere = F.lit(None).cast("string")
    customers = (
        ltv.join(rfm.select("customer_id", "rfm_segment"), "customer_id")
        .join(economics, "customer_id", "left")
        .select(
            revenue.alias("revenue"), "total_orders", "avg_order_value",
            from_cents(F.coalesce("gross_c", F.lit(0))).alias("gross"),
            from_cents(F.coalesce("freight_c", F.lit(0))).alias("freight"),
            net.alias("net"),
            F.coalesce("margin", F.lit(0.0)).alias("margin"),
            rnd(revenue / cac).alias("ltv_cac"),
            rnd(F.when(months > 0, revenue / months).otherwise(revenue)).alias("monthly"),
            F.when(months > 0, rnd(ratio(cac, revenue / months))).alias("payback"),
            rnd(net - cac).alias("contribution"),
            months.alias("months"),
            F.explode(F.array(
                segment("RFM Segment", F.col("rfm_segment"), nowhere),
                segment("State", F.col("customer_state"), F.col("customer_region")),
                segment("Region", F.col("customer_region"), nowhere),
                segment("Cohort", quarter, nowhere),
            )).alias("s"),
        )
    )
    return customers.groupBy(
        F.col("s.kind").alias("segmentation_type"),
        F.col("s.name").alias("segment_name"),
        F.col("s.region").alias("segment_region"),
    ).agg(
        F.count(F.lit(1)).alias("num_customers"),
        rnd(money_avg("revenue")).alias("avg_ltv"),
        rnd(money_sum("revenue")).alias("total_revenue"),
        rnd(F.avg("total_orders")).alias("avg_orders"),
        rnd(F.avg("avg_order_value")).alias("avg_aov"),
        rnd(money_avg("gross")).alias("avg_gross_revenue"),
        rnd(money_avg("freight")).alias("avg_total_freight"),
        rnd(money_avg("net")).alias("avg_net_revenue"),
        rnd(F.avg("margin")).alias("avg_margin_pct"),
        F.first(cac).alias("avg_cac_proxy"),
        rnd(F.avg("ltv_cac")).alias("avg_ltv_cac_ratio"),
        rnd(F.avg("payback")).alias("avg_payback_months"),
        rnd(F.avg("contribution")).alias("avg_contribution_margin"),
        rnd(F.avg("months")).alias("avg_customer_lifespan_months"),
        rnd(F.avg("monthly")).alias("avg_monthly_revenue"),
    )
