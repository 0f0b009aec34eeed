"""Operational marts: categories, delivery, payment methods, repeat purchase, sellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import MartConfig
from martloom.functions import (
    as_col,
    as_timestamp,
    bins,
    cents,
    day_diff,
    from_cents,
    money_avg,
    money_sum,
    month_start,
    pct,
    ranges,
    rate_where,
    ratio,
    rnd,
)
from martloom.operators.ranking import share_of_total, value_profile
from martloom.operators.sequence import distinct_count, top_per_group
from martloom.operators.storage import settled
from martloom.plans.common import categorised, completed

INSTALLMENT_BINS = [(1, 1, "1x"), (2, 3, "2-3x"), (4, 6, "4-6x"), (7, 12, "7-12x"),
                    (13, float("inf"), "13+x")]


def mart_category_performance(items: DataFrame) -> DataFrame:
    """One row per product category, from the item facts.

    (category, order) and then (category, customer) rows answer the questions about buyers,
    (category, day) rows those about time: every distinct count is a count of rows, and a large
    category is spread over its orders, customers or days.
    """
    sold = categorised(items)
    margin = ratio(F.col("price") - F.col("freight_value"), "price")
    per_order = sold.groupBy("category", "order_id", "customer_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum(cents("price")).alias("price_c"),
        F.sum(cents("freight_value")).alias("freight_c"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.sum(margin).alias("margin_sum"),
        F.count(margin).alias("margin_n"),
    )
    per_customer = per_order.groupBy("category", "customer_id").agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.sum(c).alias(c) for c in ("units", "price_c", "freight_c", "margin_sum", "margin_n")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    # A customer has at most one row per category here.
    mine = Window.partitionBy("customer_id")
    buyers = per_customer.withColumn("_categories", F.count(F.lit(1)).over(mine))
    revenue = from_cents(F.sum("price_c"))
    sales = buyers.groupBy("category").agg(
        rnd(revenue).alias("category_revenue"),
        F.sum("orders").alias("category_orders"),
        F.sum("units").alias("category_units"),
        rnd(ratio(revenue, F.sum("units"))).alias("avg_price_per_category"),
        rnd(F.min("low")).alias("min_price"),
        rnd(F.max("high")).alias("max_price"),
        rnd(from_cents(F.sum("freight_c"))).alias("total_freight"),
        rnd(ratio(from_cents(F.sum("freight_c")), F.sum("units"))).alias("avg_freight"),
        rnd(from_cents(F.sum("price_c") - F.sum("freight_c"))).alias("category_margin"),
        rnd(ratio(F.sum("margin_sum"), F.sum("margin_n")) * 100).alias("avg_margin_pct"),
        F.count(F.lit(1)).alias("unique_customers"),
        F.count_if(F.col("orders") >= 2).alias("repeat_customers"),
        rate_where(F.col("orders") >= 2).alias("repeat_purchase_rate_category"),
        F.count_if(F.col("_categories") > 1).alias("cross_category_customers"),
        rate_where(F.col("_categories") > 1).alias("cross_category_rate"),
    )
    days = sold.groupBy("category", F.to_date("order_purchase_timestamp").alias("day")).agg(
        F.sum(cents("price")).alias("price_c"),
        F.min("order_purchase_timestamp").alias("first_ts"),
        F.max("order_purchase_timestamp").alias("last_ts"),
    )
    last = F.max("day").over(Window.partitionBy("category"))  # calendar-sized
    days = days.withColumn("m3", F.add_months(last, -3)).withColumn("m6", F.add_months(last, -6))

    def spent(cond: Column) -> Column:
        return rnd(from_cents(F.sum(F.when(cond, F.col("price_c")).otherwise(0))))

    day = F.col("day")
    timing = days.groupBy("category").agg(
        F.min("first_ts").alias("first_sale_date"),
        F.max("last_ts").alias("last_sale_date"),
        F.count_distinct(month_start("day")).alias("active_months"),
        spent(day >= F.col("m3")).alias("revenue_last_3m"),
        spent((day >= F.col("m6")) & (day < F.col("m3"))).alias("revenue_prev_3m"),
    )
    joined = sales.join(
        distinct_count(sold, "category", "product_id", "unique_products"), "category"
    ).join(timing, "category")
    # One row per category: small windows.
    by_revenue = Window.orderBy(F.desc("category_revenue"))
    revenue_c = cents("category_revenue")
    return joined.select(
        "category", "category_revenue", "category_orders", "category_units",
        "avg_price_per_category", "min_price", "max_price", "total_freight", "avg_freight",
        "category_margin", "avg_margin_pct", "unique_customers", "unique_products",
        share_of_total("category_revenue").alias("category_share"),
        rnd(pct(F.sum(revenue_c).over(by_revenue), F.sum(revenue_c).over(Window.partitionBy())))
        .alias("cumulative_share"),
        F.dense_rank().over(by_revenue).alias("revenue_rank"),
        "first_sale_date", "last_sale_date", "active_months", "revenue_last_3m", "revenue_prev_3m",
        F.when(F.col("revenue_prev_3m") > 0,
               rnd(ratio(F.col("revenue_last_3m") - F.col("revenue_prev_3m"), "revenue_prev_3m") * 100))
        .alias("category_growth_pct"),
        "repeat_purchase_rate_category", "repeat_customers", "cross_category_rate",
        "cross_category_customers",
        rnd(ratio("category_revenue", "unique_customers")).alias("revenue_per_customer"),
        rnd(ratio("category_orders", "unique_customers")).alias("orders_per_customer"),
        rnd(ratio("category_units", "category_orders")).alias("units_per_order"),
    )


def mart_delivery_performance(facts: DataFrame, customers: DataFrame, sellers: DataFrame) -> DataFrame:
    """One row per delivered order with its main seller (dearest item) and latest review."""
    arrived, promised = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    bought, carrier = F.col("order_purchase_timestamp"), F.col("order_delivered_carrier_date")
    actual, estimated = day_diff(arrived, bought), day_diff(promised, bought)
    joined = (
        facts.where(arrived.isNotNull() & promised.isNotNull() & F.col("main_seller_id").isNotNull())
        .withColumn("seller_id", F.col("main_seller_id"))
        .withColumn("freight_value", from_cents("freight_c"))
        .join(customers.select("customer_id", "customer_state", "customer_city",
                               "customer_zip_code_prefix"), "customer_id")
        .join(sellers.select("seller_id", "seller_state", "seller_city", "seller_zip_code_prefix"),
              "seller_id")
    )
    late = F.col("delivery_delay")
    timed = joined.withColumns({
        "delivery_time_actual": actual,
        "delivery_time_estimated": estimated,
        "carrier_time": day_diff(carrier, bought),
        "transit_time": day_diff(arrived, carrier),
        "delivery_delay": actual - estimated,
        "is_delayed": actual > estimated,
    })
    return timed.select(
        "order_id", "customer_id", "seller_id", "order_purchase_timestamp",
        "order_delivered_customer_date", "order_estimated_delivery_date", "customer_state",
        "customer_city", "seller_state", "seller_city",
        F.concat("seller_state", F.lit(" → "), "customer_state").alias("delivery_route"),
        (F.col("seller_state") == F.col("customer_state")).alias("is_same_state_delivery"),
        "delivery_time_actual", "delivery_time_estimated", "carrier_time", "transit_time",
        "delivery_delay", "is_delayed",
        F.when(late > 15, "15+ days late").otherwise(
            bins(late, [(0, "On Time"), (3, "1-3 days late"), (7, "4-7 days late"),
                        (15, "8-15 days late")], "Unknown")).alias("delay_severity"),
        F.abs(F.col("customer_zip_code_prefix").cast("bigint")
              - F.col("seller_zip_code_prefix").cast("bigint")).alias("distance_proxy"),
        "freight_value",
        rnd(ratio("freight_value", "delivery_time_actual")).alias("freight_per_day"),
        "review_score",
    )


def paid_orders(facts: DataFrame) -> DataFrame:
    """Paid orders with their primary payment method, total, and installment bin."""
    average = ratio("installments", "payments")
    return facts.where("paid_c is not null").select(
        "order_id", "is_completed", "is_canceled",
        F.col("primary_method").alias("payment_method_primary"),
        from_cents("paid_c").alias("total_payment"),
        average.alias("avg_installments"),
        "max_installments",
        (F.size("payment_methods") > 1).alias("has_multiple_payment_methods"),
        # Averages such as 1.5 or 3.5 lie between two bins.
        ranges(average, INSTALLMENT_BINS, "Unknown").alias("installment_bin"),
    )


def mart_payment_analysis(facts: DataFrame) -> DataFrame:
    """One row per primary payment method."""
    methods = paid_orders(facts).groupBy("payment_method_primary").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if("is_completed").alias("successful_orders"),
        F.count_if("is_canceled").alias("canceled_orders"),
        rnd(money_sum("total_payment")).alias("total_revenue"),
        rnd(money_avg("total_payment")).alias("avg_order_value"),
        rnd(F.min("total_payment")).alias("min_order_value"),
        rnd(F.max("total_payment")).alias("max_order_value"),
        rnd(F.avg("avg_installments")).alias("avg_installments_per_method"),
        F.max("max_installments").cast("double").alias("max_installments_per_method"),
        rate_where(F.col("is_completed")).alias("conversion_rate"),
        rate_where(F.col("is_canceled")).alias("cancellation_rate"),
        F.count_if("has_multiple_payment_methods").alias("orders_with_multiple_methods"),
    )
    return methods.select(
        *methods.columns[:-1],
        share_of_total("total_orders").alias("order_share_pct"),
        share_of_total("total_revenue").alias("revenue_share_pct"),
        F.dense_rank().over(Window.orderBy(F.desc("total_revenue"))).alias("revenue_rank"),
        "orders_with_multiple_methods",
        rnd(pct("orders_with_multiple_methods", "total_orders")).alias("pct_multiple_methods"),
    )


def installment_analysis(facts: DataFrame) -> DataFrame:
    """Orders, value and conversion per bin of the order's average installments."""
    return paid_orders(facts).groupBy("installment_bin").agg(
        F.count(F.lit(1)).alias("total_orders"),
        rnd(money_avg("total_payment")).alias("avg_aov"),
        rnd(money_sum("total_payment")).alias("total_revenue"),
        rate_where(F.col("is_completed")).alias("conversion_rate"),
    )


def mart_repeat_purchase(facts: DataFrame, cfg: MartConfig) -> DataFrame:
    """First and second purchase per customer and the time between them."""
    done = completed(facts).select("customer_id", "order_id", "order_purchase_timestamp")
    # Only the first two orders of a customer leave the map side.
    early = top_per_group(
        done, ["customer_id"], ["order_purchase_timestamp", "order_id"], 2
    ).groupBy("customer_id").agg(
        F.min("order_purchase_timestamp").alias("first_purchase_date"),
        F.max("order_purchase_timestamp").alias("_later"),
    )
    counts = done.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_orders"))
    n = F.col("total_orders")
    gap = day_diff("second_purchase_date", "first_purchase_date")
    both = counts.join(early, "customer_id").withColumn(
        "second_purchase_date", F.when(n >= 2, F.col("_later"))
    )
    days = F.col("days_to_second_purchase")

    def within(limit: int) -> Column:
        return F.when(days <= limit, 1).otherwise(0)

    return both.withColumn("days_to_second_purchase", gap).select(
        "customer_id", "total_orders",
        n.alias("max_purchase_sequence"),
        "first_purchase_date", "second_purchase_date",
        as_timestamp(month_start("first_purchase_date")).alias("cohort_month"),
        "days_to_second_purchase",
        (n >= 2).cast("int").alias("has_second_purchase"),
        (n >= 2).cast("int").alias("is_repeat_customer"),
        bins(n, [(1, "1x"), (2, "2x"), (5, "3-5x"), (10, "6-10x")], "11+").alias("purchase_frequency_bin"),
        F.when(n >= 2, ranges(days, [(0, 30, "0-30"), (31, 60, "31-60"), (61, 90, "61-90"),
                                     (91, 180, "91-180")], "180+"))
        .otherwise("no_second_purchase").alias("days_to_second_purchase_bin"),
        within(30).alias("purchased_within_30_days"),
        within(60).alias("purchased_within_60_days"),
        within(90).alias("purchased_within_90_days"),
        day_diff(cfg.today, "first_purchase_date").alias("days_since_first_purchase"),
        day_diff(cfg.today, "second_purchase_date").alias("days_since_second_purchase"),
    )


def mart_seller_performance(
    items: DataFrame, facts: DataFrame, sellers: DataFrame, delivery: DataFrame
) -> DataFrame:
    """One row per seller: sales, categories, reviews, punctuality, revenue share and tier."""
    sold = completed(items)
    per_order = sold.groupBy("seller_id", "order_id", "order_purchase_timestamp").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum(cents("price")).alias("price_c"),
        F.sum(cents("freight_value")).alias("freight_c"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
    )
    per_month = per_order.groupBy("seller_id", month_start("order_purchase_timestamp").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.sum(c).alias(c) for c in ("units", "price_c", "freight_c")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("order_purchase_timestamp").alias("first_ts"),
        F.max("order_purchase_timestamp").alias("last_ts"),
    )
    revenue = from_cents(F.sum("price_c"))
    sales = per_month.groupBy("seller_id").agg(
        rnd(revenue).alias("seller_revenue"),
        F.sum("price_c").alias("_revenue_c"),
        F.sum("orders").alias("seller_orders"),
        F.sum("units").alias("seller_units"),
        rnd(ratio(revenue, F.sum("units"))).alias("seller_avg_price"),
        rnd(F.min("low")).alias("seller_min_price"),
        rnd(F.max("high")).alias("seller_max_price"),
        rnd(ratio(from_cents(F.sum("freight_c")), F.sum("units"))).alias("seller_avg_freight"),
        F.min("first_ts").alias("first_sale_date"),
        F.max("last_ts").alias("last_sale_date"),
        F.count(F.lit(1)).alias("seller_active_months"),
    )
    categories = (
        categorised(items)
        .groupBy("seller_id", "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("seller_id")
        .agg(F.count(F.lit(1)).alias("seller_categories"),
             F.max_by("category", F.struct("n", "category")).alias("primary_category"))
    )
    lines = items.groupBy("seller_id", "order_id").agg(F.count(F.lit(1)).alias("lines"))
    scores = facts.where("reviews is not null").select(
        "order_id", "reviews", "score", F.col("positive").alias("good"), F.col("negative").alias("bad"))

    def per_line(c: str) -> Column:
        return F.sum(F.col("lines") * F.col(c))

    reviewed = lines.join(scores, "order_id").groupBy("seller_id").agg(
        F.sum("reviews").alias("seller_total_reviews"),
        rnd(ratio(per_line("score"), per_line("reviews"))).alias("seller_avg_review"),
        per_line("good").alias("positive_reviews"),
        per_line("bad").alias("negative_reviews"),
        rnd(pct(per_line("good"), per_line("reviews"))).alias("positive_review_rate"),
    )
    late = F.col("is_delayed")
    shipped = (
        lines.join(delivery.select("order_id", "seller_id", "is_delayed", "delivery_time_actual",
                                   "delivery_delay"), ["order_id", "seller_id"])
        .groupBy("seller_id")
        .agg(
            rnd(pct(F.coalesce(F.sum(F.when(~late, F.col("lines"))), F.lit(0)), F.sum("lines")))
            .alias("seller_delivery_performance"),
            rnd(ratio(per_line("delivery_time_actual"), F.sum("lines")), 1).alias("avg_delivery_days"),
            rnd(ratio(F.sum(F.when(late, F.col("lines") * F.col("delivery_delay"))),
                      F.sum(F.when(late, F.col("lines")))), 1).alias("avg_delay_when_late"),
        )
    )
    located = settled(
        sales.join(sellers.select("seller_id", "seller_state", "seller_city", "seller_region"),
                   "seller_id")
    )
    by_revenue = value_profile(located.select("_revenue_c", F.col("_revenue_c").alias("r")),
                               "_revenue_c", sums=["r"], descending=True)
    by_orders = value_profile(located.select("seller_orders"), "seller_orders", descending=True)
    total = located.agg(F.sum("_revenue_c").alias("t")).scalar()
    ranked = (
        located.join(by_revenue.select("_revenue_c", F.col("dense_rank").alias("revenue_rank"), "cum_r"),
                     "_revenue_c")
        .join(by_orders.select("seller_orders", F.col("dense_rank").alias("order_rank")),
              "seller_orders")
        .withColumn("revenue_share_pct", rnd(pct("_revenue_c", total), 4))
        .withColumn("cumulative_revenue_share", rnd(pct("cum_r", total)))
    )

    def zero(c: Column | str) -> Column:
        return F.coalesce(as_col(c), F.lit(0))

    tier = F.when(F.col("revenue_rank") <= 10, "Top 10 Seller").otherwise(
        bins("cumulative_revenue_share", [(20, "Top 20% Revenue"), (50, "Top 50% Revenue"),
                                          (80, "Top 80% Revenue")], "Bottom 20% Revenue")
    )
    return (
        ranked.join(distinct_count(sold, "seller_id", "product_id", "seller_products_sold"),
                    "seller_id", "left")
        .join(categories, "seller_id", "left")
        .join(reviewed, "seller_id", "left")
        .join(shipped, "seller_id", "left")
        .select(
            "seller_id", "seller_state", "seller_city", "seller_region", "seller_revenue",
            "seller_orders", "seller_units", "seller_avg_price", "seller_min_price",
            "seller_max_price", "seller_avg_freight", "seller_products_sold", "first_sale_date",
            "last_sale_date", "seller_active_months", "revenue_share_pct",
            "cumulative_revenue_share", "revenue_rank", "order_rank",
            zero("seller_categories").alias("seller_categories"),
            F.coalesce("primary_category", F.lit("unknown")).alias("primary_category"),
            *[zero(c).alias(c) for c in (
                "seller_total_reviews", "seller_avg_review", "positive_reviews",
                "negative_reviews", "positive_review_rate", "seller_delivery_performance",
                "avg_delivery_days", "avg_delay_when_late")],
            rnd(ratio("seller_revenue", "seller_active_months")).alias("revenue_per_month"),
            rnd(ratio("seller_orders", "seller_active_months")).alias("orders_per_month"),
            rnd(ratio("seller_units", "seller_orders")).alias("units_per_order"),
            tier.alias("seller_tier"),
        )
    )
