"""Customer marts: base profile, RFM, lifetime value, cohort retention, segments, age, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import MartConfig
from martloom.functions import (
    as_col,
    bins,
    cents,
    day_diff,
    from_cents,
    label_order,
    lookup,
    money_avg,
    money_sum,
    month_diff,
    month_start,
    rate_where,
    ratio,
    rnd,
    to_long,
)
from martloom.functions.fixed import AGE_BINS, RFM_SEGMENT_CODES
from martloom.operators.ranking import (
    with_group_quantile,
    literals,
    quantile_scalars,
    share_of_total,
    value_profile,
    with_ntile,
)
from martloom.operators.sequence import distinct_count, most_frequent, sequence_within
from martloom.operators.storage import settled
from martloom.plans.common import categorised, completed



def _is_late() -> Column:
    return F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")


def mart_customer_base(
    customers: DataFrame, facts: DataFrame, items: DataFrame, cfg: MartConfig
) -> DataFrame:
    """One row per customer with orders: purchases, payments, reviews, delivery, items, flags.

    Facts and customers meet after each side has one row per customer, so a customer with very
    many orders is never a join key that repeats.
    """
    arrived = F.col("order_delivered_customer_date")
    late_days = F.when(_is_late(), day_diff(arrived, "order_estimated_delivery_date")).otherwise(0)
    per_customer = facts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if("is_delivered").alias("delivered_orders"),
        F.count_if("is_canceled").alias("canceled_orders"),
        F.min("order_purchase_timestamp").alias("first_purchase_date"),
        F.max("order_purchase_timestamp").alias("last_purchase_date"),
        from_cents(F.sum("paid_c")).alias("revenue"),
        F.sum("payments").alias("n_payments"),
        F.max("max_payment").alias("max_order_value"),
        F.min("min_payment").alias("min_order_value"),
        F.max(F.struct("max_payment", "primary_method"))["primary_method"].alias("preferred_payment_method"),
        F.sum("installments").alias("installments"),
        F.sum("reviews").alias("total_reviews"),
        F.sum("score").alias("score"),
        F.sum("commented").alias("reviews_with_comment"),
        F.sum("positive").alias("positive_reviews"),
        F.sum("negative").alias("negative_reviews"),
        F.avg(day_diff(arrived, "order_purchase_timestamp")).alias("avg_delivery_days"),
        F.count_if(_is_late()).alias("delayed_orders"),
        F.avg(F.when(arrived.isNotNull(), late_days)).alias("avg_delay_days"),
    )
    # Distinct products and sellers each as a dedup followed by a count (map-side combined), so
    # item rows are never tripled by an Expand and a large customer is spread by its pairs.
    bought = items.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_items_purchased"),
        from_cents(F.sum(cents("price"))).alias("spent_on_items"),
        from_cents(F.sum(cents("freight_value"))).alias("freight"),
    ).join(distinct_count(items, "customer_id", "product_id", "products"), "customer_id", "left").join(
        distinct_count(items, "customer_id", "seller_id", "sellers"), "customer_id", "left"
    ).withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("products", "sellers")})
    joined = customers.join(per_customer, "customer_id").join(bought, "customer_id", "left")

    def zero(c: Column | str) -> Column:
        return F.coalesce(as_col(c), F.lit(0))

    orders_n, items_n = F.col("total_orders"), zero("total_items_purchased")
    recency = day_diff(cfg.today, "last_purchase_date")
    avg_score = zero(ratio("score", "total_reviews"))
    return joined.select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state", "customer_region",
        "total_orders", "delivered_orders", "canceled_orders", "first_purchase_date",
        "last_purchase_date",
        day_diff("last_purchase_date", "first_purchase_date").alias("customer_lifespan_days"),
        recency.alias("recency_days"),
        zero("revenue").alias("total_revenue"),
        zero(ratio("revenue", "n_payments")).alias("avg_order_value"),
        zero("max_order_value").alias("max_order_value"),
        zero("min_order_value").alias("min_order_value"),
        "preferred_payment_method",
        zero(ratio("installments", "n_payments")).alias("avg_installments"),
        zero("total_reviews").alias("total_reviews"),
        avg_score.alias("avg_review_score"),
        zero("reviews_with_comment").alias("reviews_with_comment"),
        zero("positive_reviews").alias("positive_reviews"),
        zero("negative_reviews").alias("negative_reviews"),
        zero("avg_delivery_days").alias("avg_delivery_days"),
        "delayed_orders",
        zero("avg_delay_days").alias("avg_delay_days"),
        items_n.alias("total_items_purchased"),
        zero(ratio("spent_on_items", "total_items_purchased")).alias("avg_item_price"),
        zero("freight").alias("total_freight_paid"),
        zero(ratio("freight", "total_items_purchased")).alias("avg_freight_per_order"),
        zero("products").alias("unique_products_purchased"),
        zero("sellers").alias("unique_sellers_purchased_from"),
        rnd(ratio(zero("revenue"), orders_n)).alias("revenue_per_order"),
        rnd(ratio(items_n, orders_n)).alias("items_per_order"),
        (orders_n > 1).alias("is_repeat_customer"),
        (recency > cfg.churn_days).alias("is_churned"),
        (avg_score >= 4).alias("is_satisfied_customer"),
        (ratio("delayed_orders", "delivered_orders") > 0.3).alias("has_delivery_issues"),
    )


def rfm_codes() -> dict[str, str]:
    """Code -> segment; the first segment that lists a code keeps it."""
    table: dict[str, str] = {}
    for segment, codes in RFM_SEGMENT_CODES.items():
        for code in codes:
            table.setdefault(code, segment)
    return table


def mart_customer_rfm(base: DataFrame, cfg: MartConfig) -> DataFrame:
    """Recency, frequency and monetary quintiles and the segment they name.

    The rows travel through three range sorts with all their columns, so no join is needed to
    bring the scores together. Ties break on the customer id.
    """
    rows = base.select(
        "customer_id", "customer_state", "customer_region",
        day_diff(cfg.today, "last_purchase_date").alias("recency"),
        F.col("total_orders").alias("frequency"),
        F.col("total_revenue").alias("monetary"),
        "avg_order_value", "is_repeat_customer",
    )
    tie = F.col("customer_id")
    scored = with_ntile(rows, [F.col("recency").desc(), tie], 5, "r_score")
    scored = with_ntile(scored, [F.col("frequency").asc(), tie], 5, "f_score")
    scored = with_ntile(scored, [F.col("monetary").asc(), tie], 5, "m_score")
    code = F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])
    return scored.select(
        "customer_id", "customer_state", "customer_region", "recency", "frequency", "monetary",
        "r_score", "f_score", "m_score",
        code.alias("rfm_score"),
        (F.col("r_score") + F.col("f_score") + F.col("m_score")).alias("rfm_total_score"),
        lookup(code, rfm_codes(), "Other").alias("rfm_segment"),
        "avg_order_value", "is_repeat_customer",
    )


def mart_customer_ltv(customers: DataFrame, facts: DataFrame, cfg: MartConfig) -> DataFrame:
    """Lifetime value per customer with the figures of the customer's state."""
    per_customer = (
        completed(facts)
        .groupBy("customer_id")
        .agg(
            F.min("order_purchase_timestamp").alias("first_purchase_date"),
            F.max("order_purchase_timestamp").alias("last_purchase_date"),
            F.count(F.lit(1)).alias("total_orders"),
            from_cents(F.sum("paid_c")).alias("revenue"),
        )
    )
    # Read three times below (thresholds, states, rows), so it is settled once per customer.
    people = settled(
        customers.join(per_customer, "customer_id").select(
            "customer_id", "customer_state", "customer_city", "customer_region", "revenue",
            "total_orders", "first_purchase_date", "last_purchase_date",
            day_diff("last_purchase_date", "first_purchase_date").alias("customer_lifespan_days"),
        )
    )
    top, high, medium = quantile_scalars(people, "revenue", [0.90, 0.75, 0.50])
    total = F.coalesce("revenue", F.lit(0.0))
    measured = people.select(
        "customer_id", "customer_state", "customer_city", "customer_region",
        total.alias("total_revenue"), "total_orders", "first_purchase_date", "last_purchase_date",
        "customer_lifespan_days",
        rnd(ratio(total, "total_orders")).alias("avg_order_value"),
        rnd(ratio("total_orders", F.col("customer_lifespan_days") / 30.0)).alias("orders_per_month"),
        F.when(total >= top, "VIP").when(total >= high, "High").when(total >= medium, "Medium")
        .otherwise("Low").alias("clv_segment"),
        (F.col("total_orders") > 1).alias("is_repeat_customer"),
    )
    place = ["customer_state", "customer_region"]
    states = measured.groupBy(*place).agg(
        F.count(F.lit(1)).alias("total_customers_state"),
        rnd(money_avg("total_revenue")).alias("avg_ltv_state"),
        F.lit(None).cast("double").alias("median_ltv_state"),
        rnd(money_sum("total_revenue")).alias("total_revenue_state"),
        rnd(F.avg("avg_order_value")).alias("avg_aov_state"),
        rate_where(F.col("is_repeat_customer")).alias("repurchase_rate_state"),
    )
    # One row per state: windows over it are small. The join is left to the size-checked choice
    # between broadcast and shuffle.
    states = states.withColumn(
        "revenue_concentration_pct", share_of_total("total_revenue_state")
    ).withColumn(
        "customer_density_proxy",
        rnd(ratio("total_customers_state", "total_revenue_state") * 100000),
    ).withColumn(
        "state_ltv_rank", F.dense_rank().over(Window.orderBy(F.col("avg_ltv_state").desc()))
    )
    states = with_group_quantile(states, measured, place, "total_revenue", "median_ltv_state", digits=2)
    return measured.join(states, place).select(
        *measured.columns, "total_customers_state", "avg_ltv_state", "median_ltv_state",
        "total_revenue_state", "avg_aov_state", "repurchase_rate_state",
        "revenue_concentration_pct", "customer_density_proxy", "state_ltv_rank",
    )


def customer_months(facts: DataFrame) -> DataFrame:
    """Completed purchases per customer and month, with the customer's first month.

    Cohort questions only need this grain: a customer has at most one row per calendar month,
    however many orders there are, so the window per customer stays short.
    """
    monthly = (
        completed(facts)
        .groupBy("customer_id", month_start("order_purchase_timestamp").alias("order_month"))
        .agg(
            F.min("order_purchase_timestamp").alias("first_ts"),
            F.count("paid_c").alias("paid_orders"),
            F.sum("paid_c").alias("paid_c"),
            F.sum("payments").alias("payments"),
        )
    )
    mine = Window.partitionBy("customer_id")
    return monthly.withColumn("first_ts", F.min("first_ts").over(mine)).withColumn(
        "cohort", F.min("order_month").over(mine)
    )


def mart_customer_cohort_retention(facts: DataFrame) -> DataFrame:
    months = customer_months(facts).withColumn(
        "months_since_first_purchase", month_diff("order_month", "cohort")
    )
    matrix = months.groupBy("cohort", "months_since_first_purchase").agg(
        F.count(F.lit(1)).alias("retained_customers"),
        F.min("first_ts").alias("first_ts"),
        from_cents(F.sum("paid_c")).alias("revenue"),
        F.sum("paid_orders").alias("paid_orders"),
    )
    # Everybody is present at offset 0, so that row holds the size and start of the cohort.
    cohort = Window.partitionBy("cohort")
    at_start = F.col("months_since_first_purchase") == 0
    sized = matrix.withColumn(
        "cohort_size", F.max(F.when(at_start, F.col("retained_customers"))).over(cohort)
    ).withColumn("cohort_start_date", F.max(F.when(at_start, F.col("first_ts"))).over(cohort))
    offset = F.col("months_since_first_purchase")
    so_far = cohort.orderBy(offset)
    return sized.withColumn("cohort_revenue", rnd("revenue")).select(
        F.date_format("cohort", "yyyy-MM").alias("cohort_month"),
        "cohort_start_date",
        "cohort_size",
        "months_since_first_purchase",
        F.concat(F.lit("M"), offset.cast("string")).alias("month_label"),
        "retained_customers",
        rnd(F.col("retained_customers") * 100.0 / F.col("cohort_size")).alias("retention_rate"),
        "cohort_revenue",
        from_cents(F.sum(cents("cohort_revenue")).over(so_far)).alias("cumulative_revenue"),
        rnd(ratio("revenue", "paid_orders")).alias("avg_revenue_per_order"),
        rnd(ratio("revenue", "cohort_size")).alias("revenue_per_customer"),
    )


def mart_customer_segments(
    base: DataFrame, rfm: DataFrame, ltv: DataFrame, delivery: DataFrame, facts: DataFrame,
    items: DataFrame, payments: DataFrame,
) -> DataFrame:
    """Behavioural features per customer and one named segment, first match wins."""
    hour = F.hour("order_purchase_timestamp")
    timing = completed(facts).groupBy("customer_id").agg(
        rate_where(F.dayofweek("order_purchase_timestamp").isin(1, 7)).alias("pct_weekend_shopper"),
        rate_where((hour >= 20) | (hour < 6)).alias("pct_night_shopper"),
    )
    categories = (
        categorised(items)
        .groupBy("customer_id", "order_id", "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("customer_id", "category")
        .agg(F.max("n").alias("n"))
        .groupBy("customer_id")
        .agg(
            F.max_by("category", F.struct("n", "category")).alias("preferred_category"),
            F.count("category").alias("category_diversity"),
        )
    )
    paying = (
        completed(payments)
        .groupBy("customer_id", "order_id", "payment_type")
        .agg(F.avg("payment_installments").alias("avg_inst"), F.count(F.lit(1)).alias("n"))
        .groupBy("customer_id")
        .agg(
            F.max_by("payment_type", F.struct("n", "payment_type")).alias("method"),
            rnd(F.avg("avg_inst")).alias("avg_installments"),
        )
    )
    lateness = delivery.groupBy("customer_id").agg(
        rate_where(F.col("is_delayed")).alias("pct_delayed_orders")
    )
    orders_n = F.col("total_orders")
    features = (
        base.select(
            "customer_id", "customer_state", "customer_region", "total_orders", "total_revenue",
            "avg_order_value", "total_items_purchased", "total_freight_paid", "avg_review_score",
            "customer_lifespan_days",
        )
        .join(rfm.select("customer_id", "recency", "r_score", "f_score", "m_score", "rfm_segment"),
              "customer_id")
        .join(ltv.select("customer_id", "clv_segment", "orders_per_month"), "customer_id")
        .join(timing, "customer_id", "left")
        .join(categories, "customer_id", "left")
        .join(paying, "customer_id", "left")
        .join(lateness, "customer_id", "left")
        .select(
            "customer_id", "customer_state", "customer_region", "rfm_segment", "clv_segment",
            "recency",
            orders_n.alias("frequency"),
            F.col("total_revenue").alias("monetary"),
            "r_score", "f_score", "m_score", "avg_order_value",
            rnd(ratio("total_items_purchased", orders_n)).alias("avg_items_per_order"),
            F.when(orders_n > 1, rnd(ratio("customer_lifespan_days", orders_n - 1)))
            .alias("avg_days_between_purchases"),
            "orders_per_month", "customer_lifespan_days",
            F.coalesce("preferred_category", F.lit("unknown")).alias("preferred_category"),
            F.coalesce("category_diversity", F.lit(0)).alias("category_diversity"),
            F.coalesce("method", F.lit("unknown")).alias("preferred_payment_method"),
            F.coalesce("avg_installments", F.lit(0.0)).alias("avg_installments"),
            F.coalesce("pct_weekend_shopper", F.lit(0.0)).alias("pct_weekend_shopper"),
            F.coalesce("pct_night_shopper", F.lit(0.0)).alias("pct_night_shopper"),
            "avg_review_score",
            F.coalesce("pct_delayed_orders", F.lit(0.0)).alias("pct_delayed_orders"),
            "total_freight_paid",
        )
    )
    features = settled(features)
    money75, money70 = quantile_scalars(features, "monetary", [0.75, 0.70])
    aov80, aov50 = quantile_scalars(features, "avg_order_value", [0.80, 0.50])
    money, aov, times = F.col("monetary"), F.col("avg_order_value"), F.col("frequency")
    segment = F.col("rfm_segment")
    name = (
        F.when(segment.isin("Champions", "Loyal Customers") & (money >= money75), "High Value Regulars")
        .when((aov >= aov80) & (times >= 2), "Premium Shoppers")
        .when((F.col("avg_installments") >= 6) & (aov < aov50), "Bargain Hunters")
        .when((F.col("category_diversity") <= 2) & (times >= 3), "Category Focused")
        .when((times == 1) & (F.col("recency") <= 180), "Occasional Shoppers")
        .when(F.col("pct_weekend_shopper") >= 60, "Weekend Warriors")
        .when(F.col("pct_night_shopper") >= 50, "Night Owls")
        .when(segment.isin("At Risk", "Can't Lose Them") & (money >= money70), "At Risk High Value")
        .when(segment.isin("Hibernating", "Lost"), "Dormant")
        .otherwise("Standard Shoppers")
    )
    rest = [c for c in features.columns if c not in ("customer_id", "customer_state", "customer_region")]
    return features.select("customer_id", "customer_state", "customer_region",
                           name.alias("segment_name"), *rest)


def mart_customer_age(base: DataFrame, cfg: MartConfig) -> DataFrame:
    """Six life-cycle bins by months since the first purchase."""
    months = month_diff(cfg.today, "first_purchase_date")
    aged = base.where(F.col("first_purchase_date").isNotNull()).select(
        bins(months, [(3, "0-3m"), (6, "3-6m"), (12, "6-12m"), (18, "12-18m"), (24, "18-24m")],
             "24+m").alias("customer_age_bin"),
        day_diff(cfg.today, "first_purchase_date").alias("days"),
        "total_orders", "total_revenue", "avg_order_value", "is_churned", "is_repeat_customer",
    )
    per_bin = aged.groupBy("customer_age_bin").agg(
        F.count(F.lit(1)).alias("customers_in_bin"),
        rnd(F.avg("total_orders")).alias("avg_orders_in_bin"),
        rnd(money_avg("total_revenue")).alias("avg_revenue_in_bin"),
        rnd(F.avg("avg_order_value")).alias("avg_aov_in_bin"),
        rate_where(F.col("is_churned")).alias("churn_rate_bin"),
        rate_where(~F.col("is_churned")).alias("active_rate_bin"),
        rate_where(F.col("is_repeat_customer")).alias("repeat_rate_bin"),
        rnd(F.avg("days"), 1).alias("avg_age_days_in_bin"),
        rnd(F.avg(rnd(F.col("days") / 30.0, 0)), 1).alias("avg_age_months_in_bin"),
        F.sum("total_orders").alias("_orders"),
        F.sum(cents("total_revenue")).alias("_revenue_c"),
    )
    # Six rows from here on.
    life = Window.orderBy(label_order("customer_age_bin", AGE_BINS))
    stage = F.col("customer_age_bin")
    revenue, months_old = F.col("avg_revenue_in_bin"), F.col("avg_age_months_in_bin")
    previous = F.lag(revenue).over(life)
    return per_bin.select(
        *per_bin.columns[:10],
        from_cents(F.sum("_revenue_c").over(life)).alias("cumulative_revenue"),
        F.sum("_orders").over(life).alias("cumulative_orders"),
        F.sum("customers_in_bin").over(life).alias("cumulative_customers"),
        stage.isin("0-3m", "3-6m").alias("is_honeymoon_period"),
        (stage == "6-12m").alias("is_danger_zone"),
        stage.isin("12-18m", "18-24m", "24+m").alias("is_mature_period"),
        rnd(ratio("avg_orders_in_bin", months_old), 3).alias("monthly_order_frequency"),
        rnd(ratio(revenue, months_old)).alias("monthly_revenue_rate"),
        F.dense_rank().over(Window.orderBy(revenue.desc())).alias("revenue_rank"),
        F.dense_rank().over(Window.orderBy(F.desc("avg_orders_in_bin"))).alias("orders_rank"),
        F.dense_rank().over(Window.orderBy("churn_rate_bin")).alias("retention_rank"),
        previous.alias("prev_bin_revenue"),
        rnd(ratio(revenue - previous, previous) * 100).alias("revenue_growth_rate_pct"),
    )


def purchase_gaps(facts: DataFrame, cfg: MartConfig) -> DataFrame:
    """Mean and sample deviation of the days between consecutive purchases of a customer."""
    ordered = sequence_within(
        completed(facts).select("customer_id", "order_id", "order_purchase_timestamp"),
        "customer_id", ["order_purchase_timestamp", "order_id"], "order_purchase_timestamp",
    )
    gap = day_diff("order_purchase_timestamp", "previous_order_purchase_timestamp")
    sums = ordered.select("customer_id", gap.alias("gap")).where("gap is not null").groupBy(
        "customer_id"
    ).agg(F.count("gap").alias("n"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("q"))
    # Integer sums first: the same deviation whichever way the partitions were merged.
    n, s, q = (F.col(c).cast("double") for c in ("n", "s", "q"))
    return sums.select(
        "customer_id",
        ratio("s", "n").alias("gap_mean"),
        F.sqrt(F.try_divide(n * q - s * s, n * (n - 1))).alias("gap_sd"),
    )


def mart_churn_prediction(
    facts: DataFrame, items: DataFrame, payments: DataFrame, customers: DataFrame, rfm: DataFrame,
    cfg: MartConfig,
) -> DataFrame:
    """Churn label, 0-100 feature scores and a weighted risk per customer."""
    delay = F.coalesce(
        day_diff("order_delivered_customer_date", "order_estimated_delivery_date"), F.lit(0)
    )
    summary = (
        completed(facts)
        .groupBy("customer_id")
        .agg(
            F.to_date(F.min("order_purchase_timestamp")).alias("first_purchase_date"),
            F.to_date(F.max("order_purchase_timestamp")).alias("last_purchase_date"),
            F.count(F.lit(1)).alias("total_orders"),
            from_cents(F.sum("paid_c")).alias("total_spent"),
            F.count("paid_c").alias("paid_orders"),
            ratio(F.sum("installments"), F.sum("payments")).alias("avg_installments"),
            F.avg(F.when(delay > 0, 1.0).otherwise(0.0)).alias("pct_delayed_orders"),
            F.avg(delay).alias("avg_delivery_delay"),
            F.avg("review_score").alias("avg_review_score"),
            from_cents(F.sum("freight_c")).alias("total_freight_paid"),
            F.count("freight_c").alias("shipped_orders"),
        )
    )
    per_category = categorised(items).groupBy("customer_id", "category").agg(F.count(F.lit(1)).alias("n"))
    taste = per_category.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("categories"),
        F.max_by("category", F.struct("n", "category")).alias("preferred_category"),
    )
    methods = most_frequent(
        completed(payments), "customer_id", "payment_type", "preferred_payment_method"
    )
    features = settled(
        summary.join(customers.select("customer_id", "customer_state", "customer_region"),
                     "customer_id", "left")
        .join(methods, "customer_id", "left")
        .join(taste, "customer_id", "left")
        .join(purchase_gaps(facts, cfg), "customer_id", "left")
        .join(rfm.select("customer_id", "rfm_segment", "rfm_score"), "customer_id", "left")
        .select(
            "customer_id", "customer_state", "customer_region",
            day_diff(cfg.today, "last_purchase_date").alias("days_since_last_purchase"),
            "first_purchase_date", "last_purchase_date",
            day_diff("last_purchase_date", "first_purchase_date").alias("customer_lifespan_days"),
            "total_orders",
            F.coalesce("gap_mean", F.lit(0.0)).alias("avg_days_between_purchases"),
            F.coalesce("gap_sd", F.lit(0.0)).alias("stddev_days_between_purchases"),
            "total_spent",
            ratio("total_spent", "paid_orders").alias("avg_order_value"),
            "preferred_payment_method", "avg_installments", "pct_delayed_orders",
            "avg_delivery_delay",
            F.coalesce("avg_review_score", F.lit(0.0)).alias("avg_review_score"),
            "total_freight_paid",
            ratio("total_freight_paid", "shipped_orders").alias("avg_freight_per_order"),
            F.coalesce("categories", F.lit(0)).alias("num_categories_purchased"),
            "preferred_category", "rfm_segment", "rfm_score",
        )
    )
    scaled = ("days_since_last_purchase", "total_orders", "total_spent", "num_categories_purchased")
    edges = features.agg(
        *[f(c).cast("double").alias(f"{n}_{c}") for c in scaled for n, f in (("lo", F.min), ("hi", F.max))]
    )
    edges = literals(edges)

    def spread(c: str) -> Column:
        low, high = edges[f"lo_{c}"], edges[f"hi_{c}"]
        return F.try_divide(F.col(c) - low, high - low) * 100

    since, gap = F.col("days_since_last_purchase"), F.col("avg_days_between_purchases")
    scored = features.withColumns({
        "recency_score": F.when(since == 0, 100).otherwise(to_long(100 - spread("days_since_last_purchase"))),
        "frequency_score": to_long(spread("total_orders")),
        "monetary_score": to_long(spread("total_spent")),
        "review_score_normalized": to_long(F.col("avg_review_score") * 20),
        "category_diversity_score": to_long(spread("num_categories_purchased")),
        "is_churned": (since > cfg.churn_days) | ((gap > 0) & (since > 2 * gap)),
        "churn_threshold_days": F.when(gap > 0, F.greatest(F.lit(float(cfg.churn_days)), 2 * gap))
        .otherwise(float(cfg.churn_days)),
    })
    weights = {"recency_score": 0.40, "frequency_score": 0.25, "monetary_score": 0.15,
               "review_score_normalized": 0.10}
    risk = F.col("pct_delayed_orders") * 100 * 0.10
    for c, w in weights.items():
        risk = risk + (100 - F.col(c)) * F.lit(w)
    # As a decimal, so that equal risks are ties and .5 rounds up whatever the float noise.
    scored = settled(scored.withColumn("_risk", risk.cast("decimal(18,8)")))
    profile = value_profile(scored.select("_risk"), "_risk")
    # Customers without a risk (nothing paid) sort first, so they rank 0 and precede all others.
    size = literals(scored.agg(F.count(F.lit(1)).alias("n"), F.count("_risk").alias("known")))
    unknown = size["n"] - size["known"]
    ranked = profile.select(
        "_risk", ratio(unknown + F.col("cum_n") - F.col("n"), size["n"] - 1).alias("_percentile")
    )
    return scored.join(ranked, "_risk", "left").select(
        "customer_id", "customer_state", "customer_region", "days_since_last_purchase",
        "recency_score", "first_purchase_date", "last_purchase_date", "customer_lifespan_days",
        "total_orders", "frequency_score", "avg_days_between_purchases",
        "stddev_days_between_purchases", "total_spent", "avg_order_value", "monetary_score",
        "preferred_payment_method", "avg_installments", "pct_delayed_orders",
        "avg_delivery_delay", "avg_review_score", "review_score_normalized",
        "total_freight_paid", "avg_freight_per_order", "num_categories_purchased",
        "category_diversity_score", "preferred_category", "rfm_segment", "rfm_score",
        "is_churned", "churn_threshold_days",
        to_long("_risk").alias("churn_risk_score"),
        F.when(F.col("is_churned"), "Churned").when(F.col("_risk") >= 70, "High Risk")
        .when(F.col("_risk") >= 40, "Medium Risk").otherwise("Low Risk")
        .alias("churn_risk_segment"),
        rnd(F.coalesce("_percentile", F.lit(0.0)) * 100).alias("churn_risk_percentile_pct"),
    )
