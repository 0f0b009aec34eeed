"""Advanced marts: revenue cohorts, payment cohorts, purchase frequency, NPS, propensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import MartConfig
from martloom.functions import (
    as_timestamp,
    at_least,
    bins,
    day_diff,
    from_cents,
    money_avg,
    month_diff,
    ratio,
    rnd,
)
from martloom.operators.ranking import global_position, literals, value_profile
from martloom.operators.sequence import most_frequent, sequence_within
from martloom.plans.common import categorised, completed
from martloom.plans.customer import customer_months



def mart_revenue_cohort(facts: DataFrame) -> DataFrame:
    """Revenue per cohort and month since the cohort's first purchase."""
    months = customer_months(facts)
    # A customer is in the first month of the cohort exactly once.
    sizes = months.where("order_month = cohort").groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    monthly = months.where("paid_orders > 0").select(
        "cohort", F.col("order_month").alias("month"), F.col("paid_orders").alias("orders"), "payments", "paid_c"
    )
    revenue = from_cents(F.sum("paid_c"))
    cells = (
        monthly.groupBy("cohort", "month")
        .agg(
            revenue.alias("cohort_revenue"),
            F.sum("paid_c").alias("_c"),
            F.sum("orders").alias("total_orders"),
            F.count(F.lit(1)).alias("active_customers"),
            ratio(revenue, F.sum("payments")).alias("avg_order_value"),
            ratio(revenue, F.count(F.lit(1))).alias("revenue_per_active_customer"),
        )
        .join(sizes, "cohort")
        .withColumn("months_since_cohort", month_diff("month", "cohort"))
    )
    # Cohort-by-month rows from here: the calendar bounds them.
    line = Window.partitionBy("cohort").orderBy("months_since_cohort")
    so_far = from_cents(F.sum("_c").over(
        line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    size = F.col("cohort_size")
    running = cells.withColumns({
        "cumulative_revenue": so_far,
        "cumulative_revenue_per_customer": ratio(so_far, size),
        "active_customer_rate": ratio("active_customers", size),
        "monthly_revenue_per_cohort_customer": ratio("cohort_revenue", size),
        "previous_month_revenue": F.lag("cohort_revenue").over(line),
    })
    value, before = F.col("cumulative_revenue_per_customer"), F.col("previous_month_revenue")
    peers = F.avg(value).over(Window.partitionBy("months_since_cohort"))
    return running.select(
        as_timestamp(F.col("cohort")).alias("cohort_month"),
        as_timestamp(F.col("month")).alias("order_month"),
        "months_since_cohort", "cohort_size", "cohort_revenue", "cumulative_revenue",
        "total_orders", "active_customers", "avg_order_value", "revenue_per_active_customer",
        "cumulative_revenue_per_customer", "active_customer_rate",
        "monthly_revenue_per_cohort_customer",
        F.when(rnd(value, 6) > rnd(peers * 1.2, 6), "High Performing")
        .when(rnd(value, 6) < rnd(peers * 0.8, 6), "Low Performing")
        .otherwise("Average Performing").alias("cohort_performance"),
        "previous_month_revenue",
        F.when(before > 0, ratio(F.col("cohort_revenue") - before, before) * 100)
        .alias("revenue_growth_rate"),
    )


def mart_payment_cohort(facts: DataFrame, payments: DataFrame, cfg: MartConfig) -> DataFrame:
    """Customers by the method of their first payment, and how their methods change."""
    bought = F.col("order_purchase_timestamp")
    per_customer = (
        completed(facts).where("paid_c is not null")
        .groupBy("customer_id")
        .agg(
            F.min(F.struct("order_purchase_timestamp", "order_id", "opening_method",
                           "opening_installments", "opening_value")).alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.sum("payments").alias("payments"),
            from_cents(F.sum("paid_c")).alias("total_revenue"),
            F.max("max_payment").alias("max_order_value"),
            F.sum("installments").alias("installments"),
            F.max("max_installments").alias("max_installments_used"),
            day_diff(F.max(bought), F.min(bought)).alias("customer_lifetime_days"),
        )
    )
    # One row per customer and payment type.
    types = (
        completed(payments)
        .groupBy("customer_id", "payment_type", "order_id")
        .agg(F.count(F.lit(1)).alias("uses"))
        .groupBy("customer_id", "payment_type")
        .agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("orders"))
    )
    openings = per_customer.select("customer_id", F.col("first.opening_method").alias("first_type"))
    habits = types.join(openings, "customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("kinds"),
        F.max_by("payment_type", F.struct("uses", "payment_type")).alias("usual"),
        F.max(F.when(F.col("payment_type") == F.col("first_type"), F.col("orders"))).alias("loyal_orders"),
    )
    n, kinds = F.col("n"), F.col("kinds")
    start, first_type, usual = F.col("first.order_purchase_timestamp"), F.col("first.opening_method"), F.col("usual")
    moved = (n > 1) & (kinds > 1)
    revenue = F.col("total_revenue")
    return per_customer.join(habits, "customer_id").select(
        "customer_id",
        start.alias("first_purchase_date"),
        first_type.alias("cohort_payment"),
        F.col("first.opening_installments").alias("first_payment_installments"),
        F.col("first.opening_value").alias("first_purchase_value"),
        n.alias("total_orders"),
        kinds.alias("unique_payment_methods_used"),
        F.when(n > 1, ratio("loyal_orders", n)).otherwise(1.0).alias("payment_method_consistency"),
        moved.cast("int").alias("has_payment_method_migration"),
        usual.alias("most_frequent_payment_method"),
        ratio("installments", "payments").alias("avg_installments_all_orders"),
        "max_installments_used",
        "total_revenue",
        ratio(revenue, "payments").alias("avg_order_value"),
        "max_order_value", "customer_lifetime_days",
        n.alias("order_frequency"),
        (n > 1).cast("int").alias("is_repeat_customer"),
        (n - 1).alias("repeat_order_count"),
        F.when(moved & (usual != first_type), "Changed_Primary_Method")
        .when(moved, "Added_Secondary_Methods").otherwise("No_Migration").alias("migration_pattern"),
        F.when(moved, F.concat(first_type, F.lit("_to_"), usual))
        .otherwise(F.concat(first_type, F.lit("_stable"))).alias("migration_path"),
        kinds.alias("payment_method_diversity"),
        ratio(revenue, n).alias("revenue_per_order"),
        (ratio(revenue, day_diff(cfg.today, start)) * 30).alias("estimated_monthly_ltv"),
        F.when(revenue > 1000, "High_Value").when(revenue > 500, "Medium_Value")
        .when(revenue > 100, "Low_Value").otherwise("Minimal_Value").alias("customer_value_segment"),
    )


def mart_purchase_frequency(facts: DataFrame, cfg: MartConfig) -> DataFrame:
    """Customers by number of purchases, with their place on the revenue (Pareto) curve."""
    bought = F.col("order_purchase_timestamp")
    people = (
        completed(facts).where("paid_c is not null")
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("num_orders"),
            F.sum("paid_c").alias("_c"),
            ratio(from_cents(F.sum("paid_c")), F.sum("payments")).alias("avg_order_value"),
            F.min(bought).alias("first_purchase_date"),
            F.max(bought).alias("last_purchase_date"),
        )
    )
    n, tenure = F.col("num_orders"), day_diff(cfg.today, "first_purchase_date")
    ranked = global_position(people, [F.col("_c").desc(), F.col("customer_id")]).select(
        "*",
        from_cents("_c").alias("total_revenue"),
        bins(n, [(1, "1x"), (2, "2x"), (5, "3-5x"), (10, "6-10x")], "11+").alias("frequency_bin"),
    )
    curve = value_profile(ranked.select("_c", F.col("_c").alias("v")), "_c", sums=["v"], descending=True)
    totals = literals(ranked.agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("n")))
    per_bin = ranked.groupBy("frequency_bin").agg(
        F.count(F.lit(1)).alias("bin_customer_count"),
        ratio(F.count(F.lit(1)) * 100.0, totals["n"]).alias("bin_pct_customers"),
        ratio(from_cents(F.sum("_c")) * 100.0, from_cents(totals["c"])).alias("bin_pct_revenue"),
        F.avg("num_orders").alias("bin_avg_orders"),
        money_avg("total_revenue").alias("bin_avg_revenue"),
    )
    share = ratio(from_cents("cum_v"), from_cents(totals["c"]))
    revenue = F.col("total_revenue")
    return (
        ranked.join(curve.select("_c", share.alias("cumulative_revenue_pct")), "_c")
        .join(F.broadcast(per_bin), "frequency_bin")  # five bins
        .select(
            "customer_id", "num_orders", "frequency_bin", "total_revenue", "avg_order_value",
            "first_purchase_date", "last_purchase_date",
            tenure.alias("customer_tenure_days"),
            F.when(tenure > 0, ratio(n, tenure / 30.0)).otherwise(n.cast("double"))
            .alias("monthly_purchase_rate"),
            "bin_customer_count", "bin_pct_customers", "bin_pct_revenue", "bin_avg_orders",
            "bin_avg_revenue", "cumulative_revenue_pct",
            ratio(F.col("position") * 100.0, "total_rows").alias("cumulative_customer_pct"),
            F.when(F.col("cumulative_revenue_pct") <= 0.2, "Top_20%")
            .when(F.col("cumulative_revenue_pct") <= 0.5, "Next_30%")
            .otherwise("Bottom_50%").alias("pareto_segment"),
            (n == 1).cast("int").alias("is_one_time_buyer"),
            (n >= 2).cast("int").alias("is_repeat_customer"),
            (n >= 6).cast("int").alias("is_frequent_customer"),
            F.when(revenue > 1000, "VIP").when(revenue > 500, "High_Value")
            .when(revenue > 200, "Medium_Value").otherwise("Standard").alias("value_segment"),
        )
    )


def nps_category(score: Column) -> Column:
    return at_least(score, [(4, "Promoter"), (3, "Passive")], "Detractor")


def mart_nps_cohort(reviews: DataFrame, orders: DataFrame, base: DataFrame) -> DataFrame:
    """Promoter, passive and detractor history of each reviewing customer."""
    score = F.col("review_score")
    facts = completed(orders).select("order_id", "customer_id", "order_purchase_timestamp").join(
        reviews.select("order_id", "review_id", "review_score", "review_creation_date"), "order_id"
    )
    when_bought = F.struct("order_purchase_timestamp", "order_id", "review_creation_date", "review_id")
    when_reviewed = F.struct("review_creation_date", "review_id")
    people = facts.groupBy("customer_id").agg(
        F.avg(score).alias("avg_review_score"),
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(score >= 4).alias("promoter_reviews"),
        F.count_if(score == 3).alias("passive_reviews"),
        F.count_if(score <= 2).alias("detractor_reviews"),
        F.max((score <= 2).cast("int")).alias("has_negative_review"),
        F.max((score == 5).cast("int")).alias("has_positive_review"),
        F.min_by(score, when_bought).alias("first_order_review_score"),
        F.max_by(score, when_reviewed).alias("_last"),
        F.min_by(score, when_reviewed).alias("_first"),
        (F.max(score) - F.min(score)).alias("score_volatility"),
    )
    up, mid, down = F.col("promoter_reviews"), F.col("passive_reviews"), F.col("detractor_reviews")
    first = nps_category(F.col("first_order_review_score"))
    main = (
        F.when((up > down) & (up > mid), "Promoter")
        .when((down > up) & (down > mid), "Detractor")
        .otherwise("Passive")
    )
    change = F.col("_last") - F.col("_first")
    known = people.join(
        base.select("customer_id", "total_orders", "total_revenue", "avg_order_value",
                    "is_repeat_customer", "customer_lifespan_days", "recency_days"),
        "customer_id", "left",
    ).withColumn("primary_nps_category", main).withColumn("first_order_nps_category", first)
    main, first, revenue = (F.col("primary_nps_category"), F.col("first_order_nps_category"),
                            F.col("total_revenue"))
    promoter, detractor = main == "Promoter", main == "Detractor"
    return known.select(
        "customer_id", "avg_review_score", "total_reviews", "primary_nps_category",
        "has_negative_review", "has_positive_review", "promoter_reviews", "passive_reviews",
        "detractor_reviews", "first_order_review_score", "first_order_nps_category",
        (F.col("first_order_review_score") <= 2).cast("int").alias("first_order_negative"),
        F.when(F.col("total_reviews") < 2, "Single Review")
        .when(change > 1, "Improving").when(change < -1, "Declining").otherwise("Stable")
        .alias("nps_trend"),
        "score_volatility",
        "total_orders", "total_revenue", "avg_order_value", "is_repeat_customer",
        "customer_lifespan_days", "recency_days",
        ratio((up - down) * 100.0, "total_reviews").alias("customer_nps_score"),
        ((F.col("has_negative_review") == 1) & promoter).cast("int").alias("is_recovered_detractor"),
        F.when((first == "Detractor") & promoter, "Detractor_to_Promoter")
        .when((first == "Detractor") & (main == "Passive"), "Detractor_to_Passive")
        .when((first == "Promoter") & detractor, "Promoter_to_Detractor")
        .otherwise("Stable").alias("nps_journey"),
        rnd(revenue * F.when(promoter, 0.3).when(detractor, -0.2).otherwise(0.1), 6)
        .alias("estimated_nps_impact_value"),
        F.when(promoter, 0.7).when(detractor, 0.1).otherwise(0.4).alias("estimated_retention_probability"),
        F.when(promoter & (revenue > 500), "High_Value_Promoter").when(promoter, "Standard_Promoter")
        .when(detractor & (revenue > 500), "At_Risk_High_Value").when(detractor, "Standard_Detractor")
        .otherwise("Neutral_Customer").alias("nps_value_segment"),
    )


def purchase_rhythm(facts: DataFrame, cfg: MartConfig) -> DataFrame:
    """Interval, trend and delivery figures over each customer's delivered orders."""
    arrived, bought = F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp")
    delivered = completed(facts).where(arrived.isNotNull()).select(
        "customer_id", "order_id", "order_purchase_timestamp", "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    ordered = sequence_within(
        delivered, "customer_id", ["order_purchase_timestamp", "order_id"],
        "order_purchase_timestamp",
    )
    # Days are counted from one fixed day, not from the customer's first order: a correlation does
    # not change with the origin, and no join is needed to find one.
    x, y = F.col("seq"), day_diff(bought, cfg.today)
    sums = ordered.groupBy("customer_id").agg(
        F.avg(day_diff(bought, "previous_order_purchase_timestamp")).alias("avg_days_between_purchases"),
        F.avg(day_diff(arrived, bought)).alias("avg_delivery_days"),
        F.count_if(arrived > F.col("order_estimated_delivery_date")).alias("delayed_orders"),
        F.count(F.lit(1)).alias("total_orders_for_metrics"),
        *[F.sum(e).cast("double").alias(name) for name, e in
          (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))],
    )
    # Correlation from integer sums, so it does not depend on how partitions were merged.
    n, sx, sy = F.col("total_orders_for_metrics").cast("double"), F.col("sx"), F.col("sy")
    spread = F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy))
    trend = F.try_divide(n * F.col("sxy") - sx * sy, spread)
    return sums.select(
        "customer_id", "avg_days_between_purchases",
        F.when(n >= 3, rnd(trend, 6)).otherwise(0.0).alias("purchase_trend_correlation"),
        "avg_delivery_days", "delayed_orders", "total_orders_for_metrics",
    )


def mart_propensity_scores(
    customers: DataFrame, facts: DataFrame, items: DataFrame, payments: DataFrame, cfg: MartConfig,
    churn: DataFrame | None = None,
) -> DataFrame:
    """Feature table for propensity models; pass ``churn`` (customer_id, churn_probability) to
    fill the score columns, which are NULL otherwise."""
    bought = F.col("order_purchase_timestamp")
    first_item = (
        items.where(F.col("category").isNotNull())
        .groupBy("order_id")
        .agg(F.min(F.struct("order_item_id", "category"))["category"].alias("opening_category"))
    )
    per_order = completed(facts).where("paid_c is not null").join(first_item, "order_id", "left")
    place = F.struct("order_purchase_timestamp", "order_id")
    itemised = F.when(F.col("opening_category").isNotNull(), place)
    base = per_order.groupBy("customer_id").agg(
        F.min(bought).alias("first_ts"),
        F.max(bought).alias("last_ts"),
        F.count(F.lit(1)).alias("frequency"),
        from_cents(F.sum("paid_c")).alias("monetary"),
        F.avg("review_score").alias("avg_review_score"),
        F.count("review_score").alias("total_reviews"),
        ratio(F.sum("installments"), F.sum("payments")).alias("avg_installments"),
        F.min_by("opening_category", itemised).alias("first_purchase_category"),
        F.min_by(day_diff("order_delivered_customer_date", bought), itemised).alias("first_order_delivery_days"),
        F.min_by("review_score", itemised).alias("first_order_review_score"),
        F.min_by("opening_method", itemised).alias("first_payment_method"),
    )
    # Customers per moment first: the orders of the first moment (two can share it) are then one row.
    moments = completed(facts).groupBy("customer_id", "order_purchase_timestamp").agg(
        F.sum("paid_c").alias("paid_c"), F.count(F.lit(1)).alias("n"))
    opening = moments.groupBy("customer_id").agg(
        from_cents(F.coalesce(F.min(F.struct("order_purchase_timestamp", "paid_c"))["paid_c"], F.lit(0)))
        .alias("first_purchase_value"),
        F.sum("n").alias("_orders"),
    )
    methods = most_frequent(completed(payments), "customer_id", "payment_type", "preferred_payment_method")
    per_category = (
        categorised(items)
        .groupBy("customer_id", "category", "order_id")
        .agg(F.count(F.lit(1)).alias("lines"))
        .groupBy("customer_id", "category")
        .agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("orders"))
    )
    taste = per_category.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("unique_categories_purchased"),
        # Bounded by the number of product categories.
        F.sort_array(F.collect_set("category")).alias("purchased_categories"),
        F.max_by("category", F.struct("lines", "category")).alias("top_category"),
        F.sum(F.col("orders") * F.col("orders")).alias("_squares"),
    )
    joined = (
        customers.select("customer_id", "customer_unique_id", "customer_state", "customer_region")
        .join(base, "customer_id")
        .join(opening, "customer_id", "left")
        .join(methods, "customer_id", "left")
        .join(purchase_rhythm(facts, cfg), "customer_id", "left")
        .join(taste, "customer_id", "left")
    )
    unknown = F.lit(None).cast("double")
    if churn is None:
        joined, model = joined.withColumn("churn_probability", unknown), "ML_MODEL_PLACEHOLDER"
    else:
        joined = joined.join(churn.select("customer_id", "churn_probability"), "customer_id", "left")
        model = "churn_model"
    risk = F.col("churn_probability")

    def by_risk(low: str, medium: str, high: str, other: str) -> Column:
        return (F.when(risk.between(0, 0.3), low).when(risk.between(0.3, 0.7), medium)
                .when(risk > 0.7, high).otherwise(other))

    recency = day_diff(cfg.today, "last_ts")
    return joined.select(
        "customer_id", "customer_unique_id", "customer_state", "customer_region",
        recency.alias("recency_days"), "frequency", "monetary",
        day_diff(cfg.today, "first_ts").alias("customer_lifetime_days"),
        recency.alias("days_since_last_purchase"),
        "avg_review_score", "total_reviews", "preferred_payment_method", "avg_installments",
        "avg_days_between_purchases", "purchase_trend_correlation", "avg_delivery_days",
        "delayed_orders", "total_orders_for_metrics", "unique_categories_purchased",
        "purchased_categories", "top_category",
        rnd(ratio("_squares", F.col("_orders") * F.col("_orders")), 6).alias("category_concentration_index"),
        "first_purchase_category", "first_order_delivery_days", "first_order_review_score",
        "first_payment_method",
        F.coalesce("first_purchase_value", F.lit(0.0)).alias("first_purchase_value"),
        "churn_probability",
        by_risk("Low", "Medium", "High", "Unknown").alias("churn_risk_segment"),
        unknown.alias("top_category_propensity_score"),
        F.col("top_category").alias("next_best_category"),
        unknown.alias("loyalty_probability"),
        F.when(F.col("frequency") == 1, "One-time Customer").otherwise("Repeat Customer")
        .alias("current_customer_status"),
        by_risk("No immediate action", "Contact in 30 days", "Contact immediately", "Monitor")
        .alias("campaign_timing"),
        as_timestamp(cfg.today).alias("score_calculation_date"),
        F.lit(model).alias("model_version"),
    )
