"""Column order of each mart."""

CONTRACTS = {
    "customer_base": (
        "customer_id customer_unique_id customer_city customer_state customer_region "
        "total_orders delivered_orders canceled_orders first_purchase_date last_purchase_date "
        "customer_lifespan_days recency_days total_revenue avg_order_value max_order_value "
        "min_order_value preferred_payment_method avg_installments total_reviews "
        "avg_review_score reviews_with_comment positive_reviews negative_reviews "
        "avg_delivery_days delayed_orders avg_delay_days total_items_purchased avg_item_price "
        "total_freight_paid avg_freight_per_order unique_products_purchased "
        "unique_sellers_purchased_from revenue_per_order items_per_order is_repeat_customer "
        "is_churned is_satisfied_customer has_delivery_issues"
    ),
    "customer_rfm": (
        "customer_id customer_state customer_region recency frequency monetary r_score f_score "
        "m_score rfm_score rfm_total_score rfm_segment avg_order_value is_repeat_customer"
    ),
    "customer_ltv": (
        "customer_id customer_state customer_city customer_region total_revenue total_orders "
        "first_purchase_date last_purchase_date customer_lifespan_days avg_order_value "
        "orders_per_month clv_segment is_repeat_customer total_customers_state avg_ltv_state "
        "median_ltv_state total_revenue_state avg_aov_state repurchase_rate_state "
        "revenue_concentration_pct customer_density_proxy state_ltv_rank"
    ),
    "customer_cohort_retention": (
        "cohort_month cohort_start_date cohort_size months_since_first_purchase month_label "
        "retained_customers retention_rate cohort_revenue cumulative_revenue "
        "avg_revenue_per_order revenue_per_customer"
    ),
    "customer_segments": (
        "customer_id customer_state customer_region segment_name rfm_segment clv_segment "
        "recency frequency monetary r_score f_score m_score avg_order_value avg_items_per_order "
        "avg_days_between_purchases orders_per_month customer_lifespan_days preferred_category "
        "category_diversity preferred_payment_method avg_installments pct_weekend_shopper "
        "pct_night_shopper avg_review_score pct_delayed_orders total_freight_paid"
    ),
    "customer_age": (
        "customer_age_bin customers_in_bin avg_orders_in_bin avg_revenue_in_bin avg_aov_in_bin "
        "churn_rate_bin active_rate_bin repeat_rate_bin avg_age_days_in_bin "
        "avg_age_months_in_bin cumulative_revenue cumulative_orders cumulative_customers "
        "is_honeymoon_period is_danger_zone is_mature_period monthly_order_frequency "
        "monthly_revenue_rate revenue_rank orders_rank retention_rank prev_bin_revenue "
        "revenue_growth_rate_pct"
    ),
    "churn_prediction": (
        "customer_id customer_state customer_region days_since_last_purchase recency_score "
        "first_purchase_date last_purchase_date customer_lifespan_days total_orders "
        "frequency_score avg_days_between_purchases stddev_days_between_purchases total_spent "
        "avg_order_value monetary_score preferred_payment_method avg_installments "
        "pct_delayed_orders avg_delivery_delay avg_review_score review_score_normalized "
        "total_freight_paid avg_freight_per_order num_categories_purchased "
        "category_diversity_score preferred_category rfm_segment rfm_score is_churned "
        "churn_threshold_days churn_risk_score churn_risk_segment churn_risk_percentile_pct"
    ),
    "aov_analysis": (
        "order_id customer_id customer_state customer_city order_value items_per_order "
        "unique_products_per_order total_freight_value avg_item_price avg_freight_per_item "
        "freight_to_value_ratio value_bin items_bin payment_method_segment installments_segment "
        "order_purchase_timestamp order_month order_week order_year order_quarter "
        "payment_methods_used max_installments credit_card_payments boleto_payments "
        "is_high_value_order is_high_item_count_order has_high_freight_ratio "
        "customer_order_sequence"
    ),
    "geographic_performance": (
        "customer_state customer_region total_customers repeat_customers total_revenue avg_ltv "
        "median_ltv max_ltv min_ltv total_orders avg_orders_per_customer avg_aov "
        "repurchase_rate avg_customer_lifespan_days avg_orders_per_month "
        "revenue_concentration_pct cumulative_revenue_pct customer_concentration_pct ltv_rank "
        "revenue_rank customer_rank repurchase_rank customers_per_million_revenue "
        "revenue_per_customer market_penetration_category growth_potential"
    ),
    "revenue_summary": (
        "revenue_date time_period total_orders total_customers new_customers repeat_customers "
        "total_revenue new_customer_revenue repeat_customer_revenue avg_order_value "
        "cumulative_revenue previous_period_revenue revenue_growth_mom_pct "
        "previous_year_revenue revenue_growth_yoy_pct repeat_customer_rate repeat_revenue_rate "
        "revenue_per_customer revenue_per_new_customer revenue_per_repeat_customer "
        "is_high_revenue_day is_positive_growth has_high_repeat_rate"
    ),
    "unit_economics": (
        "segmentation_type segment_name segment_region num_customers avg_ltv total_revenue "
        "avg_orders avg_aov avg_gross_revenue avg_total_freight avg_net_revenue avg_margin_pct "
        "avg_cac_proxy avg_ltv_cac_ratio avg_payback_months avg_contribution_margin "
        "avg_customer_lifespan_months avg_monthly_revenue"
    ),
    "category_performance": (
        "category category_revenue category_orders category_units avg_price_per_category "
        "min_price max_price total_freight avg_freight category_margin avg_margin_pct "
        "unique_customers unique_products category_share cumulative_share revenue_rank "
        "first_sale_date last_sale_date active_months revenue_last_3m revenue_prev_3m "
        "category_growth_pct repeat_purchase_rate_category repeat_customers cross_category_rate "
        "cross_category_customers revenue_per_customer orders_per_customer units_per_order"
    ),
    "delivery_performance": (
        "order_id customer_id seller_id order_purchase_timestamp order_delivered_customer_date "
        "order_estimated_delivery_date customer_state customer_city seller_state seller_city "
        "delivery_route is_same_state_delivery delivery_time_actual delivery_time_estimated "
        "carrier_time transit_time delivery_delay is_delayed delay_severity distance_proxy "
        "freight_value freight_per_day review_score"
    ),
    "payment_analysis": (
        "payment_method_primary total_orders successful_orders canceled_orders total_revenue "
        "avg_order_value min_order_value max_order_value avg_installments_per_method "
        "max_installments_per_method conversion_rate cancellation_rate order_share_pct "
        "revenue_share_pct revenue_rank orders_with_multiple_methods pct_multiple_methods"
    ),
    "repeat_purchase": (
        "customer_id total_orders max_purchase_sequence first_purchase_date "
        "second_purchase_date cohort_month days_to_second_purchase has_second_purchase "
        "is_repeat_customer purchase_frequency_bin days_to_second_purchase_bin "
        "purchased_within_30_days purchased_within_60_days purchased_within_90_days "
        "days_since_first_purchase days_since_second_purchase"
    ),
    "seller_performance": (
        "seller_id seller_state seller_city seller_region seller_revenue seller_orders "
        "seller_units seller_avg_price seller_min_price seller_max_price seller_avg_freight "
        "seller_products_sold first_sale_date last_sale_date seller_active_months "
        "revenue_share_pct cumulative_revenue_share revenue_rank order_rank seller_categories "
        "primary_category seller_total_reviews seller_avg_review positive_reviews "
        "negative_reviews positive_review_rate seller_delivery_performance avg_delivery_days "
        "avg_delay_when_late revenue_per_month orders_per_month units_per_order seller_tier"
    ),
    "revenue_cohort": (
        "cohort_month order_month months_since_cohort cohort_size cohort_revenue "
        "cumulative_revenue total_orders active_customers avg_order_value "
        "revenue_per_active_customer cumulative_revenue_per_customer active_customer_rate "
        "monthly_revenue_per_cohort_customer cohort_performance previous_month_revenue "
        "revenue_growth_rate"
    ),
    "payment_cohort": (
        "customer_id first_purchase_date cohort_payment first_payment_installments "
        "first_purchase_value total_orders unique_payment_methods_used "
        "payment_method_consistency has_payment_method_migration most_frequent_payment_method "
        "avg_installments_all_orders max_installments_used total_revenue avg_order_value "
        "max_order_value customer_lifetime_days order_frequency is_repeat_customer "
        "repeat_order_count migration_pattern migration_path payment_method_diversity "
        "revenue_per_order estimated_monthly_ltv customer_value_segment"
    ),
    "purchase_frequency": (
        "customer_id num_orders frequency_bin total_revenue avg_order_value first_purchase_date "
        "last_purchase_date customer_tenure_days monthly_purchase_rate bin_customer_count "
        "bin_pct_customers bin_pct_revenue bin_avg_orders bin_avg_revenue "
        "cumulative_revenue_pct cumulative_customer_pct pareto_segment is_one_time_buyer "
        "is_repeat_customer is_frequent_customer value_segment"
    ),
    "nps_cohort": (
        "customer_id avg_review_score total_reviews primary_nps_category has_negative_review "
        "has_positive_review promoter_reviews passive_reviews detractor_reviews "
        "first_order_review_score first_order_nps_category first_order_negative nps_trend "
        "score_volatility total_orders total_revenue avg_order_value is_repeat_customer "
        "customer_lifespan_days recency_days customer_nps_score is_recovered_detractor "
        "nps_journey estimated_nps_impact_value estimated_retention_probability "
        "nps_value_segment"
    ),
    "propensity_scores": (
        "customer_id customer_unique_id customer_state customer_region recency_days frequency "
        "monetary customer_lifetime_days days_since_last_purchase avg_review_score "
        "total_reviews preferred_payment_method avg_installments avg_days_between_purchases "
        "purchase_trend_correlation avg_delivery_days delayed_orders total_orders_for_metrics "
        "unique_categories_purchased purchased_categories top_category "
        "category_concentration_index first_purchase_category first_order_delivery_days "
        "first_order_review_score first_payment_method first_purchase_value churn_probability "
        "churn_risk_segment top_category_propensity_score next_best_category "
        "loyalty_probability current_customer_status campaign_timing score_calculation_date "
        "model_version"
    ),
}
