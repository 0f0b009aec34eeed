"""Report statements over the mart relations, by report key."""

# Recommended action of each RFM segment (fixed values).
_ACTIONS = """WHEN 'Champions' THEN 'Reward them. They are your best customers.'
    WHEN 'Loyal Customers' THEN 'Upsell higher value products. Engage them.'
    WHEN 'Potential Loyalists' THEN 'Offer membership/loyalty program.'
    WHEN 'New Customers' THEN 'Provide on-boarding support, build relationship.'
    WHEN 'Promising' THEN 'Create brand awareness, offer free trials.'
    WHEN 'Need Attention' THEN 'Make limited time offers, recommend products.'
    WHEN 'About to Sleep' THEN 'Share valuable resources, recommend popular products.'
    WHEN 'At Risk' THEN 'Send personalized emails, offer renewals, provide helpful resources.'
    WHEN 'Can''t Lose Them' THEN 'Win them back via renewals or newer products, reach out proactively.'
    WHEN 'Hibernating' THEN 'Offer other products and special discounts. Recreate brand value.'
    WHEN 'Lost' THEN 'Revive interest with reach out campaign, ignore otherwise.'"""

_CHURN = "COUNT(*) AS customers, YES(is_churned) AS churned, RATE(is_churned) AS churn_rate_pct"
_UNIT = "FROM m_unit_economics WHERE segmentation_type"
_SLA = "RATE(NOT is_delayed) AS sla_compliance_rate"

REPORT_SQL = {
    # customer_base
    "customer_base_1": "SELECT COUNT(*) AS total_customers, COUNT(DISTINCT customer_id) AS unique_customers FROM m_customer_base",
    "customer_base_2": "SELECT is_repeat_customer, COUNT(*) AS customer_count, SHARE() AS percentage FROM m_customer_base GROUP BY 1",
    "customer_base_3": """SELECT RND(MSUM(CASE WHEN k <= n * 0.01 THEN v ELSE 0 END) / MSUM(v) * 100, 2) AS top_1_pct_revenue,
        RND(MSUM(CASE WHEN k <= n * 0.10 THEN v ELSE 0 END) / MSUM(v) * 100, 2) AS top_10_pct_revenue
        FROM (SELECT total_revenue AS v, row_number() OVER (ORDER BY total_revenue DESC) AS k, COUNT(*) OVER () AS n FROM m_customer_base)""",
    "customer_base_4": """SELECT AVGR(total_orders, 2) AS avg_orders, MEAN(total_revenue) AS avg_revenue, AVGR(avg_review_score, 2) AS avg_review,
        AVGR(recency_days, 2) AS avg_recency_days, AVGR(customer_lifespan_days, 2) AS avg_lifespan_days FROM m_customer_base""",
    "customer_base_5": """SELECT YES(is_repeat_customer) AS repeat_customers, YES(is_churned) AS churned_customers,
        YES(is_satisfied_customer) AS satisfied_customers, YES(has_delivery_issues) AS customers_with_delivery_issues FROM m_customer_base""",
    # customer_rfm
    "customer_rfm_1": """SELECT rfm_segment, COUNT(*) AS num_customers, SHARE() AS pct_customers, AVGR(recency, 1) AS avg_recency_days,
        AVGR(frequency, 1) AS avg_frequency, MEAN(monetary) AS avg_monetary FROM m_customer_rfm GROUP BY 1""",
    "customer_rfm_2": """SELECT rfm_segment, COUNT(*) AS num_customers, TOT(monetary) AS total_revenue, TSHARE(monetary) AS pct_revenue,
        MEAN(monetary) AS avg_ltv, AVGR(avg_order_value, 2) AS avg_aov FROM m_customer_rfm GROUP BY 1""",
    "customer_rfm_3": """SELECT rfm_segment, COUNT(*) AS total_customers, YES(is_repeat_customer) AS repeat_customers,
        RATE(is_repeat_customer) AS repurchase_rate_pct FROM m_customer_rfm GROUP BY 1""",
    "customer_rfm_4": "SELECT r_score, f_score, m_score, COUNT(*) AS num_customers, MEAN(monetary) AS avg_revenue FROM m_customer_rfm GROUP BY 1, 2, 3",
    "customer_rfm_5": """SELECT rfm_segment, COUNT(*) AS customers, TOT(monetary) AS total_revenue, MEAN(monetary) AS avg_ltv,
        AVGR(frequency, 1) AS avg_orders, AVGR(recency, 0) AS avg_recency_days FROM m_customer_rfm
        WHERE rfm_segment IN ('Champions', 'Loyal Customers', 'Potential Loyalists', 'Can''t Lose Them', 'At Risk') GROUP BY 1""",
    "customer_rfm_6": f"""SELECT rfm_segment, COUNT(*) AS customers, TOT(monetary) AS revenue, AVGR(recency, 0) AS avg_recency,
        AVGR(frequency, 1) AS avg_frequency, MEAN(monetary) AS avg_monetary,
        CASE rfm_segment {_ACTIONS} ELSE 'Analyze further.' END AS recommended_action FROM m_customer_rfm GROUP BY rfm_segment""",
    "customer_rfm_7": "SELECT customer_region, rfm_segment, COUNT(*) AS customers, TOT(monetary) AS revenue FROM m_customer_rfm GROUP BY 1, 2",
    # customer_ltv
    "customer_ltv_1": """SELECT COUNT(*) AS total_customers, MEAN(total_revenue) AS avg_clv, RND(quantile_disc(total_revenue, 0.5), 2) AS median_clv,
        RND(MAX(total_revenue), 2) AS max_clv, RND(MIN(total_revenue), 2) AS min_clv FROM m_customer_ltv""",
    "customer_ltv_2": """SELECT clv_segment, COUNT(*) AS customers, MEAN(total_revenue) AS avg_revenue, TOT(total_revenue) AS total_revenue,
        TSHARE(total_revenue) AS revenue_pct FROM m_customer_ltv GROUP BY 1""",
    "customer_ltv_3": """WITH r AS (SELECT total_revenue AS v, row_number() OVER (ORDER BY total_revenue DESC) AS k, COUNT(*) OVER () AS n FROM m_customer_ltv)
        SELECT 'Top ' || p || '%' AS segment, COUNT(*) AS customers, TOT(v) AS total_revenue,
        RND(MSUM(v) * 100.0 / (SELECT MSUM(v) FROM r), 2) AS revenue_pct
        FROM r, (VALUES (1), (5), (10)) AS c(p) WHERE k <= LNG(n * p / 100.0) GROUP BY p""",
    "customer_ltv_4": """SELECT DISTINCT customer_state, customer_region, total_customers_state, avg_ltv_state, median_ltv_state,
        total_revenue_state, avg_aov_state, repurchase_rate_state, revenue_concentration_pct, state_ltv_rank FROM m_customer_ltv""",
    "customer_ltv_5": """SELECT customer_state, total_revenue_state AS revenue, revenue_concentration_pct AS pct_of_total,
        RND(SUM(revenue_concentration_pct) OVER (ORDER BY total_revenue_state DESC), 2) AS cumulative_pct
        FROM (SELECT DISTINCT customer_state, total_revenue_state, revenue_concentration_pct FROM m_customer_ltv)""",
    "customer_ltv_6": "SELECT DISTINCT customer_state, total_customers_state, repurchase_rate_state, avg_ltv_state FROM m_customer_ltv",
    # customer_cohort_retention
    "customer_cohort_retention_1": "SELECT cohort_month, cohort_size, " + ", ".join(
        f"MAX(retention_rate) FILTER (WHERE months_since_first_purchase = {k}) AS M{k}" for k in (0, 1, 2, 3, 6, 12)
    ) + " FROM m_customer_cohort_retention GROUP BY 1, 2",
    "customer_cohort_retention_2": """SELECT months_since_first_purchase, month_label, AVGR(retention_rate, 2) AS avg_retention_rate,
        COUNT(DISTINCT cohort_month) AS num_cohorts, ISUM(retained_customers) AS total_retained_customers
        FROM m_customer_cohort_retention GROUP BY 1, 2""",
    "customer_cohort_retention_3": """WITH c AS (SELECT cohort_month, cohort_size, retention_rate AS m3_retention_rate,
        retained_customers AS m3_retained_customers FROM m_customer_cohort_retention WHERE months_since_first_purchase = 3)
        (SELECT 'Best Cohorts' AS category, * FROM c ORDER BY m3_retention_rate DESC, cohort_month LIMIT 5)
        UNION ALL (SELECT 'Worst Cohorts' AS category, * FROM c ORDER BY m3_retention_rate, cohort_month LIMIT 5)""",
    "customer_cohort_retention_4": """SELECT months_since_first_purchase, month_label, AVGR(retention_rate, 2) AS avg_customer_retention,
        TOT(cohort_revenue) AS total_revenue, AVGR(revenue_per_customer, 2) AS avg_revenue_per_customer,
        COUNT(DISTINCT cohort_month) AS num_cohorts FROM m_customer_cohort_retention GROUP BY 1, 2""",
    "customer_cohort_retention_5": """SELECT cohort_month, cohort_size, RND(MAX(cumulative_revenue), 2) AS total_cohort_revenue,
        RND(DIV(MAX(cumulative_revenue), cohort_size), 2) AS ltv_per_customer, """ + ", ".join(
        f"MAX(CASE WHEN months_since_first_purchase = {k} THEN retention_rate END) AS m{k}_retention" for k in (1, 3, 6)
    ) + " FROM m_customer_cohort_retention GROUP BY 1, 2",
    "customer_cohort_retention_6": """SELECT months_since_first_purchase, AVGR(retention_rate, 2) AS avg_retention,
        AVGR(ch, 2) AS avg_retention_change, RND(MIN(ch), 2) AS max_decay, COUNT(DISTINCT cohort_month) AS num_cohorts
        FROM (SELECT *, retention_rate - lag(retention_rate) OVER (PARTITION BY cohort_month ORDER BY months_since_first_purchase) AS ch
              FROM m_customer_cohort_retention) WHERE ch IS NOT NULL GROUP BY 1""",
    # customer_segments
    "customer_segments_1": "SELECT segment_name, COUNT(*) AS num_customers, SHARE() AS pct_customers FROM m_customer_segments GROUP BY 1",
    "customer_segments_2": """SELECT segment_name, COUNT(*) AS num_customers, MEAN(monetary) AS avg_ltv, AVGR(avg_order_value, 2) AS avg_aov,
        AVGR(frequency, 1) AS avg_frequency, AVGR(recency, 0) AS avg_recency_days, AVGR(category_diversity, 1) AS avg_category_diversity,
        AVGR(avg_review_score, 2) AS avg_review_score FROM m_customer_segments GROUP BY 1""",
    "customer_segments_3": """SELECT segment_name, COUNT(*) AS customers, TOT(monetary) AS total_revenue, TSHARE(monetary) AS pct_revenue,
        MEAN(monetary) AS avg_ltv FROM m_customer_segments GROUP BY 1""",
    "customer_segments_4": """SELECT segment_name, preferred_category, COUNT(*) AS num_customers, AVGR(category_diversity, 1) AS avg_category_diversity
        FROM m_customer_segments GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY segment_name ORDER BY COUNT(*) DESC, preferred_category) <= 3""",
    "customer_segments_5": """SELECT segment_name, preferred_payment_method, COUNT(*) AS num_customers, AVGR(avg_installments, 1) AS avg_installments
        FROM m_customer_segments GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY segment_name ORDER BY COUNT(*) DESC, preferred_payment_method) = 1""",
    "customer_segments_6": """SELECT segment_name, AVGR(pct_weekend_shopper, 1) AS avg_pct_weekend, AVGR(pct_night_shopper, 1) AS avg_pct_night,
        AVGR(avg_days_between_purchases, 0) AS avg_days_between_purchases FROM m_customer_segments
        WHERE avg_days_between_purchases IS NOT NULL GROUP BY 1""",
    "customer_segments_7": """SELECT segment_name, AVGR(avg_review_score, 2) AS avg_review_score, AVGR(pct_delayed_orders, 1) AS avg_pct_delayed,
        MEAN(total_freight_paid) AS avg_freight_paid FROM m_customer_segments GROUP BY 1""",
    "customer_segments_8": "SELECT segment_name, customer_region, COUNT(*) AS num_customers, TOT(monetary) AS total_revenue FROM m_customer_segments GROUP BY 1, 2",
    "customer_segments_9": "SELECT segment_name, rfm_segment, COUNT(*) AS num_customers, MEAN(monetary) AS avg_ltv FROM m_customer_segments GROUP BY 1, 2",
    "customer_segments_10": """SELECT segment_name, RND(stddev_samp(monetary), 2) AS stddev_ltv, RND(stddev_samp(avg_order_value), 2) AS stddev_aov,
        RND(stddev_samp(frequency), 2) AS stddev_frequency, RND(stddev_samp(category_diversity), 2) AS stddev_category_diversity
        FROM m_customer_segments GROUP BY 1""",
    # customer_age
    "customer_age_1": """SELECT customer_age_bin, customers_in_bin, RND(customers_in_bin * 100.0 / SUM(customers_in_bin) OVER (), 2) AS pct_of_total,
        avg_age_days_in_bin, avg_orders_in_bin FROM m_customer_age""",
    "customer_age_2": """SELECT customer_age_bin, avg_revenue_in_bin AS avg_ltv, cumulative_revenue, avg_orders_in_bin, avg_aov_in_bin,
        monthly_order_frequency FROM m_customer_age""",
    "customer_age_3": "SELECT customer_age_bin, customers_in_bin, churn_rate_bin, active_rate_bin, repeat_rate_bin FROM m_customer_age",
    "customer_age_4": """SELECT CASE WHEN is_honeymoon_period THEN 'Honeymoon Period (0-6m)' WHEN is_danger_zone THEN 'Danger Zone (6-12m)'
        ELSE 'Mature Period (12+m)' END AS lifecycle_stage, ISUM(customers_in_bin) AS total_customers, AVGR(avg_orders_in_bin, 2) AS avg_orders,
        AVGR(avg_revenue_in_bin, 2) AS avg_revenue, AVGR(avg_aov_in_bin, 2) AS avg_aov, AVGR(churn_rate_bin, 2) AS avg_churn_rate
        FROM m_customer_age GROUP BY 1""",
    "customer_age_5": "SELECT customer_age_bin, monthly_order_frequency, avg_orders_in_bin, revenue_growth_rate_pct FROM m_customer_age",
    "customer_age_6": "SELECT customer_age_bin, avg_revenue_in_bin, revenue_rank, orders_rank, retention_rank FROM m_customer_age",
    "customer_age_7": """SELECT customer_age_bin, cumulative_customers, cumulative_revenue, cumulative_orders,
        RND(DIV(cumulative_revenue, cumulative_customers), 2) AS avg_ltv_cumulative FROM m_customer_age""",
    # customer_churn
    "customer_churn_1": "SELECT COUNT(*) AS total_customers, YES(is_churned) AS churned_customers, RATE(is_churned) AS churn_rate_pct FROM m_churn_prediction",
    "customer_churn_2": f"""SELECT churn_risk_segment, {_CHURN}, AVGR(churn_risk_score, 1) AS avg_risk_score,
        AVGR(days_since_last_purchase, 1) AS avg_days_since_purchase FROM m_churn_prediction GROUP BY 1""",
    "customer_churn_3": f"SELECT rfm_segment, {_CHURN}, AVGR(churn_risk_score, 1) AS avg_risk_score, MEAN(total_spent) AS avg_ltv FROM m_churn_prediction GROUP BY 1",
    "customer_churn_4": f"""SELECT customer_state, {_CHURN}, AVGR(churn_risk_score, 1) AS avg_risk_score FROM m_churn_prediction
        GROUP BY 1 ORDER BY customers DESC, customer_state LIMIT 10""",
    "customer_churn_5": f"SELECT preferred_payment_method, {_CHURN}, AVGR(churn_risk_score, 1) AS avg_risk_score FROM m_churn_prediction GROUP BY 1",
    "customer_churn_6": """SELECT customer_id, customer_state, churn_risk_score, churn_risk_percentile_pct, days_since_last_purchase, total_orders,
        RND(total_spent, 2) AS total_spent, rfm_segment, avg_review_score, pct_delayed_orders FROM m_churn_prediction
        WHERE NOT is_churned ORDER BY churn_risk_score DESC, customer_id LIMIT 100""",
    "customer_churn_7": " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, AVGR(CASE WHEN is_churned THEN {c} ELSE 0 END, 2) AS avg_when_churned,
        AVGR(CASE WHEN is_churned THEN 0 ELSE {c} END, 2) AS avg_when_active FROM m_churn_prediction"""
        for n, c in (("High Recency", "recency_score"), ("Low Frequency", "frequency_score"), ("Low Monetary", "monetary_score"),
                     ("Delayed Orders %", "pct_delayed_orders * 100"), ("Low Review Score", "avg_review_score"))),
    "customer_churn_8": f"SELECT CAST(floor(churn_risk_score / 10) * 10 AS BIGINT) AS risk_score_bin, {_CHURN} FROM m_churn_prediction GROUP BY 1",
    "customer_churn_9": """SELECT YES(customer_id IS NULL) AS null_customer_id, YES(days_since_last_purchase IS NULL) AS null_recency,
        YES(total_orders IS NULL) AS null_frequency, YES(total_spent IS NULL) AS null_monetary, YES(churn_risk_score IS NULL) AS null_risk_score
        FROM m_churn_prediction""",
    "customer_churn_10": """SELECT COUNT(*) AS top_10_pct_customers, MEAN(total_spent) AS avg_ltv_at_risk, TOT(total_spent) AS total_ltv_at_risk,
        AVGR(days_since_last_purchase, 1) AS avg_days_inactive FROM m_churn_prediction
        WHERE churn_risk_percentile_pct >= 90 AND NOT is_churned""",
    # aov_analysis
    "aov_analysis_1": """SELECT COUNT(*) AS total_orders, MEAN(order_value) AS overall_aov, AVGR(items_per_order, 2) AS avg_items_per_order,
        AVGR(avg_item_price, 2) AS avg_item_price, RND(MIN(order_value), 2) AS min_order_value, RND(MAX(order_value), 2) AS max_order_value
        FROM m_aov_analysis""",
    "aov_analysis_2": """SELECT value_bin, COUNT(*) AS order_count, SHARE() AS percentage, MEAN(order_value) AS avg_order_value,
        AVGR(items_per_order, 2) AS avg_items_per_order FROM m_aov_analysis GROUP BY 1""",
    "aov_analysis_3": """SELECT payment_method_segment, COUNT(*) AS order_count, MEAN(order_value) AS avg_order_value,
        AVGR(items_per_order, 2) AS avg_items_per_order, AVGR(max_installments, 2) AS avg_installments FROM m_aov_analysis GROUP BY 1""",
    "aov_analysis_4": """SELECT items_bin, COUNT(*) AS order_count, MEAN(order_value) AS avg_order_value, AVGR(avg_item_price, 2) AS avg_item_price,
        AVGR(freight_to_value_ratio, 4) AS avg_freight_ratio FROM m_aov_analysis GROUP BY 1""",
    "aov_analysis_5": """SELECT order_month, COUNT(*) AS order_count, MEAN(order_value) AS monthly_aov, AVGR(items_per_order, 2) AS avg_items_per_order,
        TOT(order_value) AS total_revenue FROM m_aov_analysis GROUP BY 1""",
    "aov_analysis_6": """SELECT customer_state, COUNT(*) AS order_count, MEAN(order_value) AS avg_order_value,
        AVGR(items_per_order, 2) AS avg_items_per_order FROM m_aov_analysis WHERE customer_state IS NOT NULL
        GROUP BY 1 ORDER BY avg_order_value DESC, customer_state LIMIT 10""",
    "aov_analysis_7": """SELECT RND(CORR2(order_value, items_per_order), 6) AS value_items_correlation,
        RND(CORR2(order_value, avg_item_price), 6) AS value_price_correlation,
        RND(CORR2(items_per_order, avg_item_price), 6) AS items_price_correlation FROM m_aov_analysis""",
    "aov_analysis_8": """SELECT is_high_value_order, COUNT(*) AS order_count, MEAN(order_value) AS avg_order_value,
        AVGR(items_per_order, 2) AS avg_items_per_order, AVGR(max_installments, 2) AS avg_installments FROM m_aov_analysis GROUP BY 1""",
    # geographic_performance
    "geographic_performance_1": """SELECT customer_state, customer_region, total_customers, total_revenue AS revenue, revenue_concentration_pct,
        avg_ltv, repurchase_rate, growth_potential FROM m_geographic_performance ORDER BY total_revenue DESC, customer_state LIMIT 10""",
    "geographic_performance_2": """SELECT COUNT(*) AS num_states, MSUM(total_revenue) AS total_revenue, MSUM(revenue_concentration_pct) AS pct_of_total_revenue
        FROM m_geographic_performance WHERE cumulative_revenue_pct <= 80""",
    "geographic_performance_3": """SELECT customer_region, COUNT(*) AS num_states, ISUM(total_customers) AS total_customers, TOT(total_revenue) AS total_revenue,
        AVGR(avg_ltv, 2) AS avg_ltv, AVGR(repurchase_rate, 2) AS avg_repurchase_rate FROM m_geographic_performance GROUP BY 1""",
    "geographic_performance_4": """SELECT growth_potential, COUNT(*) AS num_states, AVGR(avg_ltv, 2) AS avg_ltv,
        AVGR(repurchase_rate, 2) AS avg_repurchase_rate, TOT(total_revenue) AS total_revenue FROM m_geographic_performance GROUP BY 1""",
    "geographic_performance_5": """SELECT market_penetration_category, COUNT(*) AS num_states, ISUM(total_customers) AS total_customers,
        TOT(total_revenue) AS total_revenue, TOT(revenue_concentration_pct) AS total_revenue_pct FROM m_geographic_performance GROUP BY 1""",
    "geographic_performance_6": """SELECT customer_state, customer_region, ltv_rank, revenue_rank, customer_rank, repurchase_rank,
        RND((ltv_rank + revenue_rank + customer_rank + repurchase_rank) / 4.0, 2) AS avg_rank FROM m_geographic_performance""",
    # revenue_summary
    "revenue_summary_1": """SELECT time_period, COUNT(*) AS period_count, MIN(revenue_date) AS first_date, MAX(revenue_date) AS last_date,
        MEAN(total_revenue) AS avg_revenue FROM m_revenue_summary GROUP BY 1""",
    "revenue_summary_2": """SELECT TOT(total_revenue) AS mart_total_revenue, (SELECT TOT(payment_value) FROM s_payments) AS source_total_revenue
        FROM m_revenue_summary WHERE time_period = 'monthly'""",
    "revenue_summary_3": """SELECT time_period, TOT(new_customer_revenue) AS total_new_revenue, TOT(repeat_customer_revenue) AS total_repeat_revenue,
        AVGR(repeat_revenue_rate, 2) AS avg_repeat_rate FROM m_revenue_summary GROUP BY 1""",
    "revenue_summary_4": """SELECT revenue_date, RND(total_revenue, 2) AS monthly_revenue, RND(revenue_growth_mom_pct, 2) AS mom_growth_pct,
        RND(repeat_revenue_rate, 2) AS repeat_rate FROM m_revenue_summary WHERE time_period = 'monthly' ORDER BY revenue_date DESC LIMIT 12""",
    "revenue_summary_5": """SELECT COUNT(*) AS total_rows, YES(total_revenue IS NULL) AS null_revenue_rows, YES(total_customers IS NULL) AS null_customer_rows,
        YES(revenue_date IS NULL) AS null_date_rows FROM m_revenue_summary""",
    "revenue_summary_6": """SELECT revenue_date, time_period, RND(total_revenue, 2) AS revenue, total_orders, RND(repeat_revenue_rate, 2) AS repeat_rate
        FROM m_revenue_summary WHERE time_period = 'monthly' ORDER BY total_revenue DESC, revenue_date LIMIT 10""",
    # unit_economics
    "unit_economics_1": f"""SELECT segment_name, num_customers, avg_ltv, avg_cac_proxy, avg_ltv_cac_ratio, avg_payback_months,
        avg_contribution_margin {_UNIT} = 'RFM Segment'""",
    "unit_economics_2": f"""SELECT segment_name AS state, segment_region AS region, num_customers, avg_ltv, avg_ltv_cac_ratio, avg_margin_pct,
        avg_contribution_margin {_UNIT} = 'State' ORDER BY total_revenue DESC, segment_name LIMIT 10""",
    "unit_economics_3": f"""SELECT segment_name AS region, num_customers, total_revenue, avg_ltv, avg_aov, avg_ltv_cac_ratio,
        avg_payback_months {_UNIT} = 'Region'""",
    "unit_economics_4": f"""SELECT segment_name AS cohort, num_customers, avg_ltv, avg_ltv_cac_ratio, avg_customer_lifespan_months,
        avg_monthly_revenue {_UNIT} = 'Cohort'""",
    "unit_economics_5": f"""SELECT segmentation_type, segment_name, num_customers, avg_ltv, avg_ltv_cac_ratio, avg_contribution_margin,
        CASE WHEN avg_ltv_cac_ratio >= 3 THEN 'Excellent' WHEN avg_ltv_cac_ratio >= 2 THEN 'Good' WHEN avg_ltv_cac_ratio >= 1 THEN 'Break Even'
        ELSE 'Loss' END AS profitability_category {_UNIT} IN ('RFM Segment', 'Region')""",
    "unit_economics_6": f"""SELECT segmentation_type, segment_name, avg_gross_revenue, avg_total_freight, avg_net_revenue, avg_margin_pct,
        avg_contribution_margin {_UNIT} = 'RFM Segment'""",
    "unit_economics_7": f"""SELECT segmentation_type, segment_name, avg_ltv, avg_cac_proxy, avg_payback_months, avg_monthly_revenue,
        CASE WHEN avg_payback_months <= 3 THEN 'Fast (0-3 months)' WHEN avg_payback_months <= 6 THEN 'Medium (3-6 months)'
        WHEN avg_payback_months <= 12 THEN 'Slow (6-12 months)' ELSE 'Very Slow (12+ months)' END AS payback_category
        {_UNIT} = 'RFM Segment' AND avg_payback_months IS NOT NULL""",
    "unit_economics_8": """SELECT segmentation_type, COUNT(DISTINCT segment_name) AS num_segments, TOT(total_revenue) AS total_revenue,
        AVGR(avg_ltv, 2) AS overall_avg_ltv, AVGR(avg_ltv_cac_ratio, 2) AS overall_avg_ltv_cac_ratio FROM m_unit_economics GROUP BY 1""",
    "unit_economics_9": f"""SELECT segmentation_type, segment_name, num_customers, total_revenue, avg_ltv_cac_ratio, avg_contribution_margin, avg_margin_pct
        {_UNIT} IN ('RFM Segment', 'State') AND num_customers >= 100
        ORDER BY avg_ltv_cac_ratio DESC, segmentation_type, segment_name LIMIT 15""",
    # category_performance
    "category_performance_1": """SELECT category, category_revenue, category_share, cumulative_share, category_orders, category_units, avg_price_per_category
        FROM m_category_performance ORDER BY category_revenue DESC, category LIMIT 10""",
    "category_performance_2": """SELECT category, category_units, category_orders, category_revenue, avg_price_per_category
        FROM m_category_performance ORDER BY category_units DESC, category LIMIT 10""",
    "category_performance_3": """SELECT category, revenue_last_3m, revenue_prev_3m, category_growth_pct, category_revenue
        FROM m_category_performance WHERE revenue_prev_3m > 0 ORDER BY category_growth_pct DESC, category LIMIT 10""",
    "category_performance_4": """SELECT category, category_revenue, category_margin, avg_margin_pct, avg_freight,
        CASE WHEN avg_margin_pct >= 80 THEN 'High Margin (80%+)' WHEN avg_margin_pct >= 70 THEN 'Good Margin (70-80%)'
        WHEN avg_margin_pct >= 60 THEN 'Average Margin (60-70%)' ELSE 'Low Margin (<60%)' END AS margin_category FROM m_category_performance""",
    "category_performance_5": """SELECT category, unique_customers, repeat_customers, repeat_purchase_rate_category, category_revenue
        FROM m_category_performance ORDER BY repeat_purchase_rate_category DESC, category LIMIT 15""",
    "category_performance_6": """SELECT category, unique_customers, cross_category_customers, cross_category_rate, category_revenue
        FROM m_category_performance ORDER BY cross_category_rate DESC, category LIMIT 15""",
    "category_performance_7": """SELECT CASE WHEN cumulative_share <= 80 THEN 'Top 80% Revenue' ELSE 'Bottom 20% Revenue' END AS pareto_group,
        COUNT(*) AS num_categories, TOT(category_revenue) AS total_revenue, TOT(category_share) AS total_share FROM m_category_performance GROUP BY 1""",
    "category_performance_8": """SELECT CASE WHEN avg_price_per_category < 50 THEN 'Budget (<R$50)' WHEN avg_price_per_category < 100 THEN 'Economy (R$50-100)'
        WHEN avg_price_per_category < 200 THEN 'Mid-Range (R$100-200)' ELSE 'Premium (R$200+)' END AS price_segment, COUNT(*) AS num_categories,
        TOT(category_revenue) AS total_revenue, AVGR(avg_price_per_category, 2) AS avg_price, AVGR(category_units, 0) AS avg_units
        FROM m_category_performance GROUP BY 1""",
    "category_performance_9": """SELECT category, unique_customers, revenue_per_customer, orders_per_customer, units_per_order, category_revenue
        FROM m_category_performance ORDER BY revenue_per_customer DESC, category LIMIT 15""",
    "category_performance_10": """SELECT COUNT(*) AS total_categories, TOT(category_revenue) AS total_revenue, MEAN(category_revenue) AS avg_revenue_per_category,
        AVGR(avg_price_per_category, 2) AS overall_avg_price, AVGR(avg_margin_pct, 2) AS overall_avg_margin,
        AVGR(repeat_purchase_rate_category, 2) AS overall_repeat_rate FROM m_category_performance""",
    # delivery_performance
    "delivery_performance_1": f"""SELECT COUNT(*) AS total_orders, YES(NOT is_delayed) AS on_time_orders, YES(is_delayed) AS delayed_orders, {_SLA},
        AVGR(delivery_time_actual, 1) AS avg_delivery_days_actual, AVGR(delivery_time_estimated, 1) AS avg_delivery_days_estimated,
        RND(AVG(delivery_delay) FILTER (WHERE is_delayed), 1) AS avg_delay_when_late FROM m_delivery_performance""",
    "delivery_performance_2": """SELECT delay_severity, COUNT(*) AS num_orders, SHARE() AS pct_orders, AVGR(delivery_delay, 1) AS avg_delay_days,
        AVGR(review_score, 2) AS avg_review_score FROM m_delivery_performance GROUP BY 1""",
    "delivery_performance_3": f"""SELECT customer_state, COUNT(*) AS total_orders, YES(NOT is_delayed) AS on_time_orders, {_SLA},
        AVGR(delivery_time_actual, 1) AS avg_delivery_days, AVGR(delivery_delay, 1) AS avg_delay_days FROM m_delivery_performance GROUP BY 1""",
    "delivery_performance_4": f"""SELECT delivery_route, COUNT(*) AS total_orders, {_SLA}, AVGR(delivery_time_actual, 1) AS avg_delivery_days,
        AVGR(delivery_delay, 1) AS avg_delay_days, MEAN(freight_value) AS avg_freight FROM m_delivery_performance
        GROUP BY 1 HAVING COUNT(*) >= 50 ORDER BY total_orders DESC, delivery_route LIMIT 20""",
    "delivery_performance_5": f"""SELECT is_same_state_delivery, COUNT(*) AS total_orders, {_SLA}, AVGR(delivery_time_actual, 1) AS avg_delivery_days,
        AVGR(carrier_time, 1) AS avg_carrier_time, AVGR(transit_time, 1) AS avg_transit_time, MEAN(freight_value) AS avg_freight
        FROM m_delivery_performance GROUP BY 1""",
    "delivery_performance_6": """SELECT delay_severity, COUNT(*) AS orders_with_reviews, AVGR(review_score, 2) AS avg_review_score,
        AVGR(delivery_delay, 1) AS avg_delay_days FROM m_delivery_performance WHERE review_score IS NOT NULL GROUP BY 1""",
    "delivery_performance_7": """SELECT delay_severity, COUNT(*) AS total_orders, MEAN(freight_value) AS avg_freight,
        AVGR(freight_per_day, 2) AS avg_freight_per_day, AVGR(delivery_time_actual, 1) AS avg_delivery_days FROM m_delivery_performance GROUP BY 1""",
    "delivery_performance_8": f"""SELECT CASE WHEN carrier_time <= 2 THEN 'Fast pickup (0-2 days)' WHEN carrier_time <= 5 THEN 'Normal pickup (3-5 days)'
        ELSE 'Slow pickup (6+ days)' END AS carrier_speed, COUNT(*) AS total_orders, AVGR(carrier_time, 1) AS avg_carrier_days,
        AVGR(transit_time, 1) AS avg_transit_days, AVGR(delivery_time_actual, 1) AS avg_total_delivery_days, {_SLA}
        FROM m_delivery_performance WHERE carrier_time IS NOT NULL GROUP BY 1""",
    "delivery_performance_9": f"""SELECT CASE WHEN distance_proxy < 5000 THEN 'Near (<5k zip diff)' WHEN distance_proxy <= 20000 THEN 'Medium (5k-20k)'
        ELSE 'Far (20k+)' END AS distance_category, COUNT(*) AS total_orders, AVGR(delivery_time_actual, 1) AS avg_delivery_days, {_SLA},
        MEAN(freight_value) AS avg_freight FROM m_delivery_performance GROUP BY 1""",
    # payment_analysis
    "payment_analysis_1": """SELECT payment_method_primary, total_orders, order_share_pct, total_revenue, revenue_share_pct, avg_order_value
        FROM m_payment_analysis""",
    "payment_analysis_2": """SELECT payment_method_primary, total_orders, successful_orders, canceled_orders, conversion_rate, cancellation_rate
        FROM m_payment_analysis""",
    "payment_analysis_3": "SELECT payment_method_primary, avg_order_value, min_order_value, max_order_value, total_revenue FROM m_payment_analysis",
    "payment_analysis_4": """SELECT payment_method_primary, avg_installments_per_method, max_installments_per_method, avg_order_value
        FROM m_payment_analysis""",
    "payment_analysis_5": "SELECT payment_method_primary, total_orders, orders_with_multiple_methods, pct_multiple_methods FROM m_payment_analysis",
    "payment_analysis_6": """SELECT installment_bin, COUNT(DISTINCT order_id) AS total_orders,
        RND(COUNT(DISTINCT order_id) * 100.0 / SUM(COUNT(DISTINCT order_id)) OVER (), 2) AS order_pct,
        MEAN(payment_value) AS avg_payment_value, TOT(payment_value) AS total_revenue, RATE(is_completed) AS conversion_rate
        FROM (SELECT CASE WHEN payment_installments = 1 THEN '1x' WHEN payment_installments <= 3 THEN '2-3x' WHEN payment_installments <= 6 THEN '4-6x'
                          WHEN payment_installments <= 12 THEN '7-12x' ELSE '13+x' END AS installment_bin, order_id, payment_value, is_completed
              FROM s_payments JOIN s_orders USING (order_id)) GROUP BY 1""",
    "payment_analysis_7": """WITH a AS (SELECT AVGR(avg_order_value, 6) AS t FROM m_payment_analysis)
        SELECT payment_method_primary, total_orders, order_share_pct, revenue_share_pct, avg_order_value, conversion_rate, cancellation_rate,
        avg_installments_per_method, CASE WHEN conversion_rate >= 95 AND avg_order_value >= t THEN 'Excellent'
        WHEN conversion_rate >= 90 OR avg_order_value >= t THEN 'Good' WHEN conversion_rate >= 80 THEN 'Average'
        ELSE 'Needs Improvement' END AS performance_category FROM m_payment_analysis, a""",
    "payment_analysis_8": """SELECT payment_method_primary, revenue_share_pct,
        RND(SUM(revenue_share_pct) OVER (ORDER BY revenue_share_pct DESC), 2) AS cumulative_revenue_pct FROM m_payment_analysis""",
    # repeat_purchase
    "repeat_purchase_1": """SELECT COUNT(*) AS total_customers, ISUM(is_repeat_customer) AS repeat_customers,
        RATE(is_repeat_customer = 1) AS repeat_purchase_rate FROM m_repeat_purchase""",
    "repeat_purchase_2": """SELECT days_to_second_purchase_bin, COUNT(*) AS customer_count, SHARE() AS percentage FROM m_repeat_purchase
        WHERE has_second_purchase = 1 GROUP BY 1""",
    "repeat_purchase_3": "SELECT purchase_frequency_bin, COUNT(*) AS customer_count, SHARE() AS percentage FROM m_repeat_purchase GROUP BY 1",
    "repeat_purchase_4": """SELECT cohort_month, COUNT(*) AS total_customers, ISUM(has_second_purchase) AS second_purchases,
        RATE(has_second_purchase = 1) AS second_purchase_rate FROM m_repeat_purchase GROUP BY 1""",
    "repeat_purchase_5": "SELECT COUNT(*) AS total_repeat_customers, " + ", ".join(
        f"ISUM(purchased_within_{d}_days) AS within_{d}_days, RATE(purchased_within_{d}_days = 1) AS pct_within_{d}_days" for d in (30, 60, 90)
    ) + " FROM m_repeat_purchase WHERE has_second_purchase = 1",
    "repeat_purchase_6": """SELECT COUNT(*) AS repeat_customers, AVGR(days_to_second_purchase, 2) AS avg_days_to_second_purchase,
        quantile_disc(days_to_second_purchase, 0.5) AS median_days_to_second_purchase, MIN(days_to_second_purchase) AS min_days_to_second_purchase,
        MAX(days_to_second_purchase) AS max_days_to_second_purchase FROM m_repeat_purchase WHERE has_second_purchase = 1""",
    # seller_performance
    "seller_performance_1": """SELECT seller_id, seller_state, seller_revenue, revenue_share_pct, seller_orders, seller_avg_review,
        seller_delivery_performance, revenue_rank FROM m_seller_performance ORDER BY seller_revenue DESC, seller_id LIMIT 20""",
    "seller_performance_2": """SELECT seller_id, seller_state, seller_orders, seller_units, seller_revenue, seller_avg_price, order_rank
        FROM m_seller_performance ORDER BY seller_orders DESC, seller_id LIMIT 20""",
    "seller_performance_3": """SELECT seller_tier, COUNT(*) AS num_sellers, TOT(seller_revenue) AS total_revenue,
        RND(SUM(CAST(revenue_share_pct AS DECIMAL(18,4))), 2) AS revenue_share, AVGR(seller_avg_review, 2) AS avg_review_score
        FROM m_seller_performance GROUP BY 1""",
    "seller_performance_4": """SELECT CASE WHEN seller_avg_review >= 4.5 THEN 'Excellent (4.5+)' WHEN seller_avg_review >= 4 THEN 'Good (4.0-4.5)'
        WHEN seller_avg_review >= 3.5 THEN 'Average (3.5-4.0)' ELSE 'Below Average (<3.5)' END AS review_category, COUNT(*) AS num_sellers,
        MEAN(seller_revenue) AS avg_revenue, AVGR(seller_orders, 1) AS avg_orders, AVGR(seller_avg_review, 2) AS avg_review
        FROM m_seller_performance WHERE seller_total_reviews >= 5 GROUP BY 1""",
    "seller_performance_5": """SELECT seller_tier, COUNT(*) AS num_sellers, AVGR(seller_delivery_performance, 2) AS avg_sla_compliance,
        AVGR(avg_delivery_days, 1) AS avg_delivery_days, AVGR(seller_avg_review, 2) AS avg_review_score FROM m_seller_performance GROUP BY 1""",
    "seller_performance_6": """SELECT seller_region, seller_state, COUNT(*) AS num_sellers, TOT(seller_revenue) AS total_revenue,
        MEAN(seller_revenue) AS avg_revenue_per_seller, AVGR(seller_avg_review, 2) AS avg_review_score FROM m_seller_performance
        GROUP BY 1, 2 ORDER BY total_revenue DESC, seller_state LIMIT 15""",
    "seller_performance_7": """SELECT CASE WHEN seller_categories = 1 THEN 'Single Category' WHEN seller_categories IN (2, 3) THEN 'Low Diversity (2-3)'
        WHEN seller_categories IN (4, 5, 6) THEN 'Medium Diversity (4-6)' ELSE 'High Diversity (7+)' END AS diversity_level, COUNT(*) AS num_sellers,
        MEAN(seller_revenue) AS avg_revenue, AVGR(seller_orders, 1) AS avg_orders, AVGR(seller_avg_review, 2) AS avg_review
        FROM m_seller_performance GROUP BY 1""",
    "seller_performance_8": """SELECT CASE WHEN seller_active_months <= 3 THEN '0-3 months' WHEN seller_active_months <= 6 THEN '4-6 months'
        WHEN seller_active_months <= 12 THEN '7-12 months' ELSE '12+ months' END AS activity_period, COUNT(*) AS num_sellers,
        MEAN(seller_revenue) AS avg_revenue, AVGR(revenue_per_month, 2) AS avg_revenue_per_month, AVGR(seller_avg_review, 2) AS avg_review
        FROM m_seller_performance GROUP BY 1""",
    "seller_performance_9": """SELECT h AS hhi_index, CASE WHEN h < 100 THEN 'Highly Competitive' WHEN h < 1500 THEN 'Competitive'
        WHEN h < 2500 THEN 'Moderately Concentrated' ELSE 'Highly Concentrated' END AS market_concentration_level
        FROM (SELECT RND(SUM(power(revenue_share_pct, 2)), 2) AS h FROM m_seller_performance)""",
    "seller_performance_10": """SELECT seller_id, seller_state, seller_revenue, seller_orders, seller_avg_review, seller_delivery_performance,
        positive_review_rate, revenue_rank, RND(seller_revenue / (SELECT MAX(seller_revenue) FROM m_seller_performance) * 0.4
            + seller_avg_review / 5.0 * 0.3 + seller_delivery_performance / 100.0 * 0.3, 3) AS balanced_score
        FROM m_seller_performance WHERE seller_total_reviews >= 10 ORDER BY balanced_score DESC, seller_id LIMIT 20""",
    # revenue_cohort
    "revenue_cohort_1": "SELECT * FROM cohort_totals",
    "revenue_cohort_2": """SELECT months_since_cohort, COUNT(DISTINCT cohort_month) AS cohorts_observed,
        RND(AVG(active_customer_rate) * 100, 2) AS avg_retention_rate_pct, AVGR(cumulative_revenue_per_customer, 2) AS avg_ltv,
        AVGR(monthly_revenue_per_cohort_customer, 2) AS avg_monthly_value FROM m_revenue_cohort WHERE months_since_cohort <= 12 GROUP BY 1""",
    "revenue_cohort_3": """SELECT order_month, COUNT(DISTINCT cohort_month) AS active_cohorts, MSUM(cohort_revenue) AS total_monthly_revenue,
        ISUM(active_customers) AS total_active_customers, RND(DIV(MSUM(cohort_revenue), SUM(active_customers)), 2) AS revenue_per_active_customer
        FROM m_revenue_cohort GROUP BY 1""",
    "revenue_cohort_4": "SELECT * FROM cohort_totals ORDER BY avg_ltv DESC, cohort_month LIMIT 10",
    "revenue_cohort_5": "SELECT cohort_month, " + ", ".join(
        f"MAX(CASE WHEN months_since_cohort = {k} THEN cohort_revenue ELSE 0 END) AS month_{k}_revenue" for k in (0, 1, 2, 3, 6, 12)
    ) + " FROM m_revenue_cohort GROUP BY 1",
    "revenue_cohort_6": """SELECT 'Total Cohorts' AS metric, CAST(COUNT(DISTINCT cohort_month) AS DOUBLE) AS value FROM m_revenue_cohort
        UNION ALL SELECT 'Average Cohort Size', AVGR(cohort_size, 0) FROM m_revenue_cohort
        UNION ALL SELECT 'Total Revenue Tracked', TOT(cohort_revenue) FROM m_revenue_cohort
        UNION ALL SELECT 'Max Months Tracked', CAST(MAX(months_since_cohort) AS DOUBLE) FROM m_revenue_cohort""",
    # payment_cohort
    "payment_cohort_1": """SELECT cohort_payment, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, AVGR(avg_order_value, 2) AS avg_aov,
        AVGR(order_frequency, 2) AS avg_orders_per_customer, RATE(is_repeat_customer = 1) AS retention_rate_pct FROM m_payment_cohort GROUP BY 1""",
    "payment_cohort_2": """SELECT migration_pattern, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, AVGR(order_frequency, 2) AS avg_orders,
        RND(AVG(payment_method_consistency) * 100, 2) AS avg_consistency_pct FROM m_payment_cohort GROUP BY 1""",
    "payment_cohort_3": """SELECT cohort_payment, AVGR(first_payment_installments, 2) AS avg_initial_installments,
        MEAN(first_purchase_value) AS avg_initial_order_value, AVGR(avg_installments_all_orders, 2) AS avg_lifetime_installments,
        AVGR(max_installments_used, 2) AS max_installments_used FROM m_payment_cohort GROUP BY 1""",
    "payment_cohort_4": """SELECT migration_path, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, AVGR(order_frequency, 2) AS avg_orders,
        AVGR(payment_method_diversity, 2) AS avg_method_diversity FROM m_payment_cohort WHERE has_payment_method_migration = 1
        GROUP BY 1 ORDER BY customer_count DESC, migration_path LIMIT 10""",
    "payment_cohort_5": """SELECT CASE WHEN payment_method_consistency = 1 THEN 'Always_Same_Method' WHEN payment_method_consistency >= 0.7
        THEN 'Mostly_Consistent' WHEN payment_method_consistency >= 0.4 THEN 'Mixed_Methods' ELSE 'Highly_Variable' END AS consistency_segment,
        COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, AVGR(order_frequency, 2) AS avg_orders, AVGR(avg_order_value, 2) AS avg_aov
        FROM m_payment_cohort GROUP BY 1""",
    "payment_cohort_6": """SELECT cohort_payment, customer_value_segment, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv,
        AVGR(order_frequency, 2) AS avg_orders, RATE(is_repeat_customer = 1) AS retention_rate_pct FROM m_payment_cohort GROUP BY 1, 2""",
    "payment_cohort_7": """SELECT cohort_payment, year(first_purchase_date) AS cohort_year, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv,
        AVGR(customer_lifetime_days, 1) AS avg_lifetime_days, AVGR(order_frequency, 2) AS avg_orders FROM m_payment_cohort GROUP BY 1, 2""",
    "payment_cohort_8": """SELECT cohort_payment, COUNT(*) AS total_customers, YES(customer_value_segment = 'High_Value') AS high_value_customers,
        RATE(customer_value_segment = 'High_Value') AS high_value_pct,
        MEAN(CASE WHEN customer_value_segment = 'High_Value' THEN total_revenue END) AS avg_high_value_ltv FROM m_payment_cohort GROUP BY 1""",
    # purchase_frequency
    "purchase_frequency_1": """SELECT frequency_bin, COUNT(*) AS customer_count, SHARE() AS pct_customers, TSHARE(total_revenue) AS pct_revenue,
        AVGR(num_orders, 2) AS avg_orders, MEAN(total_revenue) AS avg_revenue FROM m_purchase_frequency GROUP BY 1""",
    "purchase_frequency_2": """SELECT COUNT(*) AS one_time_buyers, RND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM m_purchase_frequency), 2) AS pct_one_time_buyers,
        MEAN(total_revenue) AS avg_one_time_revenue, AVGR(avg_order_value, 2) AS avg_one_time_order_value FROM m_purchase_frequency WHERE num_orders = 1""",
    "purchase_frequency_3": """SELECT pareto_segment, COUNT(*) AS customer_count, SHARE() AS pct_customers, TOT(total_revenue) AS total_revenue,
        TSHARE(total_revenue) AS pct_revenue, MEAN(total_revenue) AS avg_revenue_per_customer FROM m_purchase_frequency GROUP BY 1""",
    "purchase_frequency_4": "SELECT " + ", ".join(
        f"RND(MSUM(CASE WHEN cumulative_customer_pct <= {p} THEN total_revenue ELSE 0 END) * 100.0 / MSUM(total_revenue), 2) AS top_{p}_pct_revenue"
        for p in (20, 50, 80)) + " FROM m_purchase_frequency",
    "purchase_frequency_5": """SELECT frequency_bin, value_segment, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_revenue,
        AVGR(monthly_purchase_rate, 3) AS avg_monthly_frequency FROM m_purchase_frequency GROUP BY 1, 2""",
    "purchase_frequency_6": """SELECT frequency_bin, AVGR(customer_tenure_days, 1) AS avg_tenure_days, AVGR(num_orders, 2) AS avg_orders,
        AVGR(monthly_purchase_rate, 3) AS avg_monthly_rate FROM m_purchase_frequency GROUP BY 1""",
    "purchase_frequency_7": """SELECT COUNT(*) AS total_customers, COUNT(DISTINCT frequency_bin) AS unique_bins, MIN(num_orders) AS min_orders,
        MAX(num_orders) AS max_orders, AVGR(num_orders, 2) AS avg_orders_per_customer, TOT(total_revenue) AS total_revenue_analyzed FROM m_purchase_frequency""",
    # nps_cohort
    "nps_cohort_1": """SELECT COUNT(*) AS total_customers, YES(primary_nps_category = 'Promoter') AS promoters,
        YES(primary_nps_category = 'Passive') AS passives, YES(primary_nps_category = 'Detractor') AS detractors,
        RND(SUM(CASE primary_nps_category WHEN 'Promoter' THEN 1 WHEN 'Detractor' THEN -1 ELSE 0 END) * 100.0 / COUNT(*), 2) AS net_promoter_score
        FROM m_nps_cohort""",
    "nps_cohort_2": """SELECT primary_nps_category, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, AVGR(avg_order_value, 2) AS avg_aov,
        AVGR(total_orders, 2) AS avg_orders, RATE(is_repeat_customer) AS retention_rate FROM m_nps_cohort GROUP BY 1""",
    "nps_cohort_3": """SELECT first_order_nps_category, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, RATE(is_repeat_customer) AS retention_rate,
        AVGR(customer_lifespan_days, 1) AS avg_lifespan_days FROM m_nps_cohort GROUP BY 1""",
    "nps_cohort_4": """SELECT nps_journey, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, AVGR(avg_review_score, 2) AS avg_final_score,
        AVGR(total_orders, 2) AS avg_orders FROM m_nps_cohort WHERE nps_journey <> 'Stable' GROUP BY 1""",
    "nps_cohort_5": """SELECT nps_trend, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, AVGR(avg_review_score, 2) AS avg_score,
        RATE(is_repeat_customer) AS retention_rate FROM m_nps_cohort GROUP BY 1""",
    "nps_cohort_6": """SELECT primary_nps_category, COUNT(*) AS customers, TOT(total_revenue) AS total_revenue,
        RND(SUM(CAST(estimated_nps_impact_value AS DECIMAL(18,6))), 2) AS estimated_impact,
        AVGR(estimated_retention_probability, 3) AS avg_retention_prob FROM m_nps_cohort GROUP BY 1""",
    "nps_cohort_7": """SELECT nps_value_segment, COUNT(*) AS customer_count, MEAN(total_revenue) AS avg_ltv, AVGR(avg_review_score, 2) AS avg_score,
        RATE(is_recovered_detractor = 1) AS recovery_rate FROM m_nps_cohort GROUP BY 1""",
    # propensity_scores
    "propensity_scores_1": """SELECT COUNT(*) AS total_customers, COUNT(recency_days) AS has_recency, COUNT(frequency) AS has_frequency,
        COUNT(monetary) AS has_monetary, COUNT(avg_review_score) AS has_reviews, COUNT(top_category) AS has_category_affinity FROM m_propensity_scores""",
    "propensity_scores_2": """SELECT AVGR(recency_days, 1) AS avg_recency, AVGR(frequency, 1) AS avg_frequency, MEAN(monetary) AS avg_monetary,
        AVGR(avg_review_score, 2) AS avg_review, AVGR(unique_categories_purchased, 1) AS avg_category_diversity FROM m_propensity_scores""",
    "propensity_scores_3": """SELECT current_customer_status, COUNT(*) AS customers, MEAN(monetary) AS avg_ltv, AVGR(frequency, 1) AS avg_orders
        FROM m_propensity_scores GROUP BY 1""",
    "propensity_scores_4": """SELECT top_category, COUNT(*) AS customers, MEAN(monetary) AS avg_ltv FROM m_propensity_scores
        WHERE top_category IS NOT NULL GROUP BY 1 ORDER BY customers DESC, top_category LIMIT 10""",
    "propensity_scores_5": """SELECT first_payment_method, COUNT(*) AS customers, RATE(frequency > 1) AS repeat_rate,
        AVGR(first_order_review_score, 2) AS avg_first_review FROM m_propensity_scores WHERE first_payment_method IS NOT NULL GROUP BY 1""",
}
