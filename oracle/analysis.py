"""Statements of the exploratory analyses, by query name."""

from oracle.core import AS_OF, relation

relation("del_fact", """
SELECT o.order_id, o.customer_id, customer_state, customer_city, order_purchase_timestamp, order_approved_at,
    order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date,
    DAYS(order_delivered_carrier_date, order_purchase_timestamp) AS days_to_carrier,
    DAYS(order_delivered_customer_date, order_delivered_carrier_date) AS days_in_transit,
    DAYS(order_delivered_customer_date, order_purchase_timestamp) AS total_delivery_days,
    DAYS(order_delivered_customer_date, order_estimated_delivery_date) AS delay_days,
    CASE WHEN DAYS(order_delivered_customer_date, order_estimated_delivery_date) <= 0 THEN 1 ELSE 0 END AS sla_compliant,
    CASE WHEN DAYS(order_delivered_customer_date, order_estimated_delivery_date) <= 0 THEN 'On Time'
         WHEN DAYS(order_delivered_customer_date, order_estimated_delivery_date) <= 5 THEN 'Slight Delay'
         WHEN DAYS(order_delivered_customer_date, order_estimated_delivery_date) <= 15 THEN 'Moderate Delay'
         ELSE 'Severe Delay' END AS delivery_status,
    review_score, review_comment_message, f AS freight_value, p AS item_price, DIV(f, p) AS freight_to_price_ratio,
    customer_region AS region
FROM s_orders o LEFT JOIN s_reviews r ON o.order_id = r.order_id LEFT JOIN s_customers c ON o.customer_id = c.customer_id
LEFT JOIN (SELECT order_id, MSUM(freight_value) AS f, MSUM(price) AS p FROM s_order_items GROUP BY 1) i ON o.order_id = i.order_id
WHERE order_status = 'delivered'""")

relation("del_filled", """
SELECT * REPLACE (
    COALESCE(CAST(review_score AS DOUBLE), (SELECT RND(quantile_cont(review_score, 0.5), 6) FROM del_fact)) AS review_score,
    COALESCE(freight_value, (SELECT RND(quantile_cont(freight_value, 0.5), 6) FROM del_fact)) AS freight_value)
FROM del_fact""")

relation("del_clean", """
SELECT * FROM del_filled WHERE total_delivery_days BETWEEN 1 AND 100 AND freight_value > 0 AND freight_value <= 200
    AND delay_days >= -30 AND order_delivered_customer_date >= order_purchase_timestamp""")

relation("del_features", """
SELECT order_id, customer_state, region, total_delivery_days, delay_days, sla_compliant, delivery_status, freight_value,
    item_price, review_score,
    CASE WHEN delay_days <= 0 THEN 'On Time' WHEN delay_days <= 5 THEN 'Slight Delay' WHEN delay_days <= 15
         THEN 'Moderate Delay' ELSE 'Severe Delay' END AS delay_category,
    dayname(order_purchase_timestamp) AS purchase_weekday, month(order_purchase_timestamp) AS purchase_month,
    strftime(order_purchase_timestamp, '%Y-%m') AS purchase_year_month,
    DIV(freight_value, total_delivery_days) AS freight_per_day,
    CASE WHEN freight_value > (SELECT RND(quantile_cont(freight_value, 0.75), 6) FROM del_clean) THEN 1 ELSE 0 END AS high_freight,
    CASE WHEN freight_value <= 10 THEN 'Low' WHEN freight_value <= 20 THEN 'Medium' WHEN freight_value <= 40 THEN 'High'
         ELSE 'Very High' END AS freight_category,
    CASE WHEN review_score >= 4 THEN 1 ELSE 0 END AS positive_review,
    CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS negative_review
FROM del_clean""")

relation("del_states", """
SELECT customer_state, COUNT(*) AS total_orders, AVGR(sla_compliant, 6) AS sla_compliant, AVGR(delay_days, 6) AS delay_days,
    AVGR(total_delivery_days, 6) AS total_delivery_days, RND(MAVG(freight_value), 6) AS avg_freight FROM del_clean GROUP BY 1""")


def _regional(d: int) -> str:
    return f"""SELECT region, COUNT(*) AS total_orders, AVGR(total_delivery_days, {d}) AS avg_delivery_days,
    AVGR(delay_days, {d}) AS avg_delay_days, AVGR(sla_compliant, {d}) AS sla_rate, RND(MAVG(freight_value), {d}) AS avg_freight,
    AVGR(review_score, {d}) AS avg_review_score FROM del_clean GROUP BY 1"""


relation("del_regions", _regional(6))

relation("coh_m3", """
SELECT cohort_month, cohort_size, retention_rate, retained_customers FROM m_customer_cohort_retention
WHERE months_since_first_purchase = 3""")

relation("coh_curve", """
SELECT months_since_first_purchase, AVGR(retention_rate, 6) AS avg_retention_rate,
    RND(stddev_samp(retention_rate), 6) AS std_retention_rate, COUNT(*) AS cohort_count
FROM m_customer_cohort_retention GROUP BY 1 HAVING COUNT(*) >= 3""")

relation("coh_drops", """
SELECT cohort_month, first(months_since_first_purchase ORDER BY ch, months_since_first_purchase) AS max_drop_month,
    MIN(ch) AS max_drop_value, MAX(cohort_size) AS initial_size
FROM (SELECT *, RND(retention_rate - lag(retention_rate) OVER (PARTITION BY cohort_month ORDER BY months_since_first_purchase), 2) AS ch
      FROM m_customer_cohort_retention) WHERE ch < 0 GROUP BY 1""")

relation("coh_best_worst", """
(SELECT *, 'Top 5' AS "group" FROM coh_m3 ORDER BY retention_rate DESC, cohort_month LIMIT 5)
UNION ALL (SELECT *, 'Bottom 5' AS "group" FROM coh_m3 ORDER BY retention_rate, cohort_month DESC LIMIT 5)""")

relation("coh_by_offset", """
SELECT months_since_first_purchase, MSUM(cohort_revenue) AS cohort_revenue, AVGR(revenue_per_customer, 6) AS revenue_per_customer,
    AVGR(retention_rate, 6) AS retention_rate, MEAN(cumulative_revenue) AS cumulative_revenue
FROM m_customer_cohort_retention GROUP BY 1""")

relation("coh_ltv", """
SELECT *, RND(AVG(avg_ltv) OVER (ORDER BY cohort_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS avg_ltv_ma3
FROM (SELECT cohort_month, cohort_size, MAX(cumulative_revenue) AS total_cumulative_revenue,
             MAX(retention_rate) FILTER (WHERE months_since_first_purchase = 3) AS m3_retention,
             RND(DIV(MAX(cumulative_revenue), cohort_size), 6) AS avg_ltv
      FROM m_customer_cohort_retention GROUP BY 1, 2)""")

relation("coh_ranked", """
SELECT *, CASE WHEN place >= 0.7 THEN 'High Performers' WHEN place >= 0.3 THEN 'Medium Performers'
               ELSE 'Low Performers' END AS cohort_group
FROM (SELECT *, RND((rank() OVER (ORDER BY retention_rate) + (COUNT(*) OVER (PARTITION BY retention_rate) - 1) / 2.0)
                    / COUNT(*) OVER (), 6) AS place FROM coh_m3)""")

relation("geo_opp", """
SELECT customer_state AS state_code, customer_region AS region, avg_ltv, total_customers, total_revenue, avg_aov AS avg_order_value,
    RND((MAX(avg_ltv) OVER (PARTITION BY customer_region) - avg_ltv) * total_customers, 6) AS revenue_opportunity,
    RND(DIV(MAX(avg_ltv) OVER (PARTITION BY customer_region) - avg_ltv, avg_ltv) * 100, 6) AS ltv_gap_pct
FROM m_geographic_performance""")

relation("geo_plan", """
SELECT state_code, region, avg_ltv, total_customers, total_revenue, revenue_opportunity,
    CASE WHEN total_customers >= RND(c3, 6) AND avg_ltv <= RND(v1, 6) THEN 'Optimization Needed'
         WHEN avg_ltv BETWEEN RND(v1, 6) AND RND(v3, 6) AND total_customers >= RND(c1, 6) THEN 'Growth Opportunities'
         ELSE 'Early Stage' END AS strategy_group
FROM geo_opp, (SELECT quantile_cont(total_customers, 0.25) AS c1, quantile_cont(total_customers, 0.75) AS c3,
    quantile_cont(avg_ltv, 0.25) AS v1, quantile_cont(avg_ltv, 0.75) AS v3 FROM geo_opp)""")

relation("pay_rows", """
SELECT p.order_id, payment_type, payment_installments, payment_value, v AS aov,
    CASE WHEN order_approved_at IS NULL THEN 0 ELSE 1 END AS approved, CASE WHEN is_delivered THEN 1 ELSE 0 END AS delivered,
    review_score, DAYS(order_approved_at, order_purchase_timestamp) AS approval_days, COALESCE(n, 0) AS total_items
FROM s_payments p JOIN s_orders o USING (order_id)
JOIN (SELECT order_id, MSUM(payment_value) AS v FROM s_payments GROUP BY 1) t ON p.order_id = t.order_id
LEFT JOIN s_reviews r ON p.order_id = r.order_id
LEFT JOIN (SELECT order_id, COUNT(*) AS n FROM s_order_items GROUP BY 1) i ON p.order_id = i.order_id""")

relation("months_only", "SELECT * FROM m_revenue_summary WHERE time_period = 'monthly'")

_FACTS = ("payment_installments", "payment_value", "aov", "review_score", "approval_days", "total_items")


def _pair(a: str, b: str) -> str:
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN"
    return (f"SELECT '{a}' AS measure, '{b}' AS other, RND(CORR2({both} CAST({a} AS DOUBLE) END, "
            f"{both} CAST({b} AS DOUBLE) END), 6) AS correlation FROM pay_rows")


def _unpivot(inner: str) -> str:
    return f"SELECT metric, value FROM (UNPIVOT ({inner}) ON COLUMNS(*) INTO NAME metric VALUE value)"


def _nulls(table: str, relation_name: str, columns: tuple[str, ...]) -> str:
    parts = ", ".join(
        f"RND(COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*), 4) AS pct_null_{c}" for c in columns)
    return f"SELECT 'stg_{table}' AS table_name, COUNT(*) AS total_rows, {parts} FROM {relation_name}"


def _keys(name: str, source: str, keys: str) -> str:
    return f"""SELECT '{name}' AS table_name, ISUM(n) AS total_rows, COUNT(*) AS distinct_keys, YES(n > 1) AS duplicated_keys,
    CAST(0 AS BIGINT) AS null_key_rows FROM (SELECT {keys}, COUNT(*) AS n FROM {source} GROUP BY {keys})"""


_BASE_COLUMNS = (
    "customer_id customer_unique_id customer_city customer_state customer_region total_orders delivered_orders "
    "canceled_orders first_purchase_date last_purchase_date customer_lifespan_days recency_days total_revenue "
    "avg_order_value max_order_value min_order_value preferred_payment_method avg_installments total_reviews "
    "avg_review_score reviews_with_comment positive_reviews negative_reviews avg_delivery_days delayed_orders "
    "avg_delay_days total_items_purchased avg_item_price total_freight_paid avg_freight_per_order "
    "unique_products_purchased unique_sellers_purchased_from revenue_per_order items_per_order is_repeat_customer "
    "is_churned is_satisfied_customer has_delivery_issues").split()


def _quantile(c: str, p: float, source: str) -> str:
    return f"(SELECT RND(quantile_cont({c}, {p}), 6) FROM {source})"


ANALYSIS_SQL = {
    # eda
    "eda_mart_summary": """SELECT COUNT(*) AS total_customers, COUNT(DISTINCT customer_id) AS unique_customers, MEAN(total_revenue) AS avg_revenue,
        AVGR(total_orders, 2) AS avg_orders, YES(is_repeat_customer) AS repeat_customers, RATE(is_repeat_customer) AS repeat_rate FROM m_customer_base""",
    "eda_rfm_segments": """SELECT rfm_segment, COUNT(*) AS customer_count, TOT(monetary) AS total_revenue, MEAN(monetary) AS avg_ltv
        FROM m_customer_rfm GROUP BY 1""",
    "eda_kpis": """SELECT COUNT(*) AS total_customers, MSUM(total_revenue) AS total_revenue, ISUM(total_orders) AS total_orders,
        AVGR(avg_order_value, 6) AS avg_order_value, RND(YES(is_repeat_customer) * 100.0 / COUNT(*), 6) AS repeat_rate,
        MAVG(total_revenue) AS avg_ltv FROM m_customer_base""",
    "eda_revenue_stats": """SELECT MSUM(total_revenue) AS total_revenue, MAVG(total_revenue) AS avg_monthly_revenue, MAX(total_revenue) AS peak_month_revenue,
        MIN(total_revenue) AS lowest_month_revenue, MSUM(new_customer_revenue) AS new_customer_revenue, MSUM(repeat_customer_revenue) AS repeat_customer_revenue,
        RND(MSUM(new_customer_revenue) * 100.0 / (MSUM(new_customer_revenue) + MSUM(repeat_customer_revenue)), 4) AS new_share_pct,
        RND(MSUM(repeat_customer_revenue) * 100.0 / (MSUM(new_customer_revenue) + MSUM(repeat_customer_revenue)), 4) AS repeat_share_pct FROM months_only""",
    "eda_ltv_stats": """SELECT COUNT(*) AS n, MAVG(total_revenue) AS mean, RND(stddev_samp(total_revenue), 6) AS std, MIN(total_revenue) AS min,
        MAX(total_revenue) AS max, """ + ", ".join(
        f"RND(quantile_cont(total_revenue, {p}), 6) AS {n}" for n, p in
        (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))) + " FROM m_customer_base",
    "eda_ltv_histogram": """WITH c AS (SELECT CAST(round(total_revenue * 100) AS BIGINT) AS c FROM m_customer_base), e AS (SELECT MIN(c) AS lo, MAX(c) AS hi FROM c)
        SELECT CAST(LEAST(COALESCE(floor(DIV(c - lo, (hi - lo) / 50.0)), 0), 49) AS BIGINT) AS bar, COUNT(*) AS customers,
        MIN(c) / 100.0 AS min_value, MAX(c) / 100.0 AS max_value FROM c, e GROUP BY 1""",
    "eda_order_frequency": "SELECT total_orders, COUNT(*) AS customers FROM m_customer_base GROUP BY 1 ORDER BY 1 LIMIT 10",
    "eda_buyer_types": """SELECT YES(total_orders = 1) AS one_time_buyers, RATE(total_orders = 1) AS one_time_pct, YES(total_orders > 1) AS repeat_buyers,
        RATE(total_orders > 1) AS repeat_pct FROM m_customer_base""",
    "eda_review_scores": """SELECT COUNT(*) AS reviewing_customers, AVGR(avg_review_score, 6) AS avg_score,
        RND(YES(avg_review_score >= 4) * 100.0 / COUNT(*), 4) AS pct_four_plus, RND(quantile_cont(avg_review_score, 0.5), 6) AS median_score
        FROM m_customer_base WHERE avg_review_score > 0""",
    "eda_top_states": """SELECT MSUM(v) AS top_5_revenue, (SELECT MSUM(total_revenue) FROM m_geographic_performance) AS total_revenue,
        RND(MSUM(v) * 100.0 / (SELECT MSUM(total_revenue) FROM m_geographic_performance), 4) AS top_5_pct
        FROM (SELECT total_revenue AS v FROM m_geographic_performance ORDER BY total_revenue DESC, customer_state LIMIT 5)""",
    "eda_region_stats": """SELECT customer_region, ISUM(total_customers) AS total_customers, TOT(total_revenue) AS total_revenue, AVGR(avg_ltv, 2) AS avg_ltv,
        AVGR(repurchase_rate, 2) AS repurchase_rate FROM m_geographic_performance GROUP BY 1""",
    "eda_category_share": """WITH b AS (SELECT category_revenue AS v, row_number() OVER (ORDER BY category_revenue DESC, category) AS k FROM m_category_performance)
        SELECT MSUM(CASE WHEN k <= 10 THEN v END) AS top_10_revenue, MSUM(v) AS listed_revenue,
        RND(MSUM(CASE WHEN k <= 10 THEN v END) * 100.0 / MSUM(v), 4) AS top_10_pct FROM b WHERE k <= 20""",
    "eda_null_counts": "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _BASE_COLUMNS) + " FROM m_customer_base",
    "eda_duplicate_keys": _keys("mart_customer_base", "m_customer_base", "customer_id"),
    "eda_ltv_outliers": """WITH q AS (SELECT RND(quantile_cont(total_revenue, 0.25), 6) AS a, RND(quantile_cont(total_revenue, 0.75), 6) AS b FROM m_customer_base)
        SELECT MAX(a) AS q1, MAX(b) AS q3, RND(MAX(a - CAST(1.5 AS DOUBLE) * (b - a)), 6) AS lower_fence, RND(MAX(b + CAST(1.5 AS DOUBLE) * (b - a)), 6) AS upper_fence,
        YES(total_revenue < a - 1.5 * (b - a) OR total_revenue > b + 1.5 * (b - a)) AS outliers FROM m_customer_base, q""",
    # cohorts
    "cohort_overview": """SELECT COUNT(*) FILTER (WHERE months_since_first_purchase = 0) AS total_cohorts,
        CAST(SUM(cohort_size) FILTER (WHERE months_since_first_purchase = 0) AS BIGINT) AS total_customers, MIN(cohort_month) AS first_cohort,
        MAX(cohort_month) AS last_cohort, RND(AVG(cohort_size) FILTER (WHERE months_since_first_purchase = 0), 2) AS avg_cohort_size
        FROM m_customer_cohort_retention""",
    "cohort_retention_pivot": "SELECT cohort_month, " + ", ".join(
        f"MAX(CASE WHEN months_since_first_purchase = {k} THEN retention_rate END) AS m{k}" for k in range(13)
    ) + " FROM m_customer_cohort_retention GROUP BY 1",
    "cohort_m3_summary": """SELECT AVGR(retention_rate, 2) AS avg_m3, MAX(retention_rate) AS best_m3, MIN(retention_rate) AS worst_m3,
        first(cohort_month ORDER BY retention_rate DESC, cohort_month) AS best_cohort, first(cohort_month ORDER BY retention_rate, cohort_month) AS worst_cohort,
        RND(MAX(retention_rate) - MIN(retention_rate), 2) AS variation FROM coh_m3""",
    "cohort_curve": "SELECT * FROM coh_curve",
    "cohort_decay_m1_m3": """SELECT a.avg_retention_rate AS m1, b.avg_retention_rate AS m3,
        RND(DIV(b.avg_retention_rate - a.avg_retention_rate, a.avg_retention_rate) * 100, 4) AS decay_pct FROM coh_curve a, coh_curve b
        WHERE a.months_since_first_purchase = 1 AND b.months_since_first_purchase = 3""",
    "cohort_dropoff": "SELECT * FROM coh_drops",
    "cohort_dropoff_by_month": """SELECT max_drop_month, COUNT(*) AS cohort_count, AVGR(max_drop_value, 6) AS avg_drop_value,
        ISUM(initial_size) AS total_customers_affected FROM coh_drops GROUP BY 1""",
    "cohort_stability": """WITH s AS (SELECT cohort_month, list(retention_rate ORDER BY months_since_first_purchase) AS r FROM m_customer_cohort_retention GROUP BY 1)
        SELECT cohort_month, r[1] AS initial_retention, r[2] AS m1_retention, r[4] AS m3_retention, r[7] AS m6_retention,
        RND(r[4] - r[2], 2) AS m1_to_m3_change, RND(r[7] - r[4], 2) AS m3_to_m6_change,
        len(list_filter(range(1, len(r)), lambda i: r[i + 1] < r[i])) > 0 AS has_any_drop FROM s WHERE len(r) > 1""",
    "cohort_natural_decay": """WITH a AS (SELECT months_since_first_purchase AS k, AVGR(retention_rate, 6) AS v FROM m_customer_cohort_retention GROUP BY 1)
        SELECT a.k AS from_month, b.k AS to_month, a.v AS avg_retention_from, b.v AS avg_retention_to,
        COALESCE(RND(DIV(b.v - a.v, a.v) * 100, 4), 0) AS decay_pct, RND(b.v - a.v, 6) AS absolute_change
        FROM a JOIN a b ON b.k = a.k + 1 WHERE a.k < 12""",
    "cohort_best_worst": "SELECT * FROM coh_best_worst",
    "cohort_gap": """SELECT t AS top_avg, b AS bottom_avg, tc AS top_customers, bc AS bottom_customers, RND(t - b, 6) AS retention_gap, tc - bc AS customer_gap
        FROM (SELECT RND(AVG(retention_rate) FILTER (WHERE "group" = 'Top 5'), 6) AS t, RND(AVG(retention_rate) FILTER (WHERE "group" = 'Bottom 5'), 6) AS b,
              CAST(SUM(retained_customers) FILTER (WHERE "group" = 'Top 5') AS BIGINT) AS tc,
              CAST(SUM(retained_customers) FILTER (WHERE "group" = 'Bottom 5') AS BIGINT) AS bc FROM coh_best_worst)""",
    "cohort_revenue_by_offset": "SELECT * FROM coh_by_offset",
    "cohort_revenue_split": """SELECT MSUM(cohort_revenue) AS total_revenue,
        RND(MSUM(CASE WHEN months_since_first_purchase = 0 THEN cohort_revenue END) * 100.0 / MSUM(cohort_revenue), 4) AS m0_pct,
        RND(MSUM(CASE WHEN months_since_first_purchase BETWEEN 1 AND 3 THEN cohort_revenue END) * 100.0 / MSUM(cohort_revenue), 4) AS m1_m3_pct,
        RND(MSUM(CASE WHEN months_since_first_purchase >= 4 THEN cohort_revenue END) * 100.0 / MSUM(cohort_revenue), 4) AS m4_plus_pct,
        RND(CORR2(revenue_per_customer, retention_rate), 6) AS revenue_retention_correlation FROM coh_by_offset""",
    "cohort_ltv": "SELECT * FROM coh_ltv",
    "cohort_correlations": """SELECT AVGR(avg_ltv, 6) AS avg_ltv_all, MAX(avg_ltv) AS max_ltv, MIN(avg_ltv) AS min_ltv, RND(CORR2(cohort_size, avg_ltv), 6) AS size_ltv_correlation,
        (SELECT RND(CORR2(m3_retention, avg_ltv), 6) FROM coh_ltv WHERE m3_retention IS NOT NULL) AS retention_ltv_correlation FROM coh_ltv""",
    "cohort_groups": """SELECT cohort_group, COUNT(*) AS cohort_count, ISUM(cohort_size) AS total_customers, AVGR(retention_rate, 4) AS avg_m3_retention,
        CASE cohort_group WHEN 'High Performers' THEN 'Maintain engagement, premium loyalty programs, referrals'
            WHEN 'Medium Performers' THEN 'Incentive campaigns, upsell, cross-sell, improved onboarding'
            ELSE 'Aggressive win-back, satisfaction survey, personalized offers, onboarding review' END AS action,
        CASE cohort_group WHEN 'High Performers' THEN 'Personalized email, App push, Ambassador program'
            WHEN 'Medium Performers' THEN 'Email marketing, SMS, Push notifications' ELSE 'Win-back email, Phone, NPS survey, Direct offers' END AS channel
        FROM coh_ranked GROUP BY cohort_group""",
    "cohort_low_performers": "SELECT cohort_month, cohort_size, retention_rate FROM coh_ranked WHERE cohort_group = 'Low Performers'",
    # delivery
    "delivery_fact": "SELECT * FROM del_fact",
    "delivery_cleaning": """WITH t AS (SELECT total_delivery_days BETWEEN 1 AND 100 AS a, COALESCE(freight_value > 0 AND freight_value <= 200, false) AS b, delay_days >= -30 AS c,
        order_delivered_customer_date >= order_purchase_timestamp AS d FROM del_filled)
        SELECT COUNT(*) AS initial_rows, YES(NOT a) AS removed_by_delivery_days, YES(a AND NOT b) AS removed_by_freight,
        YES(a AND b AND NOT c) AS removed_by_early, YES(a AND b AND c AND NOT d) AS removed_by_sequence, YES(a AND b AND c AND d) AS final_rows,
        RND(DIV(YES(a AND b AND c AND d), COUNT(*)) * 100, 4) AS retention_pct FROM t""",
    "delivery_features": "SELECT * FROM del_features",
    "delivery_kpis": """SELECT COUNT(*) AS total_orders, AVGR(sla_compliant, 6) AS sla_rate, AVGR(total_delivery_days, 6) AS avg_delivery_days,
        AVGR(CASE WHEN delay_days > 0 THEN delay_days END, 6) AS avg_delay_when_late, YES(delay_days > 0) AS delayed_orders,
        RND(YES(delay_days > 0) * 100.0 / COUNT(*), 4) AS delayed_pct, MAVG(freight_value) AS avg_freight, AVGR(review_score, 6) AS avg_review FROM del_clean""",
    "delivery_sla_by_region": "SELECT region, AVGR(sla_compliant, 6) AS sla_compliant FROM del_clean GROUP BY 1",
    "delivery_sla_by_month": "SELECT purchase_month, AVGR(sla_compliant, 6) AS sla_compliant FROM del_features GROUP BY 1",
    "delivery_status_share": "SELECT delivery_status, COUNT(*) AS orders, RND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) AS percentage FROM del_clean GROUP BY 1",
    "delivery_delay_stats": """SELECT AVGR(delay_days, 6) AS mean, RND(stddev_samp(delay_days), 6) AS std, MIN(delay_days) AS min, MAX(delay_days) AS max,
        RND(quantile_cont(delay_days, 0.5), 6) AS median FROM del_clean""",
    "delivery_regions": _regional(2),
    "delivery_region_highlights": """SELECT first(region ORDER BY sla_rate DESC, region) AS best_sla_region, first(region ORDER BY sla_rate, region) AS worst_sla_region,
        first(region ORDER BY avg_delivery_days DESC, region) AS longest_delivery_region FROM del_regions""",
    "delivery_state_delay": "SELECT customer_state, delay_days FROM del_states",
    "delivery_review_impact": """SELECT *, CASE WHEN abs(correlation) > 0.3 THEN 'strong' WHEN abs(correlation) > 0.1 THEN 'moderate' ELSE 'weak' END AS strength,
        CASE WHEN correlation < 0 THEN 'negative' ELSE 'positive' END AS direction, """ + ", ".join(
        f"RND(intercept + slope * {d}, 4) AS predicted_at_{d}" for d in (0, 5, 10, 15)) + """
        FROM (SELECT RND(CORR2(delay_days, review_score), 6) AS correlation, RND(regr_slope(review_score, delay_days), 6) AS slope,
              RND(regr_intercept(review_score, delay_days), 6) AS intercept, RND(regr_r2(review_score, delay_days), 6) AS r_squared FROM del_clean)""",
    "delivery_review_by_status": """SELECT delivery_status, AVGR(review_score, 6) AS review_score, RND(YES(review_score <= 2) * 100.0 / COUNT(*), 1) AS negative_review_pct
        FROM del_clean GROUP BY 1""",
    "delivery_freight_by_status": "SELECT delivery_status, RND(MAVG(freight_value), 6) AS avg_freight FROM del_clean GROUP BY 1",
    "delivery_sla_by_freight": "SELECT freight_category, COUNT(*) AS orders, AVGR(sla_compliant, 6) AS sla_compliant FROM del_features GROUP BY 1",
    "delivery_freight_roi": """SELECT *, RND(high_freight_sla - low_freight_sla, 6) AS sla_improvement, RND(high_freight_avg - low_freight_avg, 6) AS cost_difference,
        CASE WHEN RND(high_freight_sla - low_freight_sla, 6) > 0
             THEN RND(DIV(high_freight_avg - low_freight_avg, (high_freight_sla - low_freight_sla) * 100), 4) END AS cost_per_sla_point
        FROM (SELECT RND(CORR2(freight_value, total_delivery_days), 6) AS freight_time_correlation,
              AVGR(CASE WHEN high_freight = 1 THEN sla_compliant END, 6) AS high_freight_sla, AVGR(CASE WHEN high_freight = 0 THEN sla_compliant END, 6) AS low_freight_sla,
              RND(MAVG(CASE WHEN high_freight = 1 THEN freight_value END), 6) AS high_freight_avg,
              RND(MAVG(CASE WHEN high_freight = 0 THEN freight_value END), 6) AS low_freight_avg FROM del_features)""",
    "delivery_quadrants": f"""SELECT CASE WHEN freight_value > {_quantile('freight_value', 0.5, 'del_clean')} THEN 'High Cost, ' ELSE 'Low Cost, ' END
        || CASE WHEN sla_compliant > {_quantile('sla_compliant', 0.5, 'del_clean')} THEN 'High Performance' ELSE 'Low Performance' END AS quadrant,
        COUNT(*) AS orders, RND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) AS pct FROM del_clean GROUP BY 1""",
    "delivery_worst_sla_states": "SELECT * FROM del_states ORDER BY sla_compliant, customer_state LIMIT 10",
    "delivery_worst_delay_states": "SELECT customer_state, delay_days, sla_compliant FROM del_states ORDER BY delay_days DESC, customer_state LIMIT 10",
    "delivery_by_month": """SELECT purchase_month, COUNT(*) AS total_orders, AVGR(sla_compliant, 6) AS sla_compliant, AVGR(delay_days, 6) AS delay_days,
        RND(MAVG(freight_value), 6) AS avg_freight FROM del_features GROUP BY 1""",
    "delivery_by_weekday": """SELECT purchase_weekday, COUNT(*) AS total_orders, AVGR(sla_compliant, 6) AS sla_compliant, AVGR(delay_days, 6) AS delay_days
        FROM del_features GROUP BY 1""",
    "delivery_recommendations": """WITH r AS (SELECT first(region ORDER BY sla_rate, region) AS w, first(region ORDER BY sla_rate DESC, region) AS b, MIN(sla_rate) AS lo,
            MAX(sla_rate) AS hi FROM del_regions),
        f AS (SELECT freight_category AS c, AVGR(sla_compliant, 6) AS s FROM del_features GROUP BY 1),
        m AS (SELECT purchase_month AS k, AVGR(sla_compliant, 6) AS s FROM del_features GROUP BY 1)
        SELECT 'High' AS priority, 'Regional Logistics' AS area, printf('Focus on improving %s region logistics. Current SLA: %.1f%% vs Best region (%s): %.1f%%',
            w, lo * 100, b, hi * 100) AS recommendation, 'Improve SLA by 5-10% in worst performing region' AS expected_impact FROM r
        UNION ALL SELECT 'Medium', 'Freight Cost', 'Optimize freight to ' || first(c ORDER BY s DESC, c) || ' category range for best SLA compliance',
            'Better cost-performance ratio' FROM f
        UNION ALL SELECT 'High', 'Customer Experience', 'Implement expedited shipping for orders at risk of >15 day delays', 'Reduce negative reviews by 15-20%'
            FROM del_clean HAVING YES(delay_days > 15) * 100.0 / COUNT(*) > 5
        UNION ALL SELECT 'Medium', 'Seasonal Planning', 'Increase logistics capacity in month ' || first(k ORDER BY s, k), 'Smooth seasonal fluctuations'
            FROM m HAVING MIN(s) < AVGR(s, 6) * 0.9""",
    "delivery_delayed_orders": """SELECT order_id, customer_state, region, total_delivery_days, delay_days, delivery_status, freight_value, review_score
        FROM del_clean WHERE delay_days > 0""",
    "delivery_regional_summary": _regional(3),
    "delivery_improvement_priorities": "SELECT customer_state, sla_compliant, delay_days, total_orders FROM del_states ORDER BY sla_compliant, customer_state LIMIT 10",
    "delivery_key_metrics": _unpivot("""SELECT CAST(COUNT(*) AS DOUBLE) AS "Total Orders", AVGR(sla_compliant, 6) AS "SLA Compliance Rate",
        AVGR(total_delivery_days, 6) AS "Average Delivery Time (days)", COALESCE(AVGR(CASE WHEN delay_days > 0 THEN delay_days END, 6), 0.0) AS "Average Delay (days)",
        CAST(YES(delay_days > 0) AS DOUBLE) AS "Delayed Orders Count", RND(DIV(YES(delay_days > 0), COUNT(*)), 6) AS "Delayed Orders Percentage",
        RND(MAVG(freight_value), 6) AS "Average Freight Cost (R$)", AVGR(review_score, 6) AS "Average Review Score",
        RND(CORR2(delay_days, review_score), 6) AS "Delay-Review Correlation", RND(CORR2(freight_value, sla_compliant), 6) AS "Freight-SLA Correlation" FROM del_clean"""),
    # geography
    "geo_opportunity": "SELECT * FROM geo_opp",
    "geo_top_opportunities": """SELECT state_code, region, revenue_opportunity, ltv_gap_pct, avg_ltv, total_customers FROM geo_opp
        ORDER BY revenue_opportunity DESC, state_code LIMIT 20""",
    "geo_strategy": "SELECT * FROM geo_plan",
    "geo_strategy_actions": """SELECT state_code, strategy_group, avg_ltv AS current_ltv, total_customers, action_primary, primary_channel,
        per_head * total_customers AS budget_suggested, roi_expected, RND(factor * avg_ltv, 6) AS ltv_target
        FROM geo_plan JOIN (VALUES
            ('Early Stage', 'Test marketing channels, validate product-market fit', 'Pilot campaigns, Partnerships', 30, 15, 1.5),
            ('Growth Opportunities', 'Targeted marketing campaigns, improve onboarding', 'Social media, Search ads', 20, 40, 1.25),
            ('Optimization Needed', 'Cross-sell/upsell programs, improve retention', 'In-app messages, Retargeting', 15, 30, 1.2))
            AS a(g, action_primary, primary_channel, per_head, roi_expected, factor) ON g = strategy_group""",
    "geo_performance": """SELECT customer_state, customer_region, total_revenue, avg_ltv, repurchase_rate, revenue_concentration_pct, growth_potential, ltv_rank,
        revenue_rank FROM m_geographic_performance""",
    # payments
    "pay_method_summary": """SELECT payment_type, COUNT(*) AS order_count, RND(MAVG(payment_value), 3) AS avg_payment_value, MSUM(payment_value) AS total_payment_value,
        AVGR(payment_installments, 3) AS avg_installments, RND(MAVG(aov), 3) AS avg_aov, AVGR(approved, 3) AS approval_rate, AVGR(delivered, 3) AS delivery_rate,
        AVGR(review_score, 3) AS avg_review_score, RND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS order_share,
        RND(MSUM(payment_value) * 100.0 / SUM(MSUM(payment_value)) OVER (), 6) AS revenue_share FROM pay_rows GROUP BY 1""",
    "pay_funnel": """SELECT payment_type, n AS orders, a AS approved, d AS delivered, RND(DIV(a, n), 3) AS approval_rate, RND(DIV(d, n), 3) AS delivery_rate,
        RND(DIV(d, n), 3) AS conversion_rate, RND(1 - DIV(a, n), 3) AS drop_at_approval, RND(DIV(a - d, n), 3) AS drop_at_delivery
        FROM (SELECT payment_type, COUNT(*) AS n, ISUM(approved) AS a, ISUM(delivered) AS d FROM pay_rows GROUP BY 1)""",
    "pay_installments": """SELECT payment_installments, COUNT(*) AS order_count, RND(MAVG(payment_value), 3) AS payment_value, RND(MAVG(aov), 3) AS aov,
        AVGR(approved, 3) AS approved, AVGR(review_score, 3) AS review_score FROM pay_rows GROUP BY 1""",
    "pay_correlations": " UNION ALL ".join(_pair(a, b) for i, a in enumerate(_FACTS) for b in _FACTS[i:]),
    # finance
    "fin_revenue_trend": """SELECT revenue_date, total_revenue, new_customer_revenue, repeat_customer_revenue, total_orders, total_customers, avg_order_value,
        revenue_growth_mom_pct FROM months_only""",
    "fin_unit_economics": """SELECT segmentation_type, segment_name, num_customers, avg_ltv, avg_cac_proxy, avg_ltv_cac_ratio, avg_payback_months,
        avg_contribution_margin, avg_margin_pct, total_revenue FROM m_unit_economics""",
    "fin_profitability": """SELECT segmentation_type, segment_name, num_customers, avg_ltv_cac_ratio, CASE WHEN avg_ltv_cac_ratio >= 3 THEN 'Excellent'
        WHEN avg_ltv_cac_ratio >= 2 THEN 'Good' WHEN avg_ltv_cac_ratio >= 1 THEN 'Break Even' ELSE 'Loss' END AS profitability_category,
        avg_contribution_margin, total_revenue FROM m_unit_economics""",
    "fin_pl_proxy": _unpivot("""SELECT RND(g, 4) AS "Gross Revenue", RND(f, 4) AS "Total Freight", RND(g - f, 4) AS "Net Revenue", RND(g * 0.6, 4) AS "Variable Costs",
        RND(n * 50, 4) AS "CAC Total", RND(f * 0.8, 4) AS "Freight Cost", RND(g - f - g * 0.6 - n * 50, 4) AS "Contribution Margin",
        RND((g - f - g * 0.6 - n * 50) / g * 100, 4) AS "Margin %"
        FROM (SELECT SUM(round(avg_gross_revenue * 100) * num_customers) / 100.0 AS g, SUM(round(avg_total_freight * 100) * num_customers) / 100.0 AS f,
              CAST(SUM(num_customers) AS DOUBLE) AS n FROM m_unit_economics WHERE segmentation_type = 'RFM Segment')"""),
    "fin_summary": _unpivot("""SELECT TOT(total_revenue) AS "Total Revenue", MEAN(total_revenue) AS "Average Monthly Revenue",
        RND(last(revenue_growth_mom_pct ORDER BY revenue_date), 4) AS "Latest MoM Growth",
        (SELECT AVGR(avg_ltv, 4) FROM m_unit_economics) AS "Average LTV", (SELECT AVGR(avg_ltv_cac_ratio, 4) FROM m_unit_economics) AS "LTV/CAC Ratio",
        (SELECT AVGR(avg_payback_months, 4) FROM m_unit_economics) AS "Payback Period",
        (SELECT AVGR(avg_contribution_margin, 4) FROM m_unit_economics) AS "Contribution Margin",
        (SELECT AVGR(avg_margin_pct, 4) FROM m_unit_economics) AS "Margin Percentage",
        (SELECT CAST(YES(cumulative_revenue_pct <= 80) AS DOUBLE) FROM m_geographic_performance) AS "States with 80% Revenue" FROM months_only"""),
    "fin_growth_trend": """SELECT revenue_date, RND(revenue_growth_mom_pct, 6) AS revenue_growth_mom_pct,
        RND(AVG(revenue_growth_mom_pct) OVER (ORDER BY revenue_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS trailing_growth_pct FROM months_only""",
    # quality
    "dq_nulls_customers": _nulls("customers", "s_customers", ("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state", "customer_region")),
    "dq_nulls_sellers": _nulls("sellers", "s_sellers", ("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", "seller_region")),
    "dq_nulls_products": _nulls("products", "s_products", (
        "product_id", "product_category_name", "product_category_name_english", "product_name_lenght", "product_description_lenght", "product_photos_qty",
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")),
    "dq_nulls_orders": _nulls("orders", "s_orders", (
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date")),
    "dq_nulls_order_items": _nulls("order_items", "s_order_items", ("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value")),
    "dq_nulls_payments": _nulls("payments", "s_payments", ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value")),
    "dq_nulls_reviews": _nulls("reviews", "s_reviews", (
        "review_id", "order_id", "review_score", "review_comment_title", "review_comment_message", "review_creation_date", "review_answer_timestamp")),
    "dq_raw_keys_orders": _keys("orders", "orders", "o_orderkey"),
    "dq_raw_keys_order_items": _keys("order_items", "lineitem", "l_orderkey, l_linenumber"),
    "dq_raw_keys_payments": _keys("payments", "lineitem", "l_orderkey, l_linenumber"),
    "dq_orphan_items": """SELECT 'order_items.order_id' AS relation, COUNT(*) AS child_rows,
        YES(l_orderkey NOT IN (SELECT order_id FROM s_orders)) AS orphan_rows FROM lineitem""",
    "dq_orphan_customers": """SELECT 'orders.customer_id' AS relation, COUNT(*) AS child_rows,
        YES(customer_id NOT IN (SELECT customer_id FROM s_customers)) AS orphan_rows FROM s_orders""",
}

relation("churn_people", f"""
SELECT customer_id, customer_state, customer_region, total_orders, total_revenue, avg_order_value, customer_lifespan_days,
    first_purchase_date, last_purchase_date, DAYS({AS_OF}, last_purchase_date) AS recency,
    DAYS({AS_OF}, first_purchase_date) AS tenure_days, strftime(first_purchase_date, '%Y-%m') AS purchase_year_month,
    CASE WHEN month(first_purchase_date) IN (12, 1, 2) THEN 'Summer' WHEN month(first_purchase_date) <= 5 THEN 'Fall'
         WHEN month(first_purchase_date) <= 8 THEN 'Winter' ELSE 'Spring' END AS purchase_season,
    dayname(first_purchase_date) AS purchase_weekday,
    CASE WHEN avg_order_value < 50 THEN 'Low (<50)' WHEN avg_order_value < 150 THEN 'Medium (50-150)'
         WHEN avg_order_value < 300 THEN 'High (150-300)' ELSE 'Very High (>300)' END AS order_value_category,
    CASE WHEN avg_order_value < total_revenue * CAST(0.9 AS DOUBLE) THEN 'Below Average'
         WHEN avg_order_value > total_revenue * CAST(1.1 AS DOUBLE) THEN 'Above Average' ELSE 'Average' END AS value_vs_expected,
    CASE WHEN DAYS({AS_OF}, last_purchase_date) > 180 THEN 1 ELSE 0 END AS is_churned
FROM m_customer_ltv WHERE DAYS({AS_OF}, last_purchase_date) >= 0""")

relation("churn_feats", """
WITH s AS (SELECT RND(quantile_cont(total_revenue, 0.25), 6) AS q1, RND(quantile_cont(total_revenue, 0.75), 6) AS q3,
    RND(AVG(total_revenue), 8) AS mv, RND(stddev_samp(total_revenue), 8) AS sv, RND(AVG(recency), 8) AS mr, RND(stddev_samp(recency), 8) AS sr
    FROM churn_people)
SELECT p.*, RND(ln(1 + recency), 6) AS recency_log, RND(sqrt(recency), 6) AS recency_sqrt,
    CASE WHEN recency <= 30 THEN '0-30' WHEN recency <= 90 THEN '31-90' WHEN recency <= 180 THEN '91-180'
         WHEN recency <= 365 THEN '181-365' ELSE '365+' END AS recency_binned,
    RND(DIV(recency, 713), 6) AS time_churn_prob, RND(ln(1 + total_revenue), 6) AS revenue_log, RND(sqrt(total_revenue), 6) AS revenue_sqrt,
    CASE WHEN total_revenue <= q1 THEN 'Low' WHEN total_revenue <= q3 THEN 'Medium' ELSE 'High' END AS value_segment,
    CASE WHEN total_revenue > q3 THEN 1 ELSE 0 END AS is_high_value, CASE WHEN total_revenue < q1 THEN 1 ELSE 0 END AS is_low_value,
    RND(total_revenue / (recency + 1), 6) AS value_per_day, year(first_purchase_date) AS purchase_year, month(first_purchase_date) AS purchase_month,
    day(first_purchase_date) AS purchase_day, isodow(first_purchase_date) - 1 AS purchase_dayofweek, quarter(first_purchase_date) AS purchase_quarter,
    RND(sin(2 * pi() * month(first_purchase_date) / 12), 6) AS purchase_month_sin, RND(cos(2 * pi() * month(first_purchase_date) / 12), 6) AS purchase_month_cos,
    CASE WHEN isodow(first_purchase_date) >= 6 THEN 1 ELSE 0 END AS is_weekend_purchase,
    CASE WHEN day(first_purchase_date) >= 25 THEN 1 ELSE 0 END AS is_month_end, 0 AS is_big_state, 0 AS is_southeast,
    RND(total_revenue / (recency + 1), 6) AS value_time_ratio, RND(recency * total_revenue, 6) AS recency_value_interaction,
    RND(DIV(total_revenue, avg_order_value + CAST(0.01 AS DOUBLE)), 6) AS value_aov_ratio, RND((total_revenue - mv) / sv, 6) AS revenue_zscore,
    CASE WHEN abs((total_revenue - mv) / sv) > 3 THEN 1 ELSE 0 END AS is_revenue_outlier, RND((recency - mr) / sr, 6) AS recency_zscore
FROM churn_people p, s""")

relation("churn_parts", """
SELECT customer_id, is_churned,
    CASE WHEN row_number() OVER (PARTITION BY is_churned ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id)
              <= (2 * count(*) OVER (PARTITION BY is_churned) + 5) // 10 THEN 'test' ELSE 'train' END AS part
FROM churn_people""")

ANALYSIS_SQL.update({
    "churn_split_rows": "SELECT * FROM churn_parts",
    "churn_split": """SELECT part, COUNT(*) AS customers, RND(AVG(is_churned), 4) AS churn_rate FROM churn_parts GROUP BY part""",
    "churn_reference_dates": f"""SELECT CAST(MIN(first_purchase_date) AS DATE) AS min_purchase_date, CAST(MAX(last_purchase_date) AS DATE) AS max_purchase_date,
        COUNT(DISTINCT customer_id) AS total_customers, """ + ", ".join(
        f"AVGR(CASE WHEN DAYS({AS_OF}, last_purchase_date) > {d} THEN 1.0 ELSE 0.0 END, 6) AS churn_rate_{d}" for d in (90, 180, 365)) + " FROM m_customer_ltv",
    "churn_single_purchase": "SELECT * FROM churn_people WHERE total_orders = 1",
    "churn_features": "SELECT * FROM churn_feats",
    "churn_class_balance": "SELECT is_churned, COUNT(*) AS customers, SHARE() AS pct FROM churn_people GROUP BY 1",
    "churn_recency_crosstab": """SELECT bin AS recency_bin, RND(AVG(1.0 - is_churned), 3) AS share_kept, RND(AVG(is_churned), 3) AS share_lost
        FROM (SELECT is_churned, CASE """ + " ".join(
        f"WHEN recency <= {hi} THEN '({lo}, {hi}]'" for lo, hi in ((0, 30), (30, 60), (60, 90), (90, 120), (120, 150), (150, 180), (180, 365), (365, 713))
    ) + " END AS bin FROM churn_people WHERE recency BETWEEN 1 AND 713) GROUP BY bin",
})

relation("raw_items", """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
    l_shipdate AS shipping_limit_date, pc / 100.0 AS price, (pc * CAST(round(l_tax * 100) AS BIGINT) // 100) / 100.0 AS freight_value
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) // 500 AS pc FROM lineitem)""")

ANALYSIS_SQL.update({
    "prim_dedup": """SELECT * FROM raw_items QUALIFY row_number() OVER (PARTITION BY order_id, order_item_id
        ORDER BY shipping_limit_date, product_id, seller_id, price, freight_value) = 1""",
    "prim_top_value": "SELECT seller_id, last(product_id ORDER BY price, product_id) AS product_id FROM raw_items GROUP BY 1",
    "prim_mode": """SELECT customer_id, last(payment_type ORDER BY n, payment_type) AS method FROM (
        SELECT customer_id, payment_type, COUNT(*) AS n FROM s_payments JOIN s_orders USING (order_id) GROUP BY 1, 2) GROUP BY 1""",
    "prim_distinct_count": "SELECT seller_id, COUNT(DISTINCT product_id) AS products FROM raw_items GROUP BY 1",
    "prim_top_per_group": """SELECT customer_id, order_id, value FROM (SELECT order_id, MSUM(payment_value) AS value FROM s_payments GROUP BY 1)
        JOIN s_orders USING (order_id) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY value DESC, order_id) <= 3""",
    "prim_positions": """SELECT order_id, row_number() OVER w AS position, ntile(5) OVER w AS quintile,
        RND(row_number() OVER w * 100.0 / COUNT(*) OVER (), 6) AS pct
        FROM (SELECT order_id, CENTS(payment_value) AS v FROM s_payments GROUP BY 1) WINDOW w AS (ORDER BY v DESC, order_id)""",
    "prim_value_ranks": """SELECT DISTINCT payment_value, COUNT(*) OVER (PARTITION BY payment_value) AS payments,
        dense_rank() OVER w AS dense_rank, RND(percent_rank() OVER w, 6) AS percent_rank,
        SUM(CAST(round(payment_value * 100) AS BIGINT)) OVER w / 100.0 AS running_total FROM s_payments WINDOW w AS (ORDER BY payment_value)""",
    "prim_quantiles": "SELECT " + ", ".join(
        f"RND(quantile_cont(payment_value, {p}), 6) AS q{i}" for i, p in enumerate((0.5, 0.75, 0.9, 0.99))) + " FROM s_payments",
    "prim_sequence": """SELECT customer_id, order_id, row_number() OVER w AS seq,
        DAYS(order_purchase_timestamp, lag(order_purchase_timestamp) OVER w) AS gap FROM s_orders
        WINDOW w AS (PARTITION BY customer_id ORDER BY order_purchase_timestamp, order_id)""",
    "prim_correlation": "SELECT seller_id, RND(CORR2(price, freight_value), 6) AS price_freight, COUNT(*) AS items FROM s_order_items GROUP BY 1",
    "prim_sequence_check": """SELECT COUNT(*) AS lines, YES(DAYS(l_shipdate, o_orderdate) < 0) AS early_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "prim_dates": f"""SELECT o_orderkey AS order_id, CAST(date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE) AS week,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter,
        dayname(o_orderdate) AS weekday, dayofweek(o_orderdate) + 1 AS day_number, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS three_months_back,
        MONTHS({AS_OF}, o_orderdate) AS months_ago,
        CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Summer' WHEN month(o_orderdate) <= 5 THEN 'Fall' WHEN month(o_orderdate) <= 8 THEN 'Winter'
             ELSE 'Spring' END AS season FROM orders""",
    "prim_text": """SELECT c_custkey AS customer_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, lower(c_mktsegment) AS lower,
        upper(c_mktsegment) AS upper, c_mktsegment[1:3] AS prefix, c_mktsegment || ' → ' || state AS route
        FROM customer JOIN places ON c_nationkey = n_nationkey""",
    "prim_numbers": """SELECT order_id, order_item_id, RND(ln(1 + price), 6) AS log1p, RND(sqrt(price), 6) AS sqrt, RND(sin(price), 6) AS sin,
        RND(cos(price), 6) AS cos, RND(power(price, 2), 4) AS pow2, CAST(floor(price) AS BIGINT) AS floor, abs(freight_value - price) AS abs_gap,
        GREATEST(price, freight_value) AS greatest FROM s_order_items""",
    "prim_pivot": "SELECT payment_installments, " + ", ".join(
        f"COUNT(*) FILTER (WHERE payment_type = '{k}') AS {k}" for k in ("boleto", "credit_card", "debit_card", "voucher")) + " FROM s_payments GROUP BY 1",
    "prim_crosstab": "SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS month, " + ", ".join(
        f"RND(DIV(COUNT(*) FILTER (WHERE order_status = '{k}'), COUNT(*)), 6) AS {k}" for k in ("canceled", "delivered", "invoiced")) + " FROM s_orders GROUP BY 1",
    "prim_rolling": """SELECT month, orders, orders - lag(orders) OVER w AS change,
        RND(AVG(orders) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_3, CAST(SUM(orders) OVER w AS BIGINT) AS so_far
        FROM (SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS month, COUNT(*) AS orders FROM s_orders GROUP BY 1) WINDOW w AS (ORDER BY month)""",
    "prim_lookup": "SELECT customer_id, rfm_segment AS segment, 'Desconhecido' AS region FROM m_customer_rfm",
    "prim_night_share": """SELECT user_id, COUNT(*) AS events, RND(AVG(CASE WHEN hour(ts) >= 20 OR hour(ts) < 6 THEN 1 ELSE 0 END) * 100, 2) AS pct_night,
        RND(AVG(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END) * 100, 2) AS pct_weekend FROM events GROUP BY 1""",
})


# Candidates in their order, and those made from recency (the label's input), stated here.
CHURN_CANDIDATES = (
    "recency", "recency_sqrt", "time_churn_prob", "total_revenue", "revenue_log", "is_high_value",
    "is_low_value", "value_per_day", "purchase_year", "purchase_month", "purchase_dayofweek",
    "is_weekend_purchase", "purchase_season", "customer_state", "customer_region", "is_big_state",
    "revenue_zscore", "is_revenue_outlier", "value_time_ratio", "recency_value_interaction",
)
CHURN_MADE_FROM_RECENCY = ("recency", "recency_sqrt", "time_churn_prob", "value_per_day", "value_time_ratio",
                           "recency_value_interaction")
_TEXT = ("purchase_season", "customer_state", "customer_region")


def _selection_sql() -> str:
    numeric = [c for c in CHURN_CANDIDATES if c not in _TEXT and c not in CHURN_MADE_FROM_RECENCY]
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{a}' AS later, '{b}' AS earlier, corr({a}, {b}) AS r, "
        f"var_samp({a}) AS va, var_samp({b}) AS vb FROM churn_feats"
        for i, a in enumerate(numeric) for j, b in enumerate(numeric[:i]))
    marked = " OR ".join(f"contains({{0}}, '{t}')" for t in ("_log", "_sqrt", "zscore"))
    listed = ", ".join(f"('{c}', {k}, {str(c in CHURN_MADE_FROM_RECENCY).lower()})" for k, c in enumerate(CHURN_CANDIDATES))
    return f"""SELECT * FROM (WITH RECURSIVE pairs AS ({pairs}),
strong AS (
  SELECT row_number() OVER (ORDER BY i, j) AS step, later, earlier,
    CASE WHEN {marked.format('later')} THEN later WHEN {marked.format('earlier')} THEN earlier
         WHEN va < vb THEN later ELSE earlier END AS loser
  FROM pairs WHERE NOT isnan(r) AND abs(r) > 0.8
), walk(step, dropped) AS (
  SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT s.step, CASE WHEN list_contains(w.dropped, s.later) OR list_contains(w.dropped, s.earlier) THEN w.dropped
                      ELSE list_append(w.dropped, s.loser) END
  FROM walk w JOIN strong s ON s.step = w.step + 1
), final AS (SELECT dropped FROM walk ORDER BY step DESC LIMIT 1)
SELECT feature, NOT leaking AND NOT list_contains((SELECT dropped FROM final), feature) AS is_selected,
       leaking AS is_leaking
FROM (VALUES {listed}) t(feature, k, leaking))"""


relation("churn_selection", _selection_sql())
ANALYSIS_SQL["churn_selected_features"] = "SELECT * FROM churn_selection"


def _slots_sql() -> str:
    usable = [c for c in CHURN_CANDIDATES if c not in CHURN_MADE_FROM_RECENCY]
    listed = ", ".join(f"('{c}', {k}, {str(c in _TEXT).lower()})" for k, c in enumerate(CHURN_CANDIDATES))
    distinct = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS nd FROM churn_feats"
                                  for c in usable if c not in _TEXT)
    cats = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY {c}) AS r "
        f"FROM (SELECT DISTINCT {c} FROM churn_train WHERE {c} IS NOT NULL)" for c in usable)
    return f"""SELECT * FROM (WITH cand(feature, k, is_text) AS (VALUES {listed}),
sel AS (SELECT c.* FROM cand c JOIN churn_selection s ON s.feature = c.feature WHERE s.is_selected),
nd AS ({distinct}),
kinds AS (SELECT sel.*, is_text OR coalesce(nd.nd, 0) < 10 AS is_cat FROM sel LEFT JOIN nd ON sel.feature = nd.feature),
cats AS ({cats}),
slots AS (
  SELECT k * 1000 AS o, feature AS slot FROM kinds WHERE NOT is_cat
  UNION ALL SELECT 100000 + k * 1000 + r, kinds.feature || '_' || v FROM kinds JOIN cats ON kinds.feature = cats.feature
            WHERE is_cat AND r > 1
  UNION ALL SELECT 100000 + k * 1000 + 999, feature || '_unknown' FROM kinds WHERE is_cat)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, slot FROM slots)"""


relation("churn_train", """
SELECT f.* FROM churn_feats f JOIN churn_parts p ON f.customer_id = p.customer_id WHERE p.part = 'train'""")
ANALYSIS_SQL["churn_encoding_slots"] = _slots_sql()
