"""Advanced marts."""

from oracle.core import AS_OF, relation

relation("m_revenue_cohort", """
WITH f AS (
    SELECT customer_id, date_trunc('month', MIN(order_purchase_timestamp)) AS c0 FROM s_orders
    WHERE is_completed GROUP BY 1),
z AS (SELECT c0, COUNT(*) AS cohort_size FROM f GROUP BY 1),
c AS (
    SELECT c0, date_trunc('month', order_purchase_timestamp) AS m0, MSUM(payment_value) AS cohort_revenue,
        COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT o.customer_id) AS active_customers,
        MAVG(payment_value) AS avg_order_value
    FROM s_orders o JOIN s_payments USING (order_id) JOIN f ON o.customer_id = f.customer_id
    WHERE is_completed GROUP BY 1, 2),
r AS (
    SELECT c.*, cohort_size, MONTHS(m0, c0) AS months_since_cohort,
        SUM(CAST(round(cohort_revenue * 100) AS BIGINT)) OVER w / 100.0 AS cumulative_revenue,
        lag(cohort_revenue) OVER w AS previous_month_revenue
    FROM c JOIN z USING (c0) WINDOW w AS (PARTITION BY c0 ORDER BY m0)),
k AS (SELECT *, cumulative_revenue / cohort_size AS per_head FROM r)
SELECT CAST(c0 AS TIMESTAMP) AS cohort_month, CAST(m0 AS TIMESTAMP) AS order_month, months_since_cohort,
    cohort_size, cohort_revenue, cumulative_revenue, total_orders, active_customers, avg_order_value,
    cohort_revenue / active_customers AS revenue_per_active_customer,
    per_head AS cumulative_revenue_per_customer, active_customers / cohort_size AS active_customer_rate,
    cohort_revenue / cohort_size AS monthly_revenue_per_cohort_customer,
    CASE WHEN RND(per_head, 6) > RND((SELECT AVG(per_head) FROM k b WHERE b.months_since_cohort = k.months_since_cohort) * CAST(1.2 AS DOUBLE), 6)
         THEN 'High Performing'
         WHEN RND(per_head, 6) < RND((SELECT AVG(per_head) FROM k b WHERE b.months_since_cohort = k.months_since_cohort) * CAST(0.8 AS DOUBLE), 6)
         THEN 'Low Performing' ELSE 'Average Performing' END AS cohort_performance,
    previous_month_revenue,
    CASE WHEN previous_month_revenue > 0
         THEN (cohort_revenue - previous_month_revenue) / previous_month_revenue * 100 END AS revenue_growth_rate
FROM k""")

relation("customer_payments", """
SELECT o.customer_id, order_id, order_purchase_timestamp AS ts, payment_sequential AS seq, payment_type AS kind,
    payment_installments AS inst, payment_value AS v
FROM s_orders o JOIN s_payments USING (order_id) WHERE is_completed""")

relation("m_payment_cohort", f"""
WITH f AS (
    SELECT customer_id, kind AS kind0, inst AS inst0, ts AS ts0, v AS v0 FROM customer_payments
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ts, order_id, seq) = 1),
u AS (
    SELECT customer_id, last(kind ORDER BY n, kind) AS usual FROM
        (SELECT customer_id, kind, COUNT(*) AS n FROM customer_payments GROUP BY 1, 2) GROUP BY 1),
a AS (
    SELECT customer_id, COUNT(DISTINCT order_id) AS n, COUNT(DISTINCT kind) AS kinds,
        COUNT(DISTINCT CASE WHEN kind = kind0 THEN order_id END) AS same, AVG(inst) AS ai, MAX(inst) AS mi,
        MSUM(v) AS rev, MAVG(v) AS aov, MAX(v) AS hi, DAYS(MAX(ts), MIN(ts)) AS life
    FROM customer_payments JOIN f USING (customer_id) GROUP BY 1)
SELECT customer_id, ts0 AS first_purchase_date, kind0 AS cohort_payment, inst0 AS first_payment_installments,
    v0 AS first_purchase_value, n AS total_orders, kinds AS unique_payment_methods_used,
    CASE WHEN n > 1 THEN same / n ELSE 1 END AS payment_method_consistency,
    CASE WHEN n > 1 AND kinds > 1 THEN 1 ELSE 0 END AS has_payment_method_migration,
    usual AS most_frequent_payment_method, ai AS avg_installments_all_orders, mi AS max_installments_used,
    rev AS total_revenue, aov AS avg_order_value, hi AS max_order_value, life AS customer_lifetime_days,
    n AS order_frequency, CASE WHEN n > 1 THEN 1 ELSE 0 END AS is_repeat_customer, n - 1 AS repeat_order_count,
    CASE WHEN NOT (n > 1 AND kinds > 1) THEN 'No_Migration' WHEN usual <> kind0 THEN 'Changed_Primary_Method'
         ELSE 'Added_Secondary_Methods' END AS migration_pattern,
    CASE WHEN n > 1 AND kinds > 1 THEN kind0 || '_to_' || usual ELSE kind0 || '_stable' END AS migration_path,
    kinds AS payment_method_diversity, rev / n AS revenue_per_order,
    DIV(rev, DAYS({AS_OF}, ts0)) * 30 AS estimated_monthly_ltv,
    CASE WHEN rev > 1000 THEN 'High_Value' WHEN rev > 500 THEN 'Medium_Value' WHEN rev > 100 THEN 'Low_Value'
         ELSE 'Minimal_Value' END AS customer_value_segment
FROM a JOIN f USING (customer_id) JOIN u USING (customer_id)""")

relation("m_purchase_frequency", f"""
WITH a AS (
    SELECT customer_id, COUNT(DISTINCT order_id) AS num_orders, MSUM(v) AS total_revenue, MAVG(v) AS avg_order_value,
        MIN(ts) AS first_purchase_date, MAX(ts) AS last_purchase_date
    FROM customer_payments GROUP BY 1),
b AS (
    SELECT *, DAYS({AS_OF}, first_purchase_date) AS t,
        CASE WHEN num_orders = 1 THEN '1x' WHEN num_orders = 2 THEN '2x' WHEN num_orders <= 5 THEN '3-5x'
             WHEN num_orders <= 10 THEN '6-10x' ELSE '11+' END AS frequency_bin,
        (SUM(CAST(round(total_revenue * 100) AS BIGINT)) OVER (ORDER BY total_revenue DESC) / 100.0)
            / (SUM(CAST(round(total_revenue * 100) AS BIGINT)) OVER () / 100.0) AS cumulative_revenue_pct,
        row_number() OVER (ORDER BY total_revenue DESC, customer_id) * 100.0 / COUNT(*) OVER ()
            AS cumulative_customer_pct
    FROM a),
g AS (
    SELECT frequency_bin, COUNT(*) AS n, COUNT(*) * 100.0 / (SELECT COUNT(*) FROM a) AS pc,
        MSUM(total_revenue) * 100.0 / (SELECT MSUM(total_revenue) FROM a) AS pr,
        AVG(num_orders) AS ao, MAVG(total_revenue) AS ar
    FROM b GROUP BY 1)
SELECT customer_id, num_orders, frequency_bin, total_revenue, avg_order_value, first_purchase_date,
    last_purchase_date, t AS customer_tenure_days,
    CASE WHEN t > 0 THEN num_orders / (t / 30.0) ELSE num_orders END AS monthly_purchase_rate,
    n AS bin_customer_count, pc AS bin_pct_customers, pr AS bin_pct_revenue, ao AS bin_avg_orders,
    ar AS bin_avg_revenue, cumulative_revenue_pct, cumulative_customer_pct,
    CASE WHEN cumulative_revenue_pct <= 0.2 THEN 'Top_20%' WHEN cumulative_revenue_pct <= 0.5 THEN 'Next_30%'
         ELSE 'Bottom_50%' END AS pareto_segment,
    CAST(num_orders = 1 AS INT) AS is_one_time_buyer, CAST(num_orders >= 2 AS INT) AS is_repeat_customer,
    CAST(num_orders >= 6 AS INT) AS is_frequent_customer,
    CASE WHEN total_revenue > 1000 THEN 'VIP' WHEN total_revenue > 500 THEN 'High_Value'
         WHEN total_revenue > 200 THEN 'Medium_Value' ELSE 'Standard' END AS value_segment
FROM b JOIN g USING (frequency_bin)""")

_NPS = "CASE WHEN {0} >= 4 THEN 'Promoter' WHEN {0} = 3 THEN 'Passive' ELSE 'Detractor' END"

relation("m_nps_cohort", f"""
WITH v AS (
    SELECT customer_id, review_score AS s, order_purchase_timestamp AS ts, order_id,
        review_creation_date AS rd, review_id FROM s_orders JOIN s_reviews USING (order_id) WHERE is_completed),
a AS (
    SELECT customer_id, AVG(s) AS mean, COUNT(*) AS n, YES(s >= 4) AS p, YES(s = 3) AS q, YES(s <= 2) AS d,
        MAX(CASE WHEN s <= 2 THEN 1 ELSE 0 END) AS bad, MAX(CASE WHEN s = 5 THEN 1 ELSE 0 END) AS top,
        first(s ORDER BY ts, order_id) AS s0, MAX(s) - MIN(s) AS spread,
        last(s ORDER BY rd, review_id) - first(s ORDER BY rd, review_id) AS move
    FROM v GROUP BY 1),
k AS (
    SELECT *, CASE WHEN p > d AND p > q THEN 'Promoter' WHEN d > p AND d > q THEN 'Detractor'
                   ELSE 'Passive' END AS main, {_NPS.format('s0')} AS c0 FROM a)
SELECT customer_id, mean AS avg_review_score, n AS total_reviews, main AS primary_nps_category,
    bad AS has_negative_review, top AS has_positive_review, p AS promoter_reviews, q AS passive_reviews,
    d AS detractor_reviews, s0 AS first_order_review_score, c0 AS first_order_nps_category,
    CAST(s0 <= 2 AS INT) AS first_order_negative,
    CASE WHEN n < 2 THEN 'Single Review' WHEN move > 1 THEN 'Improving' WHEN move < -1 THEN 'Declining'
         ELSE 'Stable' END AS nps_trend,
    spread AS score_volatility, b.total_orders, b.total_revenue, b.avg_order_value, b.is_repeat_customer,
    b.customer_lifespan_days, b.recency_days, (p - d) * 100.0 / n AS customer_nps_score,
    CASE WHEN bad = 1 AND main = 'Promoter' THEN 1 ELSE 0 END AS is_recovered_detractor,
    CASE WHEN c0 = 'Detractor' AND main <> 'Detractor' THEN 'Detractor_to_' || main
         WHEN c0 = 'Promoter' AND main = 'Detractor' THEN 'Promoter_to_Detractor' ELSE 'Stable' END AS nps_journey,
    RND(b.total_revenue * CASE main WHEN 'Promoter' THEN 0.3 WHEN 'Passive' THEN 0.1 ELSE -0.2 END, 6)
        AS estimated_nps_impact_value,
    CAST(CASE main WHEN 'Promoter' THEN 0.7 WHEN 'Passive' THEN 0.4 ELSE 0.1 END AS DOUBLE)
        AS estimated_retention_probability,
    CASE WHEN main = 'Passive' THEN 'Neutral_Customer'
         WHEN main = 'Promoter' THEN CASE WHEN b.total_revenue > 500 THEN 'High_Value_Promoter' ELSE 'Standard_Promoter' END
         ELSE CASE WHEN b.total_revenue > 500 THEN 'At_Risk_High_Value' ELSE 'Standard_Detractor' END END
        AS nps_value_segment
FROM k LEFT JOIN m_customer_base b USING (customer_id)""")

relation("m_propensity_scores", f"""
WITH done AS (SELECT * FROM s_orders WHERE is_completed),
base AS (
    SELECT customer_id, MIN(ts) AS t0, MAX(ts) AS t1, COUNT(DISTINCT order_id) AS n, MSUM(v) AS m, AVG(inst) AS ai
    FROM customer_payments GROUP BY 1),
opening AS (
    SELECT customer_id, MSUM(CASE WHEN ts = first_ts THEN v ELSE 0 END) AS v0 FROM customer_payments
    JOIN (SELECT customer_id, MIN(order_purchase_timestamp) AS first_ts FROM done GROUP BY 1) USING (customer_id)
    GROUP BY 1),
rv AS (
    SELECT customer_id, AVG(review_score) AS a, COUNT(*) AS n FROM s_reviews
    JOIN done USING (order_id) WHERE order_id IN (SELECT order_id FROM s_payments) GROUP BY 1),
usual AS (
    SELECT customer_id, last(kind ORDER BY n, kind) AS method FROM
        (SELECT customer_id, kind, COUNT(*) AS n FROM customer_payments GROUP BY 1, 2) GROUP BY 1),
steps AS (
    SELECT *, row_number() OVER w AS x, DAYS(order_purchase_timestamp, MIN(order_purchase_timestamp)
            OVER (PARTITION BY customer_id)) AS y,
        DAYS(order_purchase_timestamp, lag(order_purchase_timestamp) OVER w) AS g
    FROM done WHERE order_delivered_customer_date IS NOT NULL
    WINDOW w AS (PARTITION BY customer_id ORDER BY order_purchase_timestamp, order_id)),
rhythm AS (
    SELECT customer_id, AVG(g) AS gap, CASE WHEN COUNT(*) >= 3 THEN RND(CORR2(x, y), 6) ELSE 0 END AS trend,
        AVG(DAYS(order_delivered_customer_date, order_purchase_timestamp)) AS days,
        YES(order_delivered_customer_date > order_estimated_delivery_date) AS late, COUNT(*) AS k
    FROM steps GROUP BY 1),
cats AS (
    SELECT customer_id, category, COUNT(*) AS l, COUNT(DISTINCT order_id) AS o FROM sold_items GROUP BY 1, 2),
taste AS (
    SELECT customer_id, COUNT(*) AS k, array_to_string(list_sort(list(category)), ',') AS names,
        last(category ORDER BY l, category) AS top, RND(SUM(power(o / total, 2)), 6) AS hhi
    FROM cats JOIN (SELECT customer_id, COUNT(*) AS total FROM done GROUP BY 1) USING (customer_id) GROUP BY 1),
firsts AS (
    SELECT i.customer_id, i.category AS cat0, review_score AS s0, p.kind AS kind0,
        DAYS(d.order_delivered_customer_date, d.order_purchase_timestamp) AS days0
    FROM sold_items i JOIN done d ON i.order_id = d.order_id JOIN customer_payments p ON p.order_id = i.order_id
    LEFT JOIN s_reviews r ON r.order_id = i.order_id
    QUALIFY row_number() OVER (PARTITION BY i.customer_id
        ORDER BY d.order_purchase_timestamp, i.order_id, i.order_item_id, p.seq) = 1)
SELECT customer_id, customer_unique_id, customer_state, customer_region, DAYS({AS_OF}, t1) AS recency_days,
    base.n AS frequency, m AS monetary, DAYS({AS_OF}, t0) AS customer_lifetime_days,
    DAYS({AS_OF}, t1) AS days_since_last_purchase, rv.a AS avg_review_score, COALESCE(rv.n, 0) AS total_reviews,
    method AS preferred_payment_method, ai AS avg_installments, gap AS avg_days_between_purchases,
    trend AS purchase_trend_correlation, days AS avg_delivery_days, late AS delayed_orders,
    rhythm.k AS total_orders_for_metrics, taste.k AS unique_categories_purchased, names AS purchased_categories,
    top AS top_category, hhi AS category_concentration_index, cat0 AS first_purchase_category,
    days0 AS first_order_delivery_days, s0 AS first_order_review_score, kind0 AS first_payment_method,
    v0 AS first_purchase_value, CAST(NULL AS DOUBLE) AS churn_probability, 'Unknown' AS churn_risk_segment,
    CAST(NULL AS DOUBLE) AS top_category_propensity_score, top AS next_best_category,
    CAST(NULL AS DOUBLE) AS loyalty_probability,
    CASE WHEN base.n = 1 THEN 'One-time Customer' ELSE 'Repeat Customer' END AS current_customer_status,
    'Monitor' AS campaign_timing, CAST({AS_OF} AS TIMESTAMP) AS score_calculation_date,
    'ML_MODEL_PLACEHOLDER' AS model_version
FROM s_customers JOIN base USING (customer_id) LEFT JOIN opening USING (customer_id) LEFT JOIN rv USING (customer_id)
LEFT JOIN usual USING (customer_id) LEFT JOIN rhythm USING (customer_id) LEFT JOIN taste USING (customer_id)
LEFT JOIN firsts USING (customer_id)""")

relation("cohort_totals", """
WITH g AS (
    SELECT cohort_month, cohort_size, MSUM(cohort_revenue) AS total_cohort_revenue,
        MAX(cumulative_revenue_per_customer) AS max_ltv, AVGR(cumulative_revenue_per_customer, 2) AS avg_ltv
    FROM m_revenue_cohort GROUP BY 1, 2)
SELECT g.*, CASE WHEN RND(DIV(total_cohort_revenue, cohort_size), 6) > t THEN 'Above Average'
    ELSE 'Below Average' END AS performance_category
FROM g, (SELECT AVGR(RND(DIV(total_cohort_revenue, cohort_size), 6), 6) AS t FROM g)""")
