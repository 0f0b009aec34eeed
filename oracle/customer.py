"""Customer marts."""

from oracle.core import AS_OF, relation

relation("m_customer_base", f"""
SELECT c.customer_id, c.customer_unique_id, c.customer_city, c.customer_state, c.customer_region,
    o.total_orders, o.delivered_orders, o.canceled_orders, o.first_purchase_date,
    o.last_purchase_date, DAYS(o.last_purchase_date, o.first_purchase_date) AS customer_lifespan_days,
    DAYS({AS_OF}, o.last_purchase_date) AS recency_days,
    COALESCE(p.revenue, 0) AS total_revenue, COALESCE(p.aov, 0) AS avg_order_value,
    COALESCE(p.hi, 0) AS max_order_value, COALESCE(p.lo, 0) AS min_order_value,
    p.method AS preferred_payment_method, COALESCE(p.inst, 0) AS avg_installments,
    COALESCE(r.n, 0) AS total_reviews, COALESCE(r.score, 0) AS avg_review_score,
    COALESCE(r.commented, 0) AS reviews_with_comment, COALESCE(r.pos, 0) AS positive_reviews,
    COALESCE(r.neg, 0) AS negative_reviews, COALESCE(o.days, 0) AS avg_delivery_days,
    o.late AS delayed_orders, COALESCE(o.late_days, 0) AS avg_delay_days,
    COALESCE(i.n, 0) AS total_items_purchased, COALESCE(i.price, 0) AS avg_item_price,
    COALESCE(i.freight, 0) AS total_freight_paid, COALESCE(i.avg_freight, 0) AS avg_freight_per_order,
    COALESCE(i.products, 0) AS unique_products_purchased,
    COALESCE(i.sellers, 0) AS unique_sellers_purchased_from,
    RND(DIV(COALESCE(p.revenue, 0), o.total_orders), 2) AS revenue_per_order,
    RND(DIV(COALESCE(i.n, 0), o.total_orders), 2) AS items_per_order,
    o.total_orders > 1 AS is_repeat_customer,
    DAYS({AS_OF}, o.last_purchase_date) > 180 AS is_churned,
    COALESCE(r.score, 0) >= 4 AS is_satisfied_customer,
    DIV(o.late, o.delivered_orders) > 0.3 AS has_delivery_issues
FROM s_customers c
JOIN (SELECT customer_id, COUNT(*) AS total_orders, YES(is_delivered) AS delivered_orders,
             YES(is_canceled) AS canceled_orders, MIN(order_purchase_timestamp) AS first_purchase_date,
             MAX(order_purchase_timestamp) AS last_purchase_date,
             AVG(DAYS(order_delivered_customer_date, order_purchase_timestamp)) AS days,
             YES(order_delivered_customer_date > order_estimated_delivery_date) AS late,
             AVG(CASE WHEN order_delivered_customer_date > order_estimated_delivery_date
                      THEN DAYS(order_delivered_customer_date, order_estimated_delivery_date)
                      WHEN order_delivered_customer_date IS NOT NULL THEN 0 END) AS late_days
      FROM s_orders GROUP BY customer_id) o USING (customer_id)
LEFT JOIN (SELECT customer_id, MSUM(payment_value) AS revenue, MAVG(payment_value) AS aov,
                  MAX(payment_value) AS hi, MIN(payment_value) AS lo,
                  last(payment_type ORDER BY payment_value, payment_type) AS method,
                  AVG(payment_installments) AS inst
           FROM s_payments JOIN s_orders USING (order_id) GROUP BY customer_id) p USING (customer_id)
LEFT JOIN (SELECT customer_id, COUNT(DISTINCT review_id) AS n, AVG(review_score) AS score,
                  YES(has_comment) AS commented, YES(review_score >= 4) AS pos,
                  YES(review_score <= 2) AS neg
           FROM s_reviews JOIN s_orders USING (order_id) GROUP BY customer_id) r USING (customer_id)
LEFT JOIN (SELECT customer_id, COUNT(*) AS n, MAVG(price) AS price, MSUM(freight_value) AS freight,
                  MAVG(freight_value) AS avg_freight, COUNT(DISTINCT product_id) AS products,
                  COUNT(DISTINCT seller_id) AS sellers
           FROM s_order_items JOIN s_orders USING (order_id) GROUP BY customer_id) i USING (customer_id)
""")

# Segment of an RFM code (fixed values); a code listed twice belongs to the first segment, as a CASE
# takes the first branch that holds.
_SEGMENT_CASE = """CASE
    WHEN code IN ('555', '554', '544', '545', '454', '455', '445') THEN 'Champions'
    WHEN code IN ('543', '444', '435', '355', '354', '345', '344', '335') THEN 'Loyal Customers'
    WHEN code IN ('553', '551', '552', '541', '542', '533', '532', '531') THEN 'Potential Loyalists'
    WHEN code IN ('512', '511', '422', '421', '412', '411', '311') THEN 'New Customers'
    WHEN code IN ('525', '524', '523', '522', '521', '515', '514', '513') THEN 'Promising'
    WHEN code IN ('535', '534', '443', '434', '343', '334', '325', '324') THEN 'Need Attention'
    WHEN code IN ('331', '321', '312', '221', '213', '231', '241', '251') THEN 'About to Sleep'
    WHEN code IN ('255', '254', '245', '244', '253', '252', '243', '242', '235', '234') THEN 'At Risk'
    WHEN code IN ('155', '154', '144', '214', '215', '115', '114', '113') THEN 'Can''t Lose Them'
    WHEN code IN ('332', '322', '231', '241', '335', '333', '323', '322') THEN 'Hibernating'
    WHEN code IN ('111', '112', '121', '131', '141', '151', '122', '132', '142', '152', '211', '212', '223') THEN 'Lost'
    END"""

relation("m_customer_rfm", f"""
SELECT customer_id, customer_state, customer_region, recency, frequency, monetary, r_score, f_score,
    m_score, code AS rfm_score, r_score + f_score + m_score AS rfm_total_score,
    {_SEGMENT_CASE.replace('END', "ELSE 'Other' END")} AS rfm_segment, avg_order_value, is_repeat_customer
FROM (SELECT *, concat(r_score, f_score, m_score) AS code FROM (
    SELECT customer_id, customer_state, customer_region, recency_days AS recency,
        total_orders AS frequency, total_revenue AS monetary, avg_order_value, is_repeat_customer,
        ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS r_score,
        ntile(5) OVER (ORDER BY total_orders, customer_id) AS f_score,
        ntile(5) OVER (ORDER BY total_revenue, customer_id) AS m_score
    FROM m_customer_base))""")

relation("ltv_customers", """
SELECT customer_id, MIN(order_purchase_timestamp) AS first_purchase_date,
    MAX(order_purchase_timestamp) AS last_purchase_date, COUNT(DISTINCT order_id) AS total_orders,
    MSUM(payment_value) AS revenue
FROM s_orders LEFT JOIN s_payments USING (order_id)
WHERE is_completed GROUP BY customer_id""")

relation("ltv_people", """
SELECT c.customer_id, c.customer_state, c.customer_city, c.customer_region,
    COALESCE(revenue, 0) AS total_revenue, total_orders, first_purchase_date, last_purchase_date,
    DAYS(last_purchase_date, first_purchase_date) AS customer_lifespan_days,
    RND(DIV(COALESCE(revenue, 0), total_orders), 2) AS avg_order_value,
    RND(DIV(total_orders, DAYS(last_purchase_date, first_purchase_date) / 30.0), 2) AS orders_per_month,
    CASE WHEN COALESCE(revenue, 0) >= RND((SELECT quantile_cont(revenue, 0.90) FROM ltv_customers JOIN s_customers USING (customer_id)), 6) THEN 'VIP'
         WHEN COALESCE(revenue, 0) >= RND((SELECT quantile_cont(revenue, 0.75) FROM ltv_customers JOIN s_customers USING (customer_id)), 6) THEN 'High'
         WHEN COALESCE(revenue, 0) >= RND((SELECT quantile_cont(revenue, 0.50) FROM ltv_customers JOIN s_customers USING (customer_id)), 6) THEN 'Medium'
         ELSE 'Low' END AS clv_segment,
    total_orders > 1 AS is_repeat_customer
FROM s_customers c JOIN ltv_customers USING (customer_id)""")

relation("m_customer_ltv", """
SELECT p.*, s.* EXCLUDE (customer_state, customer_region),
    RND(DIV(total_customers_state, total_revenue_state) * 100000, 2) AS customer_density_proxy
FROM ltv_people p JOIN (
    SELECT *, RND(total_revenue_state * 100.0 / SUM(total_revenue_state) OVER (), 2)
               AS revenue_concentration_pct,
           dense_rank() OVER (ORDER BY avg_ltv_state DESC) AS state_ltv_rank
    FROM (SELECT customer_state, customer_region, COUNT(*) AS total_customers_state,
                 RND(MAVG(total_revenue), 2) AS avg_ltv_state,
                 RND(quantile_disc(total_revenue, 0.5), 2) AS median_ltv_state,
                 RND(MSUM(total_revenue), 2) AS total_revenue_state,
                 RND(AVG(avg_order_value), 2) AS avg_aov_state,
                 RATE(is_repeat_customer) AS repurchase_rate_state
          FROM ltv_people GROUP BY customer_state, customer_region)) s
  ON p.customer_state = s.customer_state AND p.customer_region = s.customer_region""")

relation("m_customer_cohort_retention", """
WITH firsts AS (
    SELECT customer_id, MIN(order_purchase_timestamp) AS first_ts FROM s_orders
    WHERE is_completed GROUP BY customer_id),
sizes AS (
    SELECT strftime(first_ts, '%Y-%m') AS cohort_month, COUNT(*) AS cohort_size,
           MIN(first_ts) AS cohort_start_date FROM firsts GROUP BY 1),
spend AS (SELECT order_id, MSUM(payment_value) AS v FROM s_payments GROUP BY order_id),
cells AS (
    SELECT strftime(f.first_ts, '%Y-%m') AS cohort_month,
           MONTHS(o.order_purchase_timestamp, f.first_ts) AS months_since_first_purchase,
           COUNT(DISTINCT o.customer_id) AS retained_customers, MSUM(v) AS revenue, MAVG(v) AS per_order
    FROM s_orders o JOIN firsts f USING (customer_id) LEFT JOIN spend USING (order_id)
    WHERE o.is_completed GROUP BY 1, 2)
SELECT cohort_month, cohort_start_date, cohort_size, months_since_first_purchase,
    'M' || months_since_first_purchase AS month_label, retained_customers,
    RND(retained_customers * 100.0 / cohort_size, 2) AS retention_rate,
    RND(revenue, 2) AS cohort_revenue,
    SUM(CAST(ROUND(revenue * 100) AS BIGINT)) OVER (PARTITION BY cohort_month
        ORDER BY months_since_first_purchase) / 100.0 AS cumulative_revenue,
    RND(per_order, 2) AS avg_revenue_per_order,
    RND(revenue / cohort_size, 2) AS revenue_per_customer
FROM cells JOIN sizes USING (cohort_month)""")

relation("segment_features", """
SELECT b.customer_id, b.customer_state, b.customer_region, rfm_segment, clv_segment, recency,
    b.total_orders AS frequency, b.total_revenue AS monetary, r_score, f_score, m_score,
    b.avg_order_value, RND(DIV(total_items_purchased, b.total_orders), 2) AS avg_items_per_order,
    CASE WHEN b.total_orders > 1 THEN RND(DIV(b.customer_lifespan_days, b.total_orders - 1), 2) END
        AS avg_days_between_purchases,
    orders_per_month, b.customer_lifespan_days,
    COALESCE(preferred_category, 'unknown') AS preferred_category,
    COALESCE(category_diversity, 0) AS category_diversity,
    COALESCE(method, 'unknown') AS preferred_payment_method, COALESCE(inst, 0) AS avg_installments,
    COALESCE(weekend, 0) AS pct_weekend_shopper, COALESCE(night, 0) AS pct_night_shopper,
    b.avg_review_score, COALESCE(late, 0) AS pct_delayed_orders, total_freight_paid
FROM m_customer_base b JOIN m_customer_rfm r USING (customer_id) JOIN m_customer_ltv l USING (customer_id)
LEFT JOIN (SELECT customer_id, RATE(dayofweek(order_purchase_timestamp) IN (0, 6)) AS weekend,
                  RATE(hour(order_purchase_timestamp) >= 20 OR hour(order_purchase_timestamp) < 6) AS night
           FROM s_orders WHERE is_completed GROUP BY customer_id) t USING (customer_id)
LEFT JOIN (SELECT customer_id, last(product_category_name_english ORDER BY n, product_category_name_english)
                      AS preferred_category,
                  COUNT(DISTINCT product_category_name_english) AS category_diversity
           FROM (SELECT order_id, product_category_name_english, COUNT(*) AS n
                 FROM s_order_items JOIN s_products USING (product_id) GROUP BY 1, 2)
           JOIN s_orders USING (order_id) WHERE is_completed GROUP BY customer_id) k USING (customer_id)
LEFT JOIN (SELECT customer_id, last(payment_type ORDER BY n, payment_type) AS method,
                  RND(AVG(a), 2) AS inst
           FROM (SELECT order_id, payment_type, AVG(payment_installments) AS a, COUNT(*) AS n
                 FROM s_payments GROUP BY 1, 2)
           JOIN s_orders USING (order_id) WHERE is_completed GROUP BY customer_id) p USING (customer_id)
LEFT JOIN (SELECT customer_id, RATE(is_delayed) AS late FROM m_delivery_performance
           GROUP BY customer_id) d USING (customer_id)""")

relation("m_customer_segments", """
SELECT f.*, CASE
    WHEN rfm_segment IN ('Champions', 'Loyal Customers') AND monetary >= RND(q.m75, 6)
        THEN 'High Value Regulars'
    WHEN avg_order_value >= RND(q.a80, 6) AND frequency >= 2 THEN 'Premium Shoppers'
    WHEN avg_installments >= 6 AND avg_order_value < RND(q.a50, 6) THEN 'Bargain Hunters'
    WHEN category_diversity <= 2 AND frequency >= 3 THEN 'Category Focused'
    WHEN frequency = 1 AND recency <= 180 THEN 'Occasional Shoppers'
    WHEN pct_weekend_shopper >= 60 THEN 'Weekend Warriors'
    WHEN pct_night_shopper >= 50 THEN 'Night Owls'
    WHEN rfm_segment IN ('At Risk', 'Can''t Lose Them') AND monetary >= RND(q.m70, 6)
        THEN 'At Risk High Value'
    WHEN rfm_segment IN ('Hibernating', 'Lost') THEN 'Dormant'
    ELSE 'Standard Shoppers' END AS segment_name
FROM segment_features f, (SELECT quantile_cont(monetary, 0.75) AS m75, quantile_cont(monetary, 0.70) AS m70,
    quantile_cont(avg_order_value, 0.80) AS a80, quantile_cont(avg_order_value, 0.50) AS a50
    FROM segment_features) q""")

relation("m_customer_age", f"""
WITH aged AS (
    SELECT *, MONTHS({AS_OF}, first_purchase_date) AS m, DAYS({AS_OF}, first_purchase_date) AS d
    FROM m_customer_base),
per_bin AS (
    SELECT CASE WHEN m <= 3 THEN '0-3m' WHEN m <= 6 THEN '3-6m' WHEN m <= 12 THEN '6-12m'
                WHEN m <= 18 THEN '12-18m' WHEN m <= 24 THEN '18-24m' ELSE '24+m' END AS customer_age_bin,
        COUNT(*) AS customers_in_bin, RND(AVG(total_orders), 2) AS avg_orders_in_bin,
        RND(MAVG(total_revenue), 2) AS avg_revenue_in_bin, RND(AVG(avg_order_value), 2) AS avg_aov_in_bin,
        RATE(is_churned) AS churn_rate_bin, RATE(NOT is_churned) AS active_rate_bin,
        RATE(is_repeat_customer) AS repeat_rate_bin, RND(AVG(d), 1) AS avg_age_days_in_bin,
        RND(AVG(RND(d / 30.0, 0)), 1) AS avg_age_months_in_bin,
        ISUM(total_orders) AS n, MSUM(total_revenue) AS v, MAX(m) AS pos
    FROM aged GROUP BY 1)
SELECT * EXCLUDE (n, v, pos),
    RND(SUM(v) OVER life, 2) AS cumulative_revenue, CAST(SUM(n) OVER life AS BIGINT) AS cumulative_orders,
    CAST(SUM(customers_in_bin) OVER life AS BIGINT) AS cumulative_customers,
    customer_age_bin IN ('0-3m', '3-6m') AS is_honeymoon_period,
    customer_age_bin = '6-12m' AS is_danger_zone,
    customer_age_bin IN ('12-18m', '18-24m', '24+m') AS is_mature_period,
    RND(DIV(avg_orders_in_bin, avg_age_months_in_bin), 3) AS monthly_order_frequency,
    RND(DIV(avg_revenue_in_bin, avg_age_months_in_bin), 2) AS monthly_revenue_rate,
    dense_rank() OVER (ORDER BY avg_revenue_in_bin DESC) AS revenue_rank,
    dense_rank() OVER (ORDER BY avg_orders_in_bin DESC) AS orders_rank,
    dense_rank() OVER (ORDER BY churn_rate_bin) AS retention_rank,
    lag(avg_revenue_in_bin) OVER life AS prev_bin_revenue,
    RND(DIV(avg_revenue_in_bin - lag(avg_revenue_in_bin) OVER life, lag(avg_revenue_in_bin) OVER life) * 100, 2)
        AS revenue_growth_rate_pct
FROM per_bin WINDOW life AS (ORDER BY pos)""")

relation("churn_features", f"""
WITH done AS (SELECT * FROM s_orders WHERE is_completed),
spend AS (SELECT order_id, MSUM(payment_value) AS v FROM s_payments GROUP BY 1),
freight AS (SELECT order_id, MSUM(freight_value) AS f FROM s_order_items GROUP BY 1),
basics AS (
    SELECT customer_id, DAYS({AS_OF}, MAX(order_purchase_timestamp)) AS days_since_last_purchase,
        CAST(MIN(order_purchase_timestamp) AS DATE) AS first_purchase_date,
        CAST(MAX(order_purchase_timestamp) AS DATE) AS last_purchase_date,
        COUNT(*) AS total_orders, MSUM(v) AS total_spent, MAVG(v) AS avg_order_value,
        AVG(CASE WHEN DAYS(order_delivered_customer_date, order_estimated_delivery_date) > 0
                 THEN 1.0 ELSE 0.0 END) AS pct_delayed_orders,
        AVG(COALESCE(DAYS(order_delivered_customer_date, order_estimated_delivery_date), 0))
            AS avg_delivery_delay,
        COALESCE(AVG(review_score), 0) AS avg_review_score,
        MSUM(f) AS total_freight_paid, MAVG(f) AS avg_freight_per_order
    FROM done LEFT JOIN spend USING (order_id) LEFT JOIN freight USING (order_id)
    LEFT JOIN s_reviews USING (order_id) GROUP BY customer_id),
pays AS (
    SELECT customer_id, last(payment_type ORDER BY n, payment_type) AS preferred_payment_method,
        SUM(i) / SUM(n) AS avg_installments
    FROM (SELECT customer_id, payment_type, COUNT(*) AS n, SUM(payment_installments) AS i
          FROM s_payments JOIN done USING (order_id) GROUP BY 1, 2) GROUP BY 1),
tastes AS (
    SELECT customer_id, COUNT(*) AS c, last(cat ORDER BY n, cat) AS preferred_category
    FROM (SELECT customer_id, product_category_name_english AS cat, COUNT(*) AS n
          FROM s_order_items JOIN s_products USING (product_id) JOIN done USING (order_id)
          GROUP BY 1, 2) GROUP BY 1),
gaps AS (
    SELECT customer_id, AVG(g) AS mean,
        sqrt((COUNT(g) * CAST(SUM(g * g) AS DOUBLE) - CAST(SUM(g) AS DOUBLE) * CAST(SUM(g) AS DOUBLE))
             / NULLIF(COUNT(g) * (COUNT(g) - 1.0), 0)) AS sd
    FROM (SELECT customer_id, DAYS(order_purchase_timestamp, lag(order_purchase_timestamp) OVER
              (PARTITION BY customer_id ORDER BY order_purchase_timestamp, order_id)) AS g FROM done)
    WHERE g IS NOT NULL GROUP BY 1)
SELECT b.customer_id, customer_state, customer_region, days_since_last_purchase, first_purchase_date,
    last_purchase_date, DAYS(last_purchase_date, first_purchase_date) AS customer_lifespan_days,
    total_orders, COALESCE(mean, 0) AS avg_days_between_purchases,
    COALESCE(sd, 0) AS stddev_days_between_purchases, total_spent, b.avg_order_value,
    preferred_payment_method, avg_installments, pct_delayed_orders, avg_delivery_delay,
    b.avg_review_score, total_freight_paid, avg_freight_per_order,
    COALESCE(c, 0) AS num_categories_purchased, preferred_category, rfm_segment, rfm_score
FROM basics b LEFT JOIN s_customers USING (customer_id) LEFT JOIN pays USING (customer_id)
LEFT JOIN tastes USING (customer_id) LEFT JOIN gaps USING (customer_id)
LEFT JOIN (SELECT customer_id, rfm_segment, rfm_score FROM m_customer_rfm) USING (customer_id)""")


def _scale(c: str) -> str:
    return (f"(CAST({c} - MIN({c}) OVER () AS DOUBLE) / "
            f"NULLIF(CAST(MAX({c}) OVER () - MIN({c}) OVER () AS DOUBLE), 0) * 100)")


relation("m_churn_prediction", f"""
SELECT * EXCLUDE (risk), LNG(risk) AS churn_risk_score,
    CASE WHEN is_churned THEN 'Churned' WHEN risk >= 70 THEN 'High Risk'
         WHEN risk >= 40 THEN 'Medium Risk' ELSE 'Low Risk' END AS churn_risk_segment,
    RND(percent_rank() OVER (ORDER BY risk NULLS FIRST) * 100, 2) AS churn_risk_percentile_pct
FROM (SELECT *, CAST((100 - recency_score) * 0.40 + (100 - frequency_score) * 0.25
            + (100 - monetary_score) * 0.15 + pct_delayed_orders * 100 * 0.10
            + (100 - review_score_normalized) * 0.10 AS DECIMAL(18,8)) AS risk
FROM (SELECT *,
        CASE WHEN days_since_last_purchase = 0 THEN 100
             ELSE LNG(100 - {_scale('days_since_last_purchase')}) END AS recency_score,
        LNG({_scale('total_orders')}) AS frequency_score,
        LNG({_scale('total_spent')}) AS monetary_score,
        LNG(avg_review_score * 20) AS review_score_normalized,
        LNG({_scale('num_categories_purchased')}) AS category_diversity_score,
        days_since_last_purchase > 180 OR (avg_days_between_purchases > 0
            AND days_since_last_purchase > 2 * avg_days_between_purchases) AS is_churned,
        CASE WHEN avg_days_between_purchases > 0
             THEN GREATEST(180.0, 2 * avg_days_between_purchases) ELSE 180.0 END AS churn_threshold_days
      FROM churn_features))""")
