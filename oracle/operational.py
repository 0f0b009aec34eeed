"""Operational marts."""

from oracle.core import AS_OF, relation

relation("sold_items", """
SELECT i.*, o.customer_id, o.order_purchase_timestamp, p.product_category_name_english AS category
FROM s_order_items i JOIN s_orders o USING (order_id) JOIN s_products p USING (product_id)
WHERE o.is_completed""")

relation("m_category_performance", """
WITH c AS (
    SELECT category, RND(MSUM(price), 2) AS category_revenue, COUNT(DISTINCT order_id) AS category_orders,
        COUNT(*) AS category_units, RND(MAVG(price), 2) AS avg_price_per_category,
        RND(MIN(price), 2) AS min_price, RND(MAX(price), 2) AS max_price,
        RND(MSUM(freight_value), 2) AS total_freight, RND(MAVG(freight_value), 2) AS avg_freight,
        RND(MSUM(price - freight_value), 2) AS category_margin,
        RND(AVG((price - freight_value) / NULLIF(price, 0)) * 100, 2) AS avg_margin_pct,
        COUNT(DISTINCT customer_id) AS unique_customers, COUNT(DISTINCT product_id) AS unique_products,
        MIN(order_purchase_timestamp) AS first_sale_date, MAX(order_purchase_timestamp) AS last_sale_date,
        COUNT(DISTINCT strftime(order_purchase_timestamp, '%Y-%m')) AS active_months
    FROM sold_items GROUP BY category),
recent AS (
    SELECT category, MSUM(CASE WHEN CAST(order_purchase_timestamp AS DATE) >= CAST(last_sale_date AS DATE) - INTERVAL 3 MONTH
                          THEN price ELSE 0 END) AS l3,
        MSUM(CASE WHEN CAST(order_purchase_timestamp AS DATE) >= CAST(last_sale_date AS DATE) - INTERVAL 6 MONTH
                   AND CAST(order_purchase_timestamp AS DATE) < CAST(last_sale_date AS DATE) - INTERVAL 3 MONTH
                  THEN price ELSE 0 END) AS p3
    FROM sold_items JOIN c USING (category) GROUP BY category),
rep AS (
    SELECT category, YES(n >= 2) AS repeaters, RATE(n >= 2) AS rate FROM
        (SELECT category, customer_id, COUNT(DISTINCT order_id) AS n FROM sold_items GROUP BY 1, 2)
    GROUP BY category),
crossed AS (
    SELECT category, YES(k > 1) AS many, RATE(k > 1) AS rate FROM
        (SELECT DISTINCT category, customer_id FROM sold_items)
        JOIN (SELECT customer_id, COUNT(DISTINCT category) AS k FROM sold_items GROUP BY 1) USING (customer_id)
    GROUP BY category)
SELECT c.*, RND(category_revenue * 100.0 / SUM(category_revenue) OVER (), 2) AS category_share,
    RND(SUM(category_revenue) OVER (ORDER BY category_revenue DESC) * 100.0 / SUM(category_revenue) OVER (), 2)
        AS cumulative_share,
    dense_rank() OVER (ORDER BY category_revenue DESC) AS revenue_rank,
    RND(l3, 2) AS revenue_last_3m, RND(p3, 2) AS revenue_prev_3m,
    CASE WHEN p3 > 0 THEN RND((l3 - p3) / p3 * 100, 2) END AS category_growth_pct,
    rep.rate AS repeat_purchase_rate_category, repeaters AS repeat_customers,
    crossed.rate AS cross_category_rate, many AS cross_category_customers,
    RND(DIV(category_revenue, unique_customers), 2) AS revenue_per_customer,
    RND(DIV(category_orders, unique_customers), 2) AS orders_per_customer,
    RND(DIV(category_units, category_orders), 2) AS units_per_order
FROM c JOIN recent USING (category) JOIN rep USING (category) JOIN crossed USING (category)""")

relation("m_delivery_performance", """
WITH t AS (
    SELECT *, DAYS(order_delivered_customer_date, order_purchase_timestamp) AS a,
        DAYS(order_estimated_delivery_date, order_purchase_timestamp) AS e
    FROM s_orders WHERE order_delivered_customer_date IS NOT NULL),
i AS (
    SELECT order_id, last(seller_id ORDER BY price, seller_id) AS seller_id, MSUM(freight_value) AS freight_value
    FROM s_order_items GROUP BY order_id)
SELECT t.order_id, t.customer_id, i.seller_id, order_purchase_timestamp, order_delivered_customer_date,
    order_estimated_delivery_date, customer_state, customer_city, seller_state, seller_city,
    seller_state || ' → ' || customer_state AS delivery_route,
    seller_state = customer_state AS is_same_state_delivery, a AS delivery_time_actual,
    e AS delivery_time_estimated, DAYS(order_delivered_carrier_date, order_purchase_timestamp) AS carrier_time,
    DAYS(order_delivered_customer_date, order_delivered_carrier_date) AS transit_time,
    a - e AS delivery_delay, a > e AS is_delayed,
    CASE WHEN a <= e THEN 'On Time' WHEN a - e <= 3 THEN '1-3 days late' WHEN a - e <= 7 THEN '4-7 days late'
         WHEN a - e <= 15 THEN '8-15 days late' ELSE '15+ days late' END AS delay_severity,
    abs(CAST(customer_zip_code_prefix AS BIGINT) - CAST(seller_zip_code_prefix AS BIGINT)) AS distance_proxy,
    freight_value, RND(DIV(freight_value, a), 2) AS freight_per_day, review_score
FROM t JOIN i USING (order_id) JOIN s_customers c ON t.customer_id = c.customer_id
JOIN s_sellers s ON i.seller_id = s.seller_id LEFT JOIN s_reviews r ON t.order_id = r.order_id""")

relation("paid_orders", """
SELECT order_id, is_completed, is_canceled, method, v, kinds, inst, parts,
    CASE WHEN inst = 1 THEN '1x' WHEN inst BETWEEN 2 AND 3 THEN '2-3x' WHEN inst BETWEEN 4 AND 6 THEN '4-6x'
         WHEN inst BETWEEN 7 AND 12 THEN '7-12x' WHEN inst >= 13 THEN '13+x' ELSE 'Unknown' END AS installment_bin
FROM s_orders JOIN (
    SELECT order_id, last(payment_type ORDER BY payment_value, payment_type) AS method,
        MSUM(payment_value) AS v, COUNT(DISTINCT payment_type) AS kinds,
        AVG(payment_installments) AS inst, MAX(payment_installments) AS parts
    FROM s_payments GROUP BY order_id) USING (order_id)""")

relation("m_payment_analysis", """
SELECT *, RND(total_orders * 100.0 / SUM(total_orders) OVER (), 2) AS order_share_pct,
    RND(total_revenue * 100.0 / SUM(total_revenue) OVER (), 2) AS revenue_share_pct,
    dense_rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank,
    RND(orders_with_multiple_methods * 100.0 / total_orders, 2) AS pct_multiple_methods
FROM (SELECT method AS payment_method_primary, COUNT(*) AS total_orders, YES(is_completed) AS successful_orders,
        YES(is_canceled) AS canceled_orders, RND(MSUM(v), 2) AS total_revenue,
        RND(MAVG(v), 2) AS avg_order_value, RND(MIN(v), 2) AS min_order_value, RND(MAX(v), 2) AS max_order_value,
        RND(AVG(inst), 2) AS avg_installments_per_method, CAST(MAX(parts) AS DOUBLE) AS max_installments_per_method,
        RATE(is_completed) AS conversion_rate, RATE(is_canceled) AS cancellation_rate,
        YES(kinds > 1) AS orders_with_multiple_methods
      FROM paid_orders GROUP BY method)""")

relation("m_installment_analysis", """
SELECT installment_bin, COUNT(*) AS total_orders, RND(MAVG(v), 2) AS avg_aov, RND(MSUM(v), 2) AS total_revenue,
    RATE(is_completed) AS conversion_rate
FROM paid_orders GROUP BY 1""")

relation("m_repeat_purchase", f"""
WITH q AS (
    SELECT customer_id, order_purchase_timestamp AS ts,
        row_number() OVER (PARTITION BY customer_id ORDER BY order_purchase_timestamp, order_id) AS k
    FROM s_orders WHERE is_completed),
c AS (SELECT customer_id, COUNT(*) AS n, MIN(ts) AS f, MAX(CASE WHEN k = 2 THEN ts END) AS s FROM q GROUP BY 1),
d AS (SELECT *, DAYS(s, f) AS g FROM c)
SELECT customer_id, n AS total_orders, n AS max_purchase_sequence, f AS first_purchase_date,
    s AS second_purchase_date, CAST(date_trunc('month', f) AS TIMESTAMP) AS cohort_month,
    g AS days_to_second_purchase, CAST(n >= 2 AS INT) AS has_second_purchase,
    CAST(n >= 2 AS INT) AS is_repeat_customer,
    CASE WHEN n = 1 THEN '1x' WHEN n = 2 THEN '2x' WHEN n <= 5 THEN '3-5x' WHEN n <= 10 THEN '6-10x'
         ELSE '11+' END AS purchase_frequency_bin,
    CASE WHEN n = 1 THEN 'no_second_purchase' WHEN g <= 30 THEN '0-30' WHEN g <= 60 THEN '31-60'
         WHEN g <= 90 THEN '61-90' WHEN g <= 180 THEN '91-180' ELSE '180+' END AS days_to_second_purchase_bin,
    CASE WHEN g <= 30 THEN 1 ELSE 0 END AS purchased_within_30_days,
    CASE WHEN g <= 60 THEN 1 ELSE 0 END AS purchased_within_60_days,
    CASE WHEN g <= 90 THEN 1 ELSE 0 END AS purchased_within_90_days,
    DAYS({AS_OF}, f) AS days_since_first_purchase, DAYS({AS_OF}, s) AS days_since_second_purchase
FROM d""")

relation("m_seller_performance", """
WITH sale AS (
    SELECT seller_id, RND(MSUM(price), 2) AS seller_revenue, COUNT(DISTINCT order_id) AS seller_orders,
        COUNT(*) AS seller_units, RND(MAVG(price), 2) AS seller_avg_price, RND(MIN(price), 2) AS seller_min_price,
        RND(MAX(price), 2) AS seller_max_price, RND(MAVG(freight_value), 2) AS seller_avg_freight,
        COUNT(DISTINCT product_id) AS seller_products_sold, MIN(order_purchase_timestamp) AS first_sale_date,
        MAX(order_purchase_timestamp) AS last_sale_date,
        COUNT(DISTINCT strftime(order_purchase_timestamp, '%Y-%m')) AS seller_active_months
    FROM sold_items GROUP BY seller_id),
cat AS (
    SELECT seller_id, COUNT(*) AS k, last(category ORDER BY n, category) AS top FROM
        (SELECT seller_id, category, COUNT(*) AS n FROM sold_items GROUP BY 1, 2) GROUP BY 1),
rev AS (
    SELECT seller_id, COUNT(DISTINCT review_id) AS n, RND(AVG(review_score), 2) AS a,
        YES(review_score >= 4) AS pos, YES(review_score <= 2) AS neg, RATE(review_score >= 4) AS rate
    FROM s_order_items JOIN s_reviews USING (order_id) GROUP BY 1),
dlv AS (
    SELECT i.seller_id, RATE(NOT is_delayed) AS sla, RND(AVG(delivery_time_actual), 1) AS days,
        RND(AVG(CASE WHEN is_delayed THEN delivery_delay END), 1) AS late
    FROM s_order_items i JOIN m_delivery_performance d ON i.order_id = d.order_id AND i.seller_id = d.seller_id
    GROUP BY 1),
ranked AS (
    SELECT sale.*, seller_state, seller_city, seller_region,
        RND(seller_revenue * 100.0 / SUM(seller_revenue) OVER (), 4) AS revenue_share_pct,
        RND(SUM(seller_revenue) OVER (ORDER BY seller_revenue DESC) * 100.0 / SUM(seller_revenue) OVER (), 2)
            AS cumulative_revenue_share,
        dense_rank() OVER (ORDER BY seller_revenue DESC) AS revenue_rank,
        dense_rank() OVER (ORDER BY seller_orders DESC) AS order_rank
    FROM sale JOIN s_sellers USING (seller_id))
SELECT ranked.*, COALESCE(k, 0) AS seller_categories, COALESCE(top, 'unknown') AS primary_category,
    COALESCE(n, 0) AS seller_total_reviews, COALESCE(a, 0) AS seller_avg_review,
    COALESCE(pos, 0) AS positive_reviews, COALESCE(neg, 0) AS negative_reviews,
    COALESCE(rate, 0) AS positive_review_rate, COALESCE(sla, 0) AS seller_delivery_performance,
    COALESCE(days, 0) AS avg_delivery_days, COALESCE(late, 0) AS avg_delay_when_late,
    RND(DIV(seller_revenue, seller_active_months), 2) AS revenue_per_month,
    RND(DIV(seller_orders, seller_active_months), 2) AS orders_per_month,
    RND(DIV(seller_units, seller_orders), 2) AS units_per_order,
    CASE WHEN revenue_rank <= 10 THEN 'Top 10 Seller' WHEN cumulative_revenue_share <= 20 THEN 'Top 20% Revenue'
         WHEN cumulative_revenue_share <= 50 THEN 'Top 50% Revenue'
         WHEN cumulative_revenue_share <= 80 THEN 'Top 80% Revenue' ELSE 'Bottom 20% Revenue' END AS seller_tier
FROM ranked LEFT JOIN cat USING (seller_id) LEFT JOIN rev USING (seller_id) LEFT JOIN dlv USING (seller_id)""")
