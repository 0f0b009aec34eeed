"""Financial marts."""

from oracle.core import relation

relation("order_spend", """
SELECT order_id, MSUM(payment_value) AS v, COUNT(*) AS pays, MAX(payment_installments) AS parts,
    list_sort(list(DISTINCT payment_type)) AS kinds, YES(is_credit_card) AS cards, YES(is_boleto) AS boletos
FROM s_payments GROUP BY order_id""")

relation("m_aov_analysis", """
WITH lines AS (
    SELECT order_id, COUNT(DISTINCT order_item_id) AS n, COUNT(DISTINCT product_id) AS prods,
           MSUM(freight_value) AS f FROM s_order_items GROUP BY order_id)
SELECT order_id, o.customer_id, customer_state, customer_city, v AS order_value,
    COALESCE(n, 0) AS items_per_order, COALESCE(prods, 0) AS unique_products_per_order,
    f AS total_freight_value, COALESCE(v / n, 0) AS avg_item_price,
    COALESCE(f / n, 0) AS avg_freight_per_item, f / v AS freight_to_value_ratio,
    CASE WHEN v < 50 THEN 'low' WHEN v <= 150 THEN 'medium' WHEN v <= 300 THEN 'high' ELSE 'premium' END
        AS value_bin,
    CASE WHEN n = 1 THEN 'single_item' WHEN n IN (2, 3) THEN 'few_items'
         WHEN n IN (4, 5, 6) THEN 'multiple_items' ELSE 'many_items' END AS items_bin,
    CASE WHEN len(kinds) > 1 THEN 'mixed' ELSE kinds[1] || '_only' END AS payment_method_segment,
    CASE WHEN parts = 1 THEN 'no_installments' WHEN parts <= 3 THEN 'few_installments'
         WHEN parts <= 6 THEN 'medium_installments' ELSE 'many_installments' END AS installments_segment,
    order_purchase_timestamp,
    CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS order_month,
    CAST(date_trunc('week', order_purchase_timestamp + INTERVAL 1 DAY) - INTERVAL 1 DAY AS TIMESTAMP) AS order_week,
    year(order_purchase_timestamp) AS order_year, quarter(order_purchase_timestamp) AS order_quarter,
    array_to_string(kinds, ',') AS payment_methods_used, parts AS max_installments,
    cards AS credit_card_payments, boletos AS boleto_payments,
    CASE WHEN v > 1000 THEN 1 ELSE 0 END AS is_high_value_order,
    CASE WHEN n > 5 THEN 1 ELSE 0 END AS is_high_item_count_order,
    CASE WHEN f / v > 0.3 THEN 1 ELSE 0 END AS has_high_freight_ratio,
    row_number() OVER (PARTITION BY o.customer_id ORDER BY order_purchase_timestamp, order_id)
        AS customer_order_sequence
FROM s_orders o JOIN order_spend USING (order_id) LEFT JOIN lines USING (order_id)
LEFT JOIN s_customers c ON o.customer_id = c.customer_id
WHERE is_completed AND v > 0""")

relation("m_geographic_performance", """
WITH g AS (
    SELECT customer_state, customer_region, COUNT(DISTINCT customer_id) AS total_customers,
        YES(is_repeat_customer) AS repeat_customers, RND(MSUM(total_revenue), 2) AS total_revenue,
        RND(MAVG(total_revenue), 2) AS avg_ltv, RND(quantile_disc(total_revenue, 0.5), 2) AS median_ltv,
        RND(MAX(total_revenue), 2) AS max_ltv, RND(MIN(total_revenue), 2) AS min_ltv,
        ISUM(total_orders) AS total_orders, RND(AVG(total_orders), 2) AS avg_orders_per_customer,
        RND(AVG(avg_order_value), 2) AS avg_aov, RATE(is_repeat_customer) AS repurchase_rate,
        RND(AVG(customer_lifespan_days), 2) AS avg_customer_lifespan_days,
        RND(AVG(orders_per_month), 2) AS avg_orders_per_month
    FROM m_customer_ltv GROUP BY 1, 2),
r AS (
    SELECT *, RND(total_revenue * 100.0 / SUM(total_revenue) OVER (), 2) AS revenue_concentration_pct,
        RND(SUM(total_revenue) OVER (ORDER BY total_revenue DESC) * 100.0 / SUM(total_revenue) OVER (), 2)
            AS cumulative_revenue_pct,
        RND(total_customers * 100.0 / SUM(total_customers) OVER (), 2) AS customer_concentration_pct,
        dense_rank() OVER (ORDER BY avg_ltv DESC) AS ltv_rank,
        dense_rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank,
        dense_rank() OVER (ORDER BY total_customers DESC) AS customer_rank,
        dense_rank() OVER (ORDER BY repurchase_rate DESC) AS repurchase_rank,
        RND(DIV(total_customers, total_revenue / 1000000.0), 2) AS customers_per_million_revenue,
        RND(DIV(total_revenue, total_customers), 2) AS revenue_per_customer,
        avg_ltv >= RND(AVG(avg_ltv) OVER (), 6) AS rich
    FROM g)
SELECT * EXCLUDE (rich),
    CASE WHEN revenue_concentration_pct >= 10 THEN 'High Penetration'
         WHEN revenue_concentration_pct >= 5 THEN 'Medium Penetration'
         WHEN revenue_concentration_pct >= 2 THEN 'Low Penetration' ELSE 'Very Low Penetration' END
        AS market_penetration_category,
    CASE WHEN repurchase_rate >= 15 AND rich THEN 'High Potential'
         WHEN repurchase_rate >= 10 OR rich THEN 'Medium Potential' ELSE 'Low Potential' END AS growth_potential
FROM r""")

relation("period_rows", """
SELECT order_id, o.customer_id, payment_value, CAST(order_purchase_timestamp AS DATE) AS d,
    CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS m,
    CAST(date_trunc('week', order_purchase_timestamp + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE) AS w,
    date_trunc('month', order_purchase_timestamp) =
        (SELECT date_trunc('month', MIN(order_purchase_timestamp)) FROM s_orders f
         WHERE f.is_completed AND f.customer_id = o.customer_id) AS fresh
FROM s_orders o JOIN s_payments USING (order_id) WHERE is_completed""")


def _grain(column: str, label: str) -> str:
    return f"""SELECT {column} AS revenue_date, '{label}' AS time_period,
    COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT customer_id) AS total_customers,
    COUNT(DISTINCT CASE WHEN fresh THEN customer_id END) AS new_customers,
    COUNT(DISTINCT CASE WHEN NOT fresh THEN customer_id END) AS repeat_customers,
    MSUM(payment_value) AS total_revenue,
    MSUM(CASE WHEN fresh THEN payment_value ELSE 0 END) AS new_customer_revenue,
    MSUM(CASE WHEN fresh THEN 0 ELSE payment_value END) AS repeat_customer_revenue,
    MAVG(payment_value) AS avg_order_value FROM period_rows GROUP BY {column}"""


relation("m_revenue_summary", f"""
WITH p AS ({_grain('d', 'daily')} UNION ALL {_grain('w', 'weekly')} UNION ALL {_grain('m', 'monthly')}),
g AS (SELECT *,
    SUM(CAST(round(total_revenue * 100) AS BIGINT)) OVER (PARTITION BY time_period ORDER BY revenue_date) / 100.0
        AS cumulative_revenue,
    CASE WHEN time_period = 'monthly' THEN lag(total_revenue) OVER
        (PARTITION BY time_period ORDER BY revenue_date) END AS previous_period_revenue,
    CASE WHEN time_period = 'monthly' THEN lag(total_revenue, 12) OVER
        (PARTITION BY time_period ORDER BY revenue_date) END AS previous_year_revenue FROM p)
SELECT *, DIV(total_revenue - previous_period_revenue, previous_period_revenue) * 100 AS revenue_growth_mom_pct,
    DIV(total_revenue - previous_year_revenue, previous_year_revenue) * 100 AS revenue_growth_yoy_pct,
    DIV(repeat_customers, total_customers) * 100 AS repeat_customer_rate,
    DIV(repeat_customer_revenue, total_revenue) * 100 AS repeat_revenue_rate,
    DIV(total_revenue, total_customers) AS revenue_per_customer,
    DIV(new_customer_revenue, new_customers) AS revenue_per_new_customer,
    DIV(repeat_customer_revenue, repeat_customers) AS revenue_per_repeat_customer,
    total_revenue > 10000 AS is_high_revenue_day,
    DIV(total_revenue - previous_period_revenue, previous_period_revenue) * 100 > 0 AS is_positive_growth,
    DIV(repeat_customer_revenue, total_revenue) > 0.3 AS has_high_repeat_rate
FROM g""")

relation("unit_customers", """
WITH e AS (
    SELECT customer_id, MSUM(price) AS gross, MSUM(freight_value) AS freight,
        CAST(SUM(CAST(round(price * 100) AS BIGINT) - CAST(round(freight_value * 100) AS BIGINT)) AS BIGINT) / 100.0 AS net,
        RND(AVG((price - freight_value) / NULLIF(price, 0)) * 100, 2) AS margin
    FROM s_order_items JOIN s_orders USING (order_id) WHERE is_completed GROUP BY 1),
j AS (SELECT l.*, rfm_segment, COALESCE(gross, 0) AS gross, COALESCE(freight, 0) AS freight,
             COALESCE(net, 0) AS net, COALESCE(margin, 0) AS margin,
             RND(customer_lifespan_days / 30.0, 2) AS months
      FROM m_customer_ltv l JOIN (SELECT customer_id, rfm_segment FROM m_customer_rfm) USING (customer_id)
      LEFT JOIN e USING (customer_id))
SELECT *, RND(total_revenue / 50.0, 2) AS ltv_cac,
    RND(CASE WHEN months > 0 THEN total_revenue / months ELSE total_revenue END, 2) AS monthly,
    CASE WHEN months > 0 THEN RND(DIV(50.0, total_revenue / months), 2) END AS payback,
    RND(net - 50.0, 2) AS contribution,
    year(first_purchase_date) || '-Q' || quarter(first_purchase_date) AS cohort
FROM j""")


def _segments(kind: str, name: str, region: str) -> str:
    return f"""SELECT '{kind}' AS segmentation_type, {name} AS segment_name,
    CAST({region} AS VARCHAR) AS segment_region, COUNT(*) AS num_customers,
    RND(MAVG(total_revenue), 2) AS avg_ltv, RND(MSUM(total_revenue), 2) AS total_revenue,
    RND(AVG(total_orders), 2) AS avg_orders, RND(AVG(avg_order_value), 2) AS avg_aov,
    RND(MAVG(gross), 2) AS avg_gross_revenue, RND(MAVG(freight), 2) AS avg_total_freight,
    RND(MAVG(net), 2) AS avg_net_revenue, RND(AVG(margin), 2) AS avg_margin_pct,
    CAST(50 AS DOUBLE) AS avg_cac_proxy, RND(AVG(ltv_cac), 2) AS avg_ltv_cac_ratio,
    RND(AVG(payback), 2) AS avg_payback_months, RND(AVG(contribution), 2) AS avg_contribution_margin,
    RND(AVG(months), 2) AS avg_customer_lifespan_months, RND(AVG(monthly), 2) AS avg_monthly_revenue
    FROM unit_customers GROUP BY {name}, {region}"""


relation("m_unit_economics", " UNION ALL ".join([
    _segments("RFM Segment", "rfm_segment", "NULL"),
    _segments("State", "customer_state", "customer_region"),
    _segments("Region", "customer_region", "NULL"),
    _segments("Cohort", "cohort", "NULL"),
]))
