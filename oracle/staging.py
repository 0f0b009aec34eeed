"""Raw model tables from the star schema, and the eight staging tables."""

from oracle.core import AS_OF, relation

relation("places", """
SELECT n_nationkey, n_name AS state, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey""")

relation("s_customers", """
SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id,
       CAST(1000 + c_custkey % 90000 AS VARCHAR) AS customer_zip_code_prefix,
       upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS customer_city,
       upper(state) AS customer_state, region AS customer_region
FROM customer JOIN places ON c_nationkey = n_nationkey""")

relation("s_sellers", """
SELECT s_suppkey AS seller_id, CAST(1000 + s_suppkey % 90000 AS VARCHAR) AS seller_zip_code_prefix,
       upper(s_name[1]) || lower(s_name[2:]) AS seller_city,
       upper(state) AS seller_state, region AS seller_region
FROM supplier JOIN places ON s_nationkey = n_nationkey""")

relation("s_products", """
SELECT p_partkey AS product_id, lower(p_type) AS product_category_name,
       lower(p_type) AS product_category_name_english,
       length(p_name) AS product_name_lenght, length(p_brand) AS product_description_lenght,
       p_size % 7 AS product_photos_qty,
       CASE WHEN p_size * 2500 BETWEEN 1 AND 100000 THEN CAST(p_size * 2500 AS DOUBLE) END
           AS product_weight_g,
       CASE WHEN p_size * 8 BETWEEN 1 AND 300 THEN CAST(p_size * 8 AS DOUBLE) END AS product_length_cm,
       CASE WHEN p_size BETWEEN 1 AND 300 THEN CAST(p_size AS DOUBLE) END AS product_height_cm,
       CASE WHEN p_size - 5 BETWEEN 1 AND 300 THEN CAST(p_size - 5 AS DOUBLE) END AS product_width_cm
FROM part""")

relation("dated_orders", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'invoiced' ELSE 'canceled' END
           AS order_status,
       o_orderdate AS order_purchase_timestamp,
       o_orderdate + to_days(CAST(o_orderkey % 3 AS INT)) AS order_approved_at,
       o_orderdate + to_days(CAST(CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE 3 + o_custkey % 5 END
                                  AS INT)) AS order_delivered_carrier_date,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(8 + o_orderkey % 37 AS INT)) END
           AS order_delivered_customer_date,
       o_orderdate + to_days(CAST(25 + o_orderkey % 11 AS INT)) AS order_estimated_delivery_date,
       o_orderpriority
FROM orders""")

relation("s_orders", f"""
SELECT * EXCLUDE (o_orderpriority), order_status = 'delivered' AS is_delivered,
       order_status <> 'canceled' AS is_completed, order_status = 'canceled' AS is_canceled
FROM dated_orders
WHERE order_purchase_timestamp < {AS_OF} + INTERVAL 1 DAY
  AND order_approved_at >= order_purchase_timestamp
  AND order_delivered_carrier_date >= order_approved_at
  AND (order_delivered_customer_date IS NULL
       OR order_delivered_customer_date >= order_delivered_carrier_date)
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY order_purchase_timestamp, customer_id) = 1""")

relation("priced_lines", """
SELECT *, pc * CAST(round(l_tax * 100) AS BIGINT) // 100 AS fc
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) // 500 AS pc FROM lineitem)
WHERE l_orderkey IN (SELECT order_id FROM s_orders)""")

relation("s_order_items", """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
       l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, pc / 100.0 AS price,
       fc / 100.0 AS freight_value, (pc + fc) / 100.0 AS total_item_value
FROM priced_lines
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate NULLS FIRST, l_partkey, l_suppkey, pc, fc) = 1""")

relation("s_payments", """
SELECT *, payment_type = 'credit_card' AS is_credit_card, payment_type = 'boleto' AS is_boleto
FROM (SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
             CASE WHEN l_returnflag = 'R' THEN 'credit_card' WHEN l_returnflag = 'A' THEN 'boleto'
                  WHEN l_linestatus = 'F' THEN 'debit_card' ELSE 'voucher' END AS payment_type,
             1 + CAST(trunc(l_quantity) AS BIGINT) % 12 AS payment_installments,
             (pc + fc) / 100.0 AS payment_value
      FROM priced_lines WHERE pc + fc > 0)
QUALIFY row_number() OVER (PARTITION BY order_id, payment_sequential
    ORDER BY payment_value DESC, payment_type, payment_installments) = 1""")

relation("s_reviews", """
SELECT d.order_id AS review_id, d.order_id, 1 + (7 * d.order_id + d.customer_id) % 5 AS review_score,
       CAST(NULL AS VARCHAR) AS review_comment_title,
       CASE WHEN d.order_id % 3 = 0 THEN trim(d.o_orderpriority) END AS review_comment_message,
       d.order_delivered_customer_date + INTERVAL 2 DAY AS review_creation_date,
       d.order_delivered_customer_date + INTERVAL 4 DAY AS review_answer_timestamp,
       d.order_id % 3 = 0 AS has_comment
FROM dated_orders d SEMI JOIN s_orders s ON d.order_id = s.order_id
WHERE d.order_delivered_customer_date IS NOT NULL AND d.order_id % 10 < 9""")

relation("raw_geolocation", """
WITH people AS (
  SELECT c_custkey AS k, i, lower(c_mktsegment) || ' do ' || lower(n_name) AS city, n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey, range(3) r(i) WHERE i <= c_custkey % 3
)
SELECT CASE WHEN (k + i) % 41 <> 0 THEN CAST(k % 90000 + 1000 AS INTEGER) END AS geolocation_zip_code_prefix,
       CASE WHEN (k + i) % 23 = 0 THEN 12.5 WHEN (3 * k + i) % 29 = 0 THEN 0.0
            ELSE -30.0 + CAST((k * 37 + i * 11) % 3000 AS DOUBLE) / 100 END AS geolocation_lat,
       CASE WHEN (3 * k + i) % 29 = 0 AND (k + i) % 23 <> 0 THEN 0.0
            ELSE -70.0 + CAST((k * 53 + i * 17) % 3000 AS DOUBLE) / 100 END AS geolocation_lng,
       CASE WHEN k % 5 = 0 THEN '  ' || city || ' ' ELSE city END AS geolocation_city,
       CASE WHEN k % 31 = 0 THEN 'XX' WHEN k % 4 = 0 THEN '  ' || lower(n_name) ELSE n_name END AS geolocation_state
FROM people
UNION ALL
SELECT CAST(s_suppkey % 90000 + 1000 AS INTEGER), -30.0 + CAST((s_suppkey * 41) % 3000 AS DOUBLE) / 100,
       -70.0 + CAST((s_suppkey * 59) % 3000 AS DOUBLE) / 100, 'porto ' || lower(n_name), n_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")

relation("raw_directory", """
SELECT lpad(CAST(c_custkey % 90000 + 1000 AS VARCHAR), 5, '0') || lpad(CAST((c_custkey * 7 + j) % 1000 AS VARCHAR), 3, '0') AS cep,
       'Cidade ' || c_mktsegment AS localidade,
       CASE WHEN c_custkey % 13 <> 0 THEN n_name END AS sigla_uf,
       CAST((c_custkey % 90000 + 1000) * 7 % 100000 AS VARCHAR) AS id_municipio,
       -50.0 + CAST((c_custkey * 19 + j * 3) % 1000 AS DOUBLE) / 100 AS lon,
       CASE WHEN c_custkey % 17 = 0 AND j = 0 THEN 9.0 ELSE -20.0 + CAST((c_custkey * 13 + j * 5) % 1000 AS DOUBLE) / 100 END AS lat
FROM customer JOIN nation ON c_nationkey = n_nationkey, range(2) r(j) WHERE c_custkey % 3 = 0""")

relation("s_geolocation", """
WITH seen AS (
  SELECT lpad(CAST(geolocation_zip_code_prefix AS VARCHAR), 5, '0') AS zip,
         trim(array_to_string(list_transform(string_split(lower(geolocation_city), ' '),
                                             lambda w: upper(w[1:1]) || w[2:]), ' ')) AS city,
         upper(trim(geolocation_state)) AS state, geolocation_lat AS lat, geolocation_lng AS lng
  FROM raw_geolocation
  WHERE geolocation_zip_code_prefix IS NOT NULL
    AND geolocation_lat BETWEEN -34 AND 5 AND geolocation_lng BETWEEN -74 AND -34
    AND NOT (geolocation_lat = 0 AND geolocation_lng = 0)
    AND upper(trim(geolocation_state)) IN (SELECT state FROM places)
), med AS (
  SELECT zip, city, state, quantile_disc(lat, 0.5) AS lat, quantile_disc(lng, 0.5) AS lng
  FROM seen GROUP BY zip, city, state
), dir AS (
  SELECT substr(cep, 1, 5) AS zip, localidade, sigla_uf, id_municipio, lat, lon
  FROM raw_directory
  WHERE cep IS NOT NULL AND sigla_uf IS NOT NULL AND lat BETWEEN -34 AND 5 AND lon BETWEEN -74 AND -34
  QUALIFY row_number() OVER (PARTITION BY substr(cep, 1, 5) ORDER BY cep, localidade, sigla_uf, id_municipio, lat, lon) = 1
), chosen AS (
  SELECT m.zip AS geolocation_zip_code_prefix, coalesce(d.localidade, m.city) AS geolocation_city,
         coalesce(d.sigla_uf, m.state) AS geolocation_state, coalesce(d.lat, m.lat) AS geolocation_lat,
         coalesce(d.lon, m.lng) AS geolocation_lng, d.id_municipio AS municipality_id,
         CASE WHEN d.localidade IS NOT NULL THEN 'directory' ELSE 'observed' END AS data_source
  FROM med m LEFT JOIN dir d ON m.zip = d.zip
)
SELECT c.*, coalesce(p.region, 'Desconhecido') AS geolocation_region
FROM chosen c LEFT JOIN places p ON c.geolocation_state = p.state
QUALIFY row_number() OVER (PARTITION BY geolocation_zip_code_prefix
    ORDER BY data_source <> 'directory', geolocation_state, geolocation_city, geolocation_lat, geolocation_lng) = 1""")

STAGING = {
    f"stg_{name}": f"SELECT * FROM s_{name}"
    for name in ("customers", "sellers", "products", "geolocation", "orders", "order_items", "payments", "reviews")
}
STAGING |= {
    "geolocation_source_coverage": "SELECT data_source, COUNT(*) AS total_zips, SHARE() AS pct FROM s_geolocation GROUP BY 1",
    "geolocation_region_coverage":
        "SELECT geolocation_region, COUNT(*) AS total_zips, SHARE() AS pct FROM s_geolocation GROUP BY 1",
    "geolocation_validity": """SELECT COUNT(*) AS total_zips,
        YES(geolocation_lat BETWEEN -34 AND 5 AND geolocation_lng BETWEEN -74 AND -34) AS valid_zips,
        RATE(geolocation_lat BETWEEN -34 AND 5 AND geolocation_lng BETWEEN -74 AND -34) AS pct_valid
        FROM s_geolocation""",
}


relation("raw_reviews", """
SELECT o_orderkey AS k, 1 + (7 * o_orderkey + o_custkey) % 5 AS review_score,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || chr(10) || '"noted", twice' END AS review_comment_message,
       o_orderdate + to_days(CAST(8 + o_orderkey % 37 + 2 AS INT)) AS review_creation_date,
       o_orderdate + to_days(CAST(8 + o_orderkey % 37 + 4 AS INT)) AS review_answer_timestamp
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 < 9""")

STAGING |= {
    "raw_reviews_csv_rows": """SELECT CAST(k AS VARCHAR) AS review_id, CAST(k AS VARCHAR) AS order_id,
        CAST(review_score AS INTEGER) AS review_score, CAST(NULL AS VARCHAR) AS review_comment_title,
        review_comment_message, review_creation_date, review_answer_timestamp
        FROM raw_reviews WHERE k % 83 <> 0 AND k % 97 <> 0 AND k % 89 <> 0""",
    "raw_reviews_csv_rejects": """SELECT CASE WHEN k % 83 <> 0 THEN CAST(k AS VARCHAR) END AS key,
        CASE WHEN k % 83 = 0 THEN 'review_id: missing' WHEN k % 97 = 0 THEN 'review_score: not int: five'
             ELSE 'review_creation_date: not timestamp_ntz: soon' END AS reason,
        concat_ws(',', CASE WHEN k % 83 <> 0 THEN CAST(k AS VARCHAR) ELSE '' END, CAST(k AS VARCHAR),
            CASE WHEN k % 97 = 0 THEN 'five' ELSE CAST(review_score AS VARCHAR) END, '',
            coalesce(review_comment_message, ''),
            CASE WHEN k % 89 = 0 THEN 'soon' ELSE strftime(review_creation_date, '%Y-%m-%d %H:%M:%S') END,
            strftime(review_answer_timestamp, '%Y-%m-%d %H:%M:%S')) AS record
        FROM raw_reviews WHERE k % 83 = 0 OR k % 97 = 0 OR k % 89 = 0""",
}
