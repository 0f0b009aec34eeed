"""Reads an order star schema (region, nation, customer, supplier, part, orders, lineitem) as
the raw tables of the model.

Prices are scaled to retail size in whole cents; delivery dates and review scores are derived
from the keys, so every engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_STATUS = {"F": "delivered", "O": "invoiced", "P": "canceled"}


def _days(n):
    return F.make_dt_interval(days=n.cast("int"))


def _spot(key, i, lat_mul: int, lng_mul: int):
    """A position inside the box, spread by key and point number."""
    lat = F.lit(-30.0) + ((key * lat_mul + i * 11) % 3000).cast("double") / 100
    lng = F.lit(-70.0) + ((key * lng_mul + i * 17) % 3000).cast("double") / 100
    return lat, lng


def geolocation_points(customers: DataFrame, suppliers: DataFrame, nations: DataFrame) -> DataFrame:
    """Observed positions: one to three a customer and one a supplier, at the customer's or
    supplier's postal prefix, so that a prefix has several points and sometimes several cities.
    Some points lie outside the box, some at (0, 0), some have no prefix or an unknown state; city
    and state are written in mixed case with stray blanks."""
    key, i = F.col("k"), F.col("i")
    outside, zero = (key + i) % 23 == 0, (key * 3 + i) % 29 == 0
    lat, lng = _spot(key, i, 37, 53)
    people = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))).alias("i"),
        F.concat(F.lower("c_mktsegment"), F.lit(" do "), F.lower("n_name")).alias("_city"), "n_name",
    ).select(
        F.when((key + i) % 41 != 0, (key % 90000 + 1000).cast("int")).alias("geolocation_zip_code_prefix"),
        F.when(outside, F.lit(12.5)).when(zero, F.lit(0.0)).otherwise(lat).alias("geolocation_lat"),
        F.when(zero & ~outside, F.lit(0.0)).otherwise(lng).alias("geolocation_lng"),
        F.when(key % 5 == 0, F.concat(F.lit("  "), F.col("_city"), F.lit(" "))).otherwise(F.col("_city"))
        .alias("geolocation_city"),
        F.when(key % 31 == 0, F.lit("XX")).when(key % 4 == 0, F.concat(F.lit("  "), F.lower("n_name")))
        .otherwise(F.col("n_name")).alias("geolocation_state"),
    )
    lat, lng = _spot(key, F.lit(0), 41, 59)
    firms = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("k"), "n_name").select(
        (key % 90000 + 1000).cast("int").alias("geolocation_zip_code_prefix"),
        lat.alias("geolocation_lat"), lng.alias("geolocation_lng"),
        F.concat(F.lit("porto "), F.lower("n_name")).alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )
    return people.unionByName(firms)


def postal_directory(customers: DataFrame, nations: DataFrame) -> DataFrame:
    """The official directory: two postal codes for every third customer's prefix, so that most
    prefixes are missing; some entries lack a state or lie outside the box."""
    key, j = F.col("k"), F.col("j")
    prefix = (key % 90000 + 1000).cast("string")
    return customers.where(F.col("c_custkey") % 3 == 0).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("k"), "c_mktsegment", "n_name",
             F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select(
        F.concat(F.lpad(prefix, 5, "0"), F.lpad(((key * 7 + j) % 1000).cast("string"), 3, "0")).alias("cep"),
        F.concat(F.lit("Cidade "), F.col("c_mktsegment")).alias("localidade"),
        F.when(key % 13 != 0, F.col("n_name")).alias("sigla_uf"),
        ((key % 90000 + 1000) * 7 % 100000).cast("string").alias("id_municipio"),
        (F.lit(-50.0) + ((key * 19 + j * 3) % 1000).cast("double") / 100).alias("lon"),
        F.when((key % 17 == 0) & (j == 0), F.lit(9.0))
        .otherwise(F.lit(-20.0) + ((key * 13 + j * 5) % 1000).cast("double") / 100).alias("lat"),
    )


def star_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{base}/{name}.parquet")

    places = t("nation").join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"))

    customers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        (F.col("c_custkey") % 90000 + 1000).alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )
    sellers = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"),
        (F.col("s_suppkey") % 90000 + 1000).alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.col("state").alias("seller_state"),
    )
    products = t("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_brand").alias("product_description_lenght"),
        (F.col("p_size") % 7).alias("product_photos_qty"),
        (F.col("p_size") * 2500.0).alias("product_weight_g"),
        (F.col("p_size") * 8.0).alias("product_length_cm"),
        F.col("p_size").cast("double").alias("product_height_cm"),
        (F.col("p_size") - 5.0).alias("product_width_cm"),
    )
    translation = t("part").select("p_type").distinct().select(
        F.col("p_type").alias("product_category_name"),
        F.lower("p_type").alias("product_category_name_english"),
    )

    key, buyer, bought = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    is_final = F.col("o_orderstatus") == "F"
    delivered = bought + _days(key % 37 + 8)
    orders = t("orders").select(
        key.alias("order_id"),
        buyer.alias("customer_id"),
        F.coalesce(
            *[F.when(F.col("o_orderstatus") == k, v) for k, v in ORDER_STATUS.items()]
        ).alias("order_status"),
        bought.alias("order_purchase_timestamp"),
        (bought + _days(key % 3)).alias("order_approved_at"),
        (bought + _days(F.when(key % 50 == 0, -1).otherwise(buyer % 5 + 3))).alias(
            "order_delivered_carrier_date"
        ),
        F.when(is_final, delivered).alias("order_delivered_customer_date"),
        (bought + _days(key % 11 + 25)).alias("order_estimated_delivery_date"),
    )
    reviews = t("orders").where(is_final & (key % 10 < 9)).select(
        key.alias("review_id"),
        key.alias("order_id"),
        ((key * 7 + buyer) % 5 + 1).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).alias("review_comment_message"),
        (delivered + _days(F.lit(2))).alias("review_creation_date"),
        (delivered + _days(F.lit(4))).alias("review_answer_timestamp"),
    )

    price_cents = F.expr("cast(floor(l_extendedprice * 100 + 0.5) as bigint) div 500")
    tax = F.floor(F.col("l_tax") * 100 + F.lit(0.5))
    lines = t("lineitem").withColumn("_pc", price_cents).withColumn("_tax", tax).withColumn(
        "_fc", F.expr("(_pc * _tax) div 100")
    )
    items = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        (F.col("_pc") / 100.0).alias("price"),
        (F.col("_fc") / 100.0).alias("freight_value"),
    )
    payments = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(F.col("l_returnflag") == "R", "credit_card")
        .when(F.col("l_returnflag") == "A", "boleto")
        .when(F.col("l_linestatus") == "F", "debit_card")
        .otherwise("voucher")
        .alias("payment_type"),
        (F.col("l_quantity").cast("bigint") % 12 + 1).alias("payment_installments"),
        ((F.col("_pc") + F.col("_fc")) / 100.0).alias("payment_value"),
    )
    nations = t("nation").select("n_nationkey", "n_name")
    return {
        "geolocation": geolocation_points(t("customer"), t("supplier"), nations),
        "postal_directory": postal_directory(t("customer"), nations),
        "events": t("events").select("user_id", "ts"),
        "regions": places.select("state", "region"),
        "customers": customers,
        "sellers": sellers,
        "products": products,
        "category_translation": translation,
        "orders": orders,
        "order_items": items,
        "payments": payments,
        "reviews": reviews,
    }


def reviews_export(reviews: DataFrame) -> DataFrame:
    """Raw reviews as the text a CSV export holds, with the faults such exports have: comments with
    line breaks, quotes and commas (every third review), a score that is a word (review ids divisible
    by 97), a date that is not one (by 89) and a missing review id (by 83)."""
    key = F.col("review_id")
    stamp = "yyyy-MM-dd HH:mm:ss"
    return reviews.select(
        F.when(key % 83 != 0, key.cast("string")).alias("review_id"),
        F.col("order_id").cast("string").alias("order_id"),
        F.when(key % 97 == 0, F.lit("five")).otherwise(F.col("review_score").cast("string")).alias("review_score"),
        F.col("review_comment_title"),
        F.when(key % 3 == 0, F.concat(F.col("review_comment_message"), F.lit('\n"noted", twice')))
        .otherwise(F.col("review_comment_message")).alias("review_comment_message"),
        F.when(key % 89 == 0, F.lit("soon")).otherwise(F.date_format("review_creation_date", stamp))
        .alias("review_creation_date"),
        F.date_format("review_answer_timestamp", stamp).alias("review_answer_timestamp"),
    )
